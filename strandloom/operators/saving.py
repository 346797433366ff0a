"""Tables kept between the steps of a long plan."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: What each scratch() that is open in this thread deletes at its end.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("strandloom_saved", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Tables saved inside are deleted at the end, by threads apart from each other: what is made of them is written
    inside, not read later. Without it they stay until the shared folder is cleared."""
    made: list[str] = []
    before = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(before)
        for path in made:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share (spark.checkpoint.dir). Only a local session may have no
    such folder set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    Steps that use a table several times then share its rows, and a lost executor costs one step.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
