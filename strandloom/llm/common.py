"""What the operators of this subpackage share: words, staged tables, components of a graph."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Separators of words: space and the ASCII control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
_LOCAL: dict[str, str] = {}
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("strandloom_staged", default=())
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer pieces than there are cores (a single small file) is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one gets a folder of its own; elsewhere
    the executors could not see each other's files, so the setting is demanded.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share; intermediate tables need one")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        path = _LOCAL[app]
    return path.rstrip("/")


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, a lost executor costs nothing done so far.

    The shuffle files of the write are dropped as soon as it is done, the table itself at the end of the scratch() that
    it was made in, if any; with `keep` at the end of the one around that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    around = _OPEN.get()[:-1] if keep else _OPEN.get()
    if around:
        around[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(df: DataFrame) -> None:
    """Deletes what staged() has written for this table, before its scratch() ends: nothing may read it any more."""
    if getattr(df, "staged_at", None):
        _delete(df.sparkSession, df.staged_at)


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are deleted at the end, but for those kept: nothing made inside may be read lazily after it.
    Each thread has its own."""
    made: list[str] = []
    before = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(before)
        for path in made:
            _delete(spark, path)


def with_fields(df: DataFrame, more: str) -> StructType:
    """The schema of a table, whatever its columns are called, and further fields (DDL)."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def told_apart(columns) -> Column:
    """A digest that orders rows which agree in all else: the choice among them is the same on every run."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def numbered(df: DataFrame, order, out: str, parts: int | None = None) -> DataFrame:
    """Adds `out`: places 0.. in an order without ties. Ranges are numbered apart from each other; only their sizes, a
    row a range, meet in one task.
    """
    parts = parts or min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // 50_000 + 1)
    dealt = staged(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    begins = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.withColumn("_place", place).join(begins, "_range").withColumn(out, F.col("_begin") + F.col("_place")).drop("_range", "_place", "_begin")


def packed(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, and all others in one struct `_rest`: whatever they are called, they clash with nothing."""
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in names]
    return df.select(*names, (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """The columns as they were before packed(), in their order."""
    return df.select(*[F.col(c) if c in names else F.col("_rest").getField(c).alias(c) for c in columns])


class HashMemo(dict):
    """Word (bytes) -> 64-bit hash; emptied when full, so that a worker's memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        import xxhash

        self.limit, self.digest = limit, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.digest(word)
        return value

    def array(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive values, order counts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def _forest(batches):
    """Edges of one partition -> an edge from each vertex to the least vertex that the partition links it with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in root]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i : i + 50_000]
        yield pa.record_batch([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["v", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    edges: two long columns. Returns v, root: for every vertex with a link to a smaller one, the least vertex that it
    can reach. Each partition first shrinks to a spanning forest; large and small stars then alternate on staged tables
    until every edge points at a root (their number of rounds grows with the logarithm of the size).
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("v"), F.col(b).alias("root")).where("v != root")
    now = staged(now.mapInArrow(_forest, "v long, root long").distinct(), "edges")
    while True:
        open_ends = now.select("v").join(now.select(F.col("root").alias("v")), "v", "left_semi").limit(1).count()
        twice = 0 if open_ends else now.groupBy("v").count().where("count > 1").limit(1).count()
        if not (open_ends or twice):
            return now
        both = now.union(now.select("root", "v"))
        least = both.groupBy("v").agg(F.least(F.min("root"), F.col("v")).alias("m"))
        now = both.join(least, "v").where("root > v").select(F.col("root").alias("v"), F.col("m").alias("root"))  # large star
        now = now.union(least.select("v", "m")).where("v != root").distinct()
        least = now.groupBy("v").agg(F.min("root").alias("m"))
        now = now.join(least, "v").select(F.col("root").alias("v"), F.col("m").alias("root")).union(least.select("v", "m"))  # small star
        now = staged(now.where("v != root").mapInArrow(_forest, "v long, root long").distinct(), "edges")
