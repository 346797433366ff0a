"""Tables of variants, clustered by place: ranges read few files and row groups, and references are masked with them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandloom.operators import seeding

#: Bases of a cell, cells of a folder (a folder holds neighbours, so that a genome has thousands of them, not millions).
CELL, FOLDER = 1 << 16, 1 << 8
#: Bytes of a row group: a range reads no more than the groups that its places touch.
GROUP = 1 << 20
_MADE = ("cell", "part")


def _cell(pos, size: int):
    return F.floor(pos / size).cast("long")


def write(variants: DataFrame, path: str, cell: int = CELL) -> None:
    """variants (contig_id, pos, and typed columns) -> Parquet in folders by a number of contig and cells, sorted by place.

    The width of a cell is kept with the table. Each task writes neighbouring places, so no folder has many files.
    """
    placed = variants.withColumn("cell", _cell(F.col("pos"), cell)).withColumn("part", F.pmod(F.xxhash64("contig_id", F.floor(F.col("cell") / FOLDER)), F.lit(4096)).cast("int"))
    width = F.lit(cell).alias("width")
    placed.select("*", width).repartitionByRange("part", "contig_id", "pos").sortWithinPartitions("part", "contig_id", "pos").write.option("parquet.block.size", GROUP).partitionBy("part").parquet(path)


def within(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """Ranges (contig_id, first, last, both ends in) with the variants in them.

    Ranges are listed in the cells that they touch; folders and row groups of other cells are not read: the folders of
    the ranges prune the scan when it starts, places prune its row groups. No variant meets a range twice.
    """
    table = spark.read.parquet(path)
    head = table.select("width").limit(1).first()
    size = head["width"] if head else CELL
    bounds = ranges.agg(F.min("first"), F.max("last")).first()  # a row
    near = table.where(F.col("pos").between(bounds[0], bounds[1])) if bounds[0] is not None else table.limit(0)
    cells = F.explode(F.sequence(_cell(F.col("first"), size), _cell(F.col("last"), size)))
    asked = ranges.where("first <= last").withColumn("cell", cells).withColumn("part", F.pmod(F.xxhash64("contig_id", F.floor(F.col("cell") / FOLDER)), F.lit(4096)).cast("int"))
    met = near.drop("width").join(asked, ["part", "contig_id", "cell"]).where(F.col("pos").between(F.col("first"), F.col("last")))
    return met.drop(*_MADE)


@F.pandas_udf(StringType())
def _with_n(seq: pd.Series, places: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(seq, places, strict=True):
        if found is not None and len(found):
            now = bytearray(text.encode("latin-1", "replace"))
            for i in found:
                now[i] = 78  # N
            text = now.decode("latin-1")
        out.append(text)
    return pd.Series(out)


def masked(contigs: DataFrame, variants: DataFrame) -> DataFrame:
    """contig_id, seq with N for every base that a variant (contig_id, pos, 1-based) changes; places beyond a contig's ends
    have no effect. Contigs that were cut as they were read stay cut; whole ones are masked chunk by chunk and joined.
    """
    cut = "chunk" in contigs.columns
    pieces = contigs if cut else seeding.chunks(contigs, overlap=0)
    reach = seeding.CHUNK + (seeding.OVERLAP if cut else 0)
    chunk = F.floor((F.col("pos") - 1) / seeding.CHUNK)
    # a place in the overlap stands in the chunk before, too
    at = F.explode(F.sequence(F.greatest(F.floor((F.col("pos") - 1 - reach) / seeding.CHUNK) + 1, F.lit(0)), chunk))
    places = variants.where("pos >= 1").select("contig_id", at.alias("chunk"), "pos").distinct()
    places = places.groupBy("contig_id", "chunk").agg(F.array_sort(F.collect_set((F.col("pos") - 1 - F.col("chunk") * seeding.CHUNK).cast("int"))).alias("places"))  # no more than a chunk has bases
    told = pieces.join(places, ["contig_id", "chunk"], "left").withColumn("seq", _with_n("seq", F.filter("places", lambda i: i < F.length("seq")))).drop("places")
    if cut:
        return told
    return told.groupBy("contig_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("seq"))
