"""Positions on a concatenated reference: offsets, as-of lookup, overlap with variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.saving import saved

#: Symbols between contigs and before the first one.
SEPARATOR, BOUNDARY = 1536, 10240


def offsets(contigs: DataFrame, separator: int = SEPARATOR, boundary: int = BOUNDARY, parts: int | None = None) -> DataFrame:
    """contig_id, size -> and `begin`, its place on the concatenated reference.

    Contigs are dealt to ranges of their ids; each range adds up its own sizes, and only the ranges' sums, a row each,
    meet in one task. Many rows of one id share a range.
    """
    parts = parts or int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(contigs.repartitionByRange(parts, "contig_id").withColumn("_range", F.spark_partition_id()), "ranges")
    taken = F.col("size") + separator
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum(taken).alias("_n"))
    firsts = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_range").orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)
    told = dealt.join(firsts, "_range").withColumn("begin", (F.lit(boundary) + F.col("_first") + F.coalesce(F.sum(taken).over(within), F.lit(0))).cast("long"))
    return told.drop("_range", "_first")


def translated(pos, n_initial: Column) -> Column:
    """A 1-based position on a contig without the Ns at its start -> on the contig as the file has it."""
    return pos + n_initial


def on_contigs(variants: DataFrame, contigs: DataFrame) -> DataFrame:
    """vcf() rows (chrom, pos) -> and contig_id, pos without the Ns at the start (contigs: contig_id, name, n_initial).

    Names are cut at the first blank; variants of other contigs, or among the Ns, go. Contigs are a small table, which
    Spark broadcasts by its own measure.
    """
    names = contigs.select("contig_id", "n_initial", F.split("name", "\\s", 2)[0].alias("chrom"))
    placed = variants.join(names, "chrom").withColumn("pos", F.col("pos") - F.col("n_initial"))
    return placed.where("pos >= 1").drop("chrom", "n_initial")


def located(places: DataFrame, contigs: DataFrame, width: int = 1 << 16, separator: int = SEPARATOR) -> DataFrame:
    """raw -> contig_id and pos (1-based) of the last contig that begins no later, half a separator of slack allowed.

    An as-of join without sorting all rows: contigs are listed in every bucket that they and their slack cover, and a
    place meets the few contigs of its own bucket.
    """
    slack = separator // 2
    low, high = F.col("begin") - slack, F.col("begin") + F.col("size") + separator - slack - 1
    listed = contigs.select("contig_id", "begin", low.alias("low"), high.alias("high"), F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("bucket"))
    placed = places.withColumn("bucket", F.floor(F.col("raw") / width)).join(listed, "bucket").where(F.col("raw").between(F.col("low"), F.col("high")))
    return placed.withColumn("pos", F.col("raw") - F.col("begin") + 1).drop("bucket", "begin", "low", "high")


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals (first, last; both ends in) of a key that overlap.

    Both sides are dealt to buckets of `width`; a pair counts in the bucket where the later of the two begins, so it
    comes out once. Buckets keep a dense key from becoming a cross product.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    right = right.withColumnsRenamed({"first": "_first", "last": "_last"})
    both = left.withColumn("_cell", cells("first", "last")).join(right.withColumn("_cell", cells("_first", "_last")), [key, "_cell"])
    meets = (F.col("first") <= F.col("_last")) & (F.col("_first") <= F.col("last")) & (F.col("_cell") == F.floor(F.greatest("first", "_first") / width))
    return both.where(meets).drop("_cell")

