"""Aggregates: length histograms, prefix rollups, insert-size model, run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.seeding import CHUNK, chunks


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def length_limits(histogram: DataFrame, share: float = 0.9) -> DataFrame:
    """Longest read, and the shortest that counts: no less than so large a share of the longest."""
    top = histogram.agg(F.max("length").alias("max_length"), F.min("length").alias("least"))
    return top.select("max_length", F.greatest("least", F.floor(F.col("max_length") * share)).cast("long").alias("min_length"))


def prefix_rollup(counts: DataFrame, depth: int) -> DataFrame:
    """Counts (prefix of `depth` bases, n) for all prefixes of 0 to `depth` bases, the empty one included."""
    names = [f"b{i + 1}" for i in range(depth)]
    parts = [F.substring("prefix", i + 1, 1).alias(name) for i, name in enumerate(names)]
    told = counts.select(*parts, "n").rollup(*names).agg(F.sum("n").alias("n"))
    return told.select(F.concat_ws("", *names).alias("prefix"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dinucleotides(contigs: DataFrame) -> DataFrame:
    """Counts of the sixteen pairs of neighbouring bases in each contig; zeros for one without any."""
    pairs = [a + b for a in "ACGT" for b in "ACGT"]
    own = F.substring("seq", F.lit(1), F.least(F.length("seq"), F.lit(CHUNK + 1)))  # a pair that spans two chunks counts in the first
    # a pair is counted by how much shorter the chunk gets without its first bases; the second one is only looked at
    count = lambda p: ((F.length("own") - F.length(F.regexp_replace("own", f"{p[0]}(?={p[1]})", "")))).cast("long")
    parts = chunks(contigs).select("contig_id", own.alias("own")).groupBy("contig_id").agg(*[F.sum(count(p)).alias(p) for p in pairs])
    told = contigs.select("contig_id").join(parts, "contig_id", "left")
    return told.select("contig_id", *[F.coalesce(p, F.lit(0)).cast("long").alias(p.lower()) for p in pairs])


def histogram_distance(a: Column, b: Column) -> Column:
    """L1 distance of two count arrays; one edit changes it by no more than 4."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def insert_model(pairs: DataFrame, groups: list[str], longest: float = 1000) -> DataFrame:
    """Mean, deviation and number of insert sizes by group; without a sample the prior (half and an eighth of the most)."""
    ok = F.when(F.col("insert_size").between(0, longest), F.col("insert_size"))
    told = pairs.groupBy(*groups).agg(F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("dev"), F.count(ok).alias("n"))
    return told.select(*groups, F.coalesce("mean", F.lit(longest / 2)).alias("mean"), F.coalesce("dev", F.lit(longest / 8)).alias("dev"), "n")


def run_statistics(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Sum, count, whole average, upper median, least and most by name."""
    told = rows.groupBy(name).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)").alias("median"))
    return told.withColumn("average", F.floor(F.col("total") / F.col("n")))


def error_histogram(hits: DataFrame, most: int = 49) -> DataFrame:
    return hits.groupBy(F.least("ed", F.lit(most)).cast("long").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def methods(hits: DataFrame, method: str = "method") -> DataFrame:
    """How many hits each method found, with their least, mean and most errors."""
    return hits.groupBy(F.col(method).alias("method")).agg(F.count(F.lit(1)).alias("n"), F.min("ed").alias("least"), F.avg("ed").alias("mean"), F.max("ed").alias("most"))


def unknown_bases(reads: DataFrame, most: int = 50) -> DataFrame:
    """Reads by how many of their bases are unknown; `most` and more are one."""
    n = F.length("seq") - F.length(F.translate("seq", "N", ""))
    return reads.groupBy(F.least(n, F.lit(most)).cast("long").alias("unknown")).agg(F.count(F.lit(1)).alias("n"))
