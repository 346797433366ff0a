"""Per-read work on hits: bounded lists, clusters, ranks and qualities.

hits: read_id, contig_id, pos, strand, ed and more columns. Orders end in every column that tells rows apart, so
results do not depend on how rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.scores import mapping_quality


def ranked(df: DataFrame, keys: list[str], order: list, limit: int | None = None, name: str = "nth") -> DataFrame:
    """Row numbers in each group; with a limit Spark keeps no more than so many rows before the shuffle already."""
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return df if limit is None else df.where(F.col(name) <= limit)


def top_candidates(hits: DataFrame, limit: int = 1024) -> DataFrame:
    """A read's candidates of least penalty, then position."""
    return ranked(hits, ["read_id"], ["penalty", "pos", "contig_id", "strand"], limit)


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One hit a place: that with the fewest errors."""
    return ranked(hits, ["read_id", "contig_id", "pos"], ["ed", "strand"], 1).drop("nth")


def clusters_from_previous(hits: DataFrame, distance: int = 12) -> DataFrame:
    """Hits of a read and contig no further than `distance` from the hit before are one; the best of each stays.

    All windows go by one order, so a task sorts its rows once: the best so far of the last cluster is a running
    minimum (clusters count down), and that of a cluster's last row stays. Hits without errors told come last.
    """
    by_pos = Window.partitionBy("read_id", "contig_id").orderBy("pos", "ed", "strand")
    so_far = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col("pos") - F.lag("pos").over(by_pos)
    columns, first = hits.columns, ["ed", "pos", "strand"]
    rest = [c for c in columns if c not in ("read_id", "contig_id", *first)]
    hits = hits.withColumn("_new", F.when(gap.isNull() | (gap > distance), 1).otherwise(0)).withColumn("_cluster", -F.sum("_new").over(so_far))
    nulls_last = [x for c in first for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    best = F.min(F.struct("_cluster", *nulls_last, *rest)).over(so_far)
    last = F.coalesce(F.lead("_new").over(by_pos), F.lit(1)) == 1
    told = hits.select("read_id", "contig_id", best.alias("_best"), last.alias("_last")).where("_last")
    return told.select(*[F.col(c) if c in ("read_id", "contig_id") else F.col("_best").getField(c).alias(c) for c in columns])


def clusters_from_first(hits: DataFrame, distance: int = 12) -> DataFrame:
    """The same with the distance measured from a cluster's first hit: a fold over a read's sorted hits in a contig.

    The list folded is one read's hits in one contig, which top_candidates() bounds.
    """
    item = F.struct("pos", "ed", "strand")
    lists = hits.groupBy("read_id", "contig_id").agg(F.array_sort(F.collect_list(item)).alias("hits"))
    pick = "struct<pos:bigint,ed:bigint,strand:string>"
    start = F.expr(f"struct(cast(null as bigint) as first, cast(array() as array<{pick}>) as kept)")

    def step(acc: Column, x: Column) -> Column:
        joins = acc["first"].isNotNull() & (x["pos"] - acc["first"] <= distance)
        last = F.element_at(acc["kept"], -1)
        better = F.when(x["ed"] < last["ed"], x).otherwise(last)
        kept = F.when(joins, F.concat(F.slice(acc["kept"], F.lit(1), F.greatest(F.size(acc["kept"]) - 1, F.lit(0))), F.array(better))).otherwise(F.concat(acc["kept"], F.array(x)))
        return F.struct(F.when(joins, acc["first"]).otherwise(x["pos"]).alias("first"), kept.alias("kept"))

    folded = lists.select("read_id", "contig_id", F.explode(F.aggregate("hits", start, step)["kept"]).alias("x"))
    return folded.select("read_id", "contig_id", "x.pos", "x.ed", "x.strand")


def best_error(hits: DataFrame) -> DataFrame:
    return hits.groupBy("read_id").agg(F.min("ed").alias("best_ed"), F.count(F.lit(1)).alias("n_hits"))


def qualities(hits: DataFrame) -> DataFrame:
    """read_id, best and second score, places with each, and the mapping quality (hits: score, contig_id, pos)."""
    level = F.dense_rank().over(Window.partitionBy("read_id").orderBy(F.col("score").desc()))
    places = hits.withColumn("level", level).where("level <= 2").select("read_id", "level", "score", "contig_id", "pos").distinct()
    at = lambda k, column: F.max(F.when(F.col("level") == k, F.col(column)))
    count = lambda k: F.sum(F.when(F.col("level") == k, 1).otherwise(0))
    told = places.groupBy("read_id").agg(at(1, "score").alias("best"), count(1).alias("n_best"), at(2, "score").alias("second"), count(2).alias("n_second"))
    return told.withColumn("mapq", mapping_quality(F.col("n_best"), F.col("n_second"), F.col("best") - F.coalesce("second", "best")))


def tied_with_leader(hits: DataFrame, width: float = 0.5) -> DataFrame:
    """Whether each hit's score is within `width` of its read's best, and whether it stands where the hit before does."""
    order = Window.partitionBy("read_id").orderBy(F.col("score").desc(), "contig_id", "pos", "strand")
    lead = F.first("score").over(order)
    same = (F.lag("contig_id").over(order) == F.col("contig_id")) & (F.lag("pos").over(order) == F.col("pos"))
    return hits.withColumn("tied", F.col("score") > lead - width).withColumn("same_place", F.coalesce(same, F.lit(False)))


def choice_by_hash(hits: DataFrame) -> DataFrame:
    """One of a read's best hits, picked by a digest instead of by chance: reruns agree, no position is favoured."""
    digest = F.md5(F.concat_ws("|", "read_id", "contig_id", "pos", "strand"))
    return ranked(hits.withColumn("_d", digest), ["read_id"], [F.col("score").desc(), "_d"], 1).drop("nth", "_d")


def unsolved(reads: DataFrame, hits: DataFrame, stage: int) -> DataFrame:
    """Reads without a hit of so few errors: they go on to the next stage."""
    return reads.join(hits.where(F.col("ed") <= stage).select("read_id").distinct(), "read_id", "left_anti")


def with_unmapped(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Every read with its hits; one row of nulls for a read that has none."""
    return reads.join(hits, "read_id", "left")
