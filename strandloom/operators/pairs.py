"""Mates: pairs by distance, their scores, and the fallback from sure pairs to single hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.scores import insert_penalty, insert_size, mapping_quality
from strandloom.operators.hits import ranked
from strandloom.operators.stats import insert_model
from strandloom.plans.config import AlignConfig

#: Insert sizes that a model of them needs.
SAMPLES = 100
_SIDE = ("contig_id", "strand", "pos", "ed", "score", "length")


def mates(hits: DataFrame) -> DataFrame:
    """Hits of mate 0 beside those of mate 1 on the same contig and the other strand (pair_id, mate in hits).

    An equi-join on pair and contig: its groups are one pair's hits, which the list bound keeps small.
    """
    side = lambda mate: hits.where(F.col("mate") == mate).select("pair_id", *[F.col(c).alias(f"{c}{mate + 1}") for c in _SIDE])
    both = side(0).join(side(1).withColumnRenamed("contig_id2", "_c").withColumnRenamed("pair_id", "_p"), (F.col("pair_id") == F.col("_p")) & (F.col("contig_id1") == F.col("_c")) & (F.col("strand1") != F.col("strand2")))
    size = insert_size(F.col("contig_id1"), F.col("strand1"), F.col("pos1"), F.col("length1"), F.col("_c"), F.col("strand2"), F.col("pos2"), F.col("length2"))
    return both.withColumn("insert_size", size).withColumnRenamed("contig_id1", "contig_id").drop("_c", "_p")


def insert_sizes(every: DataFrame, longest: float = 1000) -> tuple[float, float]:
    """Mean and deviation of the insert sizes of mates(): a sample for each read pair whose places, however many, all have
    the same size, so copies of a contig neither add samples nor take them away. With fewer than SAMPLES of them the
    prior (half and an eighth of the most). One row is collected."""
    sizes = every.where(F.col("insert_size").between(0, longest)).groupBy("pair_id").agg(F.min("insert_size").alias("insert_size"), F.max("insert_size").alias("_most"))
    model = insert_model(sizes.where("insert_size = _most").withColumn("all", F.lit(1)), ["all"], longest).first()
    return (model["mean"], max(model["dev"], 1.0)) if model and model["n"] >= SAMPLES else (longest / 2, longest / 8)


def of_known_size(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs whose places are as far apart as is known of them (sizes: pair_id, insert_size)."""
    return pairs.join(sizes, ["pair_id", "insert_size"], "left_semi")


def close_pairs(hits: DataFrame, mean: float, dev: float, sigmas: float = 4) -> DataFrame:
    return mates(hits).where(F.abs(F.col("insert_size") - mean) <= sigmas * dev)


def as_good_as_alone(pairs: DataFrame, hits: DataFrame, errors: int) -> DataFrame:
    """All or nothing: pairs stay only where both mates have as few errors as their best hits (hits: read_id, mate,
    pair_id, ed), and where the better mate's best is within the bound."""
    best = hits.groupBy("pair_id").agg(*[F.min(F.when(F.col("mate") == m, F.col("ed"))).alias(f"_best{m + 1}") for m in (0, 1)])
    kept = pairs.join(best, "pair_id").where((F.col("ed1") == F.col("_best1")) & (F.col("ed2") == F.col("_best2")) & (F.least("_best1", "_best2") <= errors))
    return kept.drop("_best1", "_best2")


def hopeful(pairs_of: DataFrame, hits: DataFrame, limit: int = 1024) -> DataFrame:
    """Pairs of reads worth a further search: not those of which both mates have more than half of `limit` hits."""
    many = hits.groupBy("pair_id").agg(*[F.count(F.when(F.col("mate") == m, 1)).alias(f"_n{m}") for m in (0, 1)])
    return pairs_of.join(many.where((F.col("_n0") > limit // 2) & (F.col("_n1") > limit // 2)), "pair_id", "left_anti")


def distant_pairs(hits: DataFrame, mean: float, dev: float, near: float = 4, far: float = 7) -> DataFrame:
    off = F.abs(F.col("insert_size") - mean)
    return mates(hits).where((off > near * dev) & (off <= far * dev))


def scored(pairs: DataFrame, mean: float, dev: float, saturation: float = 7, match: float = 1.0) -> DataFrame:
    """Pair score: both hits' scores less the insert size's penalty."""
    penalty = insert_penalty(F.col("insert_size").cast("double"), F.lit(float(mean)), F.lit(float(dev)), F.lit(float(saturation)), F.lit(float(match)))
    return pairs.withColumn("pair_score", F.col("score1") + F.col("score2") - penalty)


def best_pairs(pairs: DataFrame, score: str, limit: int = 128) -> DataFrame:
    return ranked(pairs, ["pair_id"], [F.col(score).desc(), "contig_id", "pos1", "pos2", "strand1"], limit)


def within_mate_errors(pairs: DataFrame, fraction: float = 0.09) -> DataFrame:
    return pairs.where((F.col("ed1") <= F.col("length1") * fraction) & (F.col("ed2") <= F.col("length2") * fraction))


def touching(pairs: DataFrame, contig) -> DataFrame:
    """Pairs with a mate on the contig asked for."""
    return pairs.where(F.col("contig_id") == F.lit(contig))


def first_tier(tiers: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first table that has any; `tier` tells which."""
    every = reduce(DataFrame.unionByName, [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)])
    return every.withColumn("_least", F.min("tier").over(Window.partitionBy(key))).where("tier = _least").drop("_least")


def beside(rescued: DataFrame) -> DataFrame:
    """Rescued mates with their anchors -> pairs as mates() has them, and anchor_ed.

    rescued: pair_id, mate, contig_id, strand, pos, ed, score, length, and the anchor's a_strand, a_pos, a_ed, a_score,
    a_length.
    """
    side = lambda m: [F.when(F.col("mate") == m, F.col(c)).otherwise(F.col("a_" + c)).alias(f"{c}{m + 1}") for c in _SIDE[1:]]
    both = rescued.select("pair_id", "contig_id", *side(0), *side(1), F.col("a_ed").alias("anchor_ed"))
    size = insert_size(F.col("contig_id"), F.col("strand1"), F.col("pos1"), F.col("length1"), F.col("contig_id"), F.col("strand2"), F.col("pos2"), F.col("length2"))
    return both.withColumn("insert_size", size)


def best_alone(hits: DataFrame) -> DataFrame:
    """The best hit of each mate by itself, as a pair: the last chance of a near pair."""
    return mates(ranked(hits, ["pair_id", "mate"], [F.col("score").desc(), "contig_id", "pos", "strand"], 1).drop("nth"))


def fallback(mapped: DataFrame, hits: DataFrame, rescued: DataFrame, mean: float, dev: float, errors: int, near: float = 4, far: float = 7, longest: float = 1000) -> DataFrame:
    """Pairs of the first of these tiers that a read pair has, and its distant pairs (tier 4) beside them.

    0: mapped pairs within `near` deviations in which both mates stand at their best. 1: rescued ones whose anchor has no
    more than `errors` errors; 2: those with worse anchors. 3: each mate's best hit, if both lie within `far` deviations
    above the mean. 4: mapped pairs beyond `near` deviations and no longer than `longest`. mapped: mates(hits). rescued:
    as mapped, and anchor_ed. The score decides between a tier and the distant pairs.
    """
    keep, off = [c for c in mapped.columns], F.abs(F.col("insert_size") - mean)
    close = as_good_as_alone(mapped.where(off <= near * dev), hits, errors)
    low, high = rescued.where(F.col("anchor_ed") <= errors), rescued.where(F.col("anchor_ed") > errors)
    alone = best_alone(hits).where(F.col("insert_size") <= mean + far * dev)
    first = first_tier([t.select(*keep) for t in (close, low, high, alone)], "pair_id")
    distant = mapped.where((off > near * dev) & (F.col("insert_size") <= longest)).select(*keep).withColumn("tier", F.lit(4))
    every = first.unionByName(distant)
    return ranked(every, ["pair_id", "contig_id", "strand1", "pos1", "strand2", "pos2"], ["tier", F.col("ed1") + F.col("ed2"), "ed1", "length1", "length2"], 1).drop("nth")


def pair_qualities(pairs: DataFrame, score: str, width: float = 0.5, cfg: AlignConfig = AlignConfig()) -> DataFrame:
    """pair_id, best and second score, how many places have scores less than `width` below each, and the pair's quality."""
    places = pairs.groupBy("pair_id", "contig_id", "strand1", "pos1", "strand2", "pos2").agg(F.max(score).alias("_s"))
    per = Window.partitionBy("pair_id")
    places = places.withColumn("best", F.max("_s").over(per)).withColumn("_rest", F.when(F.col("_s") <= F.col("best") - width, F.col("_s"))).withColumn("second", F.max("_rest").over(per))
    count = lambda c: F.count(F.when(c, 1))
    told = places.groupBy("pair_id", "best", "second").agg(count(F.col("_rest").isNull()).alias("n_best"), count(F.col("_rest") > F.col("second") - width).alias("n_second"))
    return told.withColumn("pairq", mapping_quality(F.col("n_best"), F.col("n_second"), F.col("best") - F.coalesce("second", "best"), cfg))
