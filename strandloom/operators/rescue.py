"""Mates that the seed join missed: searched for where the other mate says that they should be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import alignment, clipping, dna
from strandloom.operators import seeding

#: Bases that a lost mate must share in a row with its window before a clipped shape is tried.
SHARED = 12


def _windows(anchors: DataFrame, mates: DataFrame, pieces: DataFrame, reach: int) -> DataFrame:
    """The lost mates, turned to the strand that their anchors' mates face on, and the bases that they may stand on."""
    joined = anchors.join(mates, "pair_id")
    down = F.col("strand") == "+"
    low = F.when(down, F.col("start")).otherwise(F.greatest(F.col("start") + F.col("length") - reach, F.lit(0)))
    turned = F.when(down, dna.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    joined = joined.withColumn("low", low).withColumn("seq", turned).withColumn("chunk", F.floor(F.col("low") / seeding.CHUNK))
    joined = joined.join(pieces.select("contig_id", "chunk", F.col("seq").alias("piece")), ["contig_id", "chunk"])
    window = F.substring("piece", (F.col("low") - F.col("chunk") * seeding.CHUNK).cast("int") + 1, F.lit(reach))
    more = [c for c in anchors.columns if c not in ("pair_id", "contig_id", "start", "strand", "length")]
    return joined.select("pair_id", "contig_id", F.when(down, "-").otherwise("+").alias("strand"), "low", "seq", window.alias("window"), *more)


def _found(told: DataFrame, anchors: DataFrame, *names: str) -> DataFrame:
    more = [c for c in anchors.columns if c not in ("pair_id", "contig_id", "start", "strand", "length")]
    return told.select("pair_id", "contig_id", "strand", (F.col("low") + F.col("x.first") + 1).alias("pos"), F.col("x.ed").cast("long").alias("ed"), *names, *more)


def rescued(anchors: DataFrame, mates: DataFrame, pieces: DataFrame, mean: float, dev: float, sigmas: float = 7, errors: float = 0.09) -> DataFrame:
    """anchors: pair_id, contig_id, start, strand, length. mates: pair_id, seq. pieces: chunks().

    The window reaches from the anchor as far as the insert size allows, downstream of a + anchor and upstream of a -
    one; the mate is turned to the other strand and aligned inside with free ends. Kept: twice the mate error share at
    most. Gives pair_id, contig_id, strand, pos (1-based), ed, ext, and the anchors' further columns.
    """
    told = _windows(anchors, mates, pieces, int(mean + sigmas * dev)).withColumn("x", alignment.infix_aligned("seq", "window"))
    told = told.where(F.col("x.ed") <= F.floor(2 * errors * F.length("seq")))
    return _found(told, anchors, "x.ext")


def rescued_by_clipping(anchors: DataFrame, mates: DataFrame, pieces: DataFrame, mean: float, dev: float, sigmas: float = 28, k: int = SHARED, longest: int = 50, scores: tuple = (1.0, -5.0, -5.0, -0.4, -6.0), least: float = 0.0) -> DataFrame:
    """The same for mates of which a part only belongs there: the seeds of the lost mate are looked for within the
    interval that its partner allows (wider than rescued()'s), and the best shape from a shared one is kept: with one
    insertion or deletion of `longest` bases at most, and ends clipped.

    Gives pair_id, contig_id, strand, pos (1-based, of the first base that is not clipped), ed, ext, score, and the
    anchors' further columns. Mates that share no k bases in a row with the window, or score not above 0, or would keep
    less than the share `least`, get no row.
    """
    told = _windows(anchors, mates, pieces, int(mean + sigmas * dev)).withColumn("x", clipping.shapes(k, longest, scores, least)("seq", "window")).where("x.score IS NOT NULL")
    return _found(told, anchors, "x.ext", "x.score")
