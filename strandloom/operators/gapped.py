"""Reads with one long indel, or with an end that does not belong: an exact seed at one end, and the best shape from it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from strandloom.functions import alignment
from strandloom.operators import hits, seeding
from strandloom.operators.saving import saved

_SHAPE = StructType().add("score", DoubleType()).add("ext", StringType())


def _shape(longest: int, scores: tuple):
    @F.pandas_udf(_SHAPE)
    def told(read: pd.Series, window: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for r, w, turned in zip(read, window, right, strict=True):
            found = alignment.long_indel(r[::-1], w[::-1], 0, longest, scores) if turned else alignment.long_indel(r, w, 0, longest, scores)
            rows.append((None, None) if found is None else (found[0], "".join(alignment.tokens(found[1])[::-1]) if turned else found[1]))
        return pd.DataFrame(rows, columns=["score", "ext"])

    return told


def anchored(reads: DataFrame, contigs: DataFrame, k: int = 18, longest: int = 50, scores: tuple = (1.0, -5.0, -5.0, -0.4, -6.0), limit: int = 1024, index: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """read_id, seq -> read_id, strand, contig_id, pos (1-based), ed, ext, score, length: the best shape of each read.

    The first or the last k bases stand exactly in a contig (an equi-join with the seeds); from there the read is plain,
    has one insertion or deletion of `longest` bases at most, or its other end is clipped, whichever scores most (match,
    mismatch, gap opened, gap extended, clip). Errors are mismatches and bases of the indel. Reads that are null,
    shorter than k or have N in both seeds get no row, nor do those whose best score is not above 0. Ties go to the
    least contig, position and strand. limit: anchors of a read that are tried, by a hash of their place. least: share of
    a read that must stay when an end is clipped.
    """
    stranded = seeding.both_strands(reads.where(F.length("seq") >= k))
    size = F.length("seq")
    ends = F.array(F.struct(F.lit(False).alias("right"), F.substring("seq", F.lit(1), F.lit(k)).alias("seed")), F.struct(F.lit(True).alias("right"), F.substring("seq", size - k + 1, F.lit(k)).alias("seed")))
    seeds = stranded.withColumn("x", F.explode(ends)).select("read_id", "strand", "seq", "x.right", seeding.seed_code("x.seed").alias("seed"))
    found = seeds.join(seeding.matched_index(seeding.chunks(contigs), seeds, k, index), "seed").drop("seed")
    found = hits.ranked(found, ["read_id"], [F.xxhash64("contig_id", "pos"), "contig_id", "pos", "strand", "right"], limit).drop("nth")
    found = saved(found, "anchors")
    end = F.col("pos") + k  # where the read's last base would stand if its end were the seed
    low = F.when(F.col("right"), F.greatest(end - size - longest, F.lit(0))).otherwise(F.col("pos"))
    far = F.when(F.col("right"), end).otherwise(F.col("pos") + size + longest)
    placed = found.withColumn("low", low).withColumn("far", far).withColumn("chunk", F.floor(F.col("low") / seeding.CHUNK))
    placed = placed.join(seeding.chunks_of(contigs, found).select("contig_id", "chunk", F.col("seq").alias("piece")), ["contig_id", "chunk"])
    window = F.substring("piece", (F.col("low") - F.col("chunk") * seeding.CHUNK).cast("int") + 1, (F.col("far") - F.col("low")).cast("int"))
    told = placed.select("read_id", "strand", "contig_id", "right", F.col("pos").alias("at"), end.alias("end"), "seq", window.alias("window"))
    told = told.withColumn("x", _shape(longest, scores)("seq", "window", "right")).where("x.score > 0")
    told = told.where(F.length(F.regexp_replace("x.ext", "[^$]", "")) <= F.length("seq") * F.lit(1.0 - least))
    span = F.length(F.regexp_replace(F.regexp_replace("x.ext", "#.", ""), r"[\^$]", "")).cast("long")
    pos = F.when(F.col("right"), F.col("end") - span).otherwise(F.col("at")) + 1
    errors = F.length(F.regexp_replace("x.ext", r"[.$#^]", "")).cast("long")
    rows = told.select("read_id", "strand", "contig_id", pos.cast("long").alias("pos"), errors.alias("ed"), "x.ext", "x.score", span.alias("length"))
    return hits.ranked(rows, ["read_id"], [F.col("score").desc(), "contig_id", "pos", "strand", "ext"], 1).drop("nth")
