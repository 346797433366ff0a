"""Scores, penalties, flags and positions as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandloom.plans.config import AlignConfig

_CFG = AlignConfig()


def indel_mismatches(length: Column, cfg: AlignConfig = _CFG) -> Column:
    """Mismatches that an indel of this length counts for."""
    cost = (F.lit(cfg.gap_open) + (F.abs(length) - 1) * F.lit(cfg.gap_extend)) / F.lit(cfg.score_mismatch)
    return F.when(length == 0, F.lit(0)).otherwise(F.floor(cost)).cast("long")


def candidate_penalty(kind: Column, mismatches: Column) -> Column:
    """Mismatches, and one for each indel or clip of the candidate's shape."""
    more = F.when(kind.isin("indel1", "mismatch_clip"), 1).when(kind.isin("indel2", "indel_clip", "clip_clip"), 2).otherwise(0)
    return (mismatches + more).cast("long")


def hit_score(read_length: Column, clipped: Column, errors: Column, cfg: AlignConfig = _CFG) -> Column:
    return (read_length - clipped - errors) * F.lit(cfg.score_match) + errors * F.lit(cfg.score_mismatch)


def mapping_quality(best: Column, second: Column, gap: Column, cfg: AlignConfig = _CFG) -> Column:
    """Quality from the hits that tie for best, those with the second score, and the gap between the scores."""
    shared = F.when(best == 2, 3).when(best == 3, 2).when(best < 10, 1).otherwise(0)
    alone = F.greatest(F.lit(0), 60 - F.floor(F.lit(cfg.mapq_mult) * F.log2(1.0 + second) / F.greatest(gap, F.lit(cfg.mapq_div))))
    return F.when(best > 1, shared).when(second == 0, 60).otherwise(alone).cast("long")


def sam_flag(paired: Column, proper: Column, unmapped: Column, mate_unmapped: Column, reverse: Column, mate_reverse: Column, first: Column, secondary: Column) -> Column:
    """Bits 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40 or 0x80, and 0x100."""
    bit = lambda cond, value: F.when(cond, value).otherwise(0)
    parts = [bit(paired, 1), bit(paired & proper, 2), bit(unmapped, 4), bit(paired & mate_unmapped, 8), bit(reverse, 16), bit(paired & mate_reverse, 32), bit(paired & first, 64), bit(paired & ~first, 128), bit(secondary, 256)]
    total = parts[0]
    for p in parts[1:]:
        total = total.bitwiseOR(p)
    return total.cast("long")


def insert_size(contig1, strand1, pos1, length1, contig2, strand2, pos2, length2) -> Column:
    """From the left mate's start to the right mate's end; null across contigs, on one strand, or facing apart."""
    first_left = (pos1 < pos2) | ((pos1 == pos2) & (strand1 == "+"))
    left_strand = F.when(first_left, strand1).otherwise(strand2)
    size = F.when(first_left, pos2 - pos1 + length2).otherwise(pos1 - pos2 + length1)
    return F.when((contig1 == contig2) & (strand1 != strand2) & (left_strand == "+"), size).cast("long")


def position_hash(pos: Column) -> Column:
    """A fixed multiplicative hash of 32 bits that orders hits without bias to low positions."""
    return F.pmod(pos * F.lit(0x678DDE6F).cast("long"), F.lit(1 << 32).cast("long"))


def normalised(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


@F.pandas_udf(DoubleType())
def insert_penalty(size: pd.Series, mean: pd.Series, dev: pd.Series, saturation: pd.Series, match: pd.Series) -> pd.Series:
    """-match * log4 of the tail that an insert size leaves under the model; null sizes and far ones saturate."""

    far = np.maximum(0.0, np.floor(mean + saturation * dev) - mean)  # the last whole insert size within bounds
    off = np.minimum(np.abs(size - mean).fillna(np.inf), far)
    sigmas = np.divide(off, dev, out=np.where(off == 0, 0.0, np.inf), where=dev.to_numpy() > 0)
    tail = pd.Series(sigmas).map({x: 0.5 * math.erfc(x / math.sqrt(2)) for x in np.unique(sigmas)})
    return -match * np.log(np.maximum(tail, np.finfo(float).tiny)) / math.log(4)


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal falls with probability p, to about 0.0005, by a rational approximation."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    # fixed values: the approximation's coefficients
    x = t - (F.lit(2.515517) + 0.802853 * t + 0.010328 * t * t) / (F.lit(1.0) + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -x).otherwise(x)
