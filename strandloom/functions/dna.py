"""Sequence functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def from_text(text: Column) -> Column:
    """The fixed projection of prose to bases: letters A-Z in either case, one base each; all else goes."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES)


def encoded(seq: Column) -> Column:
    """Reads as A, C, G, T; every other symbol is N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def masked(seq: Column, quality: Column, least: int) -> Column:
    """N where the quality character is below `least`; no masking for least under 33."""
    if least < 33:
        return seq
    return F.array_join(F.zip_with(F.split(seq, ""), F.split(quality, ""), lambda s, q: F.when(F.ascii(q) < least, "N").otherwise(s)), "")


def read_name(line: Column) -> Column:
    """A title line up to the first blank, its @ dropped."""
    return F.regexp_extract(line, "^@?([^ \\t\\n]*)", 1)


def common_affixes_trimmed(ref: Column, alt: Column) -> Column:
    """A variant's alleles without their common end and then their common start: struct(ref, alt, start)."""
    least = F.least(F.length(ref), F.length(alt))
    longest = lambda ok: F.array_max(F.filter(F.sequence(F.lit(0), least), ok))
    tail = longest(lambda n: F.substring(F.reverse(ref), F.lit(1), n) == F.substring(F.reverse(alt), F.lit(1), n))
    r, a = F.substring(ref, F.lit(1), F.length(ref) - tail), F.substring(alt, F.lit(1), F.length(alt) - tail)
    head = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(r), F.length(a))), lambda n: F.substring(r, F.lit(1), n) == F.substring(a, F.lit(1), n)))
    rest = F.lit(2**31 - 1)
    return F.struct(F.substring(r, head + 1, rest).alias("ref"), F.substring(a, head + 1, rest).alias("alt"), head.cast("long").alias("start"))
