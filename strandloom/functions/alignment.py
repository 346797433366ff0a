"""Alignment kernels that no expression can say: free-end distance, traceback, and reading of extended CIGARs.

They run as Arrow-batched functions over candidates that the seed join has already thinned out.

Extended CIGAR: . match; a base: mismatch (the reference's); #base insertion (the read's); ^base deletion (the
reference's); $ clipped.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from strandloom.functions import kernels

_ALIGNED = StructType().add("ed", IntegerType()).add("first", IntegerType()).add("last", IntegerType()).add("ext", StringType())
_DESCRIBED = StructType().add("cigar", StringType()).add("md", StringType()).add("score", DoubleType()).add("events", IntegerType())
_TOKEN = re.compile(r"\.|\$|#.|\^.|[A-Za-z]")


def infix_alignment(read: str, window: str) -> tuple[int, int, int, str]:
    """Least edit distance of the whole read to any infix of the window: distance, infix (first, last), extended CIGAR.

    Of equally good ends the last counts; going back, a match or mismatch comes before an insertion or a deletion.
    """
    m, n = len(read), len(window)
    w = np.frombuffer(window.encode("latin-1", "replace"), np.uint8)
    r = np.frombuffer(read.encode("latin-1", "replace"), np.uint8)
    d = np.zeros((m + 1, n + 1), np.int32)
    d[:, 0] = np.arange(m + 1)
    steps = np.arange(n + 1, dtype=np.int32)
    for i in range(1, m + 1):
        row = np.minimum(d[i - 1, 1:] + 1, d[i - 1, :-1] + (w != r[i - 1]))
        full = np.concatenate(([i], row))
        d[i] = np.minimum.accumulate(full - steps) + steps  # deletions run along the row
    last = n - int(np.argmin(d[m, ::-1]))
    i, j, out = m, last, []
    while i > 0:
        if j > 0 and d[i, j] == d[i - 1, j - 1] + (w[j - 1] != r[i - 1]):
            out.append("." if w[j - 1] == r[i - 1] else window[j - 1])
            i, j = i - 1, j - 1
        elif d[i, j] == d[i - 1, j] + 1:
            out.append("#" + read[i - 1])
            i -= 1
        else:
            out.append("^" + window[j - 1])
            j -= 1
    return int(d[m, last]), j, last, "".join(reversed(out))


@F.pandas_udf(_ALIGNED)
def infix_aligned(read: pd.Series, window: pd.Series) -> pd.DataFrame:
    """infix_alignment() of a whole batch at once; null for a null or empty read and for a null window."""
    out = pd.DataFrame({"ed": pd.array([None] * len(read), "Int32"), "first": pd.array([None] * len(read), "Int32"), "last": pd.array([None] * len(read), "Int32"), "ext": [None] * len(read)})
    there = np.flatnonzero(read.notna() & window.notna() & (read.str.len() > 0))
    (r, m), (w, n) = kernels.rows(read.iloc[there]), kernels.rows(window.iloc[there])
    errors, last = kernels.infix_distances(r, m, w, n)
    first, ext = kernels.alignments(r, m, w, last, errors)
    for name, values in (("ed", errors), ("first", first), ("last", last), ("ext", ext)):
        out.loc[there, name] = values
    return out


def tokens(ext: str) -> list[str]:
    return _TOKEN.findall(ext)


def cigar_and_md(ext: str) -> tuple[str, str]:
    """CIGAR (M for match and mismatch) and MD (a closing 0 is left out)."""
    cigar, md, run, matches = [], [], ["", 0], 0

    def put(op: str) -> None:
        if run[0] != op:
            if run[1]:
                cigar.append(f"{run[1]}{run[0]}")
            run[0], run[1] = op, 0
        run[1] += 1

    for t in tokens(ext):
        if t == "$":
            put("S")
        elif t[0] == "#":
            put("I")
        elif t[0] == "^":
            put("D")
            md.append(f"{matches}^{t[1]}")
            matches = 0
        else:
            put("M")
            if t == ".":
                matches += 1
            else:
                md.append(f"{matches}{t}")
                matches = 0
    put("")
    return "".join(cigar), "".join(md) + (str(matches) if matches else "")


def affine_score(ext: str, match=1.0, mismatch=-5.0, gap_open=-5.0, gap_extend=-0.4, clip=-6.0) -> tuple[float, int]:
    """Score and number of events: gaps and clips count once however long, mismatches one by one."""
    score, events, before = 0.0, 0, ""
    for t in tokens(ext):
        kind = t[0] if t[0] in ".#^$" else "x"
        if kind == ".":
            score += match
        elif kind == "x":
            score, events = score + mismatch, events + 1
        elif kind == before:
            score += 0.0 if kind == "$" else gap_extend
        else:
            score, events = score + (clip if kind == "$" else gap_open), events + 1
        before = kind
    return score, events


def describing(scores: tuple = (1.0, -5.0, -5.0, -0.4, -6.0)):
    """A function of extended CIGARs: struct(cigar, md, score, events), with the scores that affine_score() takes."""

    @F.pandas_udf(_DESCRIBED)
    def told(ext: pd.Series) -> pd.DataFrame:
        known = {x: (*cigar_and_md(x), *affine_score(x, *scores)) for x in ext.dropna().unique()}
        return pd.DataFrame([known.get(x, (None,) * 4) for x in ext], columns=["cigar", "md", "score", "events"])

    return told


described = describing()


#: An insertion and a deletion two matches apart, in either order, between matches.
_SHORT = re.compile(r"(?<=\.)(?:#(.)\.\.\^(.)|\^(.)\.\.#(.))(?=\.)")


def short_indels_refined(ext: str, read: str | None = None, window: str | None = None, first: int = 0) -> tuple[str, int]:
    """The first insertion, two matches and deletion (or the reverse) between matches as three bases side by side, and
    how many such were found (0 or 1).

    The three bases are told from the read and the window (infix from `first`): a dot where they agree. Without these
    all three count as mismatches of the deleted base.
    """
    found = _SHORT.search(ext)
    if not found:
        return ext, 0
    if read is None or window is None:
        return ext[: found.start()] + (found[2] or found[3]) * 3 + ext[found.end() :], 1
    before = tokens(ext[: found.start()])
    i, j = sum(t[0] != "^" for t in before), first + sum(t[0] not in "#$" for t in before)
    three = "".join("." if read[i + k] == window[j + k] else window[j + k] for k in range(3))
    return ext[: found.start()] + three + ext[found.end() :], 1


@F.pandas_udf(StructType().add("ext", StringType()).add("ed", IntegerType()))
def refined(ext: pd.Series, read: pd.Series, window: pd.Series, first: pd.Series) -> pd.DataFrame:
    """short_indels_refined() of a batch, and the errors that follow."""
    rows = [short_indels_refined(x, r, w, int(f))[0] for x, r, w, f in zip(ext, read, window, first, strict=True)]
    return pd.DataFrame({"ext": rows, "ed": pd.array([sum(t not in (".", "$") for t in tokens(x)) for x in rows], "int32")})


def consistent(read: str, window: str, first: int, ext: str) -> bool:
    """Whether an extended CIGAR, replayed over the reference, gives the read."""
    i, j = 0, first
    for t in tokens(ext):
        if t == "$":
            i += 1
        elif t[0] == "#":
            if read[i : i + 1] != t[1]:
                return False
            i += 1
        elif t[0] == "^":
            if window[j : j + 1] != t[1]:
                return False
            j += 1
        else:
            same = read[i : i + 1] == window[j : j + 1]
            if (t == ".") != same or t != "." and window[j : j + 1] != t:
                return False
            i, j = i + 1, j + 1
    return i == len(read)


def long_indel(read: str, window: str, at: int, longest: int = 50, cfg=(1.0, -5.0, -5.0, -0.4, -6.0)) -> tuple[float, str] | None:
    """The best shape of a read whose left end is anchored at window[at]: plain, one long indel, or its tail clipped."""
    match, mismatch, opened, extended, clip = cfg
    m = len(read)
    r, w = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (read, window))
    w = np.pad(w, longest + m)  # zeros, which are no base, before and after it
    equal = lambda shift: r == w[longest + m + at + shift :][:m]
    worth = lambda hit: np.where(hit, match, mismatch)
    base = worth(equal(0))
    ahead = np.concatenate(([0.0], np.cumsum(base)))
    shape = lambda hit, i, j, shift: "".join("." if hit[k] else (window[at + k + shift] if 0 <= at + k + shift < len(window) else "N") for k in range(i, j))
    here = equal(0)
    best = (float(ahead[m]), shape(here, 0, m, 0))
    k = int(np.argmax(ahead))
    if ahead[k] + clip > best[0]:
        best = (float(ahead[k] + clip), shape(here, 0, k, 0) + "$" * (m - k))
    for size in range(1, longest + 1):
        cost = opened + (size - 1) * extended
        for shift in (size, -size):
            skip = size if shift < 0 else 0  # an insertion uses up bases of the read
            if skip > m - 2:
                continue  # no base would be left on one side of it
            hit = equal(shift)
            tail = np.concatenate((np.cumsum(worth(hit)[::-1])[::-1], [0.0]))
            total = ahead[: m + 1 - skip] + tail[skip:] + cost
            i = int(np.argmax(total))
            if total[i] > best[0] and 0 < i < m - skip and at + i + max(shift, 0) <= len(window):
                gap = "".join("#" + b for b in read[i : i + skip]) if skip else "".join("^" + b for b in window[at + i : at + i + size])
                best = (float(total[i]), shape(here, 0, i, 0) + gap + shape(hit, i + skip, m, shift))
    return best if best[0] > 0 else None
