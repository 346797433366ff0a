"""Soft clipping: of extended CIGARs (positions off the contig, ends of low quality or that cost more than a clip,
overlapping mates), and the best clipped shape of a read in a window.

What a clip costs and when an end is worth one follows the scores; the sources to match have no bodies for these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from strandloom.functions.alignment import tokens
from strandloom.functions.kernels import codes

_CLIPPED = StructType().add("score", DoubleType()).add("first", IntegerType()).add("ed", IntegerType()).add("ext", StringType())
_ENDS = StructType().add("ext", StringType()).add("moved", IntegerType())
_OUT = -1e6  # what a base outside the window costs: it is clipped


def clipped(ext: str, left: int, right: int) -> tuple[str, int]:
    """The alignment with so many read bases clipped at each end, and the reference bases that its start moves on.

    Insertions count as read bases; deletions next to a clip go with it.
    """
    found = tokens(ext)

    def cut(parts: list[str], n: int) -> tuple[list[str], int]:
        out, moved, k = [], 0, 0
        while k < len(parts) and (n > 0 or out and parts[k][0] == "^"):
            t = parts[k]
            if t[0] == "^":
                moved += 1
            else:
                out.append("$")
                n -= 1
                moved += t[0] not in "#$"
            k += 1
        return out + parts[k:], moved

    found, moved = cut(found, left)
    back, _ = cut(found[::-1], right)
    return "".join(back[::-1]), moved


def off_contig(ext: str, start: int, size: int) -> tuple[str, int]:
    """Clips what lies before the contig's first or after its last base: alignment and 0-based start."""
    place, left, right = start, 0, 0
    for t in tokens(ext):
        inside = 0 <= place < size
        if t[0] not in "^$":
            if not inside and place < 0:
                left += 1
            elif not inside:
                right += 1
        if t[0] not in "#$":
            place += 1
    out, moved = clipped(ext, left, right)
    return out, start + moved


def low_quality(ext: str, quality: str, least: int) -> tuple[str, int]:
    """Clips runs of bases below a quality at both ends, never the whole read."""
    bad = [ord(q) < least for q in quality]
    if all(bad):
        return ext, 0
    return clipped(ext, bad.index(False), bad[::-1].index(False))


def overlap(left_start: int, left_span: int, right_start: int) -> int:
    """Reference bases that the right mate shares with the left one: clipped off its start."""
    return max(0, left_start + left_span - right_start)


def boundary(ext: str, match=1.0, mismatch=-5.0, gap_open=-5.0, gap_extend=-0.4, clip=-6.0) -> tuple[str, int]:
    """Clips the ends that cost more than a clip does: the part of the alignment that scores best with its clips."""
    found, before, worth = tokens(ext), "", []
    for t in found:
        kind = t[0] if t[0] in ".#^$" else "x"
        worth.append({".": match, "x": mismatch, "$": 0.0}.get(kind, gap_extend if kind == before else gap_open))
        before = kind
    n, s = len(found), np.concatenate(([0.0], np.cumsum(worth)))
    good = np.array([t == "." for t in found], bool)
    if not good.any():
        return ext, 0
    begin = np.where(good, np.concatenate(([0.0], np.full(n - 1, clip))) - s[:-1], -np.inf)
    total = np.where(good, s[1:] + np.maximum.accumulate(begin) + np.concatenate((np.full(n - 1, clip), [0.0])), -np.inf)
    j = n - int(np.argmax(total[::-1]))  # of equal parts the longest
    i = int(np.argmax(begin[:j]))
    plain = s[-1] + clip * ((found[0] == "$") + (found[-1] == "$"))
    if total[j - 1] <= plain + 1e-9:
        return ext, 0
    used = lambda part: sum(t[0] != "^" for t in part)
    return clipped(ext, used(found[:i]), used(found[j:]))


def best_shape(read: str, window: str, k: int, longest: int = 50, scores: tuple = (1.0, -5.0, -5.0, -0.4, -6.0), least: float = 0.0) -> tuple[float, int, int, str] | None:
    """The best shape of a read that shares k bases in a row with a window: on one diagonal, or on two with an insertion
    or deletion of `longest` bases at most between, either end clipped where that scores more.

    Gives score, where it begins in the window, errors (mismatches and bases of the indel) and extended CIGAR; None
    without shared bases, without a score above 0, or where less than `least` of the read would stay. Of equal scores
    one diagonal comes before two, then the least diagonal.
    """
    match, mismatch, opened, extended, clip = scores
    m, n = len(read), len(window)
    r, w = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (read, window))
    (a, a_ok), (b, b_ok) = codes(r.tobytes(), k), codes(w.tobytes(), k)
    order = np.flatnonzero(b_ok)[np.argsort(b[b_ok], kind="stable")]
    low, high = np.searchsorted(b[order], a[a_ok]), np.searchsorted(b[order], a[a_ok], "right")
    size = high - low
    if not size.sum():
        return None
    at = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    diagonals = np.unique(order[at] - np.repeat(np.flatnonzero(a_ok), size))
    place = diagonals[:, None] + np.arange(m)[None, :]
    inside = (place >= 0) & (place < n)
    hit = inside & (w[np.clip(place, 0, n - 1)] == r[None, :])
    s = np.concatenate((np.zeros((len(hit), 1)), np.cumsum(np.where(inside, np.where(hit, match, mismatch), _OUT), 1)), 1)
    ends = np.concatenate(([0.0], np.full(m, clip)))
    left = s + np.maximum.accumulate(ends - s, 1)  # best part that ends at p
    right = np.maximum.accumulate((s + ends[::-1])[:, ::-1], 1)[:, ::-1] - s  # best part that begins at p
    whole = left + right
    d, p = np.unravel_index(int(np.argmax(whole)), whole.shape)
    best = (float(whole[d, p]), d, d, p, 0)
    for i, diagonal in enumerate(diagonals):
        for j in np.flatnonzero((np.abs(diagonals - diagonal) <= longest) & (diagonals != diagonal)):
            shift = int(diagonals[j] - diagonal)
            skip = max(0, -shift)
            total = left[i, 1 : m - skip] + right[j, 1 + skip : m] + opened + (abs(shift) - 1) * extended
            if len(total) and total.max() > best[0] + 1e-9:
                best = (float(total.max()), i, int(j), int(total.argmax()) + 1, shift)
    score, i, j, p, shift = best
    skip = max(0, -shift)
    q = p + skip
    first = p - int(np.argmax((ends - s[i])[: p + 1][::-1]))
    last = q + int(np.argmax((s[j] + ends[::-1])[q:]))
    if score <= 0 or last - first < least * m:
        return None
    shape = lambda d, x, y: "".join("." if hit[d, z] else window[diagonals[d] + z] for z in range(x, y))
    gap = "".join("#" + c for c in read[p:q]) if skip else "".join("^" + c for c in window[diagonals[i] + p : diagonals[i] + p + shift])
    ext = "$" * first + shape(i, first, p) + gap + shape(j, q, last) + "$" * (m - last)
    errors = int((~hit[i, first:p]).sum() + (~hit[j, q:last]).sum() + abs(shift))
    return score, int(diagonals[i] + first), errors, ext


def shapes(k: int, longest: int, scores: tuple, least: float):
    """best_shape() over a batch: struct(score, first, ed, ext), null without a shape."""

    @F.pandas_udf(_CLIPPED)
    def told(read: pd.Series, window: pd.Series) -> pd.DataFrame:
        rows = [(best_shape(r, w, k, longest, scores, least) if r and w else None) or (None,) * 4 for r, w in zip(read, window, strict=True)]
        return pd.DataFrame(rows, columns=["score", "first", "ed", "ext"]).astype({"first": "Int32", "ed": "Int32"})

    return told


def ends_clipped(scores: tuple, by_score: bool, least_quality: int):
    """The clipping of an alignment's own ends over a batch (ext, quality in the reference's direction, 0-based start,
    the contig's size, bases that a mate has already): struct(ext, moved). In this order: off the contig, low quality,
    by score, and the bases from the start that the mate has, unless these are all that is left."""

    @F.pandas_udf(_ENDS)
    def told(ext: pd.Series, quality: pd.Series, start: pd.Series, size: pd.Series, shared: pd.Series) -> pd.DataFrame:
        rows = []
        for x, q, at, n, mine in zip(ext, quality, start, size, shared, strict=True):
            out, begin = off_contig(x, int(at), int(n)) if n is not None and n == n else (x, int(at))
            moved = begin - int(at)
            if least_quality and q is not None and q == q:
                out, more = low_quality(out, q, least_quality)
                moved += more
            if by_score and set(out) - {".", "$"}:
                out, more = boundary(out, *scores)
                moved += more
            if mine and mine == mine:
                out, more = shared_clipped(out, int(mine) - moved)
                moved += more
            rows.append((out, moved))
        return pd.DataFrame(rows, columns=["ext", "moved"])

    return told


def shared_clipped(ext: str, shared: int) -> tuple[str, int]:
    """Clips the read's bases that stand on the first `shared` reference bases; never all that are left."""
    place = bases = 0
    for t in tokens(ext):
        if place >= shared:
            break
        bases += t[0] not in "^"
        place += t[0] not in "#$"
    if shared <= 0 or not any(t[0] not in "^$" for t in tokens(ext)[_tokens_of(ext, bases) :]):
        return ext, 0
    return clipped(ext, bases, 0)


def _tokens_of(ext: str, bases: int) -> int:
    """How many tokens hold so many read bases."""
    for i, t in enumerate(tokens(ext)):
        if bases <= 0:
            return i
        bases -= t[0] != "^"
    return len(tokens(ext))
