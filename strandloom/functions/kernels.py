"""Edit distances of many reads and windows at once: numpy over a whole Arrow batch, no Python step for each pair.

A batch is two byte matrices, a row for each pair, short rows filled up with zeros that match nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Pairs that are computed together: their words or bands stay in the processor's cache.
LOT = 2048
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def rows(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Texts -> a byte matrix and the texts' lengths; a symbol beyond one byte counts as ?."""
    found = [t.encode("latin-1", "replace") for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    width = int(sizes.max(initial=0))
    out = np.zeros((len(found), width), np.uint8)
    out[np.arange(width)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(found), np.uint8)
    return out, sizes


def codes(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each k bases in a row, and whether all of them are A, C, G or T."""
    base = _CODE[np.frombuffer(text, np.uint8)]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    out, long = (base & 3).astype(np.int64), 1
    for bit in bin(k)[3:]:  # twice as many bases a step, and one more where k has the bit
        out, long = (out[:-long] << 2 * long) + out[long:], 2 * long
        if bit == "1":
            out, long = (out[:-1] << 2) + (base[long:] & 3), long + 1
    bad = np.concatenate(([0], np.cumsum(base == 4)))
    return out, bad[k:] == bad[:-k]


def prefix_codes(text: bytes, k: int, depth: int) -> np.ndarray:
    """The numbers of the first `depth` of each k bases in a row, all of them A, C, G or T."""
    base = _CODE[np.frombuffer(text, np.uint8)]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    out = np.zeros(n, np.int32)
    for i in range(depth):
        out = out * 4 + (base[i : i + n] & 3)
    if base.max() < 4:
        return out
    bad = np.concatenate(([0], np.cumsum(base == 4)))
    return out[bad[k:] == bad[:-k]]


def _by_symbol(read: np.ndarray, words: int) -> np.ndarray:
    """For each symbol (after its rank), word and pair: the places of the symbol in the read, a bit each."""
    symbols = np.unique(read)
    symbols = symbols[symbols != 0]
    wide = np.zeros((len(read), words * 64), np.uint8)
    wide[:, : read.shape[1]] = read
    bits = [np.packbits(wide == s, axis=1, bitorder="little").view("<u8") for s in symbols]
    rank = np.full(256, len(symbols), np.int64)
    rank[symbols] = np.arange(len(symbols))
    return np.stack([*bits, np.zeros((len(read), words), np.uint64)]).transpose(0, 2, 1).copy(), rank


def _infix(read: np.ndarray, m: np.ndarray, window: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, words = len(read), max(1, -(-read.shape[1] // 64))
    places, rank = _by_symbol(read, words)
    text, each, one, none = rank[window], np.arange(size), np.uint64(1), np.uint64(0)
    up, down = np.full((words, size), ~none), np.zeros((words, size), np.uint64)  # steps of +1 and -1 down a column
    tail_word, tail_bit = np.maximum(m - 1, 0) // 64, (np.maximum(m - 1, 0) % 64).astype(np.uint64)
    score, best, last = m.copy(), m.copy(), np.zeros(size, np.int64)
    for j in range(window.shape[1]):
        plus = minus = np.zeros(size, np.uint64)  # the step along the row above a word: none above the first
        found = places[text[:, j], :, each].T
        gain = np.zeros(size, np.int64)
        for w in range(words):
            eq, p, q = found[w], up[w], down[w]
            xv = eq | q
            eq = eq | minus
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = q | ~(xh | p), p & xh
            here = tail_word == w
            gain = np.where(here, ((ph >> tail_bit) & one).astype(np.int64) - ((mh >> tail_bit) & one).astype(np.int64), gain)
            next_plus, next_minus = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = (ph << one) | plus, (mh << one) | minus
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            plus, minus = next_plus, next_minus
        score = score + gain
        better = (score <= best) & (j < n)
        best, last = np.where(better, score, best), np.where(better, j + 1, last)
    return best, last


def infix_distances(read: np.ndarray, m: np.ndarray, window: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each read to any infix of its window, and where the last such infix ends (bit-parallel).

    64 rows of the matrix are one word, and a word of all pairs one array: a step of a column is a few operations on
    arrays. With nothing nearer the empty infix at the window's start counts, at the read's length.
    """
    parts = [_infix(read[i : i + LOT], m[i : i + LOT], window[i : i + LOT], n[i : i + LOT]) for i in range(0, len(read), LOT)]
    return tuple(np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else ((), ())))


def _extended(read: np.ndarray, m: np.ndarray, text: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """Least edit distance of each read to any prefix of its text, which begins where the read does; most + 1 beyond.

    A band of 2 * most + 1 diagonals: cell b of row i stands at column i + b - most.
    """
    band, far = 2 * most + 1, most + 1
    off = np.arange(band) - most
    wide = np.zeros((len(read), read.shape[1] + band), np.uint8)
    take = min(text.shape[1], read.shape[1] + most)
    wide[:, most : most + take] = text[:, :take]
    now = np.broadcast_to(np.where(off >= 0, off, far), (len(read), band)).astype(np.int16)
    out = np.full(len(read), far, np.int16)
    ended = m == 0
    out[ended] = 0
    steps = off.astype(np.int16)
    for i in range(1, read.shape[1] + 1):
        here = wide[:, i - 1 : i - 1 + band]
        new = now + (here != read[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], now[:, 1:] + 1)
        column = i + off
        new = np.where((column[None, :] < 0) | (column[None, :] > n[:, None]), far, new)
        new = np.minimum.accumulate(new - steps, axis=1) + steps  # further along the row at one a step
        new = np.where(column[None, :] > n[:, None], far, np.minimum(new, far)).astype(np.int16)
        now = new
        ended = m == i
        if ended.any():
            out[ended] = now[ended].min(1)
    return out


def anchored_distances(read: np.ndarray, m: np.ndarray, window: np.ndarray, n: np.ndarray, at: np.ndarray, place: np.ndarray, k: int | np.ndarray, most: int) -> np.ndarray:
    """Edit distance of each read whose k bases from `at` stand in its window from `place`: what comes before and after
    them is aligned apart, with free ends in the window. Beyond `most` it is most + 1.
    """
    out = np.zeros(len(read), np.int64)
    for i in range(0, len(read), LOT):
        r, w, a, p, mm, nn, kk = (x[i : i + LOT] for x in (read, window, at, place, m, n, np.broadcast_to(k, len(read))))
        before = _extended(*_cut(r, np.zeros_like(a), a, True), *_cut(w, np.zeros_like(p), p, True), most)
        after = _extended(*_cut(r, a + kk, mm, False), *_cut(w, p + kk, nn, False), most)
        out[i : i + LOT] = np.minimum(before.astype(np.int64) + after, most + 1)
    return out


def _cut(text: np.ndarray, first: np.ndarray, last: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each row's symbols from `first` to before `last`, from the end on with `back`; and how many."""
    size = np.maximum(last - first, 0)
    step = np.arange(int(size.max(initial=0)))[None, :]
    at = (last[:, None] - 1 - step) if back else (first[:, None] + step)
    ok = step < size[:, None]
    return np.where(ok, np.take_along_axis(text, np.clip(at, 0, max(text.shape[1] - 1, 0)), 1) if text.shape[1] else 0, 0).astype(np.uint8), size


def pair_counts(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How often each of the sixteen pairs of neighbouring bases stands in each row from `first` to before `last`."""
    c = _CODE[text].astype(np.int64)
    if text.shape[1] < 2:
        return np.zeros((len(text), 16), np.int64)
    place = np.arange(text.shape[1] - 1)[None, :]
    ok = (c[:, :-1] < 4) & (c[:, 1:] < 4) & (place >= first[:, None]) & (place + 1 < last[:, None])
    row = np.nonzero(ok)[0]
    return np.bincount(row * 16 + (c[:, :-1] * 4 + c[:, 1:])[ok], minlength=len(text) * 16).reshape(len(text), 16)


def could_align(read: np.ndarray, m: np.ndarray, window: np.ndarray, n: np.ndarray, lead: np.ndarray, most: int) -> np.ndarray:
    """The count filter: whether the pairs of a read and of as many bases of its window (from `lead`) differ so little
    that `most` errors can explain it.

    One error changes no more than four counts, and moves an end of the read's place by no more than one base, which
    changes one: nothing within `most` errors is lost.
    """
    return np.abs(pair_counts(read, np.zeros_like(m), m) - pair_counts(window, lead, np.minimum(lead + m, n))).sum(1) <= 5 * most


def alignments(read: np.ndarray, m: np.ndarray, window: np.ndarray, last: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Traceback of infix_distances(): where each infix begins, and the extended CIGAR.

    Only a band about the diagonal that ends at `last` is filled, of all pairs at once; going back, a match or mismatch
    comes before an insertion, that before a deletion.
    """
    starts, told = np.zeros(len(read), np.int64), []
    for lot in range(0, len(read), LOT):
        s = slice(lot, lot + LOT)
        first, ext = _traced(read[s], m[s], window[s], last[s], errors[s])
        starts[s] = first
        told += ext
    return starts, told


def _traced(read, m, window, last, errors):
    size, most = len(read), int(errors.max(initial=0))
    band, far = 2 * most + 1, np.int16(1 << 12)
    shift = last - m - most  # column of cell b in row i: i + b + shift
    pad = int(max(0, -shift.min(initial=0))) + 1
    wide = np.zeros((size, pad + window.shape[1] + band + 1), np.uint8)
    wide[:, pad : pad + window.shape[1]] = window
    each, cells = np.arange(size), np.arange(band)
    column = lambda i: i + cells[None, :] + shift[:, None]
    length = int(m.max(initial=0))
    d = np.full((length + 1, size, band), far, np.int16)
    d[0] = np.where(column(0) >= 0, 0, far)
    steps = cells.astype(np.int16)
    for i in range(1, length + 1):
        c = column(i)
        here = np.take_along_axis(wide, np.clip(c - 1 + pad, 0, wide.shape[1] - 1), 1)
        new = d[i - 1] + (here != read[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], d[i - 1][:, 1:] + 1)
        new = np.where(c >= 0, new, far)
        new = np.where(c == 0, i, new)
        d[i] = np.minimum(np.minimum.accumulate(new - steps, axis=1) + steps, far)
    i, b = m.copy(), np.full(size, most)
    out = np.zeros((size, 2 * (length + band)), np.uint8)
    step, none = 0, np.uint8(0)
    while (i > 0).any():
        open_ = i > 0
        base, col = read[each, np.maximum(i - 1, 0)], i + b + shift
        ref = wide[each, np.clip(col - 1 + pad, 0, wide.shape[1] - 1)]
        value, above = d[i, each, b], d[np.maximum(i - 1, 0), each, b]
        same = base == ref
        diagonal = open_ & (col > 0) & (value == above + ~same)
        left = d[np.maximum(i - 1, 0), each, np.minimum(b + 1, band - 1)]
        insert = open_ & ~diagonal & (b + 1 < band) & (value == left + 1)
        delete = open_ & ~diagonal & ~insert
        # written from the end on: the symbol first, its sign before it
        out[:, 2 * step] = np.where(diagonal, np.where(same, ord("."), ref), np.where(insert, base, np.where(delete, ref, none)))
        out[:, 2 * step + 1] = np.where(insert, ord("#"), np.where(delete, ord("^"), none))
        i = i - (diagonal | insert)
        b = b + insert - delete
        step += 1
    ext = [r[r != 0][::-1].tobytes().decode("latin-1") for r in out]
    return b + shift, ext
