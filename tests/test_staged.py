"""Batched kernels against plain ones, and the staged search on planted reads."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from strandloom.functions import kernels as K
from strandloom.functions.alignment import infix_alignment
from strandloom.operators import seeding, staged
from strandloom.plans.align import align
from strandloom.plans.config import AlignConfig, segments, stages

TURN = str.maketrans("ACGT", "TGCA")


def dna(rng, n: int, letters: str = "ACGT") -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def changed(rng, s: str, n: int) -> str:
    s = list(s)
    for _ in range(n):
        k, kind = rng.randrange(len(s)) if s else 0, rng.random()
        if kind < 0.4 and s:
            s[k] = rng.choice("ACGT")
        elif kind < 0.7 or not s:
            s.insert(k, rng.choice("ACGT"))
        else:
            del s[k]
    return "".join(s)


def swap(s: str, *at: int) -> str:
    return "".join("CGTA"["ACGT".index(c)] if k in at else c for k, c in enumerate(s))


def test_bit_parallel_distances_and_tracebacks_equal_plain_ones():
    """Lengths about the limits of words, windows shorter than reads, Ns, reads far from their windows."""
    rng, reads, windows = random.Random(1), [], []
    for _ in range(2000):
        n = rng.choice([1, 2, 5, 30, 63, 64, 65, 100, 127, 128, 130, 200])
        w = dna(rng, max(1, n + rng.randrange(-3, 14)), "ACGTACGTACGTN")
        a = rng.randrange(max(1, len(w) - n + 1))
        reads.append(dna(rng, n) if rng.random() < 0.1 else changed(rng, w[a : a + n], rng.choice([0, 0, 1, 2, 3, 5, 9])) or "A")
        windows.append(w)
    (r, m), (w, n) = K.rows(pd.Series(reads)), K.rows(pd.Series(windows))
    errors, last = K.infix_distances(r, m, w, n)
    first, ext = K.alignments(r, m, w, last, errors)
    got = list(zip(errors.tolist(), first.tolist(), last.tolist(), ext))
    assert got == [infix_alignment(a, b) for a, b in zip(reads, windows)]
    assert [len(x) for x in K.infix_distances(*K.rows(pd.Series([], dtype=str)), *K.rows(pd.Series([], dtype=str)))] == [0, 0]


def test_bit_parallel_on_100_000_pairs():
    """Against the plain recurrence, itself over all pairs at once; and ten times as fast as one pair after another."""
    rng = np.random.default_rng(2)
    size, m, n = 100_000, 40, 48
    window = rng.choice(np.frombuffer(b"ACGT", np.uint8), (size, n))
    read = window[:, 4 : 4 + m].copy()
    spoiled = rng.random((size, m)) < rng.choice([0, 0.05, 0.2, 1.0], size)[:, None]
    read[spoiled] = rng.choice(np.frombuffer(b"ACGT", np.uint8), int(spoiled.sum()))
    began = time.perf_counter()
    got, last = K.infix_distances(read, np.full(size, m), window, np.full(size, n))
    each = (time.perf_counter() - began) / size
    row = np.zeros((n + 1, size), np.int16)
    for i in range(1, m + 1):
        new = np.empty_like(row)
        new[0] = i
        for j in range(1, n + 1):
            new[j] = np.minimum(np.minimum(row[j], new[j - 1]) + 1, row[j - 1] + (read[:, i - 1] != window[:, j - 1]))
        row = new
    assert (got == row.min(0)).all() and (last == n - row[::-1].argmin(0)).all()
    began = time.perf_counter()
    for i in range(300):
        infix_alignment(read[i].tobytes().decode(), window[i].tobytes().decode())
    assert (time.perf_counter() - began) / 300 > 10 * each


def test_free_ends_around_a_seed_and_the_count_filter():
    def one_side(a: str, b: str) -> int:
        d = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, e in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (c != e))
        return min(d)

    rng, most, k, rows = random.Random(4), 4, 12, []
    for _ in range(2000):
        size = rng.choice([20, 60, 100])
        ref = dna(rng, size + 2 * most)
        core, at = ref[most : most + size], rng.randrange(size - k + 1)
        x, y = (changed(rng, s, rng.choice([0, 1, 2, 3])) for s in (core[:at], core[at + k :]))
        rows.append((x + core[at : at + k] + y, ref, len(x), most + at))
    (r, m), (w, n) = K.rows(pd.Series([x[0] for x in rows])), K.rows(pd.Series([x[1] for x in rows]))
    at, place = (np.array([x[i] for x in rows]) for i in (2, 3))
    got = K.anchored_distances(r, m, w, n, at, place, k, most)
    want = np.array([min(one_side(a[:s][::-1], b[:p][::-1]) + one_side(a[s + k :], b[p + k :]), most + 1) for a, b, s, p in rows])
    assert (got == want).all() and len(set(want.tolist())) == most + 2
    assert K.could_align(r, m, w, n, place - at, most)[want <= most].all()
    far = K.rows(pd.Series(["ACGT" * 15] * 50)), K.rows(pd.Series([dna(rng, 68) for _ in range(50)]))
    assert K.could_align(*far[0], *far[1], np.full(50, 4), 2).mean() < 0.1


def test_seeds_of_two_sizes_in_more_pairs_than_a_lot():
    rng = random.Random(8)
    ref = dna(rng, 60)
    read = ref[2:40] + ref[41:58]
    for size in (K.LOT - 1, K.LOT + 1, 2 * K.LOT + 7):
        k = np.array([9, 18] * size)[:size]
        (r, m), (w, n) = K.rows(pd.Series([read] * size)), K.rows(pd.Series([ref] * size))
        got = K.anchored_distances(r, m, w, n, np.zeros(size, np.int64), np.full(size, 2), k, 3)
        assert len(got) == size and (got == 1).all()


def test_coded_seeds_are_those_of_the_text_index(spark):
    rng = random.Random(6)
    contigs = spark.createDataFrame([(1, dna(rng, 40_000)), (2, dna(rng, 300, "ACGTN")), (3, "ACG"), (4, ""), (5, dna(rng, seeding.CHUNK + 17))], "contig_id long, seq string")
    pieces = seeding.chunks(contigs)
    want = seeding.seed_index(pieces, 18).select(seeding.seed_code("seed").alias("seed"), "contig_id", "pos")
    got = seeding.coded_index(pieces, 18)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 56_000
    some = want.where("pos % 1000 = 7").select("seed")
    assert {tuple(r) for r in seeding.matched_index(pieces, some, 18).collect()} == {tuple(r) for r in seeding.matched_index(pieces, some, 18, got).collect()}
    assert seeding.matched_index(pieces, some.limit(0), 18).count() == 0


def test_plan_by_length():
    assert staged.plan([100], 5, 18) == stages(5) == [0, 1, 2, 5]
    assert staged.plan([30], 3, 18) == [0, 1, 2] and staged.plan([7], 3, 18) == [] and staged.plan([100, 9], 3, 18, "all") == [0, 3]
    assert [staged.seed_of(n, 3, 18) for n in (72, 71, 36, 35, 32, 31)] == [18, 9, 9, 8, 8, None]
    assert segments(101, 2) == [(0, 34), (34, 68), (68, 101)]


def test_stages_and_substages(spark):
    """Reads leave with the stage that solves them; a segment with N is left to the others; equal-length windows would
    miss the indel near an end."""
    rng = random.Random(8)
    ref = dna(rng, 30_000)
    at = seeding.CHUNK - 40  # over the end of a chunk
    read = ref[at : at + 100]
    reads = [
        (1, read, 0, 0, 0), (2, swap(read, 10), 1, 1, 1), (3, swap(read, 90), 1, 1, 0), (4, swap(read, 5, 50), 2, 2, 2), (5, "N" + read[1:], 1, 1, 0), (6, "N" * 3 + read[3:], 3, 3, 0), (7, read[:97] + read[98:], 1, 1, 0),
        (8, read[:3] + "T" + ("" if read[3] == "T" else "") + read[3:], 1, 1, 1), (9, swap(read, 3, 30, 60, 90), 4, None, None), (10, ref[-100:], 0, 0, 0), (11, "GATTACA" * 2 + ref[:86], None, None, None), (12, "CC" + ref[:98], 2, 2, 1),
    ]
    contigs = spark.createDataFrame([(7, ref)], "contig_id long, seq string")
    df = spark.createDataFrame([(r[0], r[1][::-1].translate(TURN) if r[0] % 2 else r[1]) for r in reads], "read_id long, seq string")
    got = {r.read_id: r for r in staged.search(df, contigs, AlignConfig(sensitive=False), 3).groupBy("read_id", "strand").agg({"ed": "min", "stage": "min", "substage": "min"}).collect()}
    for i, seq, ed, stage, substage in reads:
        if stage is None:
            assert i not in got
        else:
            r = got[i]
            assert (r.strand, r["min(ed)"], r["min(stage)"]) == ("-" if i % 2 else "+", ed, stage), (i, r)
            if not i % 2:  # a turned read has its segments from the other end
                assert r["min(substage)"] == substage, (i, r)
    wide = {r.read_id: r.ed for r in align(df, contigs, AlignConfig(errors=3, sensitive=True)).collect()}
    assert wide[9] == 4 and set(got) <= set(wide)  # a sensitive stage verifies beyond its errors


@pytest.mark.parametrize("hot", [50, 10**9])
def test_a_seed_with_100_000_places(spark, hot):
    """Reads with one segment in a repeat, with all but one block in it, and wholly in it."""
    rng = random.Random(9)
    seed = dna(rng, 18)
    copies = 100_000 if hot == 50 else 500
    parts = [seed + dna(rng, 3) for _ in range(copies)]
    home = dna(rng, 200)
    pure = seed * 6
    ref = "".join(parts[: copies // 2]) + home[:60] + seed + home[60:] + "".join(parts[copies // 2 :]) + home[::-1] + pure + home[:50]
    place = ref.index(home[:60])
    reads = [(1, ref[place + 20 : place + 128], 0), (2, swap(ref[place + 20 : place + 128], 5, 100), 2), (3, ref[place + 40 : place + 60] + seed + ref[place + 78 : place + 130], 0), (4, pure[:100], 0)]
    contigs = spark.createDataFrame([(1, ref), (2, dna(rng, 500))], "contig_id long, seq string")
    df = spark.createDataFrame([r[:2] for r in reads], "read_id long, seq string")
    got = staged.search(df, contigs, AlignConfig(sensitive=False, mode="all"), 3, hot=hot)
    found = {r.read_id: r.ed for r in got.groupBy("read_id").agg({"ed": "min"}).withColumnRenamed("min(ed)", "ed").collect()}
    assert found == {i: ed for i, _, ed in reads}


def test_repeats_cost_one_more_pass_over_the_reference(spark, monkeypatch):
    rng, passes = random.Random(9), []
    ref = dna(rng, 4000)
    whole = seeding.coded_places
    monkeypatch.setattr(seeding, "coded_places", lambda *a: (passes.append(sorted(a[1])), whole(*a))[1])
    monkeypatch.setattr(seeding, "coded_index", lambda *a, **b: passes.append("index"))
    reads = spark.createDataFrame([(1, ref[200:290]), (2, ref[900:945] + "A" + ref[945:1000])], "read_id long, seq string")
    contigs = spark.createDataFrame([(i, ref) for i in range(4)], "contig_id long, seq string")
    found = staged.search(reads, contigs, AlignConfig(sensitive=False), 3, hot=2).select("read_id", "contig_id", "ed").distinct().collect()
    assert sorted(map(tuple, found)) == [(1, i, 0) for i in range(4)] + [(2, i, 1) for i in range(4)]
    assert passes == [[9, 18], [9, 18]] or passes == [[18], [18]]


def test_nothing_to_search(spark):
    contigs = spark.createDataFrame([(1, "ACGT" * 30)], "contig_id long, seq string")
    for rows in ([], [(1, "ACG")], [(1, "N" * 50)]):
        df = spark.createDataFrame(rows, "read_id long, seq string")
        assert staged.search(df, contigs, AlignConfig(), 2).count() == 0
        assert align(df, contigs, AlignConfig(errors=2)).count() == 0
    assert staged.search(spark.createDataFrame([(1, "ACGT" * 9)], "read_id long, seq string"), contigs.limit(0), AlignConfig(), 2).count() == 0
