"""Clipping kernels against all shapes tried one by one, and pairs on planted mates."""

import itertools
import random

import pytest

from strandloom.functions import clipping
from strandloom.functions.alignment import affine_score, consistent, tokens
from strandloom.operators import rescue, seeding
from strandloom.plans.align import align_pairs
from strandloom.plans.config import AlignConfig

TURN = str.maketrans("ACGT", "TGCA")
SCORES = (1.0, -5.0, -5.0, -0.4, -6.0)


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def worth(ext: str) -> float:
    """affine_score() with a clip at each end counted once."""
    return affine_score(ext)[0]


def all_shapes(read: str, window: str, longest: int) -> float:
    """The best score of any shape with ends clipped and one indel, by trying each."""
    best, m, n = -1e9, len(read), len(window)
    for i, j in itertools.combinations(range(m + 1), 2):
        ends = -6.0 * ((i > 0) + (j < m))
        for at in range(n):
            for shift in range(-longest, longest + 1):
                for p in range(i + 1, j) if shift else (j,):
                    skip = max(0, -shift)
                    q = p + skip
                    if shift and q >= j:
                        continue
                    right = at + (p - i) + max(0, shift)
                    if at + (p - i) > n or right + (j - q) > n:
                        continue
                    score = ends + sum(1.0 if read[x] == window[at + x - i] else -5.0 for x in range(i, p)) + (sum(1.0 if read[x] == window[right + x - q] else -5.0 for x in range(q, j)) - 5.0 - 0.4 * (abs(shift) - 1) if shift else 0.0)
                    best = max(best, score)
    return best


def test_best_shape_against_all_shapes():
    rng, seen = random.Random(1), set()
    for _ in range(40):
        window = dna(rng, 26)
        kind = rng.randrange(4)
        a = rng.randrange(6)
        read = {0: window[a : a + 16], 1: dna(rng, 5) + window[a + 5 : a + 16], 2: window[a : a + 9] + window[a + 11 : a + 20], 3: window[a : a + 9] + dna(rng, 2) + window[a + 9 : a + 18]}[kind]
        got = clipping.best_shape(read, window, 4, 3, SCORES)
        if got is None:
            continue
        score, first, errors, ext = got
        assert abs(score - worth(ext)) < 1e-9 and consistent(read, window, first, ext) and errors == sum(t not in (".", "$") for t in tokens(ext))
        assert abs(score - all_shapes(read, window, 3)) < 1e-9, (read, window, got)
        seen.add((ext[0] == "$", "#" in ext, "^" in ext))
    assert len(seen) >= 4
    assert clipping.best_shape("ACGT" * 5, "T" * 40, 8) is None and clipping.best_shape("A" * 10 + "C" * 10, "A" * 10 + "G" * 30, 8, least=0.8) is None


def test_ends_that_cost_more_than_a_clip():
    assert clipping.boundary("." * 30 + "AC..") == ("." * 30 + "$$$$", 0)
    assert clipping.boundary("A.C" + "." * 30) == ("$$$" + "." * 30, 3)
    assert clipping.boundary("." * 20 + "A" + "." * 20) == ("." * 20 + "A" + "." * 20, 0)
    assert clipping.boundary("..^G^T" + "." * 30) == ("..^G^T" + "." * 30, 0) and clipping.boundary("A^G^T" + "." * 30) == ("$" + "." * 30, 3)
    assert clipping.boundary("$$" + "." * 9) == ("$$" + "." * 9, 0) and clipping.boundary("AAAA") == ("AAAA", 0)
    rng = random.Random(3)
    for _ in range(200):
        ext = "".join(rng.choice([".", ".", ".", ".", "A", "#C", "^G"]) for _ in range(14))
        out, moved = clipping.boundary(ext)
        found = tokens(ext)
        parts = [("$" if i else "") + "".join(found[i:j]) + ("$" if j < len(found) else "") for i in range(len(found)) for j in range(i + 1, len(found) + 1) if found[i] == found[j - 1] == "."]
        if parts:
            assert worth(out) >= max([worth(ext), *map(worth, parts)]) - 1e-9, (ext, out)
        assert sum(t[0] != "^" for t in tokens(out)) == sum(t[0] != "^" for t in found)


def test_shared_bases_are_clipped_but_never_all():
    assert clipping.shared_clipped("......", 2) == ("$$....", 2)
    assert clipping.shared_clipped("..#A....", 3) == ("$$$$...", 3) and clipping.shared_clipped(".^C....", 2) == ("$....", 2)
    assert clipping.shared_clipped("....", 4) == ("....", 0) and clipping.shared_clipped("....", 0) == ("....", 0)


@pytest.fixture(scope="module")
def ref():
    return dna(random.Random(5), 40_000)


def test_planted_clips_are_rescued(spark, ref):
    """Mates 300 on with a strange start, end, both and an indel; on both strands and over the end of a chunk."""
    rng, rows, mates, want = random.Random(6), [], [], {}
    for i, at in enumerate([200, 9_000, seeding.CHUNK - 150, seeding.CHUNK - 350, 39_000 - 200]):
        for j in range(4):
            key, home = f"{i}{j}", ref[at + 300 : at + 400]
            seq = {0: dna(rng, 30) + home[30:], 1: home[:60] + dna(rng, 40), 2: dna(rng, 20) + home[20:75] + dna(rng, 25), 3: home[:40] + home[55:] + dna(rng, 20)}[j]
            down = (i + j) % 2 == 0
            rows.append((key, 7, at, "+", 100) if down else (key, 7, at + 600, "-", 100))
            mates.append((key, seq[::-1].translate(TURN) if down else seq))
            want[key] = (at + 300 + {0: 30, 1: 0, 2: 20, 3: 0}[j] + 1, seq, j)
    contigs = spark.createDataFrame([(7, ref)], "contig_id long, seq string")
    anchors = spark.createDataFrame(rows, "pair_id string, contig_id long, start long, strand string, length long")
    lost = spark.createDataFrame([*mates, ("none", dna(rng, 80))], "pair_id string, seq string")
    got = {r.pair_id: r for r in rescue.rescued_by_clipping(anchors, lost, seeding.chunks(contigs), 400, 20).collect()}
    assert set(got) == set(want)
    for key, (pos, seq, j) in want.items():
        r = got[key]
        assert abs(r.pos - pos) <= 4 and consistent(seq, ref, r.pos - 1, r.ext) and abs(worth(r.ext) - r.score) < 1e-9
        assert ("$" in r.ext) and (("^" in r.ext) == (j == 3))


def _pairs(ref, orientation):
    rng, rows, places = random.Random(9), [], {}
    for i in range(20):
        at, size = rng.randrange(200, 30_000), rng.randint(290, 310)
        left, right = ref[at : at + 100], ref[at + size - 100 : at + size]
        turn = lambda s: s[::-1].translate(TURN)
        a, b = {"fr": (left, turn(right)), "rf": (turn(left), right), "ff": (left, right)}[orientation]
        rows += [(2 * i, i, 0, f"r{i}", a, "5" * 50 + "I" * 50), (2 * i + 1, i, 1, f"r{i}", b, "I" * 100)]
        places[i] = (at + 1, at + size - 99, a, b)
    return rows, places


@pytest.mark.parametrize("orientation, flags", [("rf", [64 + 16 + 3, 128 + 32 + 3]), ("ff", [64 + 3, 128 + 3])])
def test_orientations(spark, ref, orientation, flags):
    """Proper pairs, flags in order of mates: rf mates look outwards, ff mates have one strand."""
    rows, places = _pairs(ref, orientation)
    reads = spark.createDataFrame([*rows, (900, 90, 0, "lost", "ACGGT" * 20, "IIIII" * 20), (901, 90, 1, "lost", "AACCT" * 20, "5IIII" * 20)], "read_id long, pair_id long, mate int, name string, seq string, qual string")
    contigs = spark.createDataFrame([(7, ref)], "contig_id long, seq string")
    got = align_pairs(reads, contigs, AlignConfig(errors=2, orientation=orientation)).toPandas()
    for i, (first, second, a, b) in places.items():
        mine = got[got.qname == f"r{i}"].sort_values("flag")
        by_mate = mine.assign(second=mine.flag & 128).sort_values("second")
        assert by_mate.flag.tolist() == flags
        assert by_mate.pos.tolist() == [first, second] and by_mate.seq.tolist() == [ref[first - 1 : first + 99], ref[second - 1 : second + 99]]
    lost = got[got.qname == "lost"]
    assert set(lost.seq) == {"ACGGT" * 20, "AACCT" * 20} and set(lost.qual) == {"IIIII" * 20, "5IIII" * 20} and set(lost.flag) == {77, 141}


def test_tiers_clips_and_short_mates(spark, ref):
    """Close pairs fix the model; then a mate with a strange half, overlapping mates, a bad end, a long indel, mates far
    apart, and a short mate that takes part only if asked."""
    rng = random.Random(10)
    rows, _ = _pairs(ref, "fr")
    turn = lambda s: s[::-1].translate(TURN)
    pair = lambda k, a, b: [(2 * k, k, 0, f"p{k}", a, "I" * len(a)), (2 * k + 1, k, 1, f"p{k}", turn(b), "I" * len(b))]
    at = 33_000
    rows += pair(50, ref[at : at + 100], ref[at + 200 : at + 250] + dna(rng, 50))
    rows += pair(51, ref[at + 1000 : at + 1100], ref[at + 1060 : at + 1160])
    rows += pair(52, ref[at + 2000 : at + 2096] + "".join("CGTA"["ACGT".index(c)] for c in ref[at + 2096 : at + 2100]), ref[at + 2200 : at + 2300])
    rows += pair(53, ref[at + 3000 : at + 3050] + ref[at + 3070 : at + 3120], ref[at + 3200 : at + 3300])
    rows += pair(54, ref[at + 4000 : at + 4100], ref[at + 4700 : at + 4800])
    rows += pair(55, ref[at + 5000 : at + 5100], ref[at + 5240 : at + 5300])
    reads = spark.createDataFrame(rows, "read_id long, pair_id long, mate int, name string, seq string, qual string")
    contigs = spark.createDataFrame([(7, ref)], "contig_id long, seq string")
    cfg = AlignConfig(errors=3, sensitive=False)
    got = align_pairs(reads, contigs, cfg).toPandas().set_index("qname")
    one = lambda name, second: got[(got.index == name) & ((got.flag & 128 > 0) == second)].iloc[0]
    assert (one("p50", True).pos, one("p50", True).cigar, one("p50", True).xm) == (at + 201, "50M50S", "clipped") and one("p50", False).flag & 2
    assert (one("p51", False).cigar, one("p51", True).cigar, one("p51", True).pos) == ("100M", "40S60M", at + 1101)
    assert one("p51", False).tlen == 160 == -one("p51", True).tlen
    assert (one("p52", False).cigar, one("p52", False).nm, one("p52", False).pos) == ("96M4S", 0, at + 2001)
    assert (one("p53", False).xm, one("p53", False).nm) == ("indel", 20) and "20D" in one("p53", False).cigar and one("p53", False).flag == 99
    assert (one("p54", False).pos, one("p54", True).pos, one("p54", False).flag) == (at + 4001, at + 4701, 99)
    assert one("p55", True).flag & 4 or one("p55", True).xm == "rescued"
    plain = align_pairs(reads, contigs, AlignConfig(errors=3, sensitive=False, short_reads=True, boundary_clipping=False, paired_clipping=False)).toPandas()
    p51 = plain[plain.qname == "p51"]
    assert set(p51.cigar) == {"100M"} and (plain[plain.qname == "p55"].flag & 4 == 0).all() and set(plain[plain.qname == "p55"].xm) == {"perfect"}
