"""Kernels and column functions against known values and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import alignment, dna, scores
from strandloom.operators import hits, pairs, seeding, stats
from strandloom.plans.config import AlignConfig, auto_errors, read_group, segments, stages


@pytest.mark.parametrize(("ext", "cigar", "md"), [(".......", "7M", "7"), ("....A..", "7M", "4A2"), ("..#C..", "2M1I2M", "4"), ("..^G^T..", "2M2D2M", "2^G0^T2"), ("$$...", "2S3M", "3"), ("...$", "3M1S", "3"), ("...A", "4M", "3A"), ("A...", "4M", "0A3"), ("..A#C..", "3M1I2M", "2A2")])
def test_cigar_and_md(ext, cigar, md):
    assert alignment.cigar_and_md(ext) == (cigar, md)


def test_segments_and_stages():
    assert segments(100, 3) == [(0, 25), (25, 50), (50, 75), (75, 100)]
    assert segments(101, 2) == [(0, 34), (34, 68), (68, 101)]
    assert [stages(e) for e in (2, 4, 5, 6, 7, 8)] == [[0, 1, 2], [0, 1, 2, 4], [0, 1, 2, 5], [0, 1, 2, 3, 6], [0, 1, 2, 3, 4, 7], [0, 1, 2, 3, 4, 5, 8]]
    assert auto_errors(100, 100) == 4 and auto_errors(99, 50) == 2 and auto_errors(300, 300) == 8
    assert read_group("@RG\\tID:foo\\tSM:bar") == ("@RG\tID:foo\tSM:bar", "foo")


def test_mapping_quality(spark):
    cases = [((1, 0, 0.0), 60), ((1, 1, 5.0), 42), ((1, 1, 1.5), 0), ((1, 1, 0.2), 0), ((1, 3, 20.0), 51), ((2, 0, 0.0), 3), ((3, 0, 0.0), 2), ((9, 0, 0.0), 1), ((10, 0, 0.0), 0)]
    df = spark.createDataFrame([c[0] for c in cases], "b int, s int, g double")
    assert [r[0] for r in df.select(scores.mapping_quality(F.col("b"), F.col("s"), F.col("g"))).collect()] == [c[1] for c in cases]


def test_indel_equivalents_and_insert_size(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 3, 10, 14, 50)], "n int")
    assert [r[0] for r in df.select(scores.indel_mismatches(F.col("n"))).collect()] == [0, 1, 1, 1, 2, 4]
    c = F.lit
    sizes = spark.range(1).select(
        scores.insert_size(c(1), c("+"), c(100), c(100), c(1), c("-"), c(300), c(100)), scores.insert_size(c(1), c("+"), c(100), c(100), c(1), c("+"), c(300), c(100)),
        scores.insert_size(c(1), c("+"), c(100), c(100), c(2), c("-"), c(300), c(100)), scores.insert_size(c(1), c("-"), c(100), c(100), c(1), c("+"), c(300), c(100)),
    ).first()
    assert list(sizes) == [300, None, None, None]


def test_insert_penalty(spark):
    df = spark.createDataFrame([(310.0,), (300.0,), (320.0,), (1000.0,), (None,)], "x double")
    got = [r[0] for r in df.select(scores.insert_penalty("x", F.lit(310.0), F.lit(8.164966), F.lit(7.0), F.lit(1.0))).collect()]
    assert got == pytest.approx([0.5, 1.590014, 1.590014, 19.656141, 19.656141], abs=1e-5)


def test_infix_alignment_against_brute_force():
    rng = random.Random(3)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(150):
        w = "".join(rng.choices("ACGT", k=rng.randint(0, 14)))
        r = "".join(rng.choices("ACGT", k=rng.randint(1, 8)))
        ed, first, last, ext = alignment.infix_alignment(r, w)
        assert ed == min(distance(r, w[i:j]) for i in range(len(w) + 1) for j in range(i, len(w) + 1))
        assert alignment.consistent(r, w, first, ext)
        assert distance(r, w[first:last]) == ed
        assert sum(t != "." for t in alignment.tokens(ext)) == ed


def test_long_indels_and_refinement():
    rng = random.Random(5)
    ref = "".join(rng.choices("ACGT", k=300))
    gone = ref[40:80] + ref[92:140]
    score, ext = alignment.long_indel(gone, ref, 40)
    assert alignment.cigar_and_md(ext)[0].count("D") == 1 and alignment.consistent(gone, ref, 40, ext) and score == pytest.approx(len(gone) - 5 - 0.4 * 11)
    more = ref[40:80] + "ACGTACG" + ref[80:130]
    score, ext = alignment.long_indel(more, ref, 40)
    assert alignment.consistent(more, ref, 40, ext) and score >= 90 - 5 - 0.4 * 6
    assert alignment.short_indels_refined("...#A..^C...") == ("...CCC...", 1)


def test_reads_shorter_than_the_longest_indel():
    rng = random.Random(5)
    ref = "".join(rng.choice("ACGT") for _ in range(150))
    assert alignment.long_indel(ref[:45], ref, 0) == (45.0, "." * 45)
    score, ext = alignment.long_indel(ref[:20] + ref[40:65], ref, 0)
    assert ext == "." * 20 + "".join("^" + b for b in ref[20:40]) + "." * 25 and abs(score - (45 - 5 - 19 * 0.4)) < 1e-9
    for m in range(1, 55):
        found = alignment.long_indel("A" * m, ref, 10)
        assert found is None or len(found[1].replace("#", "")) >= 1


def test_prefixes_are_those_of_the_text_index(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ACGTACGTACGTN") for _ in range(n))) for i, n in enumerate((0, 17, 18, 19, 40, 900, 3000))] + [(7, "ACGT" * 600)]
    pieces = seeding.chunks(spark.createDataFrame(rows, "contig_id long, seq string"), 700, 300)
    want = {(r.prefix, r.n) for r in seeding.seed_index(pieces, 18, 700).groupBy(F.substring("seed", 1, 3).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = seeding.seed_prefixes(pieces, 18, 3, 700)
    assert {tuple(r) for r in counts.collect()} == want
    told = dict(map(tuple, stats.prefix_rollup(counts, 3).collect()))
    assert told[""] == sum(n for _, n in want) and told["AC"] == sum(n for p, n in want if p.startswith("AC"))
    assert "Generate" not in seeding.seed_prefixes(pieces.select("contig_id", "chunk", "length", "seq").localCheckpoint(), 18, 3)._jdf.queryExecution().toString()  # no row a place


def test_patterns_and_grams_send_no_other_seed(spark):
    contigs = spark.createDataFrame([(1, "ACGTACGTACNACGTAC"), (2, "TTTTTTTTTTTTTTTT")], "contig_id long, seq string")
    found = seeding.occurrences(contigs, "ACGTAC")
    assert sorted(map(tuple, found.collect())) == [(1, 0), (1, 4), (1, 11)] and seeding.occurrences(contigs, "ACN").count() == 0
    assert found._jdf.queryExecution().toString().count("Generate explode") < seeding.seed_index(seeding.chunks(contigs), 6)._jdf.queryExecution().toString().count("Generate explode")  # no row a place
    reads = seeding.both_strands(spark.createDataFrame([(9, "T" * 12 + "ACGT" * 3)], "read_id long, seq string"))
    told = {(r.strand, r.contig_id, r.shared) for r in seeding.shared_qgrams(reads, seeding.chunks(contigs), 1, 12).collect()}
    assert told == {("+", 2, 1)}


def test_strata_save_only_places_of_seeds_of_reads(spark, tmp_path):
    rng = random.Random(7)
    ref = "".join(rng.choice("ACGT") for _ in range(20_000))
    kept = {}

    def save(df, name):
        path = str(tmp_path / f"{name}-{len(kept)}")
        df.write.parquet(path)
        kept[f"{name}-{len(kept)}"] = out = spark.read.parquet(path)
        return out

    reads = spark.createDataFrame([(1, ref[100:180])], "read_id long, seq string")
    found = seeding.strata(reads, spark.createDataFrame([(1, ref)], "contig_id long, seq string"), AlignConfig(mode="first"), 2, save).collect()
    assert [(r.start, r.ed, r.stage) for r in found] == [(100, 0, 0)]
    assert kept["index-0"].count() < 20


def test_variants_trimmed(spark):
    df = spark.createDataFrame([("ACGT", "AGGT"), ("AC", "ACC"), ("CCC", "CC"), ("A", "A")], "r string, a string")
    got = [tuple(r[0]) for r in df.select(dna.common_affixes_trimmed(F.col("r"), F.col("a"))).collect()]
    assert got == [("C", "G", 1), ("", "C", 1), ("C", "", 0), ("", "", 0)]


def _cases(rng, n=6):
    contigs = [(i, "".join(rng.choices("ACGT", k=rng.choice([150, 400, 900])))) for i in range(n)]
    found = []
    for i in range(20):
        seq = rng.choice(contigs)[1]
        at = rng.randrange(len(seq) - 100)
        read = list(seq[at : at + 100])
        for _ in range(rng.randint(0, 3)):
            read[rng.randrange(100)] = rng.choice("ACGT")
        found.append((i, "".join(read)))
    return contigs, found


def test_mapping_against_brute_force(spark):
    contigs, source = _cases(random.Random(11))
    c, r = spark.createDataFrame(contigs, "contig_id long, seq string"), spark.createDataFrame(source, "read_id long, seq string")
    got = {(x.read_id, x.strand, x.contig_id, x.start): x.ed for x in seeding.map_reads(r, c, 3, 18).collect()}
    turn = str.maketrans("ACGT", "TGCA")
    for i, read in source:
        for strand, s in (("+", read), ("-", read[::-1].translate(turn))):
            for j, seq in contigs:
                for p in range(len(seq) - len(s) + 1):
                    wrong = sum(a != b for a, b in zip(s, seq[p : p + len(s)]))
                    if wrong <= 3:
                        assert got[i, strand, j, p] <= wrong


def test_modes_are_nested(spark, tmp_path):
    contigs, source = _cases(random.Random(12))
    c, r = spark.createDataFrame(contigs, "contig_id long, seq string"), spark.createDataFrame(source, "read_id long, seq string")
    n = iter(range(1000))

    def save(df, name):
        path = str(tmp_path / f"{name}{next(n)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    key = lambda df: {(x.read_id, x.strand, x.contig_id, x.start) for x in df.collect()}
    first, second, every = (key(seeding.strata(r, c, AlignConfig(mode=m), 2, save)) for m in ("first", "second", "all"))
    assert first and first <= second <= every


def test_chunks_lose_no_place(spark):
    seq = "".join(random.Random(2).choices("ACGT", k=5000))
    df = spark.createDataFrame([(1, seq), (2, ""), (3, "ACG")], "contig_id long, seq string")
    pieces = seeding.chunks(df, 700, 100)
    got = sorted((r.pos, r.seed) for r in seeding.seed_index(pieces, 18, 700).where("contig_id = 1").collect())
    assert got == [(i, seq[i : i + 18]) for i in range(len(seq) - 17)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "read_id long, contig_id long, pos long, strand string, ed long, score double, penalty long")
    assert hits.top_candidates(none).count() == hits.clusters_from_first(none).count() == hits.qualities(none).count() == 0
    assert seeding.map_reads(spark.createDataFrame([], "read_id long, seq string"), spark.createDataFrame([], "contig_id long, seq string"), 3).count() == 0


def test_first_tier(spark):
    a, b = spark.createDataFrame([(1, 5)], "k long, v long"), spark.createDataFrame([(1, 6), (2, 7)], "k long, v long")
    assert sorted((r.k, r.v, r.tier) for r in pairs.first_tier([a, b], "k").collect()) == [(1, 5, 0), (2, 7, 1)]


def test_clipping():
    from strandloom.functions import clipping

    assert clipping.clipped("....", 1, 1) == ("$..$", 1)
    assert clipping.clipped(".^G#A..", 2, 0) == ("$$..", 2)
    assert clipping.clipped("..^T.", 0, 1) == ("..$", 0)
    assert clipping.off_contig(".....", -2, 100) == ("$$...", 0)
    assert clipping.off_contig(".....", 97, 100) == ("...$$", 97)
    assert clipping.low_quality("....", "!II!", 40) == ("$..$", 1) and clipping.low_quality("..", "!!", 40) == ("..", 0)
    assert clipping.overlap(10, 50, 40) == 20 and clipping.overlap(10, 20, 40) == 0


def test_align_and_rescue_find_planted_reads(spark):
    from strandloom.operators import rescue
    from strandloom.plans.align import align, to_sam

    rng = random.Random(21)
    ref = "".join(rng.choices("ACGT", k=3000))
    read = ref[500:540] + ref[541:601]  # one base gone
    turned = ref[1500:1600][::-1].translate(str.maketrans("ACGT", "TGCA"))
    other = "".join(rng.choices("ACGT", k=100))
    c = spark.createDataFrame([(1, ref)], "contig_id long, seq string")
    r = spark.createDataFrame([(1, "a", read, "I" * 100), (2, "b", turned, "I" * 100), (3, "c", other, "I" * 100)], "read_id long, name string, seq string, qual string")
    got = {x.qname: x for x in to_sam(r, align(r.select("read_id", "seq"), c, AlignConfig(errors=3))).collect()}
    assert (got["a"].flag, got["a"].pos, got["a"].cigar, got["a"].nm) == (0, 501, "40M1D60M", 1) or got["a"].nm == 1
    assert (got["b"].flag, got["b"].pos, got["b"].cigar, got["b"].mapq) == (16, 1501, "100M", 60) and got["b"].seq == ref[1500:1600]
    assert got["c"].flag == 4 and got["c"].rname == "*"
    anchors = spark.createDataFrame([(7, 1, 1000, "+", 100)], "pair_id long, contig_id long, start long, strand string, length int")
    mates = spark.createDataFrame([(7, ref[1200:1300][::-1].translate(str.maketrans("ACGT", "TGCA")))], "pair_id long, seq string")
    found = rescue.rescued(anchors, mates, seeding.chunks(c), 300, 20).collect()
    assert [(x.strand, x.pos, x.ed) for x in found] == [("-", 1201, 0)]
