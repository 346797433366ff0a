"""Variant tables, FASTQ folders and streams on small files."""

import random

import pandas as pd
import pytest

from strandloom.operators import seeding
from strandloom.plans.align import align, to_sam
from strandloom.plans.config import AlignConfig
from strandloom.sources import readers, variants
from strandloom.streaming import reads as streams


def test_ranges_read_only_their_cells(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(1, 5_000_000), f"v{i}") for i in range(3000)] + [(0, 65_536, "edge"), (0, 65_535, "before")]
    table = spark.createDataFrame(rows, "contig_id long, pos long, name string")
    variants.write(table, str(tmp_path / "v"), cell=1 << 12)
    asked = [(1, 0, 100_000, 300_000), (2, 0, 65_535, 65_536), (3, 1, 10, 5), (4, 2, 4_000_000, 4_000_500), (5, 9, 1, 10)]
    spark.createDataFrame(asked, "id int, contig_id long, first long, last long").coalesce(1).write.parquet(str(tmp_path / "r"))
    ranges = spark.read.parquet(str(tmp_path / "r"))
    got = variants.within(spark, str(tmp_path / "v"), ranges)
    want = sorted((i, c, p, n) for i, contig, a, b in asked for c, p, n in rows if c == contig and a <= p <= b)
    assert sorted((r.id, r.contig_id, r.pos, r.name) for r in got.collect()) == want and len(want) > 30
    plan = got._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "GreaterThanOrEqual(pos,1)" in plan
    variants.write(table.limit(0), str(tmp_path / "none"))
    assert variants.within(spark, str(tmp_path / "v"), ranges.limit(0)).count() == 0


@pytest.mark.parametrize("cut", [False, True])
def test_masks_over_chunk_ends(spark, cut):
    rng = random.Random(2)
    refs = {1: "".join(rng.choice("ACGT") for _ in range(40_000)), 2: "ACGT"}
    contigs = spark.createDataFrame(list(refs.items()), "contig_id long, seq string")
    if cut:
        contigs = seeding.chunks(contigs)
    places = [1, 2, seeding.CHUNK - 1, seeding.CHUNK, seeding.CHUNK + 1, seeding.CHUNK + seeding.OVERLAP, seeding.CHUNK + seeding.OVERLAP + 1, 39_999, 40_000, 40_001, 90_000, 0, -5]
    rows = [(1, p) for p in places + places[:3]] + [(2, 4), (3, 1)]
    got = variants.masked(contigs, spark.createDataFrame(rows, "contig_id long, pos long")).collect()
    want = {i: "".join("N" if (i, k + 1) in set(rows) else c for k, c in enumerate(s)) for i, s in refs.items()}
    if cut:
        assert len(got) == 4 and all(r.seq == want[r.contig_id][r.chunk * seeding.CHUNK :][: seeding.CHUNK + seeding.OVERLAP] for r in got)
    else:
        assert {r.contig_id: r.seq for r in got} == want


def _record(name: str, seq: str) -> str:
    return f"@{name} more\n{seq}\n+\n{'I' * len(seq)}\n"


def test_fastq_folders_are_numbered_by_file(spark, tmp_path):
    """Files of different sizes: the order is that of their names, whatever Spark reads first; splits within a file too."""
    want = []
    (tmp_path / "in").mkdir()
    for n, size in enumerate([3, 200, 40]):
        names = [f"f{n}r{i}" for i in range(size)]
        (tmp_path / f"in/{n}.fq").write_text("".join(_record(x, "ACGT" * (1 + n)) for x in names) + "\n" * (n == 1))
        want += names
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = readers.fastq(spark, str(tmp_path / "in")).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.ordinal, r.name) for r in got] == list(enumerate(want))


def test_malformed_fastq_stops(spark, tmp_path):
    (tmp_path / "a.fq").write_text(_record("a", "ACGT") + "@b\nACGT\n+\nIII\n" + _record("c", "ACGT"))
    with pytest.raises(Exception, match="malformed record 1"):
        readers.fastq(spark, str(tmp_path / "a.fq")).collect()
    assert [r.name for r in readers.fastq(spark, str(tmp_path / "a.fq"), stop=False).orderBy("ordinal").collect()] == ["a", "c"]


def test_fastq_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    ref = "".join(rng.choice("ACGT") for _ in range(3000))
    contigs = spark.createDataFrame([(1, ref)], "contig_id long, seq string")
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / f"in/{n}.fq").write_text("".join(_record(f"f{n}r{i}", ref[a : a + 80]) for i, a in enumerate(rng.randrange(2900) for _ in range(5))))
    streams.fastq_to_sam(streams.arriving_fastq(spark, str(tmp_path / "in"), 1), contigs, str(tmp_path / "out"), str(tmp_path / "cp"), AlignConfig(errors=1)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    reads = readers.fastq(spark, str(tmp_path / "in")).withColumnRenamed("ordinal", "read_id")
    want = to_sam(reads, align(reads.select("read_id", "seq", "qual"), contigs, AlignConfig(errors=1)), contigs)
    told = lambda df: sorted((r.qname, r.flag, r.pos, r.cigar, r.seq) for r in df.collect())
    assert told(got) == told(want) and len(told(got)) == 10 and got.select("batch").distinct().count() == 2


def test_models_freeze_over_batches(spark, tmp_path):
    """The first files fill the model; later ones change nothing. Groups without samples have a model of none."""
    rng, rows = random.Random(4), []
    for n in range(4):
        part = [(g, 100 * n + i, None if rng.random() < 0.2 else float(rng.randrange(200, 400))) for g in (1, 2) for i in range(30 if g == 1 else 8)] + [(3, n, None)]
        rng.shuffle(part)
        rows.append(part)
        spark.createDataFrame(part, "group long, ordinal long, insert_size double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.streamed_models(spark, str(tmp_path / "in"), "group long, ordinal long, insert_size double", str(tmp_path / "out"), str(tmp_path / "cp"), most=50)
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values("batch").groupby("group").last()
    for g in (1, 2, 3):
        x = [s for part in rows for h, o, s in sorted(part, key=lambda r: r[1]) if h == g and s is not None][:50]
        assert got.loc[g, "n"] == len(x) and bool(got.loc[g, "frozen"]) == (len(x) == 50)
        if x:
            assert abs(got.loc[g, "mean"] - pd.Series(x).mean()) < 1e-9 and abs(got.loc[g, "dev"] - pd.Series(x).std(ddof=0)) < 1e-9


def test_saved_tables_go_with_their_scratch(spark, tmp_path):
    from pathlib import Path

    from strandloom.operators import saving

    home = Path(saving.folder(spark, "x").removeprefix("file://")).parent
    before = set(home.iterdir())
    kept = saving.saved(spark.range(3), "kept")
    with saving.scratch(spark):
        saving.saved(spark.range(3), "gone")
        with saving.scratch(spark):
            saving.saved(spark.range(3), "gone")
            assert len(set(home.iterdir()) - before) == 3
        assert len(set(home.iterdir()) - before) == 2
    assert len(set(home.iterdir()) - before) == 1 and kept.count() == 3
