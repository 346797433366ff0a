"""FASTA in byte ranges against a plain reading of the whole file."""

import random

import pytest

from strandloom.operators import seeding
from strandloom.plans.align import align_pairs
from strandloom.plans.config import AlignConfig
from strandloom.sources import fasta


def plain(text: str) -> list[tuple]:
    out = []
    for record in text.replace("\r", "\n").split(">")[1:]:
        head, _, body = record.partition("\n")
        raw = "".join(c.upper() if c.upper() in "ACGT" else "N" for c in "".join(body.split()))
        if raw.strip("N"):
            out.append(((head.split() or [""])[0], raw.strip("N"), len(raw) - len(raw.lstrip("N")), len(raw) - len(raw.rstrip("N"))))
    return sorted(out)


def text_of(rng) -> str:
    parts = ["\n \r\n"]
    for i in range(14):
        size = rng.choice([0, 1, 50, 300, 900])
        seq = "N" * rng.choice([0, 0, 7, 120]) + "".join(rng.choice("ACGTacgtNx") for _ in range(size)) + "n" * rng.choice([0, 0, 5, 90])
        width = rng.choice([1, 7, 60, 10_000])
        parts.append(f">c{i} {'more ' * rng.choice([0, 1, 30])}{rng.choice(['', chr(233)])}" + rng.choice(["\n", "\r\n"]))
        parts += [seq[a : a + width] + rng.choice(["\n", "\r\n", "\n\n"]) for a in range(0, len(seq), width)]
    return "".join(parts).rstrip() + rng.choice(["", "\n"])


@pytest.mark.parametrize("width, chunk, overlap", [(37, 40, 25), (64, 100, 0), (1 << 20, 64, 30), (200, 1000, 300)])
def test_chunks_equal_a_plain_reading(spark, tmp_path, width, chunk, overlap):
    rng, want = random.Random(width), []
    for n in range(2):
        text = text_of(rng)
        (tmp_path / f"{n}.fa").write_bytes(text.encode())
        want += [(name, i, len(seq), seq[i * chunk : (i + 1) * chunk + overlap], lead, tail) for name, seq, lead, tail in plain(text) for i in range(-(-len(seq) // chunk))]
    got = fasta.chunks(spark, str(tmp_path), chunk, overlap, width).collect()
    assert sorted((r.name, r.chunk, r.size, r.seq, r.n_initial, r.n_final) for r in got) == sorted(want)
    assert len({(r.contig_id, r.chunk) for r in got}) == len(got)


def test_short_contigs_read_no_whole_blocks():
    """3,000 contigs of 100 bases: the bytes read follow the bases."""
    import io

    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.got += len(out)
            return out

    file = Counted((b">c\n" + b"ACGTA" * 20 + b"\n") * 3000)
    found = [list(fasta.cut(file, 104 * i + 3, 0, 100, 0, 100, 60, 20)) for i in range(3000)]
    assert all(f == [(0, "ACGTA" * 16), (1, "ACGTA" * 8)] for f in found)
    assert Counted.got <= 3000 * 1100


def test_malformed_files_stop(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\nACGT\n>x\nACGT\n")
    (tmp_path / "b.fa").write_text(">" + "x" * (fasta.HEADER + 9) + "\nACGT\n")
    (tmp_path / "c.fa").write_text("")
    for name, said in (("a", "does not begin with >"), ("b", "longer than")):
        with pytest.raises(Exception, match=said):
            fasta.chunks(spark, str(tmp_path / f"{name}.fa")).collect()
    assert fasta.chunks(spark, str(tmp_path / "c.fa")).count() == 0
    with pytest.raises(FileNotFoundError):
        fasta.chunks(spark, str(tmp_path / "none.fa"))


def test_a_contig_of_250_mb_in_one_line(spark, tmp_path):
    """No row above a megabyte; every chunk is where it belongs."""
    unit = "".join(random.Random(1).choice("ACGT") for _ in range(1_000_003))
    with open(tmp_path / "big.fa", "w") as f:
        f.write(">big one\n")
        for _ in range(250):
            f.write(unit)
    got = fasta.chunks(spark, str(tmp_path / "big.fa"))
    told = got.selectExpr("count(1) AS n", "max(length(seq)) AS longest", "max(size) AS size", "sum(length(seq)) AS bases").first()
    size = 250 * 1_000_003
    n = -(-size // seeding.CHUNK)
    assert (told.n, told.longest, told.size) == (n, seeding.CHUNK + seeding.OVERLAP, size)
    for r in got.where("chunk % 3001 = 7").select("chunk", "seq").collect():
        at = r.chunk * seeding.CHUNK % 1_000_003
        assert r.seq == (unit + unit)[at : at + len(r.seq)]


def test_pairs_on_cut_contigs(spark, tmp_path):
    rng = random.Random(2)
    ref = "".join(rng.choice("ACGT") for _ in range(40_000))
    (tmp_path / "r.fa").write_text(">chr1 x\nNNNNN\n" + ref + "\n")
    rows = []
    for i in range(12):
        at = 3_000 * i + 10
        rows += [(2 * i, i, 0, f"r{i}", ref[at : at + 100]), (2 * i + 1, i, 1, f"r{i}", ref[at + 200 : at + 300][::-1].translate(str.maketrans("ACGT", "TGCA")))]
    reads = spark.createDataFrame(rows, "read_id long, pair_id long, mate int, name string, seq string")
    got = align_pairs(reads, fasta.chunks(spark, str(tmp_path / "r.fa")), AlignConfig(errors=2)).toPandas()
    assert sorted(zip(got.qname, got.pos, got.rname, got.tlen)) == sorted((f"r{i}", 3_000 * i + 16 + d, "chr1", 300 - 600 * (d > 0)) for i in range(12) for d in (0, 200))
