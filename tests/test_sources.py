"""Readers and writers on small files; streams against their batch forms."""

import gzip
import struct
from pathlib import Path

import pandas as pd

from strandloom.operators import seeding
from strandloom.sources import bam, readers, writers
from strandloom.streaming import reads as streams


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nNNacg\nTTx\n>two\nNNN\n>three\nACGTN\r\nNN\n")
    got = {r["name"]: (r.seq, r.n_initial, r.n_final, r["size"]) for r in readers.fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"one": ("ACGTT", 2, 1, 5), "three": ("ACGT", 0, 3, 4)}


def test_fastq_plain_gzip_and_pairs(spark, tmp_path):
    text = "".join(f"@r{i} x\r\nACGTNacg\r\n+\r\nIIIIIIII\r\n" for i in range(50))
    (tmp_path / "a.fq").write_bytes(text.encode())
    with gzip.open(tmp_path / "b.fq.gz", "wb") as f:
        f.write(text.encode())
    rows = readers.fastq(spark, str(tmp_path / "a.fq")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.name, r.seq, r.qual) for r in rows] == [(i, f"r{i}", "ACGTNACG", "IIIIIIII") for i in range(50)]
    both = readers.fastq_pairs(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.fq.gz"))
    assert sorted(r.read_id for r in both.collect()) == list(range(100))
    (tmp_path / "l.txt").write_text("a;b\n\nc\n")
    assert readers.listed(spark, str(tmp_path / "l.txt")) == [["a", "b"], ["c"]]


def test_vcf(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\n1\t10\trs1\tA\tC,AT\t.\t.\tAF=0.1,0.2;X=1\n2\t20\trs2\tAC\tA\t.\t.\tCAF=[0.7,0.3]\n2\t21\t.\tA\t.\t.\t.\t.\n")
    got = sorted((r.chrom, r.pos, r.alt, r.freq, r.vtype) for r in readers.vcf(spark, str(tmp_path / "v.vcf")).collect())
    assert got == [("1", 10, "AT", 0.2, "ins"), ("1", 10, "C", 0.1, "snp"), ("2", 20, "A", 0.3, "del")]


def test_sam_round_trip(spark, tmp_path):
    schema = "qname string, strand string, rname string, pos long, mapq long, cigar string, md string, ed long, score double, seq string, qual string, method string"
    df = spark.createDataFrame([("a", "-", "c1", 5, 60, "4M", "4", 0, 4.0, "AACG", "ABCD", "perfect"), ("b", None, None, None, None, None, None, None, None, "ACGT", "IIII", None)], schema)
    writers.write_sam(writers.single_rows(df), writers.sam_header([("c1", 100)], 'x "y"', "@RG\tID:z"), str(tmp_path / "out"), gzip=True)
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out/rows")).collect())
    assert lines == ["a\t16\tc1\t5\t60\t4M\t*\t0\t0\tCGTT\tDCBA\tNM:i:0\tMD:Z:4\tAS:i:4.0\tXM:Z:perfect", "b\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII"]
    head = [r.value for r in spark.read.text(str(tmp_path / "out/header")).collect()]
    assert head[1] == "@SQ\tSN:c1\tLN:100" and len(head) == 4 and '"' not in head[3]


def test_paired_rows(spark):
    schema = "qname string, pair_id long, mate int, strand string, rname string, pos long, length long, mapq long, cigar string, md string, ed long, score double, seq string, qual string, method string"
    hit = lambda name, pair, mate, strand, rname, pos: (name, pair, mate, strand, rname, pos, 4, 60, "4M", "4", 0, 4.0, "AACG", "ABCD", "perfect")
    none = lambda name, pair, mate: (name, pair, mate, *[None] * 9, "ACGT", "IIII", None)
    rows = [hit("p", 1, 0, "+", "c1", 10), hit("p", 1, 1, "-", "c1", 30), hit("q", 2, 0, "-", "c1", 5), none("q", 2, 1), none("r", 3, 0), none("r", 3, 1)]
    got = {(r.qname, bool(r.flag & 64)): r for r in writers.paired_rows(spark.createDataFrame(rows, schema)).collect()}
    said = {k: (r.flag, r.rname, r.pos, r.rnext, r.pnext, r.tlen) for k, r in got.items()}
    assert said[("p", True)] == (1 + 2 + 32 + 64, "c1", 10, "=", 30, 24) and said[("p", False)] == (1 + 2 + 16 + 128, "c1", 30, "=", 10, -24)
    assert said[("q", True)] == (1 + 8 + 16 + 64, "c1", 5, "=", 5, 0) and said[("q", False)] == (1 + 4 + 32 + 128, "c1", 5, "=", 5, 0)
    assert said[("r", True)] == (1 + 4 + 8 + 64, "*", 0, "*", 0, 0)


def test_index_round_trip(spark, tmp_path):
    df = seeding.seed_index(seeding.chunks(spark.createDataFrame([(1, "ACGTACGTACGTNACGT" * 9)], "contig_id long, seq string")), 8)
    writers.write_index(df, str(tmp_path / "ix"), 4)
    assert sorted(map(tuple, readers.index(spark, str(tmp_path / "ix")).select(df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_stream_of_reads_equals_batch(spark, tmp_path):
    seq = "ACGTTGCAAGGCTTAACCGGATATCGCGTACGATCGATTTAGGCCCTAGATCGGGATTTCACACAGTGTGTAACCTTGG" * 2
    contigs = spark.createDataFrame([(1, seq)], "contig_id long, seq string")
    source = spark.createDataFrame([(i, seq[i : i + 80]) for i in range(10)], "read_id long, seq string")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streams.mapped(streams.arriving(spark, str(tmp_path / "in"), "read_id long, seq string", 1), contigs, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    want = seeding.best_in_contig(seeding.map_reads(source, contigs, 3)).select("read_id", "strand", "start", "ed")
    got = spark.read.parquet(str(tmp_path / "out")).select("read_id", "strand", "start", "ed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_running_insert_model(spark, tmp_path):
    df = spark.createDataFrame([("a", 300.0), ("a", 320.0), ("a", 310.0), ("b", None)], "group string, insert_size double")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("group string, insert_size double").parquet(str(tmp_path / "in"))
    seen: list[pd.DataFrame] = []
    q = streams.running_insert_model(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: seen.append(b.toPandas())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = pd.concat(seen).groupby("group").last()
    assert got.loc["a", "n"] == 3 and abs(got.loc["a", "mean"] - 310) < 1e-9 and abs(got.loc["a", "dev"] - 8.164966) < 1e-5 and got.loc["b", "n"] == 0


def _records(data: bytes):
    """A BAM file's contigs and records, read field by field."""
    whole, at = gzip.decompress(data), 0

    def take(form):
        nonlocal at
        got = struct.unpack_from("<" + form, whole, at)
        at += struct.calcsize("<" + form)
        return got[0] if len(got) == 1 else got

    assert take("4s") == b"BAM\x01"
    text = take(f"{take('i')}s").decode()
    contigs = [(take(f"{take('i')}s")[:-1].decode(), take("i")) for _ in range(take("i"))]
    out = []
    while at < len(whole):
        end = take("i") + at
        ref, pos, size, mapq, where, n, flag, length, next_ref, next_pos, tlen = take("iiBBHHHiiii")
        name = take(f"{size}s")[:-1].decode()
        cigar = "".join(f"{c >> 4}{'MIDNSHP=X'[c & 15]}" for c in (take("I") for _ in range(n)))
        seq = "".join("=ACMGRSVTWYHKDBN"[c] for b in take(f"{(length + 1) // 2}s") for c in (b >> 4, b & 15))[:length]
        qual = take(f"{length}s")
        tags = whole[at:end]
        at = end
        out.append((name, flag, ref, pos, mapq, where, cigar, next_ref, next_pos, tlen, seq, qual, tags))
    return text, contigs, out


def test_bam(spark, tmp_path):
    header = writers.sam_header([("one", 100_000), ("two", 200)])
    names = "rg string, qname string, flag int, rname string, pos long, mapq long, cigar string, rnext string, pnext long, tlen long, seq string, qual string, nm long, md string, as_score double, xm string"
    made = [
        ("g", "a", 99, "one", 16_380, 60, "4M1D2M2S", "=", 16_500, 129, "ACGTNACG", "IIIIIIII", 1, "4^C2", 3.5, "edits"),
        ("g", "b", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "*", None, None, None, None),
        ("g", "c", 4, "*", 0, 0, "*", "*", 0, 0, None, "*", None, None, None, None),
        ("g", "d", 16, "two", 1, 3, "5M", "one", 7, 0, "TTTTT", "!!!!!", 0, "5", 5.0, "perfect"),
    ]
    folder = tmp_path / "out"
    for _ in range(2):  # the second run takes the place of the first
        bam.write_bam(spark.createDataFrame(made, names).repartition(2), header, f"file://{folder}")
    files = sorted(Path(folder).glob("*.bam"))
    assert files and all(f.read_bytes().endswith(bam.block(b"")) for f in files) and not list(folder.glob("_part*"))
    told = [_records(f.read_bytes()) for f in files]
    assert all(t[:2] == (header, [("one", 100_000), ("two", 200)]) for t in told)
    a, b, c, d = sorted(x for t in told for x in t[2])
    assert a[:12] == ("a", 99, 0, 16_379, 60, 585, "4M1D2M2S", 0, 16_499, 129, "ACGTNACG", bytes([40] * 8))
    assert a[12] == b"NMi\x01\0\0\0MDZ4^C2\0RGZg\0ASf" + struct.pack("<f", 3.5) + b"XMZedits\0"
    assert b[:12] == ("b", 4, -1, -1, 0, 4680, "", -1, -1, 0, "ACG", b"\xff" * 3) and b[12] == b"RGZg\0"
    assert c[10] == "" and d[:12] == ("d", 16, 1, 0, 3, 4681, "5M", 0, 6, 0, "TTTTT", bytes(5))


def test_bam_blocks(spark, tmp_path):
    """A file of many blocks, none over the format's bound; and no rows at all."""
    header = writers.sam_header([("one", 1000)])
    columns = ["qname", "0 AS flag", "'one' AS rname", "1L AS pos", "9L AS mapq", "'100M' AS cigar", "'*' AS rnext", "0L AS pnext", "0L AS tlen", "repeat('ACGTA', 20) AS seq", "'*' AS qual", "0L AS nm", "'100' AS md", "1D AS as_score", "sha2(qname, 512) AS xm"]
    rows = spark.range(5000).selectExpr("cast(id AS string) AS qname").selectExpr(*columns).coalesce(1)
    bam.write_bam(rows, header, f"{tmp_path}/many")
    data = next((tmp_path / "many").glob("*.bam")).read_bytes()
    at, sizes = 0, []
    while at < len(data):
        sizes.append(struct.unpack_from("<H", data, at + 16)[0] + 1)
        at += sizes[-1]
    assert at == len(data) and len(sizes) > 10
    assert sorted(int(r[0]) for r in _records(data)[2]) == list(range(5000))
    bam.write_bam(rows.limit(0), header, f"{tmp_path}/none")
    assert all(_records(f.read_bytes())[2] == [] for f in (tmp_path / "none").glob("*.bam"))
