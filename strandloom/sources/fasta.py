"""FASTA references of any size: read in byte ranges and cut into chunks while they are read.

No task reads more than its range and the bases that a chunk goes beyond it, and no row holds a whole contig, however
the file breaks its lines. Ranges are scanned once for their records; a row for each range then tells where its bases
begin in their contig; the second pass emits the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.saving import saved
from strandloom.operators.seeding import CHUNK, OVERLAP

#: Bytes of a range, of a header line at most, and of a read.
RANGE, HEADER, BLOCK = 8 << 20, 1 << 16, 1 << 20
#: Bases and chunks that a task hands on at a time.
HELD, ROWS = 4 << 20, 4096
_BLANKS = b" \t\r\n\x0b\x0c"
_BASES = bytes(ord(chr(c).upper()) if chr(c) in "ACGTacgt" else ord("N") for c in range(256))
_PARTS = "file string, begin long, part int, at long, name string, bases long, lead long, tail long"


def _opened(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, name


def sizes(paths: list[str]) -> list[tuple[str, int]]:
    """The files of paths (a folder stands for the files in it, by name) and their bytes; a missing one is an error."""
    out = []
    for path in paths:
        system, name = _opened(path)
        found = system.get_file_info(name)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        inside = [found] if found.type == fs.FileType.File else sorted(system.get_file_info(fs.FileSelector(name)), key=lambda f: f.path)
        head = path.split("://", 1)[0] + "://" if "://" in path else ""
        out += [(head + f.path, f.size) for f in inside if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return out


def _lines(stream, at: int, end: int, most: int = BLOCK) -> Iterator[tuple[int, bool, bytes]]:
    """Byte place, whether a line begins there, and bytes up to a line's end or a read's, from `at` to before `end`."""
    stream.seek(at)
    fresh = True
    while at < end:
        block = stream.read(min(most, end - at))
        if not block:
            return
        for part in block.splitlines(keepends=True):
            yield at, fresh, part
            at, fresh = at + len(part), part[-1:] in (b"\n", b"\r")


def _inside(stream, begin: int) -> tuple[bool, bool]:
    """Whether a byte place lies in a header line, and whether a line begins there."""
    if begin == 0:
        return False, True
    low = max(0, begin - HEADER)
    stream.seek(low)
    before = stream.read(begin - low)
    line = before[max(before.rfind(b"\n"), before.rfind(b"\r")) + 1 :]
    if len(line) == len(before) and low > 0:
        return False, False  # a line longer than any header: bases
    return line.startswith(b">"), not line


def scanned(path: str, begin: int, end: int) -> list[tuple]:
    """The parts of a range: what goes on from the range before (part 0, name null), then one for each header in it:
    byte place of its first base, name, bases, and how many N they begin and end with."""
    system, name = _opened(path)
    parts, now = [], [begin, None, 0, 0, 0]
    with system.open_input_file(name) as stream:
        skip, fresh_at = _inside(stream, begin)
        title = bytearray()
        for at, fresh, line in _lines(stream, begin, end):
            if at == begin:
                fresh = fresh_at
            if fresh:
                if line.startswith(b">"):
                    parts.append(tuple(now))
                    skip, title = True, bytearray()
                    now = [at, "", 0, 0, 0]
                else:
                    skip = False
            if skip:
                if now[1] is not None:
                    title += line
                    if len(title) > HEADER:
                        raise ValueError(f"{path}: the header at byte {now[0]} is longer than {HEADER} bytes")
                    now[1] = title
                now[0] = at + len(line)
                continue
            bases = line.translate(_BASES, _BLANKS)
            if not bases:
                continue
            if begin == 0 and not parts and now[1] is None:
                raise ValueError(f"{path} does not begin with >")
            lead = len(bases) - len(bases.lstrip(b"N"))
            if now[3] == now[2]:
                now[3] += lead
            now[4] = now[4] + len(bases) if lead == len(bases) else len(bases) - len(bases.rstrip(b"N"))
            now[2] += len(bases)
        if skip and now[1] is not None and not title.endswith((b"\n", b"\r")):  # a header that goes on beyond the range
            stream.seek(end)
            rest = stream.read(HEADER).splitlines(keepends=True)
            title += rest[0] if rest else b""
            now[1], now[0] = title, end + len(rest[0] if rest else b"")
        parts.append(tuple(now))
    told = lambda t: None if t is None else bytes(t)[1:].decode("utf-8", "replace").strip()
    return [(at, told(title), n, lead, tail) for at, title, n, lead, tail in parts]


def cut(stream, at: int, base: int, bases: int, lead: int, size: int, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    """The chunks that begin among the `bases` bases from byte `at`, the first of which is the contig's base `base`.

    lead: Ns at the contig's start; size: its bases without those at both ends. A read is about as long as what is
    still needed, so that a short contig costs no whole block.
    """
    first = max(0, -(-(base - lead) // chunk))
    last = min(base - lead + bases, size)  # no chunk begins at or after it
    need = min(base - lead + bases + chunk + overlap, size) - (base - lead)
    held, low = bytearray(), base - lead  # bases read and not dropped yet, and where they begin
    lines = _lines(stream, at, 1 << 62, min(BLOCK, max(1024, need + need // 32 + 64)))
    for number in range(first, -(-last // chunk) if last > 0 else 0):
        begin, end = number * chunk, min(number * chunk + chunk + overlap, size)
        while low + len(held) < end:
            found = next(lines, None)
            if found is None or (found[1] and found[2].startswith(b">")):
                break
            held += found[2].translate(_BASES, _BLANKS)
        del held[: max(0, begin - low)]
        low = max(low, begin)
        yield number, held[: end - begin].decode("ascii")


def chunks(spark: SparkSession, paths: str | list[str], chunk: int = CHUNK, overlap: int = OVERLAP, width: int = RANGE) -> DataFrame:
    """contig_id, chunk, length, seq, name, n_initial, n_final, size: contigs in overlapping chunks, as align() and
    seeding.chunks() take them; size is that without the Ns at both ends, which are cut off and counted.

    Symbols other than A, C, G, T count as N; contigs without any go. A file whose first symbol that is no blank is not >
    is an error, and so is a header beyond HEADER bytes. contig_id is a hash of the file and the header's place in it.
    Compressed files have no byte ranges: readers.fasta() reads them.
    """
    files = sizes([paths] if isinstance(paths, str) else paths)
    rows = [(f, i, min(i + width, n)) for f, n in files for i in range(0, n, width)]
    tasks = max(1, min(len(rows), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranges = spark.createDataFrame(rows, "file string, begin long, end long").repartition(tasks)

    def scan(batches):
        for batch in batches:
            for f, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = scanned(f, a, b)
                columns = list(zip(*[(f, a, i, *x) for i, x in enumerate(found)], strict=True))
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "begin", "part", "at", "name", "bases", "lead", "tail"])

    parts = saved(ranges.mapInArrow(scan, _PARTS), "parts")
    # what a range hands on: its last header, or that of the ranges before it, and the bases since
    per = Window.partitionBy("file").orderBy("begin")
    ends = parts.groupBy("file", "begin").agg(F.max(F.struct("part", "bases", "name")).alias("x"))
    ends = ends.select("file", "begin", F.when(F.col("x.part") > 0, F.struct(F.col("begin").alias("b"), F.col("x.part").alias("p"))).alias("own"), F.col("x.bases").alias("bases"))
    ends = ends.withColumn("open", F.last("own", True).over(per)).withColumn("run", F.sum("bases").over(Window.partitionBy("file", "open").orderBy("begin")))
    ends = ends.select("file", "begin", F.lag("open").over(per).alias("open"), F.lag("run").over(per).alias("run"))
    placed = parts.join(ends, ["file", "begin"])
    own = F.col("part") > 0
    placed = placed.select("file", "at", "bases", "lead", "tail", "name", F.when(own, F.col("begin")).otherwise(F.col("open.b")).alias("b"), F.when(own, F.col("part")).otherwise(F.col("open.p")).alias("p"), F.when(own, F.lit(0)).otherwise(F.coalesce("run", F.lit(0))).cast("long").alias("base"))
    placed = placed.where("b IS NOT NULL").withColumn("contig_id", F.xxhash64("file", "b", "p"))
    some = F.col("lead") < F.col("bases")
    contigs = placed.groupBy("contig_id").agg(F.max("name").alias("name"), F.min(F.when(some, F.col("base") + F.col("lead"))).alias("n_initial"), F.max(F.when(some, F.col("base") + F.col("bases") - F.col("tail"))).alias("_end"), F.sum("bases").alias("_all"))
    contigs = contigs.where("n_initial IS NOT NULL").select("contig_id", F.split("name", "\\s", 2)[0].alias("name"), "n_initial", (F.col("_all") - F.col("_end")).alias("n_final"), (F.col("_end") - F.col("n_initial")).alias("size"))
    work = saved(placed.drop("name", "lead", "tail", "b", "p").join(contigs, "contig_id").where("bases > 0"), "work")

    def emit(batches):
        stream, now = None, None
        for batch in batches:
            keys, held, rows = ("file", "at", "base", "bases", "n_initial", "size"), 0, []

            def made():
                one = batch.take(pa.array([r[0] for r in rows], pa.int64()))
                numbers, seqs = pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())
                return pa.record_batch([one.column("contig_id"), numbers, one.column("size"), seqs, one.column("name"), one.column("n_initial"), one.column("n_final"), one.column("size")], ["contig_id", "chunk", "length", "seq", "name", "n_initial", "n_final", "size"])

            for i, (path, *values) in enumerate(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)):
                if path != now:
                    if stream is not None:
                        stream.close()
                    system, name = _opened(path)
                    stream, now = system.open_input_file(name), path
                for number, seq in cut(stream, *values, chunk, overlap):
                    rows.append((i, number, seq))
                    held += len(seq)
                    if held >= HELD or len(rows) >= ROWS:
                        yield made()
                        held, rows = 0, []
            if rows:
                yield made()
        if stream is not None:
            stream.close()

    work = work.repartition(tasks, "file", "at").sortWithinPartitions("file", "at")
    return work.mapInArrow(emit, "contig_id long, chunk long, length long, seq string, name string, n_initial long, n_final long, size long")
