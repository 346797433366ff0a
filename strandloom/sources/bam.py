"""BAM as a sink: SAM rows to binary records in BGZF blocks, a complete file for each task.

Every task writes its own file under a hidden name; the driver gives the files of the tasks that count their names, so
an attempt that fails or runs twice leaves nothing behind. Where a task's rows are sorted, its file is.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Fixed values of the format: signs of CIGAR operations and of bases, by their codes; most bytes of a block.
OPERATIONS, SYMBOLS, BLOCK = "MIDNSHP=X", "=ACMGRSVTWYHKDBN", 0xFF00
#: Levels of the bins by place: bits of a bin's size, number of its first bin.
BINS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
TAGS = (("NM", "nm", "i"), ("MD", "md", "Z"), ("RG", "rg", "Z"), ("AS", "as_score", "f"), ("XM", "xm", "Z"), ("MO", "mo", "Z"))


def packed_cigar(cigar: str) -> list[int]:
    """CIGAR text to numbers: length in the upper 28 bits, operation in the lower four; none for *."""
    return [int(n) << 4 | OPERATIONS.index(op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds places begin (0-based) to end (exclusive)."""
    return next((first + (begin >> bits) for bits, first in BINS if begin >> bits == (end - 1) >> bits), 0)


def block(data: bytes) -> bytes:
    """A BGZF block: a gzip member that says its own size. An empty one ends a file."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


def header_bytes(text: str) -> tuple[bytes, dict[str, int]]:
    """The header of a file, and the number of each contig that its @SQ lines name."""
    lines = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in text.splitlines() if line.startswith("@SQ")]
    out = [b"BAM\x01", struct.pack("<i", len(text.encode())), text.encode(), struct.pack("<i", len(lines))]
    for line in lines:
        name = line["SN"].encode() + b"\0"
        out += [struct.pack("<i", len(name)), name, struct.pack("<i", int(line["LN"]))]
    return b"".join(out), {line["SN"]: i for i, line in enumerate(lines)}


_CODES = bytes(ord(f"{max(SYMBOLS.find(chr(c).upper()), 0) if chr(c).upper() in SYMBOLS else 15:x}") for c in range(256))
_PHRED = bytes(max(c - 33, 0) for c in range(256))


def record(row: dict, contigs: dict[str, int]) -> bytes:
    """A row of writers.single_rows() or paired_rows() as a record; tags without a value are left out."""
    name, cigar, seq = row["qname"].encode() + b"\0", packed_cigar(row["cigar"]), "" if row["seq"] in (None, "*") else row["seq"]
    own = contigs.get(row["rname"], -1)
    following = own if row["rnext"] == "=" else contigs.get(row["rnext"], -1)
    begin, span = row["pos"] - 1, sum(c >> 4 for c in cigar if OPERATIONS[c & 15] in "MDN=X")
    codes = seq.encode("latin-1", "replace").translate(_CODES) + b"0" * (len(seq) % 2)  # a hexadecimal digit a base
    quality = b"\xff" * len(seq) if row["qual"] in (None, "*") else row["qual"].encode("latin-1", "replace").translate(_PHRED)
    body = [struct.pack("<iiBBHHHiiii", own, begin, len(name), row["mapq"], bin_of(begin, begin + max(span, 1)), len(cigar), row["flag"], len(seq), following, row["pnext"] - 1, row["tlen"]), name]
    body += [struct.pack(f"<{len(cigar)}I", *cigar), bytes.fromhex(codes.decode()), quality]
    for tag, column, kind in TAGS:
        value = row.get(column)
        if value is not None:
            body.append(tag.encode() + kind.encode() + (str(value).encode() + b"\0" if kind == "Z" else struct.pack("<" + kind, value)))
    whole = b"".join(body)
    return struct.pack("<i", len(whole)) + whole


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, header: str, path: str, overwrite: bool):
        self.header, self.path, self.overwrite = header, path, overwrite

    def write(self, iterator: Iterator) -> Written:
        store, folder = _folder(self.path)
        store.create_dir(folder, recursive=True)
        held, contigs = header_bytes(self.header)
        name = f"part-{uuid.uuid4().hex}.bam"
        with store.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            buffer = bytearray(held)
            for batch in iterator:
                for row in batch.to_pylist():
                    buffer += record(row, contigs)
                    while len(buffer) >= BLOCK:
                        out.write(block(bytes(buffer[:BLOCK])))
                        del buffer[:BLOCK]
            if buffer:
                out.write(block(bytes(buffer)))
            out.write(block(b""))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _folder(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(folder)):
                if old.base_name.startswith("part-"):
                    store.delete_file(old.path)
        for m in filter(None, messages):
            store.move(f"{folder}/_{m.name}", f"{folder}/{m.name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _folder(self.path)
        for m in filter(None, messages):
            store.delete_file(f"{folder}/_{m.name}")


class BamSink(DataSource):
    """Options: path, header (SAM text)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["header"], self.options["path"], overwrite)


def write_bam(rows: DataFrame, header: str, path: str) -> None:
    """Rows of writers.single_rows() or paired_rows() as BAM files under `path`, a file for each task; no order is made.

    header: SAM text; its @SQ lines name the contigs, a row on any other one becomes a read without a contig. It goes to
    every task (a line for each contig). No rows make files without records. `path` must be one that driver and
    executors reach.
    """
    rows.sparkSession.dataSource.register(BamSink)
    rows.write.format("bam").option("header", header).mode("overwrite").save(path)
