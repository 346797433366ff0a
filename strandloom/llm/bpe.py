"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its incremental decoder.

A text is cut into pieces by the vocabulary's split pattern. Within a piece the encoding of every prefix is known from
left to right: its last token is the longest one that agrees with the token before it, and two neighbours agree when the
merges cut their joined bytes exactly between them. A token is final as soon as the prefixes that later bytes can still
build on (no more than the sufficient lookahead back) all share it; then it is emitted and forgotten.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import table, with_fields

#: The split pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers, and the longest it remembers (characters).
MEMO, MEMO_CHARS = 300_000, 40
#: Characters of a text that are cut into pieces at a time.
CHUNK = 1 << 20
#: Documents whose results a task holds before it hands them on.
ROWS = 500


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges by rank, and the strings that are tokens of their own."""

    def __init__(self, spec: str):
        said = json.loads(spec)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.ids = {raw(t): i for t, i in said["model"]["vocab"].items() if t not in self.special}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids), default=1)
        #: The sufficient lookahead in bytes: a token that spans a position was merged from parts, so it begins no more
        #: than this before the position. Prefixes that end further back than this are none that later bytes build on.
        self.lookahead = max([len(a) + len(b) for a, b in self.ranks] + [self.longest]) - 1
        #: Lengths, longest first, of the tokens that end in these (at most two) bytes: in long pieces only these are looked up.
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > 1:
                ends.setdefault(token[-2:], set()).add(len(token))
        self.sizes = {end: (*sorted(sizes, reverse=True), 1) for end, sizes in ends.items()}
        self._agree: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The merges applied by rank, leftmost first: the definition that the transducer rests on (short pieces)."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks, none = self.ranks, 1 << 60
        while len(parts) > 1:
            rank = [ranks.get(p, none) for p in zip(parts, parts[1:])]
            least = min(rank)
            if least == none:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(rank) and rank[i] == least:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def agree(self, a: int, b: int) -> bool:
        """Whether tokens a, b stand next to each other when their joined bytes are encoded."""
        known = self._agree.get((a, b))
        if known is None:
            if len(self._agree) >= 500_000:
                self._agree.clear()
            left, right = self.bytes[a], self.bytes[b]
            known = self._agree[a, b] = self.merged(left + right) == [left, right]
        return known

    def short(self, piece: bytes) -> list[int]:
        """Ids of a piece held whole: the same transducer without a window, for pieces no longer than MEMO_CHARS."""
        ids, known, last, n = self.ids.get, self._agree.get, [-1], len(piece)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                token = ids(piece[start:end])
                if token is None:
                    continue
                ahead = last[start]
                if start:
                    if ahead is None:
                        continue
                    fits = known((ahead, token))
                    if not (self.agree(ahead, token) if fits is None else fits):
                        continue
                last.append(token)
                break
            else:
                last.append(None)
        return self._path(last[1:], n)

    def tokens(self, piece: Iterable[bytes]) -> Iterator[int]:
        """Ids of a piece that arrives in blocks of bytes; memory is bounded by the lookahead, not by the piece."""
        ids, agree, full = self.ids, self.agree, 4 * (self.lookahead + 1)
        window, last = b"", []  # bytes not yet emitted, and for each of their prefixes the last token of its encoding
        before, due = -1, full  # the token emitted last, and the window at which tokens are looked for that are final
        for block in piece:
            for i in range(len(block)):
                window += block[i : i + 1]
                n = len(window)
                for size in self.sizes.get(window[-2:], (1,)):
                    token = ids.get(window[n - size :]) if size <= n else None
                    if token is None:
                        continue
                    ahead = last[n - size - 1] if n > size else before
                    if ahead is None or n > size and ahead == -1:
                        continue
                    if ahead < 0 or agree(ahead, token):
                        last.append(token)
                        break
                else:
                    last.append(None)
                if n >= due:
                    yield from (done := self._stable(last))
                    if done:
                        gone = sum(len(self.bytes[t]) for t in done)
                        window, last, before = window[gone:], last[gone:], done[-1]
                    due = max(full, len(window) + self.lookahead)
        yield from self._path(last, len(last))

    def _path(self, last: list, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= len(self.bytes[out[-1]])
        return out[::-1]

    def _stable(self, last: list) -> list[int]:
        """The tokens that all prefixes which later bytes can build on have in common.

        A prefix without its last token is a shorter prefix: so they form a tree, and the shared tokens are those of the
        nearest ancestor of all that end within the lookahead.
        """
        n = len(last)
        ends = {end for end in range(max(1, n - self.lookahead), n + 1) if last[end - 1] is not None}
        heap = [-end for end in ends]
        heapq.heapify(heap)
        while len(heap) > 1:
            end = -heapq.heappop(heap)
            shorter = end - len(self.bytes[last[end - 1]])
            if shorter <= 0:
                return []
            if shorter not in ends:
                ends.add(shorter)
                heapq.heappush(heap, -shorter)
        return self._path(last, -heap[0]) if heap else []


class Memo(dict):
    """Piece (text) -> its ids as bytes. Two generations: pieces not met while the newer one fills up are forgotten."""

    def __init__(self, vocabulary: Vocabulary, limit: int = MEMO):
        super().__init__()
        self.vocabulary, self.limit, self.older = vocabulary, limit // 2, {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > MEMO_CHARS:
            raw = piece.encode()
            return np.fromiter(self.vocabulary.tokens(raw[i : i + 4096] for i in range(0, len(raw), 4096)), "<u4").tobytes()
        value = self.older.get(piece)
        if value is None:
            ids = self.vocabulary.short(piece.encode())
            value = pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = value
        return value


class Codec:
    """Encodes and decodes whole texts in bounded steps."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.memo = vocabulary, Memo(vocabulary)
        self.split = regex.compile(PATTERN)
        self.stops = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None

    def _ordinary(self, text: str) -> Iterator[bytes]:
        at, n = 0, len(text)
        while at < n:
            if n - at <= CHUNK:
                yield b"".join(map(self.memo.__getitem__, self.split.findall(text, at)))
                return
            found, end = [], at  # the last pieces of a chunk may go on: they wait for the next one
            for m in self.split.finditer(text, at):
                if m.end() - at > CHUNK and found:
                    break
                found.append(m[0])
                end = m.end()
            yield b"".join(map(self.memo.__getitem__, found))
            at = end

    def encoded(self, text: str) -> Iterator[bytes]:
        """Blocks of ids, little-endian unsigned 32-bit."""
        special = self.vocabulary.special
        if self.stops is None or not any(s in text for s in special):
            yield from self._ordinary(text)
            return
        for part in self.stops.split(text):
            if part in special:
                yield special[part].to_bytes(4, "little")
            elif part:
                yield from self._ordinary(part)

    def decoded(self, blocks: Iterable[bytes]) -> Iterator[str]:
        """Text of blocks of ids: bytes feed a UTF-8 machine that holds back at most an unfinished character."""
        machine, of = codecs.getincrementaldecoder("utf-8")("replace"), self.vocabulary.bytes.__getitem__
        for block in blocks:
            yield machine.decode(b"".join(map(of, np.frombuffer(block, "<u4").tolist())))
        yield machine.decode(b"", True)


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """A worker builds the tables of a vocabulary once and keeps what it has learnt of pieces between tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Vocabulary(spec))
    return _CODECS[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs without `text` -> and n_tokens, ids_sha256, decoded_sha256 (and ids).

    The vocabulary file (its size is its own bound, about 1.5 MB) goes to the executors as a broadcast. Null text
    counts as empty; extra columns pass through as they are.
    """
    with open(path or default_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c != text]
    schema = with_fields(docs.drop(text), "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))

    def run(batches):
        coder = codec(spec.value)
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            counts, ids_digest, text_digest, lists = [], [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                blocks = coder.encoded(value.as_py() or "")
                n, digest, back, kept = 0, hashlib.sha256(), hashlib.sha256(), []

                def passed(blocks=blocks, digest=digest, kept=kept):
                    nonlocal n
                    for block in blocks:
                        n += len(block) // 4
                        digest.update(block)
                        if with_ids:
                            kept.append(block)
                        yield block

                for part in coder.decoded(passed()):
                    back.update(part.encode())
                counts.append(n)
                ids_digest.append(digest.hexdigest())
                text_digest.append(back.hexdigest())
                if with_ids:
                    lists.append(np.frombuffer(b"".join(kept), "<u4").astype(np.int32))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            columns += [pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.record_batch(columns, [*rest, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return docs.mapInArrow(run, schema)


def op4_streaming_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's number of tokens and the digests of its ids and of the text decoded from them.

    Null and empty texts have no tokens and the digests of no bytes. Equal rows get equal answers; a null doc_id is
    carried along. An empty table gives no rows.
    """
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
