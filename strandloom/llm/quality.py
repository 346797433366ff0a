"""Quality rules: simple counts, and the perplexity of each text under a modified Kneser-Ney model of its language.

The model predicts the bytes of the running text (words with one space between them, beginning and end) from up to
ORDER - 1 bytes before, across the limits of words. Spark counts n-grams over all documents and smooths them by joins
between the orders; nothing is dropped and nothing of the model is gathered. Each piece of the table (chunk) asks for
the n-grams that its own texts hold; their probabilities are joined in Spark and meet the chunk's texts in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import HashMemo, chained, staged, table

ORDER = 5
BEGIN, END, SYMBOLS = 2, 3, 257
#: A language's band: its median log perplexity, and so many times the distance from it to the 5th and 95th percentile.
#: By labels.quality of sf0.1 (README): 1.75 keeps 99.7 % of the clean documents that pass the counts.
BAND, TAIL = 1.75, 0.05
MARKS = "#*$%&|<>"
_DOCS = 400  # documents that are packed and scored together
_PIECE = 1 << 18  # bytes of text that are turned into n-grams at once
_HELD = 1 << 22  # n-grams that a task counts before it hands them on
_CHUNK = 32 << 20  # bytes of a table that share a chunk, about


def _pieces(found: list[bytes]):
    """Texts -> their numbers and bytes with beginning and end, in lots of about _PIECE bytes.

    A longer text is cut; a later piece repeats the ORDER - 1 bytes before it and is not `fresh`.
    """
    lot, size = [], 0
    for i, text in enumerate(found):
        whole = b"\x02" + text + b"\x03"
        for a in range(0, len(whole), _PIECE):
            piece = whole[max(0, a - ORDER + 1) : a + _PIECE]
            if lot and size + len(piece) > 2 * _PIECE:
                yield lot
                lot, size = [], 0
            lot.append((i, a == 0, piece))
            size += len(piece)
    if lot:
        yield lot


def _symbols(lot: list[tuple[int, bool, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Place in the piece, whether a symbol is predicted here, where pieces begin, and for each order the n-gram that ends there."""
    sizes = np.fromiter((len(x[2]) for x in lot), np.int64, len(lot))
    starts = np.cumsum(sizes) - sizes
    x = np.frombuffer(b"".join(x[2] for x in lot), np.uint8).astype(np.int64)
    place = np.arange(len(x)) - np.repeat(starts, sizes)
    fresh = np.repeat(np.fromiter((x[1] for x in lot), bool, len(lot)), sizes)
    grams, g = [], np.zeros(len(x), np.int64)
    for n in range(ORDER):
        g = g.copy()
        if n < len(x):
            g[n:] |= x[: len(x) - n] << (8 * n)
        grams.append(g)
    return place, (place > 0) & (fresh | (place >= ORDER - 1)), starts, grams


def _split(text: str | None, running: bool) -> list[bytes]:
    """What the model takes for a unit: the running text, or (not running) each word alone."""
    found = (text or "").encode().split()
    return [b" ".join(found)] if running and found else found


def _counter(running: bool):
    def run(batches):
        """chunk, doc_id, tag, text -> chunk, tag, n, gram, c: full n-grams, and shorter ones where a text begins."""
        held: dict[tuple[int, int], list] = {}

        def merged(parts):
            key, group = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            return key, np.bincount(group, np.concatenate([x[1] for x in parts])).astype(np.int64)

        def flushed():
            for (chunk, tag), parts in held.items():
                key, c = merged(parts) if parts else ((), ())  # texts without a word
                for a in range(0, len(key), 100_000):
                    k = key[a : a + 100_000]
                    yield pa.record_batch([pa.array(np.full(len(k), chunk)), pa.array(np.full(len(k), tag)), pa.array((k >> 40).astype(np.int32)), pa.array(k & ((1 << 40) - 1)), pa.array(c[a : a + 100_000])], ["chunk", "tag", "n", "gram", "c"])
            held.clear()

        for batch in batches:
            where: dict[tuple[int, int], list[int]] = {}
            for i, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                where.setdefault(at, []).append(i)
            for at, rows in where.items():
                parts = held.setdefault(at, [])
                found = (u for i in rows for u in _split(batch.column(3)[i].as_py(), running))
                for lot in _pieces(found):
                    place, todo, _, grams = _symbols(lot)
                    order = np.minimum(place + 1, ORDER)
                    key = np.choose(order - 1, grams) | (order << 40)
                    key, c = np.unique(key[todo], return_counts=True)
                    parts.append((key, c))
                    if sum(len(x[0]) for x in parts[1:]) > max(1 << 20, len(parts[0][0])):
                        parts[:] = [merged(parts)]
            if sum(len(x[0]) for parts in held.values() for x in parts) > _HELD:
                yield from flushed()
        yield from flushed()

    return run


def asked(docs: DataFrame, running: bool = True) -> DataFrame:
    """docs (chunk, doc_id, tag, text) -> chunk, tag, n, gram, c: what each chunk holds, with counts; staged."""
    return staged(docs.select("chunk", "doc_id", "tag", "text").mapInArrow(_counter(running), "chunk long, tag long, n int, gram long, c long"), "asked")


def ngrams(found: DataFrame) -> DataFrame:
    """asked() -> tag, n, gram, c: raw counts of full n-grams, continuation counts of the shorter ones."""
    full = staged(found.groupBy("tag", "n", "gram").agg(F.sum("c").alias("c")), "grams")
    level, levels = full.where(F.col("n") == ORDER), []
    levels.append(level)
    for n in range(ORDER - 1, 0, -1):
        shorter = level.groupBy("tag", F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        level = staged(shorter.select("tag", F.lit(n).alias("n"), "gram", "c").unionByName(full.where(F.col("n") == n)), "grams")
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def smoothed(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interpolated modified Kneser-Ney: (tag, n, gram, c, p) and (tag, n, context, gamma)."""
    of = counts.groupBy("tag", "n").agg(*[F.sum(F.when(F.col("c") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    d = lambda k: F.least(F.greatest(F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5 * k)), F.lit(0.1)), F.lit(0.95 * k))
    off = staged(of.select("tag", "n", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3")), "discounts")
    counts = counts.join(off, ["tag", "n"]).withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    counts = counts.withColumn("context", F.shiftright("gram", 8))
    contexts = counts.groupBy("tag", "n", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("lost")).withColumn("gamma", F.col("lost") / F.col("total"))
    contexts = staged(contexts, "contexts")
    done, before = [], None
    for n in range(1, ORDER + 1):
        here = counts.where(F.col("n") == n).join(contexts.where(F.col("n") == n).drop("n"), ["tag", "context"])
        own = (F.col("c") - F.col("d")) / F.col("total")
        if before is None:
            here = here.withColumn("p", own + F.col("gamma") / SYMBOLS)
        else:
            here = here.withColumn("gram_", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
            here = here.join(before.select("tag", F.col("gram").alias("gram_"), F.col("p").alias("q")), ["tag", "gram_"]).withColumn("p", own + F.col("gamma") * F.col("q"))
        before = staged(here.select("tag", "n", "gram", "c", "p"), "smoothed")
        done.append(before)
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out, contexts.select("tag", "n", "context", "gamma")


class Model:
    """For each language and order sorted arrays: n-gram -> log p, context -> log gamma (without a text's own n-grams only)."""

    def __init__(self, grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], contexts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] | None = None):
        self.grams, self.contexts = grams, contexts

    @staticmethod
    def _look(arrays, key) -> tuple[np.ndarray, np.ndarray]:
        if arrays is None or not len(arrays[0]):
            return np.zeros(len(key), bool), np.zeros(len(key))
        keys, values = arrays
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        found = keys[at] == key
        return found, np.where(found, values[at], 0.0)

    def score(self, tag: int, found: list[bytes]) -> np.ndarray:
        """Natural log probability of each text, its end included. Without contexts every n-gram must be known."""
        total = np.zeros(len(found))
        for lot in _pieces(found):
            place, todo, starts, grams = _symbols(lot)
            out, back = np.zeros(len(place)), np.zeros(len(place))
            for n in range(ORDER, 0, -1):
                at = np.flatnonzero(todo & (place >= n - 1))
                gram = grams[n - 1][at]
                hit, value = self._look(self.grams.get((tag, n)), gram)
                if self.contexts is None and not hit.all():
                    raise LookupError("texts hold n-grams that their chunk did not count: its rows changed between two reads")
                out[at[hit]] = back[at[hit]] + value[hit]
                todo[at[hit]] = False
                at, gram = at[~hit], gram[~hit]
                if len(at):
                    back[at] += self._look(self.contexts.get((tag, n)), gram >> 8)[1]
            out[todo] = back[todo] - math.log(SYMBOLS)
            np.add.at(total, [x[0] for x in lot], np.add.reduceat(out, starts))
        return total


def _arrays(tag: np.ndarray, n: np.ndarray, key: np.ndarray, value: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    out = {}
    for t in np.unique(tag):
        for k in range(1, ORDER + 1):
            at = np.flatnonzero((tag == t) & (n == k))
            at = at[np.argsort(key[at], kind="stable")]
            out[int(t), k] = key[at], value[at]
    return out


def fit(docs: DataFrame, running: bool = False) -> Model:
    """docs: text, tag -> the whole model in memory, for small tables only: the query looks n-grams up by chunks."""
    def arrays(df: DataFrame, key: str, value: str):
        t = df.select("tag", "n", key, F.log(value).alias("v")).toArrow()
        return _arrays(*(t.column(i).to_numpy() for i in range(4)))

    grams, contexts = smoothed(ngrams(asked(docs.withColumns({"chunk": F.lit(0).cast("long"), "doc_id": F.lit(0)}), running)))
    return Model(arrays(grams, "gram", "p"), arrays(contexts, "context", "gamma"))


def _marked(text: str) -> int:
    return sum(map(text.count, MARKS))


def _same_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _in_repeats(hashes: np.ndarray) -> int:
    """Words that lie in a window of three words that occurs twice or more."""
    if len(hashes) < 4:
        return 0
    _, inverse, count = np.unique(chained(hashes, 3), return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    cover = np.zeros(len(hashes), bool)
    for i in range(3):
        cover[at + i] = True
    return int(cover.sum())


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, surprise double"


_PARTS = "chunk long, tag long, n int, gram long, v float, docs binary"


def _pack(batches):
    """chunk, doc_id, tag, text -> compressed lots of documents, each of one chunk; n tells how they sort: after n-grams."""
    for whole in batches:
        chunk = whole.column(0).to_numpy()
        for c in np.unique(chunk):
            own = pa.Table.from_batches([whole]).filter(pa.array(chunk == c)).select(["doc_id", "tag", "text"])
            for a in range(0, own.num_rows, _DOCS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_table(own.slice(a, _DOCS))
                yield pa.record_batch([pa.array([int(c)]), pa.array([0], pa.int64()), pa.array([ORDER + 1], pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.float32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "tag", "n", "gram", "v", "docs"])


def _rated(batch: pa.Table, model: Model, hashes: HashMemo) -> pa.RecordBatch:
    tags = batch.column("tag").to_pylist()
    texts = [t or "" for t in batch.column("text").to_pylist()]
    split = [t.encode().split() for t in texts]
    surprise: list[float | None] = [None] * len(texts)
    for tag in set(tags):
        own = [j for j, t in enumerate(tags) if t == tag and split[j]]
        found = [b" ".join(split[j]) for j in own]
        for j, f, s in zip(own, found, model.score(tag, found).tolist(), strict=True):
            surprise[j] = -s / (len(f) + 1)
    rows = []
    for text, found, s in zip(texts, split, surprise, strict=True):
        spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
        rows.append((len(found), len(text) - spaces, _marked(text), _same_lines(text), _in_repeats(hashes.array(found)), s))
    kinds = [pa.int64()] * 5 + [pa.float64()]
    return pa.record_batch([batch.column("doc_id").combine_chunks(), batch.column("tag").combine_chunks(), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "tag", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "surprise"])


def _measure(batches):
    """Rows of _PARTS, chunk by chunk, n-grams before documents."""
    hashes, chunk, held, model = HashMemo(), None, [], None
    for batch in batches:
        chunks, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(n > ORDER) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if chunks[a] != chunk:
                chunk, held, model = chunks[a], [], None
            if n[a] <= ORDER:
                held.append([batch.column(i).slice(a, b - a).to_numpy() for i in (1, 2, 3, 4)])
                continue
            if model is None:
                model = Model(_arrays(*map(np.concatenate, zip(*held))) if held else {})
                held = []
            for i in range(a, b):
                yield _rated(pa.ipc.open_stream(batch.column(5)[i].as_buffer()).read_all(), model, hashes)


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, tag, text) -> doc_id, tag, the counts and `surprise`: negative log probability a byte (null: no words).

    A chunk is a partition of the table, or a share by hash where partitions are large: what a task holds of the model
    is bounded by the text it scores, however large the model is.
    """
    shares = max(1, round(docs.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes() / _CHUNK))
    docs = docs.withColumn("chunk", F.spark_partition_id().cast("long") * shares + F.pmod(F.xxhash64("text"), F.lit(shares)))
    found = asked(docs)
    grams, _ = smoothed(ngrams(found))
    known = found.select("chunk", "tag", "n", "gram").join(grams.select("tag", "n", "gram", F.log("p").cast("float").alias("v")), ["tag", "n", "gram"])
    known = staged(known.select("chunk", "tag", "n", "gram", "v"), "known").withColumn("docs", F.lit(None).cast("binary"))
    # the same columns as in asked(): what a small table's repartition deals out where depends on the columns it has
    lots = docs.select("chunk", "doc_id", "tag", "text").mapInArrow(_pack, _PARTS)
    parts = known.unionByName(lots).repartition("chunk").sortWithinPartitions("chunk", "n")
    return parts.mapInArrow(_measure, "doc_id long, tag long, " + _MEASURES)


def bands(rows: DataFrame) -> DataFrame:
    """tag -> low, high: the surprise between which a language's documents are kept."""
    q = F.percentile_approx("surprise", F.array(F.lit(TAIL), F.lit(0.5), F.lit(1 - TAIL)), 1000)
    got = rows.groupBy("tag").agg(q.alias("q"))
    return got.select("tag", (F.col("q")[1] - BAND * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + BAND * (F.col("q")[2] - F.col("q")[1])).alias("high"))


def op10_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document.

    Null text has no words: all counts 0, base_failed, not kept. Documents with a null lang share a model and band of
    their own. A null or repeated doc_id is carried along; equal rows get equal answers. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64(F.coalesce("lang", F.lit(""))).alias("tag"))
    rows = staged(measured(docs), "measures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("surprise").between(F.col("low"), F.col("high")), F.lit(False))
    limits = staged(bands(rows.where(~failed)), "bands")  # a row a language; of known size, so Spark can choose to broadcast it
    joined = rows.join(limits, "tag", "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), F.exp("surprise").alias("perplexity"), "low", "high")
