"""Language identification: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection.

Training is stochastic gradient descent in numpy on a bounded sample of labelled documents; prediction reads every
text whole, in bounded steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import mix64, table, with_fields

BUCKETS, WIDTH, ORDERS = 1 << 15, 16, (1, 2, 3)
#: Bound of the training sample: documents of all languages together. Their texts count whole.
SAMPLE_DOCS = 4000
#: Different subwords that a document of the sample is told by at most; of a text with more, a hash picks them.
SAMPLE_SUBWORDS = 8192
EPOCHS, BATCH, RATE = 6, 64, 0.5
#: Steps of gradient descent at least: small samples are passed more often.
STEPS = 350
#: Of the calibration documents that are predicted right, the share that the rejection threshold may lose.
LOST = 0.001
STEP = 1 << 20  # symbols of a text that are hashed at a time
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _symbols(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """A text's letters in order, each run of other characters as one edge, an edge at both ends; and how many letters."""
    low, after_letter = text.lower(), True
    yield np.array([32], np.uint64), 0
    for i in range(0, len(low), STEP):
        codes = np.frombuffer(low[i : i + STEP].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after_letter
        after_letter = bool(letter[-1])
        yield np.where(letter, codes, 32).astype(np.uint64)[keep], int(letter.sum())
    yield np.array([32], np.uint64), 0


def subwords(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of all subwords of 1 to 3 symbols of a text, step by step (the same however it is stepped), and letters."""
    tail = np.empty(0, np.uint64)
    for part, n in _symbols(text):
        x, old = np.concatenate((tail, part)), len(tail)
        found, h = [], np.zeros(len(x), np.uint64)
        for k in range(max(ORDERS)):
            h = h[: max(len(x) - k, 0)] * np.uint64(0x9E3779B97F4A7C15) + x[k:] + np.uint64(1)
            if k + 1 in ORDERS:
                new = h[max(old - k, 0) :]  # those that end in this part
                g = (new ^ (new >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append((g >> np.uint64(49)).astype(np.int32))
        tail = x[max(len(x) - max(ORDERS) + 1, 0) :]
        yield np.concatenate(found), n


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and their counts; none without a letter. No more than BUCKETS of them."""
    total, letters = np.zeros(BUCKETS, np.int64), 0
    for found, n in subwords(text or ""):
        total += np.bincount(found, minlength=BUCKETS)
        letters += n
    at = np.flatnonzero(total) if letters else np.empty(0, np.int64)
    return at.astype(np.int32), total[at].astype(np.float32)


def thinned(found: np.ndarray, n: np.ndarray, most: int = SAMPLE_SUBWORDS) -> tuple[np.ndarray, np.ndarray]:
    """No more than `most` of a text's buckets, by a hash of bucket and text."""
    if len(found) <= most:
        return found, n
    keep = np.sort(np.argsort(mix64(found.astype(np.uint64) + np.uint64(int(n.sum())) * np.uint64(BUCKETS)), kind="stable")[:most])
    return found[keep], n[keep]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    votes: np.ndarray  # bucket x language: the bucket's embedding times the softmax weights, over the temperature
    bias: np.ndarray
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; `und` and 0 for null or a text without a letter. Long texts are summed in steps."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        total, count, letters = np.zeros(len(self.languages)), 0, 0
        for found, n in subwords(text):
            total += self.votes[found].sum(0, dtype=np.float64)
            count, letters = count + len(found), letters + n
        if not letters:
            return UNKNOWN, 0.0
        z = total / count + self.bias
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def fit(languages: list[str], labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], held: np.ndarray) -> Model:
    """rows: subword buckets of each document and their shares; held: the documents that calibrate instead of train."""
    rng, k = np.random.default_rng(7), len(languages)
    emb, w, b = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)), np.zeros((WIDTH, k)), np.zeros(k)
    train = np.flatnonzero(~held)
    if not len(train):
        train = np.flatnonzero(held)
    batches = (len(train) + BATCH - 1) // BATCH
    epochs, done = max(EPOCHS, -(-STEPS // batches)), 0
    steps = epochs * batches
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), BATCH):
            part = train[i : i + BATCH]
            sizes = np.array([len(rows[j][0]) for j in part])
            flat, share = (np.concatenate([rows[j][x] for j in part]) for x in (0, 1))
            doc = np.repeat(np.arange(len(part)), sizes)
            mean = np.add.reduceat(emb[flat] * share[:, None], np.concatenate(([0], np.cumsum(sizes)[:-1])), 0)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ w.T
            w -= rate * mean.T @ p / len(part) * 8
            b -= rate * p.mean(0)
            order = np.argsort(flat, kind="stable")
            at = np.flatnonzero(np.diff(flat[order], prepend=-1))
            emb[flat[order][at]] -= rate * np.add.reduceat((back[doc] * share[:, None])[order], at, 0) * 8
            done += 1
    votes = emb @ w
    calib = np.flatnonzero(held) if held.any() else train
    z = np.array([rows[j][1] @ votes[rows[j][0]] + b for j in calib]).reshape(-1, k)
    y = labels[calib]

    doubt = 1 / (len(y) + 2)  # that a sample without a mistake leaves: keeps scores off 1

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        s = s - np.log(np.exp(s).sum(1, keepdims=True))
        own = s[np.arange(len(y)), y]
        return -float(np.mean((1 - doubt) * own + doubt * (s.sum(1) - own) / max(k - 1, 1)))

    heat = min(np.geomspace(0.05, 10, 60), key=loss) if len(y) else 1.0
    s = z / heat
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == y
    threshold = min(0.5, float(np.quantile(p.max(1)[right], LOST))) if right.any() else 0.0
    return Model(tuple(languages), (votes / heat).astype(np.float32), b / heat, threshold)


def train(docs: DataFrame, docs_bound: int = SAMPLE_DOCS) -> Model:
    """Fits a model to docs (doc_id, text, lang).

    At most docs_bound documents, the same number for each language, are taken by the order of a hash of doc_id: a
    share that gives about a fifth more than wanted passes first, so that only the sample itself is ordered. Their texts
    count whole; the counts of SAMPLE_SUBWORDS subwords at most for each reach the driver (66 KB). Of more languages than
    docs_bound those with the most documents are learnt, of equally many the first by name; the others are not.
    """
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 40)))
    none = Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 0.0)
    known = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(docs_bound).collect()}
    if not known:
        return none
    each = docs_bound // len(known)
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, (1.2 * each + 50) / n) * (1 << 40)) for lang, n in known.items()], "lang string, below double")
    picked = docs.join(F.broadcast(share), "lang").where("h < below")  # a row for each language, no more than docs_bound
    picked = picked.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("nth") <= each)

    def run(batches):
        for batch in batches:
            made = [thinned(*counted(t.as_py())) for t in batch.column(0)]
            columns = [pa.array([m[i] for m in made], pa.list_(kind)) for i, kind in ((0, pa.int32()), (1, pa.float32()))]
            yield pa.record_batch([batch.column(1), batch.column(2), *columns], ["lang", "h", "found", "n"])

    told = picked.select("text", "lang", "h").mapInArrow(run, "lang string, h long, found array<int>, n array<float>").toArrow()
    lang, h = told.column("lang").to_pylist(), told.column("h").to_pylist()
    rows = [(f.values.to_numpy(), n.values.to_numpy()) for f, n in zip(told.column("found"), told.column("n"), strict=True)]
    order = sorted((i for i in range(len(rows)) if len(rows[i][0])), key=lambda i: (lang[i], h[i], rows[i][0].tobytes(), rows[i][1].tobytes()))
    if not order:
        return none
    rows = [(rows[i][0], rows[i][1] / rows[i][1].sum()) for i in order]
    languages = sorted({lang[i] for i in order})
    labels = np.array([languages.index(lang[i]) for i in order], int)
    return fit(languages, labels, rows, np.array([h[i] % 5 == 0 for i in order], bool))


def may_learn() -> Column:
    """Documents outside the held-out fold: crc32 of doc_id as text, modulo 5, is not 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score, rejected added. The model is broadcast: BUCKETS x languages numbers."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    schema = with_fields(docs, "lang_pred string, score double, rejected boolean")

    def run(batches):
        model = shared.value
        for batch in batches:
            told = [model.predict(t.as_py()) for t in batch.column(names.index("text"))]
            columns = [pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64())]
            columns.append(pa.array([x[0] == UNKNOWN or x[1] < model.threshold for x in told], pa.bool_()))
            yield pa.record_batch([*batch.columns, *columns], [*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def op3_subword_softmax(spark, sf_dir: str) -> DataFrame:
    """Language of every document.

    Null texts and texts without a letter are `und` with score 0 and rejected. A null doc_id is neither learnt from nor
    held out. Without anything to learn from, all are `und`. Equal texts get equal answers; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang").where(may_learn()))
    told = predicted(docs.select("doc_id", "text"), model)
    return told.select("doc_id", F.coalesce(~may_learn(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
