"""Quality classifier: a generalised additive model with pairwise interactions, from cyclic boosting of shallow trees.

Every text becomes a row of plain measures. A measure's values are cut into bins by the sample's quantiles; boosting
goes round the measures in turn, each time adding a small tree over the bins of one of them to its lookup table, then
in the same way round the pairs of measures that explain most of what is left. A score is the sum of one table entry
for each measure and pair, through the logistic function: a text is scored by looking up bins.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import table, with_fields
from strandloom.llm.language import may_learn

#: Bound of the training sample: labelled documents, in the order of a hash of doc_id.
SAMPLE_DOCS = 20_000
#: From this score on a text is predicted to be of quality 1.
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, PATIENCE = 240, 120, 0.1, 20
#: What a leaf's weight is raised by, so that few documents move it little; and leaves of a tree.
SHRINK, LEAVES = 2.0, 3
_PIECE = 1 << 20  # bytes of a text that are measured at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BREAK = re.compile(rb"\n+")

#: What is measured, in order.
MEASURES = (
    "log_words", "word_bytes", "longest_word", "upper", "digits", "marks", "bangs", "stops", "high_bytes", "other_signs", "entropy", "distinct", "distinct_pairs", "commonest", "same_as_last", "line_bytes", "same_lines", "one_byte_words", "upper_words",
)
_KIND = np.full(256, 7, np.int64)
for _i, _signs in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>", b"!?", b".,;:", range(128, 256))):
    _KIND[list(_signs)] = _i
_KIND[[9, 10, 11, 12, 13, 32]] = 8


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about _PIECE bytes that end with a word."""
    at = 0
    while at < len(raw):
        end = at + _PIECE
        found = _SPACE.search(raw, end) if end < len(raw) else None
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def measured(text: str | None) -> list[float]:
    """The measures of a whole text. Counts are summed over its pieces; of null and empty texts all are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    hist = np.zeros(256, np.int64)
    n = size = longest = kinds = twos = common = again = lines = same = single = capital = 0
    for piece in _pieces(raw):
        hist += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        words = piece.split()
        if not words:
            continue
        lengths = list(map(len, words))
        n, size, longest = n + len(words), size + sum(lengths), max(longest, max(lengths))
        single += lengths.count(1)
        counted = Counter(words)
        kinds, common = kinds + len(counted), common + max(counted.values())
        twos += len(set(zip(words, islice(words, 1, None), strict=False)))
        again += sum(map(operator.eq, words, islice(words, 1, None)))
        capital += sum(map(bytes.isupper, words))
        found = [x for x in _BREAK.split(piece) if x]
        lines, same = lines + len(found), same + len(found) - len(set(found))
    if not n:
        return [0.0] * len(MEASURES)
    kind = np.bincount(_KIND, weights=hist, minlength=9)
    ink = max(1.0, kind[:8].sum())
    p = hist[hist > 0] / hist.sum()
    return [
        math.log1p(n), size / n, math.log1p(longest), kind[0] / max(1.0, kind[0] + kind[1]), *(kind[i] / ink for i in (2, 3, 4, 5, 6, 7)), float(-(p * np.log2(p)).sum()),
        kinds / n, twos / n, common / n, again / n, math.log1p(size / max(lines, 1)), same / max(lines, 1), single / n, capital / n,
    ]


@dataclass(frozen=True)
class Model:
    edges: tuple[np.ndarray, ...]  # of each measure: the limits between its bins
    coarse: tuple[np.ndarray, ...]  # the same for pairs
    base: float
    tables: tuple[np.ndarray, ...]  # an entry a bin
    pairs: tuple[tuple[int, int, np.ndarray], ...]  # two measures and an entry for each pair of bins

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rows of measures -> scores: one addition for each measure and pair, over all rows at once."""
        z = np.full(len(x), self.base)
        for f, entries in enumerate(self.tables):
            z += entries[np.searchsorted(self.edges[f], x[:, f])]
        for f, g, entries in self.pairs:
            z += entries[np.searchsorted(self.coarse[f], x[:, f]), np.searchsorted(self.coarse[g], x[:, g])]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Limits between bins of about as many documents each; a value that many share gets a bin of its own."""
    values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1), method="lower"))
    return (values[1:] + values[:-1]) / 2


def tree(gain: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Sums of gradient and curvature by bin -> a step for each bin: the best tree of so many leaves, split by split."""
    worth = lambda g, h: g * g / (h + SHRINK)
    parts, steps = [(0, len(gain))], np.zeros(len(gain))
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            if b - a < 2:
                continue
            g, h = np.cumsum(gain[a:b]), np.cumsum(weight[a:b])
            won = worth(g[:-1], h[:-1]) + worth(g[-1] - g[:-1], h[-1] - h[:-1]) - worth(g[-1], h[-1])
            i = int(won.argmax())
            if won[i] > best[0]:
                best = (won[i], (a, a + i + 1, b))
        if best[1] is None:
            break
        a, m, b = best[1]
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    for a, b in parts:
        steps[a:b] = gain[a:b].sum() / (weight[a:b].sum() + SHRINK)
    return steps


def pair_tree(gain: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The same over two measures' bins: one split of the first, then one of the second on either side; and its worth."""
    total = gain.sum() ** 2 / (weight.sum() + SHRINK)
    steps, best = np.zeros_like(gain), 0.0
    rows_g, rows_h = np.cumsum(gain, 0), np.cumsum(weight, 0)
    for m in range(1, len(gain)):
        worth, parts = 0.0, []
        for g, h, rows in ((rows_g[m - 1], rows_h[m - 1], slice(0, m)), (rows_g[-1] - rows_g[m - 1], rows_h[-1] - rows_h[m - 1], slice(m, None))):
            left, lower = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            right, upper = g.sum() - left, h.sum() - lower
            found = left * left / (lower + SHRINK) + right * right / (upper + SHRINK)
            if not len(found):
                continue
            i = int(found.argmax())
            worth += found[i]
            parts.append((rows, i + 1, left[i] / (lower[i] + SHRINK), right[i] / (upper[i] + SHRINK)))
        if worth - total > best:
            best, steps = worth - total, np.zeros_like(gain)
            for rows, i, a, b in parts:
                steps[rows, :i], steps[rows, i:] = a, b
    return steps, best


def _loss(y: np.ndarray, z: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def _boosted(cells: list[np.ndarray], sizes: list[tuple[int, ...]], y, z, held, rounds: int, grow) -> tuple[list[np.ndarray], np.ndarray]:
    """Rounds over tables in turn; `held` documents do not teach but tell when to stop. Tables and scores after that."""
    tables, taught, w = [np.zeros(s) for s in sizes], ~held, None
    best, kept, since = _loss(y[held], z[held]) if held.any() else math.inf, None, 0
    for r in range(rounds):
        for j, cell in enumerate(cells):
            p = 1 / (1 + np.exp(-z))
            w = taught * p * (1 - p)
            n = int(np.prod(sizes[j]))
            gain, weight = (np.bincount(cell, weights=v, minlength=n).reshape(sizes[j]) for v in (taught * (y - p), w))
            step = RATE * grow(gain, weight)
            tables[j] += step
            z = z + step.ravel()[cell]
        if held.any():
            now = _loss(y[held], z[held])
            if now < best - 1e-6:
                best, kept, since = now, ([t.copy() for t in tables], z), 0
            else:
                since += 1
            if since > PATIENCE:
                break
    if held.any():
        return kept or ([np.zeros(s) for s in sizes], z - sum(t.ravel()[c] for t, c in zip(tables, cells, strict=True)))
    return tables, z


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model:
    """Rows of measures, labels 0 and 1, and the documents that only tell when to stop -> a model.

    Without documents, or with one label only, the model is its base: the share of label 1, held off 0 and 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return Model((), (), base, (), ())
    if not (~held).any() or not held.any():
        held = np.zeros(len(y), bool)
    fields = range(x.shape[1])
    edges, coarse = (tuple(_edges(x[:, f], bins) for f in fields) for bins in (BINS, PAIR_BINS))
    cells = [np.searchsorted(edges[f], x[:, f]) for f in fields]
    tables, z = _boosted(cells, [(len(e) + 1,) for e in edges], y, np.full(len(y), base), held, ROUNDS, tree)
    small = [np.searchsorted(coarse[f], x[:, f]) for f in fields]
    p = 1 / (1 + np.exp(-z))
    found = []
    for f, g in combinations(fields, 2):
        size = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        if min(size) > 1:
            cell = small[f] * size[1] + small[g]
            gain, weight = (np.bincount(cell, weights=~held * v, minlength=size[0] * size[1]).reshape(size) for v in (y - p, p * (1 - p)))
            found.append((-pair_tree(gain, weight)[1], f, g, size, cell))
    found = sorted(found, key=lambda t: t[:3])[:PAIRS]
    two, z = _boosted([t[4] for t in found], [t[3] for t in found], y, z, held, PAIR_ROUNDS, lambda g, h: pair_tree(g, h)[0])
    return Model(edges, coarse, base, tuple(tables), tuple((t[1], t[2], e) for t, e in zip(found, two, strict=True)))


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_DOCS) -> Model:
    """docs: doc_id, text. labels: doc_id, quality. Fits a model to at most `bound` labelled documents.

    They are the first by a hash of doc_id: a table of that bound, which is broadcast to the documents, so no text is
    shuffled. Of rows that share a doc_id one counts, the one with the least measures; a doc_id with several labels has
    the one that most of its rows say (1 if as many). One row of measures for each reaches the driver.
    """
    named = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    named = named.withColumn("h", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("gam")), F.lit(1 << 40)))
    picked = named.orderBy("h", "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # `bound` rows of three numbers

    def run(batches):
        for batch in batches:
            rows = pa.array([measured(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(1), batch.column(2), batch.column(3), rows], ["doc_id", "quality", "h", "x"])

    rows = found.select("text", "doc_id", "quality", "h").mapInArrow(run, "doc_id long, quality int, h long, x array<double>")
    rows = rows.groupBy("doc_id", "quality", "h").agg(F.min("x").alias("x")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(MEASURES))
    h = rows.column("h").to_numpy()
    return fit(x, rows.column("quality").to_numpy().astype(float), h % 5 == 0)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted added. The model is broadcast: its tables are of set size."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        for batch in batches:
            x = np.array([measured(t.as_py()) for t in batch.column(names.index("text"))], float).reshape(-1, len(MEASURES))
            score = shared.value.score(x)
            yield pa.record_batch([*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(run, with_fields(docs, "score double, predicted int"))


def op11_additive_model(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, as labels.quality marks it.

    Null and empty texts have all measures 0 and the score that follows. A null doc_id is neither learnt from nor held
    out. Labels that are null or neither 0 nor 1 teach nothing; without labels, or with one only, every score is the
    share of label 1 (half without any). Equal texts get equal scores, repeated rows stay repeated; an empty table gives
    no rows. Other columns have no effect.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(may_learn()), labels.select("doc_id", "quality").where(may_learn()))
    return scored(docs, model).select("doc_id", F.coalesce(~may_learn(), F.lit(False)).alias("held_out"), "score", "predicted")
