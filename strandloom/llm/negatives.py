"""Hard negatives by exact inner product: norm-bucketed search.

Candidates are dealt to slices and sorted in each by their norm, longest first; so many in a row are a bucket. Anchors
are a stated query set, dealt to blocks. A task has one block of anchors and one slice: it reads the slice's buckets in
order, passes over those whose longest norm times the anchor's (Cauchy-Schwarz) stays below the lower limit of a window
or below the k-th score that the window already has, and multiplies the rest in one matrix product. Each task gives
the best k of each window; the best k of all slices follow by a ranked window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import released, staged, table
from strandloom.llm.vectors import matrix, usable, whole

#: Anchors of a block, candidates of a bucket, candidates of a slice at least and at most (about).
BLOCK, BUCKET, LEAST, SLICE = 512, 512, 1024, 1 << 18
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is within these percentages of its positive's.
LOW, HIGH = 30, 90
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_FOUND = "rid long, positive_score long, scores array<long>, ids array<long>"
_STREAM = ["task", "kind", "rid", "vec_id", "label", "x", "n2", "windows"]


class Windows:
    """The windows of one block of anchors and the best k that each has met.

    An anchor without `windows` looks among its own label for any score; one with them looks among other labels, once
    for each (a positive's score), for scores from LOW to HIGH percent of it.
    """

    def __init__(self, width: int, k: int):
        self.width, self.k, self.parts, self.buckets, self.passed = width, k, [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def close(self) -> None:
        t = pa.Table.from_batches(self.parts).combine_chunks().to_batches()[0]
        self.a = matrix(t.column(5), self.width)
        self.rid, self.label = (t.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
        self.norm = np.sqrt((self.a * self.a).sum(1))
        listed = t.column(7).to_pylist()
        self.own = all(w is None for w in listed)
        pairs = [(i, s) for i, w in enumerate(listed) for s in ([0] if w is None else w)]
        self.of, self.score = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], np.int64)
        # whole scores s with LOW * p <= 100 * s <= HIGH * p
        self.low = np.full(len(pairs), _NONE + 1) if self.own else -((-LOW * self.score) // 100)
        self.high = np.full(len(pairs), _LAST) if self.own else (HIGH * self.score) // 100
        self.scores, self.ids = np.full((len(pairs), self.k), _NONE), np.full((len(pairs), self.k), _LAST)

    def meet(self, x: np.ndarray, rid: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        """A bucket: at most BUCKET candidates, whose longest norm bounds their scores."""
        self.buckets += 1
        longest = float(np.sqrt((x * x).sum(1).max()))
        bound = self.norm[self.of] * longest * (1 + 1e-9) + 1e-6
        wanted = np.flatnonzero((bound >= self.low) & (bound >= self.scores[:, -1]) & (self.low <= self.high))
        if not len(wanted):
            self.passed += 1
            return
        order = np.argsort(ids, kind="stable")  # of equal scores the first place is the smaller id
        x, rid, ids, label = x[order], rid[order], ids[order], label[order]
        used, at = np.unique(self.of[wanted], return_inverse=True)
        product = (self.a[used] @ x.T).astype(np.int64)
        same = self.label[used][:, None] == label[None, :]
        fit = same & (self.rid[used][:, None] != rid[None, :]) if self.own else ~same
        score = product[at]
        ok = fit[at] & (score >= np.maximum(self.low, self.scores[:, -1])[wanted][:, None]) & (score <= self.high[wanted][:, None])
        some = np.flatnonzero(ok.any(1))
        if not len(some):
            return
        n, wanted = x.shape[0], wanted[some]
        key = np.where(ok[some], score[some] * n + np.arange(n - 1, -1, -1), _NONE)  # no two of a row are equal
        k = min(self.k, n)
        top = np.argpartition(key, n - k, axis=1)[:, n - k :]
        rows = np.arange(len(some))[:, None]
        there = key[rows, top] != _NONE
        new = np.where(there, score[some[:, None], top], _NONE)
        scores, ids = np.concatenate((self.scores[wanted], new), 1), np.concatenate((self.ids[wanted], np.where(there, ids[top], _LAST)), 1)
        first = np.argsort(ids, axis=1, kind="stable")
        scores, ids = scores[rows, first], ids[rows, first]
        best = np.argsort(-np.maximum(scores, _NONE + 1), axis=1, kind="stable")[:, : self.k]
        self.scores[wanted], self.ids[wanted] = scores[rows, best], ids[rows, best]

    def found(self) -> pa.RecordBatch:
        full = self.scores != _NONE
        keep = np.flatnonzero(full[:, 0])
        sizes = full[keep].sum(1)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        ids = self.ids[keep][full[keep]]
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(self.scores[keep][full[keep]]), pa.array(ids, mask=ids == _LAST))]
        return pa.record_batch([pa.array(self.rid[self.of[keep]]), pa.array(self.score[keep]), *lists], ["rid", "positive_score", "scores", "ids"])


def _searched(width: int, k: int):
    def run(batches):
        task, now, open_anchors = None, None, False
        for batch in batches:
            tasks, kinds = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(tasks)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if tasks[a] != task:
                    if now is not None and not open_anchors:
                        yield now.found()
                    task, now, open_anchors = tasks[a], Windows(width, k), True
                if kinds[a] == 0:
                    now.add(part)
                    continue
                if open_anchors and now.parts:
                    now.close()
                    open_anchors = False
                if open_anchors:
                    continue  # a slice that no anchor asks
                x = matrix(part.column(5), width)
                rid, label = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
                ids = part.column(3).fill_null(_LAST).to_numpy(zero_copy_only=False)
                for i in range(0, len(x), BUCKET):
                    now.meet(x[i : i + BUCKET], rid[i : i + BUCKET], ids[i : i + BUCKET], label[i : i + BUCKET])
        if now is not None and not open_anchors:
            yield now.found()

    return run


def searched(anchors: DataFrame, rows: DataFrame, k: int, width: int, blocks: int, slices: int) -> DataFrame:
    """anchors: rid, vec_id, label, x, n2, block, windows. rows: rid, vec_id, label, x, n2. Gives rid, positive_score (0
    without windows), id, score, nth: the best k of each window, higher scores first, then smaller ids, null ids last.
    """
    null = F.lit(None).cast("array<long>")
    asked = anchors.withColumn("kind", F.lit(0)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    least = F.sqrt("n2") if "windows" not in anchors.columns else None
    if least is None:  # shorter candidates than any window of a block can use do not travel to it
        floor = F.array_min(F.transform("windows", lambda p: F.lit(LOW / 100) * p)) / F.greatest(F.sqrt("n2"), F.lit(1e-9))
        limits = anchors.groupBy("block").agg((F.min(floor) * (1 - 1e-9) - 1e-6).alias("_least"))
        offered = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(limits, "block").where(F.sqrt("n2") >= F.col("_least")).drop("_least")
    else:
        asked = asked.withColumn("windows", null)
        offered = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    offered = offered.withColumn("kind", F.lit(1)).withColumn("windows", null).withColumn("slice", F.pmod(F.xxhash64("rid"), F.lit(slices)).cast("int"))
    both = asked.select("block", "slice", *_STREAM[1:]).unionByName(offered.select("block", "slice", *_STREAM[1:]))
    both = both.withColumn("task", (F.col("block") * slices + F.col("slice")).cast("int")).select(*_STREAM)
    dealt = both.repartitionById(blocks * slices, F.col("task")).sortWithinPartitions("task", "kind", F.col("n2").desc(), "rid")
    found = dealt.mapInArrow(_searched(width, k), _FOUND)
    listed = found.select("rid", "positive_score", F.explode(F.arrays_zip("scores", "ids")).alias("x")).select("rid", "positive_score", F.col("x.scores").alias("score"), F.col("x.ids").alias("id"))
    order = Window.partitionBy("rid", "positive_score").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return listed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def relabelled(label: Column, vec_id: Column) -> Column:
    """The label, or the next of ten where vec_id is divisible by 7."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).cast("int")


def mined(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """rows: vec_id, label, x. Gives anchor_id, positive_id, rank, negative_id and both scores; see op12_norm_buckets()."""
    rows = staged(rows.withColumn("n2", F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where(is_anchor)
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors"), F.max(F.size("x")).alias("width")).first()
    blocks = max(1, -(-told["anchors"] // BLOCK))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(-(-told["n"] // SLICE), min(-(-parts // blocks), -(-told["n"] // LEAST)), 1)
    width = told["width"] or 0
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("rid", F.lit("block")), F.lit(blocks)).cast("int"))
    positives = searched(anchors, rows, POSITIVES, width, blocks, slices)
    positives = staged(positives.select("rid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    limits = positives.groupBy("rid").agg(F.array_sort(F.collect_set("positive_score")).alias("windows"))  # POSITIVES at most
    asked = staged(anchors.join(limits, "rid"), "anchors")
    negatives = searched(asked, rows, NEGATIVES, width, blocks, slices)
    negatives = negatives.select("rid", "positive_score", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positives.join(negatives, ["rid", "positive_score"]).join(asked.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    out = staged(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for df in (rows, positives, asked):
        released(df)
    return out


def op12_norm_buckets(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (vec_id divisible by 100) and positive.

    Rows with a null label or an unusable vector take no part; those with a null vec_id do, as candidates that come last
    among equal scores. A repeated row is a row of its own each time, also as an anchor's twin. Vectors of different
    lengths are compared as if the shorter one ended in zeros. Without an anchor, a positive or a score in its window
    there is no row. Components beyond 4,096 on either side count as 4,096. Other columns have no effect.
    """
    rows = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", relabelled(F.col("label"), F.col("vec_id")).alias("label"), whole(F.col("embedding")).alias("x"))
    return mined(rows, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


OP12_SQL = """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS MATERIALIZED (SELECT a.rid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM kept a JOIN kept b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
pos AS (SELECT rid, anchor_id, id AS positive_id, score AS positive_score, nth FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id NULLS LAST) AS nth FROM scored WHERE same) WHERE nth <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.rid, p.nth ORDER BY s.score DESC, s.id NULLS LAST)::INT AS rank
  FROM pos p JOIN scored s ON s.rid = p.rid AND NOT s.same WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score) WHERE rank <= 10"""
