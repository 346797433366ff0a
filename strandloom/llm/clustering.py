"""Centroid clustering with Yinyang groups: exact rounds that skip the centroids which bounds rule out.

The centroids are put into groups once. Every vector keeps an upper bound of the distance to its centroid and, for
each group, a lower bound of the distance to the group's other centroids. A round moves the bounds by how far the
centroids went; a vector whose lower bounds all lie above its upper bound stays (global filter), groups whose bound
lies above it are passed over (group filter), and the centroids of the rest are measured exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import released, staged, table
from strandloom.llm.vectors import matrix, usable, whole

CENTROIDS, ROUNDS, WIDTH = 40, 5, 64
#: Centroids of a group, on average.
GROUP = 10
_STATE = "vec_id long, x array<int>, was int, cluster int, upper double, lower array<double>, distance long"


@dataclass(frozen=True)
class Step:
    """What the tasks of a round are told: all of it is of the size of the centroids."""

    centroids: np.ndarray  # whole numbers, as doubles
    groups: tuple[np.ndarray, ...]  # the centroids of each, ascending
    drift: np.ndarray | None  # how far each centroid went since the round before; None in the first round
    measure: bool  # whether every vector's distance is wanted


def grouped(centroids: np.ndarray, size: int = GROUP, rounds: int = 5) -> tuple[np.ndarray, ...]:
    """Centroids -> groups of near ones, by a few plain rounds over the centroids themselves."""
    n = max(1, -(-len(centroids) // size))
    middle = centroids[:: max(1, len(centroids) // n)][:n]
    for _ in range(rounds):
        of = _squares(centroids, middle).argmin(1)
        middle = np.array([centroids[of == g].mean(0) if (of == g).any() else middle[g] for g in range(len(middle))])
    return tuple(np.flatnonzero(of == g) for g in range(len(middle)) if (of == g).any())


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids: exact, since vectors' components are bounded whole numbers."""
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(1)


def _least_two(d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the least distance, its centroid (the smaller number of equal ones) and the least of the others."""
    at = d.argmin(1)
    rows = np.arange(len(d))
    least = d[rows, at]
    d[rows, at] = np.inf
    return least, ids[at], d.min(1)


def assigned(x: np.ndarray, step: Step, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None):
    """One round for the rows of x: new cluster, upper and lower bounds. Without bounds all centroids are measured."""
    c, groups, n = step.centroids, step.groups, len(x)
    if cluster is None:
        d = _squares(x, c)
        best = d.argmin(1).astype(np.int32)
        upper, lower = np.sqrt(d[np.arange(n), best]), np.empty((n, len(groups)))
        d[np.arange(n), best] = np.inf
        for g, ids in enumerate(groups):
            lower[:, g] = np.sqrt(d[:, ids].min(1))
        return best, upper, lower
    cluster, upper = cluster.copy(), upper + step.drift[cluster]
    lower = lower - np.array([step.drift[ids].max() for ids in groups])[None, :]
    above = lambda u: u * (1 + 1e-9) + 1e-6  # noqa: E731  rounding of roots must not hide a tie
    rows = np.flatnonzero(lower.min(1) <= above(upper))  # global filter
    here = _own(x[rows], c[cluster[rows]])
    upper[rows] = np.sqrt(here)
    rest = lower[rows].min(1) <= above(upper[rows])  # again, with the distance itself
    rows, here = rows[rest], here[rest]
    old, best, near = cluster[rows], cluster[rows].copy(), here.copy()
    limit = above(upper[rows])
    for g, ids in enumerate(groups):
        part = np.flatnonzero(lower[rows, g] <= limit)  # group filter
        if not len(part):
            continue
        d = _squares(x[rows[part]], c[ids])
        d[ids[None, :] == old[part][:, None]] = np.inf
        first, which, second = _least_two(d, ids)
        won = (first < near[part]) | ((first == near[part]) & (which < best[part]))
        lower[rows[part], g] = np.sqrt(np.where(won, second, first))
        # a centroid that was best so far is now one of the others of its group
        lost = part[won & (best[part] != old[part])]
        home = _group_of(groups, len(c))[best[lost]]
        lower[rows[lost], home] = np.minimum(lower[rows[lost], home], np.sqrt(near[lost]))
        best[part[won]], near[part[won]] = which[won], first[won]
    moved = np.flatnonzero(best != old)
    home = _group_of(groups, len(c))[old[moved]]
    lower[rows[moved], home] = np.minimum(lower[rows[moved], home], np.sqrt(here[moved]))
    cluster[rows], upper[rows] = best, np.sqrt(near)
    return cluster, upper, lower


def _group_of(groups: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    out = np.empty(n, int)
    for g, ids in enumerate(groups):
        out[ids] = g
    return out


def _round(state: DataFrame, step: Step) -> DataFrame:
    first, width = step.drift is None, step.centroids.shape[1]

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), width)
            if first:
                was, bounds = pa.nulls(len(x), pa.int32()), (None, None, None)
            else:
                was = batch.column(3)
                bounds = was.to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            cluster, upper, lower = assigned(x, step, *bounds)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * lower.shape[1]), pa.array(lower.ravel()))
            far = pa.array(_own(x, step.centroids[cluster]).astype(np.int64)) if step.measure else pa.nulls(len(x), pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), was, pa.array(cluster.astype(np.int32)), pa.array(upper), flat, far], ["vec_id", "x", "was", "cluster", "upper", "lower", "distance"])

    return state.mapInArrow(run, _STATE)


def _changes(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the sums and counts of the clusters gained and lost in a round. A task adds up its own rows; k * (width + 1)
    numbers reach the driver."""

    def run(batches):
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            x = np.concatenate((matrix(batch.column(0), width).astype(np.int64), np.ones((batch.num_rows, 1), np.int64)), 1)
            np.add.at(total, batch.column(2).to_numpy(), x)
            had = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            np.subtract.at(total, batch.column(1).drop_null().to_numpy(), x[had])
        c, i = np.nonzero(total)
        yield pa.record_batch([pa.array(c), pa.array(i), pa.array(total[c, i])], ["c", "i", "s"])

    moved = state.where(~F.col("was").eqNullSafe(F.col("cluster"))).select("x", "was", "cluster").mapInArrow(run, "c long, i long, s long")
    out = np.zeros((k, width + 1), np.int64)
    for r in moved.groupBy("c", "i").agg(F.sum("s").alias("s")).collect():
        out[r["c"], r["i"]] = r["s"]
    return out[:, :width], out[:, width]


def clustered(vectors: DataFrame, starts: DataFrame, rounds: int = ROUNDS, size: int = GROUP) -> tuple[DataFrame, np.ndarray]:
    """vectors: vec_id, x (whole numbers, all of one length). starts: c (0, 1, ...), x; a bounded table, collected.

    Returns vec_id, cluster, distance (squared) and the final centroids. Each round is a pass over a written table, in
    which vectors never move between tasks; only the sums of vectors that changed their cluster are gathered, a row a
    cluster.
    """
    rows = sorted(starts.collect(), key=lambda r: r["c"])
    centroids = np.array([r["x"] for r in rows], np.int64)
    k, width = centroids.shape
    groups, drift = grouped(centroids.astype(float), size), None
    sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
    state = vectors
    for i in range(rounds + 1):
        new = staged(_round(state, Step(centroids.astype(float), groups, drift, i == rounds)), "yinyang")
        if i:
            released(state)
        state = new
        if i == rounds:
            break
        more = _changes(state, k, width)
        sums, counts = sums + more[0], counts + more[1]
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        drift, centroids = np.sqrt(((moved - centroids).astype(float) ** 2).sum(1)), moved
    return state.select("vec_id", "cluster", "distance"), centroids


def op13_yinyang(spark, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings of 64 usable components, after five rounds from centroids chosen by a hash of vec_id.

    Vectors of another length, null ones and those with a null or non-finite component get no row. A repeated row is a
    vector of its own each time; a null vec_id counts as an empty text in the hash; of equal hashes the smaller vector
    starts the smaller number. With fewer than 40 vectors there are as many centroids, with none no rows. Components
    beyond 4,096 on either side count as 4,096. Other columns have no effect, whatever they are called.
    """
    x = F.when(usable(F.col("embedding")) & (F.size("embedding") == WIDTH), whole(F.col("embedding")))
    vectors = staged(table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x")).where("x IS NOT NULL"), "vectors")
    chosen = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = vectors.select(chosen.alias("h"), "x").orderBy("h", "x").limit(CENTROIDS).collect()  # no more than CENTROIDS rows
    fields = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return vectors.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    state, centroids = clustered(vectors, spark.createDataFrame([(i, r["x"]) for i, r in enumerate(starts)], "c int, x array<int>"))
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()], fields)
    return state.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster


def _sql() -> str:
    square = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT"
    finite = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND {finite} = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 40))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT k.rid, k.vec_id, k.v, min({square} * 64 + c) AS m FROM kept k, c{i} c GROUP BY ALL)")
        if i < ROUNDS:
            parts.append(f"m{i} AS MATERIALIZED (SELECT c, list(x ORDER BY i) AS v FROM (SELECT m % 64 AS c, i, floor(sum(v[i]) / count(*))::BIGINT AS x FROM a{i}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, (m % 64)::INT AS cluster, (m // 64)::BIGINT AS distance, sum(m // 64) OVER (PARTITION BY m % 64)::BIGINT AS cluster_inertia, sum(m // 64) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = m % 64"""


OP13_SQL = _sql()
