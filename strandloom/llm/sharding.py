"""Hierarchical weighted hash tree: every document descends region, rack and shard by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import mix64, staged, table, with_fields


@dataclass(frozen=True)
class Tree:
    """shards: leaves 0..n-1; per_rack leaves in a rack, per_region racks in a region; weights default to 1."""

    shards: int
    per_rack: int = 5
    per_region: int = 4
    weights: tuple[float, ...] = ()

    def weight(self, leaf: int) -> float:
        return (self.weights[leaf] if self.weights else 1.0) if leaf < self.shards else 0.0

    def regions(self) -> int:
        return -(-self.shards // (self.per_rack * self.per_region))


#: Levels of draws: children of the root, of a region, of a rack; a light leaf's mark and delay; a heavy leaf's excess.
_REGION, _RACK, _SHARD, _MARK, _DELAY, _EXCESS = range(6)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _uniform(keys: np.ndarray, level: int, node: np.ndarray | int) -> np.ndarray:
    """A number between 0 and 1 for each key at a node of a level, always the same one."""
    at = np.asarray(node).astype(np.uint64) * _STEP[0] + np.uint64(level + 1) * _STEP[1]
    return ((mix64(mix64(keys ^ mix64(at)) + at) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _draw(keys: np.ndarray, level: int, node: np.ndarray | int, rate: float = 1.0) -> np.ndarray:
    """An exponential draw of a rate for each key at a node; the least draw wins."""
    return -np.log(_uniform(keys, level, node)) / rate


def _first(keys: np.ndarray, level: int, parent: np.ndarray, width: int) -> np.ndarray:
    """The child with the least draw, all children being alike."""
    return parent * width + np.stack([_draw(keys, level, parent * width + i) for i in range(width)]).argmin(0)


def leaves(keys: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf of each key (64-bit hashes). A key descends: one draw for each region, then one for each rack of the
    winner, then one for each of its shards (2 + 4 + 5 draws for 40 shards); see with_shard()."""
    of_region = tree.per_region * tree.per_rack
    held = np.array([min(max(tree.weight(i), 0.0), 1.0) for i in range(tree.regions() * of_region)])
    heavy = [(i, tree.weight(i) - 1.0) for i in range(tree.shards) if tree.weight(i) > 1]

    def descended(keys: np.ndarray, regions: np.ndarray) -> np.ndarray:
        return _first(keys, _SHARD, _first(keys, _RACK, regions, tree.per_region), tree.per_rack)

    def reached(keys: np.ndarray, times: list[np.ndarray], nodes: list[tuple[bool, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of the least time, of a region (then a descent) or of a leaf itself; and whether it is the latter."""
        won = np.stack(times).argmin(0)
        node, whole = np.array([n for _, n in nodes])[won], np.array([w for w, _ in nodes])[won]
        out = node.copy()
        out[whole] = descended(keys[whole], node[whole])
        return out, ~whole

    regions = [_draw(keys, _REGION, g, of_region) for g in range(tree.regions())]
    extra = [_draw(keys, _EXCESS, i, more) for i, more in heavy]
    out, straight = reached(keys, [*regions, *extra], [*((True, g) for g in range(len(regions))), *((False, i) for i, _ in heavy)])
    on = np.flatnonzero(~straight & (_uniform(keys, _MARK, out) >= held[out]))
    if not len(on):
        return out
    # room that is empty there: these keys compare the times of regions and of the shards in regions with empty room
    k, times, nodes = keys[on], [x[on] for x in extra], [(False, i) for i, _ in heavy]
    for g, begun in enumerate(regions):
        racks = range(g * tree.per_region, (g + 1) * tree.per_region)
        if held[g * of_region : (g + 1) * of_region].min() == 1:
            times.append(begun[on])
            nodes.append((True, g))
            continue
        of_racks = [_draw(k, _RACK, r, tree.per_rack) for r in racks]
        for r, own in zip(racks, of_racks, strict=True):
            rooms = range(r * tree.per_rack, (r + 1) * tree.per_rack)
            if not held[rooms.start : rooms.stop].any():
                continue
            of_rooms = [_draw(k, _SHARD, i) for i in rooms]
            since = begun[on] + own - np.minimum.reduce(of_racks) - np.minimum.reduce(of_rooms)
            for i, mine in zip(rooms, of_rooms, strict=True):
                if held[i] > 0:
                    times.append(since + mine + np.where(_uniform(k, _MARK, i) < held[i], 0.0, _draw(k, _DELAY, i, held[i])))
                    nodes.append((False, i))
    out[on] = reached(k, times, nodes)[0]
    return out


def with_shard(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Adds `out`, the leaf of `key` in the tree, and out_region, out_rack.

    Draws go by room, not by what stands there yet: a rack has room for per_rack shards of weight 1 and a region for
    per_region racks, so an old node's draws never change when others come or grow. A row that lands on a shard which is
    not there, or (by its mark) on what a shard of less than 1 lacks, goes on to the region or shard with the next time:
    of a node's children the first has the node's own time, each other one comes later by as much as its draw exceeds the
    least, which is exponential of its own rate again. What a shard weighs above 1 draws beside the regions. So each
    shard's time is exponential in its own weight, rows are dealt by weight at all three levels, and a new or changed
    shard moves rows only into or out of itself. A null key draws as any other value. Shards of weight 0 or less take
    nothing. Spark hashes the key, whatever its type; a batch of rows descends at once.
    """
    schema = with_fields(df, f"`{out}` int, `{out}_region` int, `{out}_rack` int")

    def run(batches):
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            leaf = leaves(keys, tree)
            rack = leaf // tree.per_rack
            told = [pa.array(x.astype(np.int32)) for x in (leaf, rack // tree.per_region, rack)]
            yield pa.record_batch([*batch.columns[:-1], *told], schema.names)

    return df.select("*", F.xxhash64(F.col(key)).alias("_drawn")).mapInArrow(run, schema)


def with_slots(df: DataFrame, shard: str, key: str, rows_per_cell: int = 50_000, out: str = "slot") -> DataFrame:
    """Adds `out`: gapless places 0.. within each shard.

    A shard's rows split into cells of about rows_per_cell by a hash of the key, so that no task orders a whole shard;
    a cell's first place is the sum of the cells before it. Repeated keys take neighbouring places.
    """
    df = staged(df, "placed")  # read twice below
    total = df.count()
    cells = max(1, total // rows_per_cell)
    df = df.withColumn("_cell", F.pmod(F.xxhash64(F.col(key), F.lit("cell")), F.lit(cells)).cast("int"))
    sizes = df.groupBy(shard, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(shard, "_cell").orderBy(F.col(key).asc_nulls_first()))
    df = df.withColumn("_place", place).join(starts, [shard, "_cell"])
    return df.withColumn(out, (F.col("_start") + F.col("_place") - 1).cast("long")).drop("_cell", "_start", "_place")


def op5_hash_tree(spark, sf_dir: str, shards: int = 40) -> DataFrame:
    """Shards of all documents under the law `key`: doc_id and the number of shards decide.

    Null text: size 16 and the checksum of no bytes, 0. A null doc_id is a key as any other. Rows that repeat a doc_id
    share its shard and take a slot each. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = with_shard(docs, "doc_id", Tree(shards), "shard").withColumnRenamed("shard_region", "region").withColumnRenamed("shard_rack", "rack")
    placed = with_shard(placed, "doc_id", Tree(shards + 1), "grown_shard").drop("grown_shard_region", "grown_shard_rack")
    return with_slots(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
