"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word shingles, seen through minwise tokens. Trees branch on them: at each node a few token
positions are chosen, by the node's path alone, and a document goes down once for each with its token there. Documents
that share a node are likely alike; small nodes are compared exhaustively, large ones in blocks, or they branch again. Several
independent trees bring the recall to target. Every link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import HashMemo, chained, components, mix64, packed, scratch, staged, table, told_apart, unpacked

#: Token positions chosen at the roots of all trees together (4 trees of 2), and at each inner node.
ROOTS, BRANCHES = 8, 3
#: Minwise tokens of 8 bits in a sketch: nodes compare documents by them.
SKETCH = 128
#: Documents in a node that are compared exhaustively; larger nodes are cut into blocks that share PIVOTS documents.
NODE, PIVOTS = 1000, 32
#: Shingles and documents of a node that a task compares at a time (more go to further blocks).
BLOCK_SHINGLES, BLOCK = 1_000_000, 4000
#: The documents outside a node's main component, in groups of about so many shingles, are compared with the node's
#: blocks. A node of more than NODE documents, most of them outside, branches instead where that makes fewer rows, this
#: many levels at most.
LEVELS, OUTSIDE = 6, 3_000_000
#: Standard deviations that a sketch's estimate may fall short of the least similarity.
SLACK = 4.5


def shingle_hashes(text: str | None, k: int, memo: HashMemo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of k words, A-Z lower-cased; all words as one if there are fewer."""
    w = memo.array((text or "").encode().lower().split())
    if not len(w):
        return w
    if len(w) < k:
        return np.unique(mix64(chained(w, len(w)) + np.uint64(len(w))))
    return np.unique(mix64(chained(w, k) + np.uint64(k)))


_RNG = np.random.default_rng(20)
_ODD = _RNG.integers(0, 1 << 63, ROOTS + SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)


def _tokens(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Minwise values at the roots' positions (64 bits) and the sketch (8 bits of the others)."""
    least = np.full(ROOTS + SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2000):
        part = found[i : i + 2000]
        for j in range(ROOTS + SKETCH):
            least[j] = min(least[j], (part * _ODD[j]).min())
    mixed = mix64(least + np.arange(ROOTS + SKETCH, dtype=np.uint64))
    return mixed[:ROOTS].view(np.int64), (mixed[ROOTS:] & np.uint64(255)).astype(np.uint8).tobytes()


def _digest(sorted_set: bytes) -> bytes:
    return hashlib.blake2b(sorted_set, digest_size=16).digest()


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


_SIGNED = "row long, n int, set_key binary, roots array<long>, sketch binary"


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """row, text -> row, n (shingles), set_key (16 bytes, the same for equal sets), roots, sketch; null without words."""

    def run(batches):
        memo = HashMemo()
        for batch in batches:
            sizes, keys, roots, sketches = [], [], [], []
            for text in _column(batch, "text"):
                found = shingle_hashes(text.as_py(), shingle, memo)
                sizes.append(len(found))
                if len(found):
                    keys.append(_digest(found.tobytes()))
                    root, sketch = _tokens(found)
                    roots.append(root)
                    sketches.append(sketch)
                else:
                    keys.append(None), roots.append(None), sketches.append(None)
            yield pa.record_batch([_column(batch, "row"), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["row", "n", "set_key", "roots", "sketch"])

    return docs.select("row", "text").mapInArrow(run, _SIGNED)


_NODE = "key long, rep long, n int, sketch binary, comp long"


def _least_equal(similarity: float) -> int:
    """Tokens of a sketch that two documents of the least similarity share, but for SLACK deviations."""
    return int(SKETCH * similarity - SLACK * (SKETCH * similarity * (1 - similarity)) ** 0.5)


def _grouped(batches, work):
    """Rows in order of their first column, the node's key -> work(key, table of the node's rows)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cut, cut[1:]):
            if held and held[0].column(0)[0].as_py() != keys[i]:
                if len(held) > 1 or held[0].num_rows > 1:
                    yield from work(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(i, j - i))
    if held and (len(held) > 1 or held[0].num_rows > 1):
        yield from work(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))


def _sketches(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)


def _lanes(rows) -> np.ndarray:
    """Sketches by eights of their tokens, for _same()."""
    sketch = _sketches(rows)
    return np.ascontiguousarray(sketch.reshape(len(sketch), SKETCH // 8, 8).transpose(1, 0, 2))


def _same(lanes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Tokens that each sketch shares with one: bytes of 0 and 1, summed eight at a time (SKETCH is below 256)."""
    eights = (lanes == one[:, None]).view(np.uint64)[..., 0].sum(0)
    return ((eights * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _forest_of(similarity: float):
    """First pass over a node: the links of a maximal spanning forest of the likely ones; all likely ones if they are
    not many more, else the node is noted as dense.
    """
    need = _least_equal(similarity)

    def work(key, rows):
        rep, first = np.unique(rows.column("rep").to_numpy(), return_index=True)
        n, lanes, m = rows.column("n").to_numpy()[first], _lanes(rows)[:, first], len(rep)
        best, link, todo = np.full(m, -1), np.full(m, -1), np.ones(m, bool)
        todo[0] = False
        tree, every, likely, cur = [], [], 0, 0
        while True:
            rest = np.flatnonzero(todo)
            if not len(rest):
                break
            same = _same(lanes, lanes[:, cur])[rest]
            ok = (same >= need) & (np.minimum(n[rest], n[cur]) >= similarity * np.maximum(n[rest], n[cur]))
            likely += int(ok.sum())
            if likely <= 4 * m:
                every += [(cur, j) for j in rest[ok].tolist()]
            better = ok & (same > best[rest])
            best[rest[better]], link[rest[better]] = same[better], cur
            cur = int(rest[np.argmax(best[rest])])
            if best[cur] >= 0:
                tree.append((int(link[cur]), cur))
            todo[cur] = False
        dense = likely > 4 * m
        picked = tree if dense else every
        if picked or dense:
            a, b = ([int(rep[f(x)]) for x in picked] + [None] * dense for f in (min, max))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(picked) + [key] * dense, pa.int64())], ["a", "b", "dense"])

    return lambda batches: _grouped(batches, work)


def _outside(similarity: float):
    """Second pass over a cell: documents outside the main component (query) and those of the cell's block (own), of
    other components, that are likely linked with them. As many rows at most as come in.
    """
    need = _least_equal(similarity)

    def work(key, rows):
        n, lanes, comp = rows.column("n").to_numpy(), _lanes(rows), rows.column("comp").to_numpy()
        own = np.flatnonzero(rows.column("own").to_numpy())
        block, size, part = np.ascontiguousarray(lanes[:, own]), n[own], comp[own]
        found = np.zeros(len(n), bool)
        for i in np.flatnonzero(rows.column("query").to_numpy()):
            ok = (_same(block, lanes[:, i]) >= need) & (part != comp[i]) & (np.minimum(size, n[i]) >= similarity * np.maximum(size, n[i]))
            found[own[ok]] = True
            found[i] |= ok.any()
        if found.any():
            yield from rows.select(["key", "rep", "comp", "query"]).filter(pa.array(found)).combine_chunks().to_batches()

    return lambda batches: _grouped(batches, work)


def _exact(similarity: float):
    """Third pass: full sets of a block, each query against all; one link between two components is enough."""
    percent = round(100 * similarity)

    def work(key, rows):
        rep, comp = rows.column("rep").to_numpy(), rows.column("comp").to_numpy()
        query = np.flatnonzero(rows.column("query").to_numpy())
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("s")]
        sizes = np.array(list(map(len, sets)))
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        doc, ends = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes)
        now, out = comp.copy(), []
        for i in query:
            mark = np.zeros(int(ids.max()) + 1, bool)
            mark[ids[ends[i] - sizes[i] : ends[i]]] = True
            shared = np.bincount(doc[mark[ids]], minlength=len(sets))
            ok = np.flatnonzero((100 * shared >= percent * (sizes + sizes[i] - shared)) & (now != now[i]))
            for j in ok:
                if now[j] != now[i]:
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
                    now[now == now[j]] = now[i]
        if out:
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return lambda batches: _grouped(batches, work)


def _branch(batches):
    """Rows of large nodes -> rows of their children, and the node: positions come from its key, values from the sketch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy().view(np.uint64)
        sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
        for i in range(BRANCHES):
            at = (mix64(key + np.uint64(i + 1)) % np.uint64(SKETCH)).astype(np.int64)
            value = sketch[np.arange(len(key)), at].astype(np.uint64)
            child = mix64(mix64(key * np.uint64(BRANCHES) + np.uint64(i)) + value).view(np.int64)
            yield pa.record_batch([pa.array(child), *batch.columns[1:], batch.column(0)], ["key", "rep", "n", "sketch", "comp", "parent"])


def _full_sets(wanted: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """rep -> rep, s: the whole set of each representative wanted (reps: set_key, rep)."""
    wanted = wanted.join(reps, "rep")

    def sets(batches):
        memo = HashMemo()
        for batch in batches:
            found = [shingle_hashes(t.as_py(), shingle, memo).tobytes() for t in _column(batch, "text")]
            own = pa.array([_digest(s) == k.as_py() for s, k in zip(found, _column(batch, "set_key"), strict=True)], pa.bool_())
            yield pa.record_batch([_column(batch, "rep").filter(own), pa.array(found, pa.binary()).filter(own)], ["rep", "s"])

    made = docs.join(wanted, F.col("row") == F.col("rep")).select("rep", "text", "set_key").mapInArrow(sets, "rep long, s binary")
    return staged(made, "sets")  # a row that repeats another gives the same set again, which does no harm


def _confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Candidate pairs a, b of representatives -> those whose full sets are alike."""
    full, percent = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), docs, reps, shingle), round(100 * similarity)

    def alike(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_column(batch, "x"), _column(batch, "y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([_column(batch, "a").filter(keep), _column(batch, "b").filter(keep)], ["a", "b"])

    left = pairs.join(full.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a")
    both = left.join(full.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")
    return staged(both.mapInArrow(alike, "a long, b long"), "links")


def _in_blocks(rows: DataFrame, blocks, everywhere) -> DataFrame:
    """Rows of a node dealt to its blocks by a hash of the document; those that are to be everywhere go to each."""
    own = F.array(F.pmod(F.xxhash64("rep"), blocks))
    block = F.explode(F.when(everywhere, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(own))
    rows = rows.withColumn("_block", block)
    return rows.withColumn("key", F.when(F.col("_block") == 0, F.col("key")).otherwise(F.xxhash64("key", "_block"))).drop("_block")


def _in_cells(rows: DataFrame) -> DataFrame:
    """Rows of a node dealt to cells of a block (all documents, `own`) and a group (of those outside the main component,
    `query`): each outside document meets any other one in a cell, goes to a cell once, and no cell grows with the node."""
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    block, group = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.pmod(F.xxhash64("rep", F.lit("group")), F.col("groups"))
    cell = lambda b, g, own, query: F.struct(b.alias("b"), g.alias("g"), own.alias("own"), query.alias("query"))
    plain = F.transform(each("groups"), lambda g: cell(block, g, F.lit(True), F.col("outer") & (g == group)))
    others = F.filter(each("blocks"), lambda b: F.col("outer") & (b != block))
    rows = rows.withColumn("_c", F.explode(F.concat(plain, F.transform(others, lambda b: cell(b, group, F.lit(False), F.lit(True))))))
    return rows.select(F.xxhash64("key", "_c.b", "_c.g").alias("key"), "rep", "n", "sketch", "comp", "_c.own", "_c.query")


def _about(rows: DataFrame, *more: str) -> DataFrame:
    """Of each node (and what its rows have in common) with several components: the main one, all documents and those of
    the main one, its blocks and groups, and the rows that _in_cells() makes of it."""
    parts = rows.groupBy("key", *more, "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    main = F.struct("c", "comp")
    about = parts.groupBy(F.col("key").alias("_k"), *more).agg(F.max_by("comp", main).alias("main"), F.sum("n").alias("all"), F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("n", main).alias("inside"), F.count(F.lit(1)).alias("k"))
    blocks = F.greatest(F.ceil(F.col("all") / BLOCK_SHINGLES), F.ceil(F.col("m") / BLOCK))
    groups = F.greatest(F.ceil((F.col("all") - F.col("inside")) / OUTSIDE), F.ceil((F.col("m") - F.col("most")) / (4 * BLOCK)))
    about = about.where("k > 1").withColumn("blocks", blocks).withColumn("groups", groups)
    return staged(about.select("_k", *more, "main", "m", "most", "blocks", "groups", F.expr("m * groups + (m - most) * (blocks - 1)").alias("cost")), "about")


def _in_order(rows: DataFrame) -> DataFrame:
    """Each node in one piece and in order of its key."""
    return rows.repartition("key").sortWithinPartitions("key")


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """docs: row (unique), text -> (row, n, root), (a, b): sizes and component (least row) of all, and confirmed links.

    Documents with equal sets stand as one from the start. At the roots small nodes are compared whole and large ones in
    blocks that share pivots; a spanning forest of what is alike links them. Then components are known, and large or
    dense nodes only need links between different ones: the documents outside the node's main component are compared with
    all of it, on sketches, then on full sets. A group of near copies, or of texts nearly so alike, never grows smaller by
    branching; it costs a row a member and cell. A very large node, of many cells, branches where its children make fewer
    rows, level by level. Nodes within one component need no more work. A pair at the least similarity is missed with a chance of about (1 -
    similarity) to the power ROOTS (under 1 in 300,000), more by (1 - similarity) to the power BRANCHES for each level
    below, plus as much again for its sketch. README has the recall as measured against all pairs.
    """
    told = staged(signed(docs, shingle), "signed")
    sets = staged(told.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("row").alias("rep")), "sets")
    reps = told.join(sets.withColumnRenamed("rep", "row"), ["row", "set_key"])
    at = F.posexplode("roots").alias("i", "v")
    first = reps.select("row", "n", "sketch", at).select(F.xxhash64("i", "v").alias("key"), F.col("row").alias("rep"), "n", "sketch")
    of_key = lambda keys: F.col("key") == keys["_k"]
    large = staged(first.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > NODE).select(F.col("key").alias("_k"), "m"), "large")
    nodes = first
    if large.limit(1).count():
        shared = F.pmod(F.xxhash64("key", "rep"), F.col("m")) < PIVOTS
        cut = _in_blocks(first.join(large, of_key(large)), F.ceil(F.col("m") / NODE), shared).select(first.columns)
        nodes = first.join(large, of_key(large), "left_anti").unionByName(cut)
    got = staged(_in_order(nodes).mapInArrow(_forest_of(similarity), "a long, b long, dense long"), "pairs")
    links = _confirm(staged(got.where("dense IS NULL").select("a", "b").distinct(), "candidates"), docs, sets, shingle, similarity)
    again = staged(got.where("dense IS NOT NULL").select(F.col("dense").alias("_k")).union(large.select("_k")).distinct(), "again")
    if again.limit(1).count():
        comps = components(links).select(F.col("v").alias("rep"), F.col("root").alias("comp"))
        rows = first.join(again, of_key(again), "left_semi").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        rows, found = rows.select("key", "rep", "n", "sketch", "comp"), None
        about = _about(rows)
        for depth in range(LEVELS + 1):
            many = about.where((F.col("m") > NODE) & (2 * F.col("most") < F.col("m")) & (F.col("cost") > 2 * BRANCHES * F.col("m")))
            flat, below = about, None
            if depth < LEVELS and many.limit(1).count():
                level = staged(rows.join(many, of_key(many), "left_semi").mapInArrow(_branch, _NODE + ", parent long"), "level")
                below = _about(level, "parent")
                less = below.groupBy("parent").agg(F.sum("cost").alias("less"))
                less = many.join(less, F.col("_k") == F.col("parent"), "left").where(F.coalesce("less", F.lit(0)) + BRANCHES * F.col("m") < F.col("cost"))
                deep = staged(less.select("_k"), "deep")
                flat = about.join(deep, "_k", "left_anti")
            cut = rows.join(flat, of_key(flat)).withColumn("outer", F.col("comp") != F.col("main"))
            held = staged(_in_order(_in_cells(cut)).mapInArrow(_outside(similarity), "key long, rep long, comp long, query boolean"), "outside")
            found = held if found is None else found.unionByName(held)
            if below is None or not deep.limit(1).count():
                break
            of_parent = F.col("parent") == deep["_k"]
            rows = level.join(deep, of_parent, "left_semi").drop("parent")
            about = below.join(deep.withColumnRenamed("_k", "parent"), "parent", "left_semi").drop("parent")
        if found.limit(1).count():
            full = _full_sets(found.select("rep").distinct(), docs, sets, shingle)
            exact = _in_order(found.join(full, "rep").select("key", "rep", "comp", "query", "s")).mapInArrow(_exact(similarity), "a long, b long")
            links = links.unionByName(staged(exact, "links"))
    comps = components(links)
    roots = told.join(sets, "set_key", "left").join(comps.withColumnRenamed("v", "rep"), "rep", "left")
    return roots.select("row", F.col("n").cast("long").alias("n"), F.coalesce("root", "rep", "row").alias("root")), links


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept.

    Null and wordless texts have no shingles and are linked with nothing. A row with a null doc_id is not compared; its
    component is null and it is kept. Rows that repeat a doc_id are told apart by their
    sets; equal rows get equal answers.
    """
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows = known.select(F.col("doc_id").alias("row"), "text")
    with scratch(docs.sparkSession):
        told = staged(similar(rows, shingle, similarity)[0], "near", keep=True)
    told = told.select(F.col("row").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), (F.col("row") == F.col("root")).alias("kept"))
    none = signed(docs.where("doc_id IS NULL").select(F.lit(0).cast("long").alias("row"), "text"), shingle)
    none = none.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return told.unionByName(none)


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents (all columns) with one of each component left: that with the least doc_id.

    Rows that repeat doc_id and text leave one row, whose other columns come first by their digest; rows with a null
    doc_id all stay. Null and wordless texts are linked with nothing. An empty table gives no rows.
    """
    names = ["doc_id", "text"]
    kept = near_duplicates(docs, shingle, similarity).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    rows = packed(docs, names)
    known = rows.where("doc_id IS NOT NULL").withColumn("_h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_told", told_apart(["text", "_rest"]))
    known = known.withColumn("_again", F.lag("_h").over(Window.partitionBy("doc_id").orderBy("_h", "_told")))
    known = known.where(F.col("_again").isNull() | (F.col("_again") != F.col("_h")))
    known = known.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").select(*rows.columns)
    return unpacked(known.unionByName(rows.where("doc_id IS NULL")), docs.columns, names)


def op1_chosen_path(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 2-word shingles at a Jaccard similarity of 0.8 or more.

    See near_duplicates() for nulls and repeated rows. An empty table gives no rows.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


#: All pairs of documents that share a shingle, compared on full sets; components by following links.
OP1_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM d),
n AS (SELECT doc_id, count(shingle) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, links.b FROM reach r JOIN links ON r.other = links.a)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id, n
"""
