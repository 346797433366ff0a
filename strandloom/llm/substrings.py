"""Substring dedup: repeated runs of words across documents, found in suffix trees that are partitioned by prefix.

The tree of all suffixes is never built whole. A repeat of WINDOW words holds an anchor of PREFIX words, the least of its
runs of so many words by hash, which is the same wherever the same words stand. So only suffixes whose first WINDOW
words hold an anchor that two documents share can lie under a deep node; they are dealt to groups by that anchor.
An anchor of many documents is extended by the suffix's own first words, by more of them the more documents it has, so
that every group fits a task. A group carries the words themselves. It sorts its suffixes by them; common-prefix lengths of
neighbours then give the internal nodes: suffixes between which no common prefix is shorter than WINDOW words are the
leaves under one node of that depth, and what a document has under such nodes joins up to its maximal repeats.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import HashMemo, chained, mix64, scratch, staged, table

WINDOW, PREFIX = 13, 5
#: Words of a suffix that its group is named by besides the anchor, for anchors of more than so many documents. Suffixes
#: that share WINDOW words are one leaf, which needs no bound.
SPLITS = ((500, 9), (4000, WINDOW))
#: Different words that a task numbers before it starts anew with the next group.
_WORDS = 1_000_000


def _least_prefix(prefixes: np.ndarray) -> np.ndarray:
    """For each window the least of the prefix hashes inside it: the same for the same words wherever they stand."""
    n = WINDOW - PREFIX + 1
    out, have = prefixes, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step] if step else out, out[step:])
        have += step
    return out


class _Hashes:
    def __init__(self):
        self.memo = HashMemo()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of a text's words, of its runs of PREFIX words, and for each window the least of these."""
        w = self.memo.array((text or "").encode().split())
        g = mix64(chained(w, PREFIX))
        return w, g, _least_prefix(g) if len(w) >= WINDOW else np.empty(0, np.uint64)


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _anchors(batches):
    """Per document: windows, a digest of the text, and the distinct prefixes that its windows are filed under."""
    hashes = _Hashes()
    for batch in batches:
        found = [hashes.of(t.as_py())[2] for t in _column(batch, "text")]
        digests = [hashlib.blake2b((t.as_py() or "").encode(), digest_size=16).digest() for t in _column(batch, "text")]
        prefixes = [np.unique(x[_heads(x)]).view(np.int64) for x in found]
        yield pa.record_batch([_column(batch, "doc_id"), _column(batch, "rid"), pa.array(list(map(len, found)), pa.int32()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "rid", "n", "digest", "anchors"])


_LEAVES = "group long, doc_id long, rid long, starts array<int>, n int, words binary"
_RUNS = "doc_id long, rid long, start int, n int"


def _runs(doc: np.ndarray, rid: np.ndarray, start: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where consecutive windows of one document (and equal `more`) begin, and how many each run has."""
    head = np.ones(len(start), bool)
    head[1:] = (start[1:] != start[:-1] + 1) | (rid[1:] != rid[:-1]) | (doc[1:] != doc[:-1])
    for x in more:
        head[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(head)
    return at, np.diff(np.append(at, len(start))).astype(np.int32)


def _heads(node: np.ndarray) -> np.ndarray:
    """Where each node begins; leaves of a node are neighbours."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(node), 1), bool), node[1:] != node[:-1])))


def _least(value: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each leaf the least value under its node."""
    return np.repeat(np.minimum.reduceat(value, head), np.diff(np.append(head, len(value)))) if len(value) else value


def _set(x) -> np.ndarray:
    return x.values.to_numpy().view(np.uint64) if x.is_valid else np.empty(0, np.uint64)


class _Prefixes:
    """Which group a window goes to, by the anchors and longer prefixes that are known to be shared and crowded."""

    def __init__(self):
        self.hashes = _Hashes()

    def dealt(self, text: str | None, anchors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows under shared anchors: their starts and groups, and hashes of their words. anchors: all shared ones,
        then those of more documents than each of SPLITS."""
        w, _, least = self.hashes.of(text)
        head = _heads(least)
        at = np.flatnonzero(np.repeat(np.isin(least[head], anchors[0]), np.diff(np.append(head, len(least)))))
        group = least[at]
        base = group.copy()
        for (_, length), many in zip(SPLITS, anchors[1:], strict=True):
            if len(many):
                longer = np.flatnonzero(np.isin(base, many))
                group[longer] = mix64(base[longer] * np.uint64(0x9E3779B97F4A7C15) ^ _chained_at(w, at[longer], length))
        return at, group, _chained_at(w, at, WINDOW)


def _chained_at(w: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k values from each place on."""
    out = w[at]
    for i in range(1, k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + w[at + i])
    return mix64(out + np.uint64(k))


_LISTS = ["shared", *[f"many{i}" for i in range(len(SPLITS))]]


def _settled(texts: dict, node: np.ndarray, doc: np.ndarray, rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Windows of a batch whose words also stand in a smaller document of the batch; `node` is a hash of their words."""
    split = lru_cache(128)(lambda r: texts[r].as_py().encode().split())
    order = np.lexsort((doc, node))
    head = _heads(node[order])
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.repeat(head, np.diff(np.append(head, len(order))))]
    like = np.flatnonzero(doc != doc[lead])
    ahead = start[lead[like]] - start[like]
    out = np.zeros(len(order), bool)
    for i, n in zip(*(x.tolist() for x in _runs(doc[like], rid[like], start[like], rid[lead[like]], ahead)), strict=True):
        one, other = like[i], lead[like[i]]
        words = [split(int(rid[x]))[start[x] : start[x] + n + WINDOW - 1] for x in (one, other)]
        out[like[i : i + n]] = words[0] == words[1]  # hashes that agree by chance settle nothing
    return out


def _leaves(batches):
    """Suffixes that begin under shared prefixes: a row for each run of consecutive ones of a group, with all their words.

    A row lists every place where its document has the same words under the same group. Of equal windows in a batch
    only those of the least document go on to meet other batches, so a passage that many documents share sends a row a
    batch; the others are settled (group and words null).
    """
    prefixes, names = _Prefixes(), ["group", "doc_id", "rid", "starts", "n", "words"]
    for batch in batches:
        parts, texts = [], {}
        for doc, rid, text, *anchors in zip(*(_column(batch, c) for c in ("doc_id", "rid", "text", *_LISTS)), strict=True):
            at, group, node = prefixes.dealt(text.as_py(), list(map(_set, anchors)))
            if len(at):
                texts[rid.as_py()] = text
                parts.append((group.view(np.int64), np.full(len(at), doc.as_py()), np.full(len(at), rid.as_py()), at.astype(np.int32), node.view(np.int64)))
        if not parts:
            continue
        group, doc, rid, start, node = (np.concatenate(x) for x in zip(*parts, strict=True))
        settled = _settled(texts, node, doc, rid, start)
        go = np.flatnonzero(~settled)
        at, size = _runs(doc[go], rid[go], start[go], group[go])
        rows, split, now = {}, [], None
        for i, n in zip(go[at].tolist(), size.tolist()):
            r = int(rid[i])
            if r != now:
                split, now = texts[r].as_py().encode().split(), r
            s = int(start[i])
            rows.setdefault((int(group[i]), int(doc[i]), r, n, b" ".join(split[s : s + n + WINDOW - 1])), []).append(s)
        keys = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        made = [pa.array(k, kind) for k, kind in zip(keys, kinds)]
        yield pa.record_batch([*made[:3], pa.array(list(rows.values()), pa.list_(pa.int32())), *made[3:]], names)
        done = np.flatnonzero(settled)
        if len(done):
            at, size = _runs(doc[done], rid[done], start[done])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32)), pa.array(start[done[at]]))
            yield pa.record_batch([pa.nulls(len(at), pa.int64()), *(pa.array(x[done[at]]) for x in (doc, rid)), lists, pa.array(size), pa.nulls(len(at), pa.binary())], names)


def _suffix_nodes(group: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (group, place in ids) sorted by group and words: their order, and the node of WINDOW words that each is under.

    Neighbours whose common prefix is shorter than WINDOW words, or of another group, are under different nodes.
    """
    first = ids[at[:, None] + np.arange(WINDOW)].astype(np.int64)
    keys = [first[:, i] << 32 | first[:, i + 1] for i in range(0, WINDOW - 1, 2)] + [first[:, -1]] * (WINDOW % 2)
    order = np.lexsort((*keys[::-1], group))
    first, group = first[order], group[order]
    same = first[1:] == first[:-1]
    common = np.where(same.all(1), WINDOW, same.argmin(1))  # words that neighbours have in common
    split = (common < WINDOW) | (group[1:] != group[:-1])
    return order, np.concatenate(([0], np.cumsum(split)))


def _repeats(batches):
    """Rows in order of their group -> windows (doc_id, rid, start, n) under a node that a smaller document shares."""
    held: list[pa.RecordBatch] = []
    numbers: dict[bytes, int] = {}

    def done(rows: pa.Table):
        if len(numbers) > _WORDS:
            numbers.clear()
        size = rows.column("n").to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        found = [w for x in rows.column("words") for w in x.as_py().split(b" ")]
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found))
        begins = np.cumsum(size + (WINDOW - 1)) - (size + (WINDOW - 1))
        group, doc = (rows.column(c).to_numpy()[row] for c in ("group", "doc_id"))
        order, node = _suffix_nodes(group, ids, begins[row] + nth)
        again = np.empty(len(order), bool)
        again[order] = doc[order] > _least(doc[order], _heads(node))
        hit = np.flatnonzero(again)
        where, n = _runs(doc[hit], row[hit], nth[hit])
        starts, first = rows.column("starts").combine_chunks(), hit[where]
        counts = pc.list_value_length(starts).to_numpy()[row[first]]
        out = np.repeat(np.arange(len(first)), counts)
        offsets = starts.offsets.to_numpy()[row[first]]
        place = np.repeat(offsets, counts) + np.arange(len(out)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = starts.values.to_numpy()[place.astype(np.int64)] + nth[first][out]
        rid = rows.column("rid").to_numpy()[row[first]]
        return pa.record_batch([pa.array(doc[first][out]), pa.array(rid[out]), pa.array(begin.astype(np.int32)), pa.array(n[out])], ["doc_id", "rid", "start", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        group = _column(batch, "group").to_numpy()
        cut = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
        if cut or held and _column(held[0], "group")[0].as_py() != group[0]:
            yield done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield done(pa.Table.from_batches(held))


def repeated(docs: DataFrame) -> DataFrame:
    """docs: doc_id (not null), rid (tells texts of one doc_id apart), text -> doc_id, rid, runs (start, n): windows
    whose words also stand as a window in a document with a smaller doc_id.

    Of exact copies (by a digest of 128 bits) only the least document is followed; all windows of the others are
    repeats. Other windows are equal when their words are.
    """
    found = staged(docs.select("doc_id", "rid", "text").mapInArrow(_anchors, "doc_id long, rid long, n int, digest binary, anchors array<long>"), "anchors").where("n > 0")
    groups = found.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    copies = found.select("doc_id", "rid", "n", "digest").join(groups, "digest").where(F.col("doc_id") > F.col("least"))
    copies = staged(copies.select("doc_id", "rid", F.lit(0).alias("start"), "n"), "copies")
    each = found.join(copies.select("rid"), "rid", "left_anti").select("rid", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("rid").alias("a"), F.max("rid").alias("b"), F.count(F.lit(1)).alias("k")).where("a < b")
    shared = staged(shared.select("anchor", "k"), "shared")
    lists = [F.collect_set(F.when(F.col("k") > least, F.col("anchor"))).alias(name) for name, least in zip(_LISTS, (0, *(n for n, _ in SPLITS)))]
    wanted = staged(each.join(shared, "anchor").groupBy("rid").agg(*lists), "wanted")
    leaves = staged(docs.select("doc_id", "rid", "text").join(wanted, "rid").mapInArrow(_leaves, _LEAVES), "leaves")
    sorted_ = leaves.where("group IS NOT NULL").repartition("group").sortWithinPartitions("group")
    every = sorted_.mapInArrow(_repeats, _RUNS)
    settled = leaves.where("group IS NULL").select("doc_id", "rid", F.explode("starts").alias("start"), "n")
    every = every.unionByName(settled).unionByName(copies)
    return staged(every.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "runs", keep=True)


def _cut(batches):
    for batch in batches:
        counts, gone, digests, repeats, texts = [], [], [], [], []
        for text, runs in zip(_column(batch, "text"), _column(batch, "runs"), strict=True):
            found = (text.as_py() or "").encode().split()
            n, longest, kept = len(found), 0, found
            if runs.is_valid and len(runs):
                flat = runs.values.flatten()
                edge = np.zeros(n + 1, np.int64)
                start, size = flat[0].to_numpy(), flat[1].to_numpy()
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size + WINDOW - 1, -1)
                cover = np.cumsum(edge[:n]) > 0
                kept = [x for x, c in zip(found, cover.tolist(), strict=True) if not c]
                longest = int((np.diff(np.concatenate(([0], cover.view(np.int8), [0]))) == 1).sum())
            joined = b" ".join(kept)
            counts.append(n)
            gone.append(n - len(kept))
            repeats.append(longest)
            digests.append(hashlib.sha256(joined).hexdigest())
            texts.append(joined.decode())
        yield pa.record_batch([_column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(repeats, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats", "text"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, n_repeats (maximal repeats), text (what is left).

    Null text has no words; documents shorter than a window lose nothing; nor do those with a null doc_id, which is
    not smaller than any. Rows that repeat a doc_id do not make each other's words repeats.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    with scratch(docs.sparkSession):
        runs = repeated(docs.where("doc_id IS NOT NULL"))
    runs = runs.withColumnsRenamed({"doc_id": "_doc", "rid": "_rid"})
    joined = docs.join(runs, (F.col("doc_id") == F.col("_doc")) & (F.col("rid") == F.col("_rid")), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_repeats long, text string")


def op8_suffix_trees(spark, sf_dir: str) -> DataFrame:
    """Words that each document loses to documents with smaller ids, and a digest of those it keeps.

    See deduplicated() for nulls and repeated rows. An empty table gives no rows.
    """
    return deduplicated(table(spark, sf_dir, "documents")).drop("text")


#: Every window of every document by its words; a word goes when a window over it stands in a smaller document too.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, p, array_to_string(w[p : p + {WINDOW - 1}], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY words) AS least FROM v) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, p + i AS p FROM again, range({WINDOW}) t(i)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (p > before + 1 OR before IS NULL) AS n_repeats FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY 1),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_repeats, 0) AS n_repeats
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
