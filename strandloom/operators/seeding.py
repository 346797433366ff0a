"""Seeds, candidates and verified hits: the join of reads with a reference."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from strandloom.functions import dna
from strandloom.functions.kernels import codes, prefix_codes
from strandloom.operators.saving import saved
from strandloom.plans.config import AlignConfig

#: Bases of a reference chunk, and how far each goes into the next: no read is longer.
CHUNK, OVERLAP = 1 << 14, 10_240
#: Places that are cut out of one short string: finding a place in a string takes time in proportion to it.
BLOCK = 512
#: So many different seeds of reads, at most, are sent to the tasks that code the reference.
SENT = 1 << 20


def chunks(contigs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """contig_id, seq -> contig_id, chunk, length, seq: overlapping pieces, so that no row or task holds a whole contig.

    Contigs that were cut as they were read (sources.fasta) are such pieces already.
    """
    if "chunk" in contigs.columns:
        if (size, overlap) != (CHUNK, OVERLAP):
            raise ValueError("these contigs are cut already, to other chunks")
        return contigs.select("contig_id", "chunk", "length", "seq")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size)))
    cut = contigs.where(F.length("seq") > 0).select("contig_id", "seq", starts.alias("at"))
    return cut.select("contig_id", (F.col("at") / size).cast("long").alias("chunk"), F.length("seq").alias("length"), F.substring("seq", F.col("at") + 1, F.lit(size + overlap)).alias("seq"))


def chunks_of(contigs: DataFrame, places: DataFrame, **sizes) -> DataFrame:
    """chunks() of the contigs that `places` (a table with contig_id, saved) lie on: the others are dropped before they
    are cut and shuffled. Where more than SENT contigs are asked for, all are cut."""
    asked = places.select("contig_id").distinct()
    few = asked.limit(SENT + 1).count() <= SENT
    return chunks(contigs.join(F.broadcast(asked), "contig_id", "left_semi") if few else contigs, **sizes)


def whole(contigs: DataFrame) -> DataFrame:
    """One row a contig without its bases: contig_id, size and, where known, name, n_initial and n_final."""
    known = [c for c in ("name", "n_initial", "n_final") if c in contigs.columns]
    if "chunk" in contigs.columns:
        return contigs.where("chunk = 0").select("contig_id", F.col("length").alias("size"), *known)
    return contigs.select("contig_id", F.length("seq").cast("long").alias("size"), *known)


def seed_index(pieces: DataFrame, k: int, size: int = CHUNK) -> DataFrame:
    """Chunks -> seed, contig_id, pos for every place whose k bases have no N; a place belongs to one chunk."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(parts, "contig_id", "chunk")  # a file of a few splits, or a long contig, spreads before rows multiply
    own = F.least(F.length("seq") - k + 1, F.lit(size))  # places that begin in this chunk and not in the next
    blocks = pieces.where(own > 0).select("contig_id", "chunk", "seq", own.alias("own"), F.explode(F.sequence(F.lit(0), own - 1, F.lit(BLOCK))).alias("at"))
    n = F.least(F.lit(BLOCK), F.col("own") - F.col("at"))
    blocks = blocks.select("contig_id", (F.col("chunk") * size + F.col("at")).alias("at"), n.alias("n"), F.substring("seq", F.col("at") + 1, n + (k - 1)).alias("b"))
    seeds = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.substring("b", i + 1, F.lit(k)).alias("seed")))
    rows = blocks.select("contig_id", "at", F.explode(seeds).alias("x"))
    return rows.select("x.seed", "contig_id", (F.col("at") + F.col("x.i")).alias("pos")).where(~F.col("seed").rlike("[^ACGT]"))


def coded_index(pieces: DataFrame, k: int, size: int = CHUNK, wanted: np.ndarray | None = None) -> DataFrame:
    """chunks() -> seed (a number), contig_id, pos for every place whose k bases have no N; a place belongs to one chunk.

    wanted: ascending seeds; all others are left out. It is broadcast, so it has a checked size.
    """
    if k > 31:
        raise ValueError("a seed of more than 31 bases is no 64-bit number")
    spark = pieces.sparkSession
    shared = None if wanted is None else spark.sparkContext.broadcast(wanted)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(parts, "contig_id", "chunk").select("contig_id", "chunk", "seq")
    schema = StructType([StructField("seed", LongType()), pieces.schema["contig_id"], StructField("pos", LongType())])

    def run(batches):
        for batch in batches:
            for lot in range(0, batch.num_rows, 64):  # rows of a chunk are many rows of seeds
                part, seeds, rows, places = batch.slice(lot, 64), [], [], []
                for i, (chunk, seq) in enumerate(zip(part.column(1).to_pylist(), part.column(2), strict=True)):
                    found, ok = codes(seq.as_py().encode("latin-1", "replace")[: size + k - 1], k)
                    if shared is not None and len(found):
                        near = np.searchsorted(shared.value, found)
                        ok &= shared.value[np.minimum(near, len(shared.value) - 1)] == found if len(shared.value) else False
                    at = np.flatnonzero(ok)
                    seeds.append(found[at])
                    rows.append(np.full(len(at), i))
                    places.append(at + chunk * size)
                if rows:
                    yield pa.record_batch([pa.array(np.concatenate(seeds)), part.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places))], schema.names)

    return pieces.mapInArrow(run, schema)


def coded_places(pieces: DataFrame, wanted: dict[int, np.ndarray], size: int = CHUNK) -> DataFrame:
    """k, seed, contig_id, pos of the wanted seeds (ascending, by their k) as coded_index() has them: all k in one pass."""
    tables = {}
    for k, seeds in wanted.items():
        some = np.zeros(1 << (18 if len(seeds) < 1 << 14 else 23), bool)  # most places have no wanted seed: told by low bits
        some[seeds & (len(some) - 1)] = True
        tables[k] = seeds, some
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(tables)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(parts, "contig_id", "chunk").select("contig_id", "chunk", "seq")
    schema = StructType([*StructType.fromDDL("k int, seed long").fields, pieces.schema["contig_id"], StructField("pos", LongType())])

    def run(batches):
        for batch in batches:
            for lot in range(0, batch.num_rows, 64):
                part, out = batch.slice(lot, 64), []
                for i, (chunk, seq) in enumerate(zip(part.column(1).to_pylist(), part.column(2), strict=True)):
                    raw = seq.as_py().encode("latin-1", "replace")
                    for k, (seeds, some) in shared.value.items():
                        found, ok = codes(raw[: size + k - 1], k)
                        at = np.flatnonzero(some[found & (len(some) - 1)] & ok)
                        at = at[seeds[np.minimum(np.searchsorted(seeds, found[at]), len(seeds) - 1)] == found[at]]
                        if len(at):
                            out.append((np.full(len(at), k, np.int32), found[at], np.full(len(at), i), at + chunk * size))
                if out:
                    ks, numbers, rows, places = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.record_batch([pa.array(ks), pa.array(numbers), part.column(0).take(pa.array(rows)), pa.array(places)], schema.names)

    return pieces.mapInArrow(run, schema)


def seed_prefixes(pieces: DataFrame, k: int, depth: int, size: int = CHUNK) -> DataFrame:
    """prefix, n: the places of seed_index() by their first `depth` bases. A task counts what it reads, so no place is a
    row; 4 ** depth rows a task meet in the shuffle."""

    def run(batches):
        n = np.zeros(4**depth, np.int64)
        for batch in batches:
            for seq in batch.column(0):
                n += np.bincount(prefix_codes(seq.as_py().encode("latin-1", "replace")[: size + k - 1], k, depth), minlength=len(n))
        found = np.flatnonzero(n)
        names = ["".join("ACGT"[i >> 2 * j & 3] for j in reversed(range(depth))) for i in found.tolist()]
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(n[found])], ["prefix", "n"])

    return pieces.select("seq").mapInArrow(run, "prefix string, n long").groupBy("prefix").agg(F.sum("n").alias("n"))


@F.pandas_udf(LongType())
def seed_code(seed: pd.Series) -> pd.Series:
    """The number of a seed as coded_index() has it; null where it has another symbol than A, C, G, T."""
    known = {}
    for x in seed.dropna().unique():
        number, ok = codes(x.encode("latin-1", "replace"), len(x)) if x else (np.zeros(1, np.int64), [False])
        known[x] = int(number[0]) if ok[0] else None
    return pd.Series([known.get(x) for x in seed], dtype="Int64")


def matched_index(pieces: DataFrame, seeds: DataFrame, k: int, index: DataFrame | None = None) -> DataFrame:
    """The places of an index whose seed is one of `seeds` (any table with a column seed): seed, contig_id, pos.

    index: coded_index() for this k, read back; without one the reference is coded here. No more than SENT different
    seeds are sent to the tasks that read the index or code the reference; else both sides are shuffled by seed.
    """
    distinct = seeds.where("seed IS NOT NULL").select("seed").distinct()
    few = np.sort(distinct.limit(SENT + 1).toArrow().column(0).to_numpy())
    if index is None and len(few) <= SENT:
        return coded_index(pieces, k, wanted=few)
    places = coded_index(pieces, k) if index is None else index.select("seed", "contig_id", "pos")
    return places.join(F.broadcast(distinct) if len(few) <= SENT else distinct, "seed", "left_semi")


def occurrences(contigs: DataFrame, pattern: str) -> DataFrame:
    """contig_id, pos of every place where the pattern (31 bases at most) stands, overlapping ones too; none for one with N."""
    number, ok = codes(pattern.encode("latin-1", "replace"), len(pattern))
    return coded_index(chunks(contigs), len(pattern), wanted=number[ok]).select("contig_id", "pos")


def both_strands(reads: DataFrame) -> DataFrame:
    """read_id, seq -> a row for each strand; the read is turned, not the reference."""
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("-").alias("strand"), dna.reverse_complement(F.col("seq")).alias("seq")))
    return reads.select("read_id", F.explode(strands).alias("x")).select("read_id", "x.strand", "x.seq")


def read_seeds(reads: DataFrame, errors: int, k: int) -> DataFrame:
    """The first k bases of each of errors + 1 pieces: with no more errors one piece is unharmed."""
    n = errors + 1
    at = lambda j: F.floor(F.length("seq") * j / n).cast("int")
    seeds = F.transform(F.sequence(F.lit(0), F.lit(errors)), lambda j: F.struct(at(j).alias("at"), F.substring("seq", at(j) + 1, F.lit(k)).alias("seed")))
    rows = reads.where(F.length("seq") >= n * k).select("read_id", "strand", F.length("seq").alias("length"), F.explode(seeds).alias("x"))
    return rows.select("read_id", "strand", "length", "x.at", seed_code("x.seed").alias("seed")).where("seed IS NOT NULL")


def candidates(seeds: DataFrame, index: DataFrame) -> DataFrame:
    """The seed join: distinct places where a read could start. A small side is broadcast by Spark's own measure of it."""
    start = F.col("pos") - F.col("at")
    return seeds.join(index, "seed").select("read_id", "strand", "contig_id", start.alias("start")).where("start >= 0").distinct()


def windows(found: DataFrame, stranded: DataFrame, pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """Candidates with the read's bases and as many of the reference; only the chunk that holds the start is joined."""
    found = found.withColumn("chunk", F.floor(F.col("start") / size))
    joined = found.join(stranded, ["read_id", "strand"]).join(pieces.withColumnRenamed("seq", "piece"), ["contig_id", "chunk"])
    joined = joined.where(F.col("start") + F.length("seq") <= F.col("length"))
    at = (F.col("start") - F.col("chunk") * size).cast("int")
    return joined.select("read_id", "strand", "contig_id", "start", "seq", F.substring("piece", at + 1, F.length("seq")).alias("window"))


def verified(placed: DataFrame, errors: int) -> DataFrame:
    """Those with an edit distance within the bound; the exact ones skip the matrix."""
    distance = F.when(F.col("window") == F.col("seq"), F.lit(0)).otherwise(F.levenshtein("window", "seq", errors))
    return placed.withColumn("ed", distance.cast("long")).where("ed >= 0")


def map_reads(reads: DataFrame, contigs: DataFrame, errors: int = 3, k: int = AlignConfig.seed, bound: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """read_id, strand, contig_id, start, ed, seq, window: every verified place of every read.

    bound: errors that a window of the read's own length may have (default: `errors`). index: coded_index() of the
    contigs for this k, as written; else the seeds of the reads are looked for in the contigs.
    """
    stranded = both_strands(reads)
    seeds = read_seeds(stranded, errors, k)
    found = saved(candidates(seeds, matched_index(chunks(contigs), seeds, k, index)), "candidates")
    return verified(windows(found, stranded, chunks_of(contigs, found)), errors if bound is None else bound)


def map_all_lengths(reads: DataFrame, contigs: DataFrame, errors: int, k: int = AlignConfig.seed, bound: int | None = None, index: DataFrame | None = None, least: int = 8) -> DataFrame:
    """map_reads() for reads of any length: those too short for errors + 1 seeds of k bases take shorter seeds (k, its
    half, ... but no less than `least` bases), those too short for these fewer seeds, and so a bound of fewer errors.

    Reads shorter than two of the shortest seeds are looked for as a whole with no error.
    """
    n, out, sizes = errors + 1, [], [k]
    while sizes[-1] > least:
        sizes.append(max(least, sizes[-1] // 2))
    classes = [(n * x, x, errors) for x in sizes] + [(e * least, least, e - 1) for e in range(n - 1, 0, -1)]
    lengths = [r["n"] for r in reads.select(F.length("seq").alias("n")).distinct().collect() if r["n"] is not None]  # no more than a chunk's overlap
    above = 1 << 31
    for low, seed, e in classes:
        if seed == k == sizes[0] and not out or any(low <= x < above for x in lengths):
            own = reads.where((F.length("seq") >= low) & (F.length("seq") < above))
            out.append(map_reads(own, contigs, e, seed, None if bound is None else min(bound, 2 * e), index if seed == k else None))
        above = low
    return reduce(DataFrame.unionByName, out)


def best_in_contig(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy("read_id", "contig_id").orderBy("ed", "start", "strand")
    return hits.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def strata(reads: DataFrame, contigs: DataFrame, cfg: AlignConfig, errors: int, save=saved) -> DataFrame:
    """Mapping stage by stage: a read that a stage solves is not searched further (mode first), searched for one error
    more than its best (second), or searched with all errors at once (all).

    Each stage's hits and unsolved reads are saved, so a stage restarts from them and not from the reads. The contigs are
    passed over once for the seeds of all stages, and only the places of these are saved.
    """
    steps = [errors] if cfg.mode == "all" else range(errors + 1)
    index = None
    if len(steps) > 1:
        stranded = both_strands(reads)
        seeds = reduce(DataFrame.unionByName, [read_seeds(stranded, step, cfg.seed) for step in steps])
        index = save(matched_index(chunks(contigs), seeds, cfg.seed), "index")
    left, out, best = reads, None, None
    for step in steps:
        hits = map_reads(left, contigs, step, cfg.seed, index=index)
        if cfg.mode == "second" and best is not None:
            hits = hits.join(best, "read_id", "left").where(F.col("best").isNull() | (F.col("ed") <= F.col("best") + 1)).drop("best")
        hits = save(hits.select("read_id", "strand", "contig_id", "start", "ed").withColumn("stage", F.lit(step)), "hits")
        out = hits if out is None else out.unionByName(hits)
        best = out.groupBy("read_id").agg(F.min("ed").alias("best"))
        if step != steps[-1]:
            solved = best.where(F.col("best") <= (step if cfg.mode == "first" else step - 1)).select("read_id")
            left = save(left.join(solved, "read_id", "left_anti"), "left")
    order = Window.partitionBy("read_id", "strand", "contig_id", "start").orderBy("stage")
    return out.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def shared_qgrams(reads: DataFrame, pieces: DataFrame, errors: int, q: int, index: DataFrame | None = None) -> DataFrame:
    """The counting join: distinct q-grams, cut from each read side by side, that a contig (chunks()) shares with it.

    A place within `errors` errors keeps all q-grams but `errors` of them; a contig with fewer cannot hold the read.
    index: coded_index() of the contigs for q, read back.
    """
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length("seq") / q).cast("int") - 1, F.lit(0))), lambda j: F.struct(j.alias("j"), F.substring("seq", j * q + 1, F.lit(q)).alias("seed")))
    rows = reads.where(F.length("seq") >= q).select("read_id", "strand", F.floor(F.length("seq") / q).alias("n"), F.explode(grams).alias("x")).select("read_id", "strand", "n", "x.j", seed_code("x.seed").alias("seed"))
    held = rows.join(matched_index(pieces, rows, q, index).select("seed", "contig_id").distinct(), "seed")  # other seeds never leave their task
    counted = held.groupBy("read_id", "strand", "contig_id", "n").agg(F.countDistinct("j").alias("shared"))
    return counted.where(F.col("shared") >= F.col("n") - errors)
