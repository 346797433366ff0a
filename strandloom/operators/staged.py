"""Search in stages: no error, one, two, ... and at last all that are allowed; a read that a stage solves leaves.

A stage of e errors cuts every read by its own length into e + 1 segments (its substages): with no more errors one
segment has none, so an equi-join of the segments' seeds with the reference misses nothing. Seeds are numbers (two
bits a base); what numpy codes is joined, grouped and sorted by Spark. Places are verified with free ends around the
seed, a batch of pairs at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from strandloom.functions import kernels
from strandloom.operators import seeding
from strandloom.operators.saving import saved
from strandloom.plans.config import AlignConfig, segments, stages

#: Shortest seed, and places that a seed may have before it counts as a repeat's.
LEAST, HOT = 8, 1000
#: Parts that the places of a repeat's seed are dealt to.
SALT = 32
#: From so many errors on the bit-parallel distance is taken for the banded one.
BIT_PARALLEL = 7


def seed_sizes(longest: int) -> list[int]:
    """Seed lengths from the longest down to LEAST, each half of the one before."""
    out = [longest]
    while out[-1] > LEAST:
        out.append(max(LEAST, out[-1] // 2))
    return out


def seed_of(length: int, stage: int, longest: int) -> int | None:
    """The seed length that a read of this length takes in a stage; None if its segments are shorter than any seed."""
    return next((k for k in seed_sizes(longest) if length // (stage + 1) >= k), None)


def plan(lengths: list[int], errors: int, longest: int, mode: str = "first") -> list[int]:
    """The stages of a run: with mode all the last one only. Stages that no read is long enough for are left out."""
    wanted = [errors] if mode == "all" else stages(errors)
    able = [s for s in range(errors + 1) if any(seed_of(n, s, longest) for n in lengths)]
    if mode == "all" and lengths:  # reads too short for all errors are searched for as many as they can have
        wanted = sorted({max((s for s in able if seed_of(n, s, longest)), default=-1) for n in lengths} - {-1})
    return [s for s in wanted if s in able]


def segment_seeds(reads: DataFrame, steps: list[int], longest: int, mode: str = "first") -> DataFrame:
    """read_id, strand, seq -> read_id, strand, stage, substage, k, at, seed: of each segment the first k bases in a row
    without N. A segment without such bases has no row: its read is left to the other substages.
    """
    schema = StructType([reads.schema["read_id"], *StructType.fromDDL("strand string, stage int, substage int, k int, at int, seed long").fields])

    def run(batches):
        for batch in batches:
            found = []
            for i, seq in enumerate(batch.column(2).to_pylist()):
                raw, coded = seq.encode("latin-1", "replace"), {}
                able = [s for s in steps if seed_of(len(raw), s, longest)]
                for stage in able[-1:] if mode == "all" else able:
                    k = seed_of(len(raw), stage, longest)
                    if k not in coded:
                        coded[k] = kernels.codes(raw, k)
                    seed, ok = coded[k]
                    for minor, (a, b) in enumerate(segments(len(raw), stage)):
                        free = np.flatnonzero(ok[a : b - k + 1])
                        if len(free):
                            found.append((i, stage, minor, k, a + int(free[0]), int(seed[a + free[0]])))
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            row = pa.array(columns[0], pa.int64())
            numbers = [pa.array(c, t) for c, t in zip(columns[1:], (*[pa.int32()] * 4, pa.int64()), strict=True)]
            yield pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), *numbers], schema.names)

    return reads.select("read_id", "strand", "seq").mapInArrow(run, schema)


def blocks(reads: DataFrame, stage: int, longest: int) -> DataFrame:
    """read_id, strand, stage, substage, k, at, seed of all of a read's side-by-side blocks (k as in the stage), and n,
    how many it has; blocks with an N have a null seed. The substage is that of the segment in which a block begins."""
    schema = StructType([reads.schema["read_id"], *StructType.fromDDL("strand string, stage int, substage int, k int, at int, seed long, n int").fields])

    def run(batches):
        for batch in batches:
            found = []
            for i, seq in enumerate(batch.column(2).to_pylist()):
                raw = seq.encode("latin-1", "replace")
                k = seed_of(len(raw), stage, longest)
                if k is None:
                    continue
                seed, ok = kernels.codes(raw, k)
                at = range(0, len(raw) - k + 1, k)
                found += [(i, min(stage, a * (stage + 1) // len(raw)), k, a, int(seed[a]) if ok[a] else None, len(at)) for a in at]
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            row = pa.array(columns[0], pa.int64())
            rest = [pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)]
            yield pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.full(len(row), stage, np.int32)), *rest], schema.names)

    return reads.select("read_id", "strand", "seq").mapInArrow(run, schema)


def used_index(pieces: DataFrame, seeds: DataFrame, sizes: list[int], longest: int, index: DataFrame | None = None) -> DataFrame:
    """k, seed, contig_id, pos of all places whose seed some read has: the one pass over the reference for all stages.

    index: seeding.coded_index() of the longest seed, read back.
    """
    if index is None:
        distinct = seeds.where("seed IS NOT NULL").select("k", "seed").distinct()
        few = distinct.limit(seeding.SENT + 1).toArrow()
        if few.num_rows <= seeding.SENT:
            ks, numbers = (few.column(c).to_numpy() for c in ("k", "seed"))
            return seeding.coded_places(pieces, {k: np.sort(numbers[ks == k]) for k in sizes if (ks == k).any()})
    parts = [seeding.matched_index(pieces, seeds.where(F.col("k") == k), k, index if k == longest else None).select(F.lit(k).alias("k"), "seed", "contig_id", "pos") for k in sizes]
    return reduce(DataFrame.unionByName, parts)


def counted(seeds: DataFrame, index: DataFrame, hot: DataFrame, errors: int) -> DataFrame:
    """Places of reads whose segments are repeats: the q-gram counting join.

    seeds: blocks(). A place within `errors` errors keeps all of the read's n blocks but `errors`, each no more than
    `errors` bases off the place's diagonal. If at least one of the blocks that must be kept is no repeat's, the places
    of repeats are not looked at: the others are counted by (read, contig, cell of diagonals), and n - errors less the
    number of repeats must meet. A read with fewer such blocks counts its repeats too; their places are dealt to SALT
    parts, so none of them is one task's. Cells overlap by half, so any errors + 1 + errors diagonals share one.

    Returns read_id, strand, stage, substage, k, at, contig_id, pos of the blocks in cells that hold enough.
    """
    told = seeds.join(hot.select("k", "seed", F.lit(True).alias("hot")), ["k", "seed"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    per = Window.partitionBy("read_id", "strand")
    told = told.withColumn("n_hot", F.sum(F.col("hot").cast("int")).over(per)).withColumn("need", F.col("n") - errors)
    alone = F.col("need") - F.col("n_hot") >= 1
    told = told.withColumn("need", F.when(alone, F.col("need") - F.col("n_hot")).otherwise(F.greatest(F.col("need"), F.lit(1)))).where((~alone | ~F.col("hot")) & F.col("seed").isNotNull())
    cold = told.where("NOT hot").join(index, ["k", "seed"])
    salted = index.join(hot.select("k", "seed"), ["k", "seed"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("contig_id", "pos"), F.lit(SALT)).cast("int"))
    repeated = told.where("hot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).join(salted, ["k", "seed", "salt"]).drop("salt")
    width = 2 * (2 * errors + 1)
    found = cold.unionByName(repeated).withColumn("diagonal", F.col("pos") - F.col("at"))
    cells = F.array(F.floor(F.col("diagonal") / width) * 2, F.floor((F.col("diagonal") + width // 2) / width) * 2 + 1)
    found = found.withColumn("cell", F.explode(cells))
    enough = found.groupBy("read_id", "strand", "contig_id", "cell").agg(F.countDistinct("at").alias("shared"), F.first("need").alias("need")).where("shared >= need")
    kept = found.join(enough.select("read_id", "strand", "contig_id", "cell"), ["read_id", "strand", "contig_id", "cell"], "left_semi")
    return kept.select("read_id", "strand", "stage", "substage", "k", "at", "contig_id", "pos").distinct()


def _distances(most: int):
    """Distance of each read to its window, no more than `most`, else null: the count filter first, then free ends around
    the seed, or from BIT_PARALLEL errors on the best infix."""

    @F.pandas_udf(LongType())
    def told(seq: pd.Series, window: pd.Series, at: pd.Series, place: pd.Series, k: pd.Series, lead: pd.Series) -> pd.Series:
        (read, m), (text, n) = kernels.rows(seq), kernels.rows(window)
        at, place, k, lead = (x.to_numpy(np.int64) for x in (at, place, k, lead))
        out = np.full(len(seq), most + 1)
        i = np.flatnonzero(kernels.could_align(read, m, text, n, lead, most))
        if most < BIT_PARALLEL:
            out[i] = kernels.anchored_distances(read[i], m[i], text[i], n[i], at[i], place[i], k[i], most)
        else:
            out[i] = kernels.infix_distances(read[i], m[i], text[i], n[i])[0]
        return pd.Series(out).where(out <= most)

    return told


def verified(places: DataFrame, stranded: DataFrame, pieces: DataFrame, most: int) -> DataFrame:
    """Places (read_id, strand, stage, substage, k, at, contig_id, pos) with no more than `most` errors: read_id, strand,
    contig_id, low, seq, window, lead, ed, stage, substage.

    The window is the read's own place and `most` bases on either side, as far as the contig goes; `lead` of them stand
    before the place. Exact places are told by an expression.
    """
    key = ["read_id", "strand", "contig_id", "start"]
    seed = F.struct("stage", "substage", "k", "at", "pos")
    once = places.withColumn("start", F.col("pos") - F.col("at")).groupBy(*key).agg(F.array_sort(F.collect_set(seed)).alias("seeds"))  # a seed a segment
    low = F.greatest(F.col("start") - most, F.lit(0))
    placed = once.withColumn("low", low).withColumn("chunk", F.floor(F.col("low") / seeding.CHUNK)).join(stranded, ["read_id", "strand"])
    placed = placed.join(pieces.select("contig_id", "chunk", F.col("seq").alias("piece")), ["contig_id", "chunk"])
    lead = F.col("start") - F.col("low")  # below 0 where the read hangs over the contig's start
    window = F.substring("piece", (F.col("low") - F.col("chunk") * seeding.CHUNK).cast("int") + 1, (F.length("seq") + most + lead).cast("int"))
    placed = placed.select(*key, "low", "seq", "seeds", window.alias("window"), F.greatest(lead, F.lit(0)).cast("int").alias("lead"))
    exact = (F.col("start") >= 0) & (F.substring("window", F.col("lead") + 1, F.length("seq")) == F.col("seq"))
    kept = ["read_id", "strand", "contig_id", "low", "seq", "window", "lead", "ed", "stage", "substage"]
    if most == 0:
        return placed.where(exact).withColumn("x", F.col("seeds")[0]).select("*", F.lit(0).cast("long").alias("ed"), "x.stage", "x.substage").select(kept)
    one = F.slice("seeds", 1, 1)  # from BIT_PARALLEL errors on the best infix is the same for all of them
    tried = F.when(F.col("exact"), one).otherwise(F.col("seeds")) if most < BIT_PARALLEL else one
    told = placed.withColumn("exact", F.coalesce(exact, F.lit(False))).withColumn("x", F.explode(tried))
    asked = lambda c, none: F.when(F.col("exact"), F.lit(none)).otherwise(c)  # noqa: E731  # exact places go through as empty pairs
    place = (F.col("x.pos") - F.col("low")).cast("int")
    far = _distances(most)(asked(F.col("seq"), ""), asked(F.col("window"), ""), asked(F.col("x.at"), 0), asked(place, 0), "x.k", asked(F.col("lead"), 0))
    told = told.withColumn("ed", far).withColumn("ed", asked(F.col("ed"), 0).cast("long")).where("ed IS NOT NULL")
    best = F.row_number().over(Window.partitionBy(*key).orderBy("ed", "x.substage"))
    return told.withColumn("_nth", best).where("_nth = 1").select("*", "x.stage", "x.substage").select(kept)


def search(reads: DataFrame, contigs: DataFrame, cfg: AlignConfig, errors: int, index: DataFrame | None = None, save: Callable = saved, hot: int = HOT) -> DataFrame:
    """read_id, seq -> verified() rows of all stages, each place with the first stage and substage that found it.

    Mode first: a read leaves with the stage that finds it within that stage's errors. Second: with the stage after.
    All: one stage with all errors. With cfg.sensitive a stage verifies up to sensitivity_factor times its errors, but
    only its own errors solve a read; in mode second no more than one beyond the read's best. Reads shorter than two
    of the shortest seeds are searched without errors, those shorter than one not at all. Each stage's hits and unsolved
    reads are saved: a restart repeats one stage.
    """
    pieces, stranded = seeding.chunks(contigs).select("contig_id", "chunk", "seq"), save(seeding.both_strands(reads), "strands")
    lengths = sorted(r["n"] for r in stranded.select(F.length("seq").alias("n")).distinct().collect())  # no more than a chunk's overlap
    steps = plan(lengths, errors, cfg.seed, cfg.mode)
    sizes = sorted({k for n in lengths for s in steps if (k := seed_of(n, s, cfg.seed))}, reverse=True)
    if not steps:
        empty = StructType([stranded.schema["read_id"], stranded.schema["strand"], contigs.schema["contig_id"], *StructType.fromDDL("low long, seq string, window string, lead int, ed long, stage int, substage int").fields])
        return reads.sparkSession.createDataFrame([], empty)
    seeds = save(segment_seeds(stranded, steps, cfg.seed, cfg.mode), "seeds")
    used = save(used_index(pieces, seeds, sizes, cfg.seed, index), "used")
    repeats = used.groupBy("k", "seed").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > hot)
    repeats = save(repeats, "repeats")
    any_hot = repeats.limit(1).count() > 0
    if any_hot:  # the blocks of all stages, for every read with a repeat's seed: one more pass over the reference
        asked = stranded.join(seeds.join(repeats, ["k", "seed"], "left_semi").select("read_id", "strand").distinct(), ["read_id", "strand"], "left_semi")
        cuts = save(reduce(DataFrame.unionByName, [blocks(asked, step, cfg.seed) for step in steps]), "blocks")
        more = save(used_index(pieces, cuts.where("seed IS NOT NULL"), sizes, cfg.seed, index), "used")
        over = save(more.groupBy("k", "seed").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > hot), "repeats")
    left, out = stranded, None
    for step in steps:
        own = seeds.where(F.col("stage") == step)
        if out is not None:
            own = own.join(left.select("read_id", "strand"), ["read_id", "strand"], "left_semi")
        most = int(step * cfg.sensitivity_factor) if cfg.sensitive else step
        cold = own.join(repeats, ["k", "seed"], "left_anti") if any_hot else own
        places = cold.join(used, ["k", "seed"]).select("read_id", "strand", "stage", "substage", "k", "at", "contig_id", "pos")
        if any_hot:
            hot_reads = own.join(repeats, ["k", "seed"], "left_semi").select("read_id", "strand").distinct()
            cut = cuts.where(F.col("stage") == step).join(hot_reads, ["read_id", "strand"], "left_semi")
            places = places.unionByName(counted(cut, more, over, step).select(places.columns))
        places = save(places, "places")
        hits = verified(places, stranded, seeding.chunks_of(contigs, places), most)
        if cfg.mode == "second" and out is not None:
            best = out.groupBy("read_id").agg(F.min("ed").alias("_best"))
            hits = hits.join(best, "read_id", "left").where(F.col("_best").isNull() | (F.col("ed") <= F.col("_best") + 1)).drop("_best")
        hits = save(hits, "hits")
        out = hits if out is None else out.unionByName(hits)
        if step != steps[-1] and cfg.mode != "all":
            best = out.groupBy("read_id").agg(F.min("ed").alias("best"))
            solved = best.where(F.col("best") <= (step if cfg.mode == "first" else step - 1)).select("read_id")
            left = save(left.join(solved, "read_id", "left_anti"), "left")
    order = Window.partitionBy("read_id", "strand", "contig_id", F.col("low") + F.col("lead")).orderBy("stage", "substage")
    return out.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
