"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, an exponential tilt of its size held to at most MOST, such that its source meets its target
of words (a capped tilt: the dual is that of the balance with an upper bound on rates); rates then become whole copies.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import numbered, packed, scratch, staged, table, told_apart, unpacked, with_fields, words

#: Weights of the sources in order, the share of all words that the mix has, copies of a document at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents that one task rounds together.
CELL = 4096


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> and weight, target.

    Sources in code point order, null last, take the weights in turn: ranges of sources are numbered apart, so no task
    orders them all. The level at which `share` of all words is dealt by weight with no source above `most` times its
    size comes from filling up: sources that a level would take above their cap are set to it and the rest is dealt
    again, until no more are. Only sums over the sources reach the driver.
    """
    ranked = numbered(sources, F.col("source").asc_nulls_last(), "_rank")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))).drop("_rank")
    ranked = staged(ranked.withColumn("_full_at", most * F.col("source_size") / F.col("weight")), "ranked")
    level, full = 0.0, -1
    while True:  # the level only rises, so each round sets more sources to their cap or is the last
        capped = F.col("_full_at") < F.lit(level)
        got = ranked.agg(F.count(F.when(capped, 1)).alias("full"), F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("source_size"))).alias("in_full"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if got["full"] == full or not got["open"]:
            break
        full, level = got["full"], (share * got["all"] - most * (got["in_full"] or 0)) / got["open"]
    return ranked.withColumn("target", F.least(F.lit(float(level)) * F.col("weight"), (most * F.col("source_size")).cast("double"))).drop("_full_at")


def tilts(sizes: DataFrame, wanted: DataFrame, most: float = MOST, rounds: int = 60, near: float = 1e-6) -> DataFrame:
    """source -> tilt: the dual solution; a document of n words has rate min(most, exp(tilt * n / scale)).

    sizes: source, size, n (documents of that size). wanted: source, source_size, target, docs. Each round sums the
    gradient and the curvature over all sizes by source and takes a Newton step, or halves the bracket where the step
    would leave it. A source at its cap has an infinite tilt.
    """
    scale = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0))
    full = F.col("target") >= F.lit(most) * F.col("source_size") * (1 - 1e-12)
    state = wanted.select("source", "target", scale.alias("scale"), full.alias("full"), F.coalesce(F.log(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0.0)).alias("tilt"), F.lit(-2000.0).alias("low"), F.lit(2000.0).alias("high"), F.lit(False).alias("done"))
    state = staged(state, "tilt")
    for _ in range(rounds):
        if not state.where("NOT full AND NOT done").limit(1).count():
            break
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * x, F.lit(50.0))))
        joined = sizes.withColumnRenamed("source", "_source").join(state.where("NOT full"), F.col("_source").eqNullSafe(F.col("source")))
        sums = joined.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
        sums = sums.withColumnRenamed("source", "_source")
        gap = F.coalesce(F.col("got"), F.lit(0.0)) - F.col("target")
        new = state.join(sums, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("gap", gap)
        new = new.withColumn("low", F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high")))
        step = F.col("tilt") - F.try_divide(F.col("gap"), F.col("slope"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        done = (F.abs(F.col("gap")) <= near * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("high") - F.col("low") < 1e-12)
        new = new.withColumn("done", F.col("done") | done).withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2))
        state = staged(new.select(*state.columns), "tilt")
    return state.select("source", "scale", "full", "tilt")


def _round(group: pd.DataFrame) -> pd.DataFrame:
    """Rates of one cell -> copies: large documents first, what rounding leaves is carried to the next document."""
    group = group.sort_values(["size", "order"], ascending=[False, True], kind="stable")
    copies, over = [], 0.0
    for n, rate in zip(group["size"].tolist(), group["rate"].tolist(), strict=True):
        if n == 0:
            copies.append(int(rate + 0.5))
            continue
        wanted = rate * n + over
        c = min(MOST, max(0, int(wanted / n + 0.5)))
        over = wanted - c * n
        copies.append(c)
    return group.assign(copies=copies).drop(columns=["rate", "order", "cell"])


def mix(docs: DataFrame) -> DataFrame:
    """docs: row columns with source and size -> the same and source_size, target, copies (0 to 2).

    Sources are compared null-safely. Cells of about CELL documents of a source, chosen by a hash of all row columns,
    are rounded apart from each other, so a source of any size spreads over many tasks.
    """
    docs = staged(docs, "sizes")
    with scratch(docs.sparkSession):
        sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
        wanted = staged(targets(staged(sources, "sources")), "targets")
        sizes = staged(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
        solved = tilts(sizes, wanted)
        about = wanted.withColumnRenamed("source", "_s").join(solved.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
        about = staged(about, "about", keep=True)  # a row a source; of known size, so Spark can choose to broadcast it
    rated = docs.join(about, F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("full"), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    order = F.xxhash64(*docs.columns)
    rated = rated.withColumn("rate", rate).withColumn("order", order).withColumn("cell", F.pmod(F.xxhash64("order"), F.ceil(F.col("docs") / CELL)))
    kept = [*docs.columns, "source_size", "target"]
    schema = with_fields(rated.select(*kept), "copies int")
    return rated.select(*kept, "rate", "order", "cell").groupBy("source", "cell").applyInPandas(_round, schema)


def op9_entropy_balance(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken from each.

    Null text has size 0 and gives nothing. A null source is a source of its own, last in order. A null or repeated
    doc_id is carried along. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def resampled(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it (columns unchanged).

    Rows that repeat doc_id and text, whatever their other columns hold, are taken as often as the mix takes them all
    together, from that one of them whose other columns come first by their digest. Null text has no words, so it is
    kept or not as its source's rate for nothing is rounded; an empty table gives no rows.
    """
    names = ["doc_id", "source", "text"]
    keyed = packed(docs, names).withColumn("_h", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    slim = keyed.select("doc_id", "source", F.col("_h"), F.size(words(F.col("text"))).cast("long").alias("size"))
    taken = staged(mix(slim), "mix").groupBy("doc_id", "_h").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    taken = taken.select(F.col("doc_id").alias("_doc"), F.col("_h").alias("_k"), "_copies")
    first = keyed.withColumn("_told", told_apart(["source", "text", "_rest"])).withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy("_told"))).where("_nth = 1")
    joined = first.join(taken, first["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_k")))
    return unpacked(joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))), docs.columns, names)
