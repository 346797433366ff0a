"""Document fingerprints: SimHash by weighted votes of term hashes, and block tables that find close fingerprints.

Only DataFrame functions run here. A term is a run of five words; it votes once for each time it occurs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import staged, table, words

SHINGLE = 5
#: Documents whose ids share a quotient by this are neighbours in one partition: no more than so many distinct ids.
NEAR_IDS = 1024
#: Votes that fit a lane of 16 bits (the top lane keeps clear of the sign).
LANE = 32_000
#: Hamming radius of close fingerprints, and blocks that a fingerprint is cut into.
RADIUS, BLOCKS = 3, 6


def term_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words in order (lower case)."""
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def shingled(hashes: Column) -> Column:
    """Hashes of all runs of SHINGLE words; all words as one if there are fewer; null without words."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, SHINGLE)))
    return F.when(n >= SHINGLE, runs).when(n > 0, F.array(F.xxhash64(hashes)))


def votes(rows: DataFrame, keys: list[str], terms: str) -> DataFrame:
    """keys and `fingerprint` (long): bit i is set if more than half of the terms' hashes have it.

    Four counters of 16 bits share a long, so 16 sums count 64 bits; terms beyond LANE go to a group of their own
    before lanes could overflow. Rows without terms get 0. Keys must tell rows apart.
    """
    each = rows.select(*keys, F.posexplode_outer(terms).alias("_at", "_h")).withColumn("_part", F.floor(F.coalesce("_at", F.lit(0)) / LANE))
    lanes = [F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(F.lit(0x0001000100010001))).alias(f"_v{j}") for j in range(16)]
    parts = each.groupBy(*keys, "_part").agg(F.count("_h").alias("_n"), *lanes)
    bits = [F.sum(F.shiftrightunsigned(f"_v{i % 16}", 16 * (i // 16)).bitwiseAND(F.lit(0xFFFF))).alias(f"_b{i}") for i in range(64)]
    sums = parts.groupBy(*keys).agg(F.sum("_n").alias("_n"), *bits)
    value = F.lit(0).cast("long")
    for i in range(64):
        value = value.bitwiseOR(F.when(2 * F.col(f"_b{i}") > F.col("_n"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, value.alias("fingerprint"))


def _masks(blocks: int, agree: int) -> list[int]:
    """Masks of all choices of `agree` blocks, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs a < b of distinct fingerprints that differ in at most `radius` bits.

    prints: fingerprint, distinct. Two such prints agree in blocks - radius blocks at least; one table for each choice
    of so many blocks, keyed by them, meets every pair. A pair comes from the first table that it agrees in, so none is
    listed twice; no more rows are made than there are pairs.
    """
    masks = _masks(blocks, blocks - radius)
    keyed = prints.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "k"))
    a = keyed.select("t", "k", F.col("fingerprint").alias("a"))
    b = keyed.select(F.col("t").alias("_t"), F.col("k").alias("_k"), F.col("fingerprint").alias("b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)])
    meets = (F.col("t") == F.col("_t")) & (F.col("k") == F.col("_k")) & (F.col("a") < F.col("b")) & (F.bit_count(apart) <= radius) & (first == F.col("t"))
    return a.join(b, meets).select("a", "b")


def _before(tops: DataFrame) -> DataFrame:
    """cell -> the cell whose first document follows this cell's last one (after the last cell: the first).

    Cells are dealt out in ranges, and each range is put in order by a task of its own; only the first cell of each
    range (no more rows than there are ranges) meets those of the others. So ids may be as sparse as they like.
    """
    parts = int(tops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = staged(tops.select("cell").repartitionByRange(parts, F.col("cell").desc()).withColumn("part", F.spark_partition_id()), "ranges")
    heads = ranges.groupBy("part").agg(F.max("cell").alias("head")).withColumn("_then", F.lead("head").over(Window.orderBy(F.col("head").desc())))
    first = tops.agg(F.max("cell").alias("first_cell"))
    order = Window.partitionBy("part").orderBy(F.col("cell").desc())
    told = ranges.withColumn("then", F.lead("cell").over(order)).join(heads.select("part", "_then"), "part")
    return told.select("cell", F.coalesce("then", "_then", first.scalar()).alias("then"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> cell, nth, doc_id, n_chars, edited_sha256, fingerprint, edited (long), next_cell.

    Documents stand in descending order of doc_id (null last), equal ids by text. Each document's text and its edited
    text, whose end is the next document's start, vote apart.
    """
    cell = F.coalesce(F.floor(F.col("doc_id") / NEAR_IDS), F.lit(-(1 << 62)).cast("long"))
    docs = docs.select(cell.alias("cell"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tops = staged(docs.groupBy("cell").agg(F.max("doc_id").alias("top")), "tops")
    then = _before(tops)
    heads = docs.withColumnsRenamed({"cell": "_cell"}).join(tops, (F.col("_cell") == F.col("cell")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("cell").agg(F.min("text").alias("head"))
    heads = staged(heads, "heads").withColumnRenamed("cell", "then")
    follow = then.join(heads, "then").select("cell", "then", "head")
    order = Window.partitionBy("cell").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text"))
    placed = docs.withColumn("nth", F.row_number().over(order)).withColumn("_next", F.lead("text").over(order))
    placed = placed.join(follow, "cell", "left")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    following = F.coalesce("_next", "head")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), following.substr(F.lit(1), cut))
    placed = placed.select("cell", "nth", "doc_id", n.cast("long").alias("n_chars"), F.when(F.col("_next").isNull(), F.col("then")).alias("next_cell"), "text", edited.alias("edited"))
    placed = placed.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["cell", "nth", "doc_id", "n_chars", "next_cell", "edited_sha256", "which"]
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    both = placed.withColumn("_x", F.explode(texts)).select(*keys[:-1], "_x.which", term_hashes(F.col("_x.t")).alias("_words"))
    told = votes(both.withColumn("_terms", shingled(F.col("_words"))), keys, "_terms")
    pick = lambda i: F.max(F.when(F.col("which") == i, F.col("fingerprint")))
    return told.groupBy(*keys[:-1]).agg(pick(0).alias("fingerprint"), pick(1).alias("edited"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    Null text counts as empty; without words a fingerprint is 0. Null doc_ids come last in the order of documents,
    repeated ones next to each other in order of their texts, each with a row. A single document follows itself. An
    empty table gives no rows. near_links: other fingerprints of documents within RADIUS bits.
    """
    told = staged(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "prints")
    order = Window.partitionBy("cell").orderBy("nth")
    first = told.where("nth = 1").select(F.col("cell").alias("next_cell"), F.col("fingerprint").alias("_first"))
    pairs = close_pairs(told.select("fingerprint").distinct())  # counted where they meet: no pair is stored or shuffled
    links = pairs.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("near_links"))
    told = told.withColumn("_next", F.lead("fingerprint").over(order)).join(first, "next_cell", "left").join(links, "fingerprint", "left")
    alike = lambda other: F.lit(1.0) - F.bit_count(F.col("fingerprint").bitwiseXOR(other)) / F.lit(64.0)
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return told.select(
        "doc_id", "n_chars", "edited_sha256", text("fingerprint").alias("fingerprint"), text("edited").alias("edited_fingerprint"),
        alike(F.col("edited")).alias("near_edited"), alike(F.coalesce("_next", "_first")).alias("near_next"), F.coalesce("near_links", F.lit(0)).cast("long").alias("near_links"),
    )
