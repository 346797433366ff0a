"""Sinks: SAM text, seed index, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.functions.scores import insert_size, sam_flag


def sam_header(contigs: list[tuple[str, int]], command: str = "", group: str = "") -> str:
    """@HD, a @SQ for each contig (its size with the Ns at its ends), @RG if given, @PG."""
    lines = ["@HD\tVN:1.3\tSO:unsorted", *(f"@SQ\tSN:{name}\tLN:{size}" for name, size in contigs)]
    lines += [group] if group else []
    said = command.replace('"', " ").replace("@", " ")
    return "\n".join([*lines, f"@PG\tID:strandloom\tPN:strandloom\tVN:1\tCL:{said}"]) + "\n"


def _extra(mapped: DataFrame) -> list[str]:
    """Columns of further tags, where there are any: the read group, and an insert model's mean and deviation."""
    return [c for c in ("rg", "mo") if c in mapped.columns]


def single_rows(mapped: DataFrame) -> DataFrame:
    """One SAM row a read, unmapped ones included (null rname).

    mapped: qname, strand, rname, pos (1-based), mapq, cigar, md, ed, score, seq, qual, method.
    """
    no, yes = F.lit(False), F.lit(True)
    unmapped = F.col("rname").isNull()
    reverse = F.coalesce(F.col("strand") == "-", no) & ~unmapped
    flag = sam_flag(no, no, unmapped, no, reverse, no, no, no)
    turned = lambda c, f: F.when(reverse, f(F.col(c))).otherwise(F.col(c))
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return mapped.select(
        *_extra(mapped), "qname", flag.alias("flag"), star("rname").alias("rname"), zero("pos").alias("pos"), zero("mapq").alias("mapq"), star("cigar").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"),
        turned("seq", dna.reverse_complement).alias("seq"), F.coalesce(turned("qual", F.reverse), F.lit("*")).alias("qual"), F.when(~unmapped, F.col("ed")).alias("nm"), F.when(~unmapped, F.col("md")).alias("md"), F.when(~unmapped, F.col("score")).alias("as_score"), F.when(~unmapped, F.col("method")).alias("xm"),
    )


def paired_rows(mapped: DataFrame) -> DataFrame:
    """SAM rows of mates (mapped: as for single_rows(), and pair_id, mate 0 or 1, length on the reference).

    Mates meet on pair_id. An unmapped mate borrows the place of the mapped one; the template's length counts from the
    left mate's start to the right one's end, with a minus on the right.
    """
    no, other = F.lit(False), mapped.select(F.col("pair_id").alias("_p"), (1 - F.col("mate")).alias("_m"), *[F.col(c).alias(f"_{c}") for c in ("rname", "pos", "strand", "length")])
    both = mapped.join(other, (F.col("pair_id") == F.col("_p")) & (F.col("mate") == F.col("_m")), "left")
    lost, mate_lost = F.col("rname").isNull(), F.col("_rname").isNull()
    reverse, mate_reverse = F.coalesce(F.col("strand") == "-", no) & ~lost, F.coalesce(F.col("_strand") == "-", no) & ~mate_lost
    size = insert_size(F.col("rname"), F.col("strand"), F.col("pos"), F.col("length"), F.col("_rname"), F.col("_strand"), F.col("_pos"), F.col("_length"))
    left = (F.col("pos") < F.col("_pos")) | ((F.col("pos") == F.col("_pos")) & ~reverse)
    flag = sam_flag(F.lit(True), size.isNotNull(), lost, mate_lost, reverse, mate_reverse, F.col("mate") == 0, no)
    turned = lambda c, f: F.when(reverse, f(F.col(c))).otherwise(F.col(c))
    place = lambda own, borrowed, empty: F.coalesce(F.col(own), F.col(borrowed), F.lit(empty))
    rname, pos = place("rname", "_rname", "*"), place("pos", "_pos", 0).cast("long")
    rnext, pnext = place("_rname", "rname", "*"), place("_pos", "pos", 0).cast("long")
    tag = lambda c: F.when(~lost, F.col(c)).alias(c)
    return both.select(
        *_extra(mapped), "qname", flag.alias("flag"), rname.alias("rname"), pos.alias("pos"), F.coalesce("mapq", F.lit(0)).cast("long").alias("mapq"), F.coalesce("cigar", F.lit("*")).alias("cigar"),
        F.when(rnext == "*", "*").when(rnext == rname, "=").otherwise(rnext).alias("rnext"), pnext.alias("pnext"), F.coalesce(F.when(left, size).otherwise(-size), F.lit(0)).cast("long").alias("tlen"),
        turned("seq", dna.reverse_complement).alias("seq"), F.coalesce(turned("qual", F.reverse), F.lit("*")).alias("qual"), F.when(~lost, F.col("ed")).alias("nm"), tag("md"), F.when(~lost, F.col("score")).alias("as_score"), F.when(~lost, F.col("method")).alias("xm"),
    )


def sam_line(extra: tuple[str, ...] = ()) -> Column:
    """The text of a row of single_rows() or paired_rows(); tags only for mapped reads, the score with one decimal.

    extra: rg and mo, where the rows have these columns.
    """
    fields = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    tag = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name), c.cast("string")))
    mapped = lambda c: F.when(F.col("nm").isNotNull(), F.col(c))
    score = F.when(F.col("as_score").isNotNull(), F.format_string("%.1f", F.col("as_score").cast("double")))
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in fields], tag("NM:i:", F.col("nm")), tag("MD:Z:", F.col("md")), *[tag("RG:Z:", mapped(c)) for c in extra if c == "rg"], tag("AS:i:", score), tag("XM:Z:", F.col("xm")), *[tag("MO:Z:", mapped(c)) for c in extra if c == "mo"])


def write_sam(rows: DataFrame, header: str, path: str, gzip: bool = False) -> None:
    """Text parts under path/rows, in no set order, and the header under path/header."""
    spark = rows.sparkSession
    spark.createDataFrame([(header.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    out = rows.select(sam_line(tuple(c for c in ("rg", "mo") if c in rows.columns)).alias("value")).write.mode("overwrite")
    (out.option("compression", "gzip") if gzip else out).text(f"{path}/rows")


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Seeds as Parquet, in folders by a hash of the seed and sorted in them, so that a lookup reads few row groups."""
    bucket = F.pmod(F.xxhash64("seed"), F.lit(buckets)).cast("int")
    index.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("seed").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_variants(variants: DataFrame, path: str) -> None:
    """intervals.on_contigs() rows as Parquet in order of place, so that a range is found in few row groups."""
    variants.repartitionByRange("contig_id", "pos").sortWithinPartitions("contig_id", "pos", "vtype", "alt").write.mode("overwrite").parquet(path)


def write_unmapped(rows: DataFrame, path: str) -> None:
    """FASTQ text of the rows of single_rows() that are not mapped."""
    lost = rows.where(F.col("flag").bitwiseAND(F.lit(4)) != 0)
    lost.select(F.concat_ws("\n", F.concat(F.lit("@"), "qname"), "seq", F.lit("+"), "qual").alias("value")).write.mode("overwrite").text(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)
