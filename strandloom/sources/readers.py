"""File sources: FASTA, FASTQ (single and paired, plain or compressed), VCF, lists of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def listed(spark: SparkSession, path: str) -> list[list[str]]:
    """File names of a list: one a line, or two for paired reads with ; between. Blank lines count for nothing."""
    lines = (r["value"].strip() for r in spark.read.text(path).toLocalIterator())
    return [line.split(";") for line in lines if line]


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, seq, n_initial, n_final, size of each record; Ns at both ends are cut off and counted, empty records go.

    Records are split at > by the reader, so a file is read in parallel where its codec allows; symbols other than
    A, C, G, T count as N.
    """
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", "^([^\\n\\r]*)", 1)
    body = F.regexp_replace(F.upper(F.regexp_replace(F.regexp_replace("value", "^[^\\n\\r]*", ""), "\\s", "")), "[^ACGT]", "N")
    rows = rows.select(head.alias("name"), body.alias("raw"))
    first, last = F.length(F.regexp_extract("raw", "^N*", 0)), F.length(F.regexp_extract("raw", "N*$", 0))
    kept = rows.where(F.regexp_replace("raw", "N", "") != "")
    seq = F.substring("raw", first + 1, F.length("raw") - first - last)
    return kept.select(F.split("name", "\\s", 2)[0].alias("name"), seq.alias("seq"), first.cast("long").alias("n_initial"), last.cast("long").alias("n_final"), F.length(seq).cast("long").alias("size"))


def fasta_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of several files as fasta() has them, with `file_no`: contigs of a file come before those of the next."""
    return reduce(DataFrame.unionByName, [fasta(spark, p).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)])


def fasta_reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a FASTA file, as fastq() has them, without qualities; their order is that of names."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    seq = F.regexp_replace(F.upper(F.regexp_replace(F.regexp_replace("value", "^[^\\n\\r]*", ""), "\\s", "")), "[^ACGT]", "N")
    return rows.select(F.regexp_extract("value", "^([^ \\t\\r\\n]*)", 1).alias("name"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"), F.lit(0).alias("mate"))


def fastq_lines(lines: DataFrame) -> DataFrame:
    """A text source's rows with what tells their order: file, byte place of the split in it, and row within the task."""
    return lines.select(F.regexp_replace("value", "\\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def fastq_records(lines: DataFrame, mate: int = 0, stop: bool = True) -> DataFrame:
    """fastq_lines() rows -> file, ordinal, name, seq, qual, mate of each record of four lines.

    Records are numbered through the files in order of their names. A split's lines are numbered by the task that reads
    it; the sizes of splits and files before it, a row each, give the rest. A record that is not @, bases, + and as many
    qualities is an error, or is left out without `stop`. Blank lines at a file's end count for nothing.
    """
    per = Window.partitionBy("file", "block").orderBy("id")
    lines = lines.withColumn("id", F.monotonically_increasing_id()).withColumn("at", F.row_number().over(per) - 1)
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    placed = lines.join(begins, ["file", "block"]).withColumn("n", F.col("at") + F.col("begin"))
    pick = lambda k: F.max(F.when(F.pmod("n", F.lit(4)) == k, F.col("line")))
    rows = placed.groupBy("file", F.floor(F.col("n") / 4).alias("record")).agg(pick(0).alias("name"), pick(1).alias("seq"), pick(2).alias("plus"), pick(3).alias("qual"))
    rows = rows.where(F.concat_ws("", "name", "seq", "plus", "qual") != "")
    good = F.coalesce(F.col("name").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual")), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("malformed record "), F.col("record").cast("string"), F.lit(" of "), F.col("file"))).cast("boolean") if stop else F.lit(False)
    rows = rows.where(F.when(good, True).otherwise(bad))
    files = rows.groupBy("file").agg((F.max("record") + 1).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    firsts = files.select(F.col("file").alias("_f"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    rows = rows.join(firsts, F.col("file") == F.col("_f"))
    return rows.select("file", (F.col("first") + F.col("record")).alias("ordinal"), F.regexp_extract("name", "^@?([^ \\t\\n]*)", 1).alias("name"), F.regexp_replace(F.upper("seq"), "[^ACGT]", "N").alias("seq"), "qual", F.lit(mate).alias("mate"))


def fastq(spark: SparkSession, path: str, mate: int = 0, stop: bool = True) -> DataFrame:
    """ordinal, name, seq, qual, mate of each record of four lines (LF or CRLF; gzip and bzip2 by the file's name); see
    fastq_records()."""
    return fastq_records(fastq_lines(spark.read.text(path)), mate, stop).drop("file")


def fastq_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Mates by their place in two files: read_id = 2 * ordinal + mate, pair_id = ordinal."""
    both = fastq(spark, first, 0).unionByName(fastq(spark, second, 1))
    return both.withColumn("pair_id", F.col("ordinal")).withColumn("read_id", F.col("ordinal") * 2 + F.col("mate"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, freq, vtype (snp, mnp, ins, del): a row for each alternative allele, frequencies from AF=
    or CAF=."""
    names = "chrom string, pos long, id string, ref string, alts string, qual string, filter string, info string"
    rows = spark.read.schema(names).option("sep", "\t").option("comment", "#").csv(path)
    af = F.split(F.regexp_extract("info", "(?:^|;)AF=([^;]*)", 1), ",")
    caf = F.split(F.regexp_extract("info", "(?:^|;)CAF=\\[?([^;\\]]*)", 1), ",")
    rows = rows.select("*", F.posexplode(F.split("alts", ",")).alias("i", "alt"), af.alias("af"), caf.alias("caf"))
    freq = F.coalesce(F.expr("try_cast(get(af, i) as double)"), F.expr("try_cast(get(caf, i + 1) as double)"))
    kind = F.when((F.length("ref") == 1) & (F.length("alt") == 1), "snp").when(F.length("ref") == F.length("alt"), "mnp").when(F.length("ref") < F.length("alt"), "ins").otherwise("del")
    return rows.where("alt NOT IN ('.', '') AND alt NOT LIKE '<%'").select("chrom", "pos", "id", "ref", "alt", freq.alias("freq"), kind.alias("vtype"))


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
