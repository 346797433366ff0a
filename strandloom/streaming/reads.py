"""Streams of reads: a folder that fills with files, mapped against a static index, and running statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandloom.operators import seeding
from strandloom.plans.align import align, to_sam
from strandloom.plans.config import AlignConfig
from strandloom.sources import readers


def arriving(spark: SparkSession, folder: str, schema: str, files: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive, no more than `files` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def mapped(reads: DataFrame, contigs: DataFrame, sink: str, checkpoint: str, errors: int = 3, k: int = 18):
    """Maps each batch of reads (read_id, seq) with the batch operators; a batch that is run again replaces its folder."""

    def run(batch: DataFrame, number: int) -> None:
        hits = seeding.best_in_contig(seeding.map_reads(batch, contigs, errors, k))
        hits.select("read_id", "strand", "contig_id", "start", "ed").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return reads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str, width: str, time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by tumbling window and kind; rows later than `late` are dropped once a window is closed."""
    held = events.withWatermark(time, late) if events.isStreaming else events
    told = held.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return told.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
    for batch in batches:
        x = batch["insert_size"].dropna()
        if len(x):
            other, k = float(x.mean()), len(x)
            gap = other - mean
            m2 += float(((x - other) ** 2).sum()) + gap * gap * n * k / (n + k)
            mean += gap * k / (n + k)
            n += k
    state.update((n, mean, m2))
    yield pd.DataFrame([[key[0], n, mean, (m2 / n) ** 0.5 if n else 0.0]], columns=["group", "n", "mean", "dev"])


def running_insert_model(pairs: DataFrame) -> DataFrame:
    """group, insert_size -> after each batch the group's number of samples, mean and deviation so far (state: three
    numbers a group, the same whatever the order of rows)."""
    return pairs.groupBy("group").applyInPandasWithState(_fold, "group string, n long, mean double, dev double", "n long, mean double, m2 double", "update", "NoTimeout")


def arriving_fastq(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """Lines of FASTQ files as they arrive in a folder; each file arrives whole, so its records are whole in a batch."""
    return readers.fastq_lines(spark.readStream.option("maxFilesPerTrigger", files).text(folder))


def fastq_to_sam(lines: DataFrame, contigs: DataFrame, sink: str, checkpoint: str, cfg: AlignConfig = AlignConfig(errors=3), index: DataFrame | None = None):
    """Maps arriving_fastq() batch by batch: SAM rows under sink/batch=n, which a batch that is run again replaces.

    A read is known by its file and number in it, which no batch changes. index: align.build_index(), read back.
    """

    def run(batch: DataFrame, number: int) -> None:
        records = readers.fastq_records(batch).withColumn("read_id", F.xxhash64("file", "ordinal")).drop("mate")
        to_sam(records, align(records.select("read_id", "seq", "qual"), contigs, cfg, index), contigs, cfg).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class FirstSamples(StatefulProcessor):
    """A group's mean and deviation of the first `most` insert sizes; from then on they stay as they are.

    State: three numbers a group. Of a batch's rows, whatever their number, only the first that are still wanted (by
    ordinal) are held.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.model.get() if self.model.exists() else (0, 0.0, 0.0)
        held = None
        for batch in rows:
            batch = batch.loc[batch["insert_size"].notna(), ["ordinal", "insert_size"]]
            held = batch if held is None else pd.concat([held, batch])
            held = held.nsmallest(max(self.most - n, 0), ["ordinal", "insert_size"])
        for x in held["insert_size"].tolist() if held is not None else []:
            n += 1
            gap = x - mean
            mean += gap / n
            m2 += gap * (x - mean)
        self.model.update((n, mean, m2))
        yield pd.DataFrame([[key[0], n, mean, (m2 / n) ** 0.5 if n else 0.0, n >= self.most]], columns=["group", "n", "mean", "dev", "frozen"])

    def close(self) -> None:
        pass


def frozen_insert_model(pairs: DataFrame, most: int = 100) -> DataFrame:
    """group, ordinal, insert_size -> after each batch every group's model so far: n, mean, dev, frozen.

    Samples count in order of ordinal within a batch, batches as they come; null sizes do not. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass).
    """
    return pairs.groupBy("group").transformWithStateInPandas(FirstSamples(most), "group long, n long, mean double, dev double, frozen boolean", "Update", "None")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streamed_models(spark: SparkSession, folder: str, schema: str, sink: str, checkpoint: str, most: int = 100, files: int = 1) -> None:
    """Runs frozen_insert_model() over the Parquet files of a folder, some at a time in the order they came; each batch's
    models are written to sink/batch=n."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        told = frozen_insert_model(arriving(spark, folder, schema, files), most)
        save = lambda df, number: df.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        told.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
