"""Structured Streaming over a landing folder of FASTA files: the stateless operators, and deduplication with a horizon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.functions import sequence as S


def stream_fasta(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of the files that arrive in a folder: id, desc, seq, qual, source file and its arrival time (the event time).

    A stream has no global input order, so there are no order columns; sorting, splitting and counted samples need a batch.
    """
    rows = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    value = F.regexp_replace("value", r"^\s*>", "")
    head = F.regexp_replace(F.substring_index(value, "\n", 1), r"\s+\z", "")
    body = F.when(F.instr(value, "\n") > 0, F.substring(value, F.instr(value, "\n") + 1, F.length(value)))
    rest = F.regexp_extract(head, r"^\S*\s+(.*)$", 1)
    return rows.where(F.trim("value") != "").select(
        F.regexp_extract(head, r"^\S*", 0).alias("id"), F.when(rest != "", rest).alias("desc"), F.coalesce(F.regexp_replace(body, r"\s+", ""), F.lit("")).alias("seq"),
        F.lit(None).cast("string").alias("qual"), F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_modification_time").alias("arrived"),
    )


def dedup_stream(df: DataFrame, by_id: bool = False, prefix: int | None = None, ignore_case: bool = False, horizon: str = "1 hour") -> DataFrame:
    """One record of each key that comes within a horizon; state older than that goes."""
    keyed = df.withColumn("_key", F.sha2(S.dedup_key(by_id, prefix, ignore_case).cast("binary"), 256)).withWatermark("arrived", horizon)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_stats(df: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Records, bases and GC bases by arrival window."""
    return df.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count("*").alias("count"), F.sum(S.seq_length("seq")).alias("total_len"), F.sum(S.count_bases("seq", "GC")).alias("gc_count"))


def run_stream(df: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, once: bool = False) -> StreamingQuery:
    """Writes a transformed stream as Parquet, exactly once for each arrival; `once` stops after what is there."""
    writer = transform(df).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
