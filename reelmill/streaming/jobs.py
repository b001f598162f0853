"""Incremental jobs: folder watch, resumable ledger, queue, live transcript, running statistics and monthly quota.

Each stream is a Structured Streaming query with a checkpoint; `once` runs what is there and stops (available-now),
else it goes on by processing time. Sinks are idempotent, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelmill.sources.files import EXTENSIONS, JOB_SCHEMA

SEGMENT_SCHEMA = "video_id LONG, seg_no LONG, start_sec DOUBLE, end_sec DOUBLE, speaker STRING, text STRING"


def _start(writer, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def watch_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """H1: new recordings below a folder, each once, as (path, length, modified)."""
    files = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY").option("recursiveFileLookup", "true").load(folder)
    found = files.where(F.lower("path").rlike(rf"\.({'|'.join(EXTENSIONS)})$")).select("path", "length", F.col("modificationTime").alias("modified"))
    return _start(found.writeStream.format("parquet").option("path", out), checkpoint, once)


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not exist yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


LEDGER = "path STRING, returncode INT, finished_at TIMESTAMP, batch STRING"


def resume_ledger(runs: DataFrame, ledger: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """H2: runs (path, returncode, finished_at) join the ledger unless their path is in it as completed. A batch of a checkpoint has a
    folder of its own in the ledger, so a batch that is replayed replaces what it wrote."""

    def add(batch: DataFrame, number: int) -> None:
        own = f"{crc32(checkpoint.encode()):08x}-{number}"
        done = _existing(batch.sparkSession, ledger, LEDGER).where(F.col("batch") != own).where("returncode = 0").select("path").distinct()
        fresh = batch.groupBy("path").agg(F.min_by("returncode", F.struct("returncode", "finished_at")).alias("returncode"), F.min("finished_at").alias("finished_at"))
        fresh.join(done, "path", "left_anti").write.mode("overwrite").parquet(f"{ledger.rstrip('/')}/batch={own}")

    return _start(runs.writeStream.foreachBatch(add), checkpoint, once)


STATUS = "job_id STRING, status STRING, ts TIMESTAMP"


def queue_states(events: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """H3: status events append to a table; `latest_states` reads the state of each job from it."""
    return _start(events.select("job_id", "status", "ts").writeStream.format("parquet").option("path", table), checkpoint, once)


def latest_states(spark: SparkSession, table: str) -> DataFrame:
    """The latest status of each job; finished and failed jobs count as pending again, running ones stay."""
    last = _existing(spark, table, STATUS).groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))
    return last.withColumn("status", F.when(F.col("status").isin("finished", "failed"), "pending").otherwise(F.col("status")))


def live_transcript(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """H4: transcript segments, as JSON lines, append as formatted rows."""
    rows = spark.readStream.schema(SEGMENT_SCHEMA).json(folder).where("trim(text) <> ''")
    line = F.format_string("[%.3f - %.3f] %s: %s", "start_sec", "end_sec", F.coalesce("speaker", F.lit("UNK")), F.trim("text"))
    return _start(rows.select("video_id", "seg_no", line.alias("line")).writeStream.format("parquet").option("path", out), checkpoint, once)


def read_job_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Job logs as a stream of stages."""
    logs = spark.readStream.schema(JOB_SCHEMA).json(folder)
    return logs.select("job_id", F.to_timestamp("timestamp").alias("ts"), F.explode("stages").alias("stage", "s")).select("job_id", "ts", "stage", "s.sec", "s.status")


def stage_statistics(stages: DataFrame) -> DataFrame:
    """H5: running number, total and longest time of each stage (update mode)."""
    return stages.groupBy("stage").agg(F.count("*").alias("n"), F.sum("sec").alias("total_sec"), F.max("sec").alias("max_sec"))


def monthly_quota(stages: DataFrame, late: str = "31 days") -> DataFrame:
    """H6: minutes a month. Months differ in length, so the key is the truncated month; the watermark bounds the state."""
    months = stages.withWatermark("ts", late).groupBy(F.date_trunc("month", "ts").alias("month"))
    return months.agg((F.sum("sec") / 60).alias("minutes"))
