"""Readers and streams run over data that Spark derives from the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.plans.registry import query
from reelmill.sources.files import read_profile_log, read_sidecars
from reelmill.sources.scratch import scratch_path
from reelmill.streaming import jobs as streams


@query("a5_sidecar_ingest", "titles", "SELECT cast(tconst AS varchar) AS media_id, title_type AS repository, CASE WHEN tconst % 3 = 0 THEN original_title ELSE primary_title END AS title FROM titles")
def sidecar_ingest(titles: DataFrame) -> DataFrame:
    """A5: titles written as XML side-cars (every third without a TITLE) and read back with the title's fallbacks."""
    spark = titles.sparkSession
    path = scratch_path(spark, "sidecars")
    cars = titles.select(F.col("tconst").cast("string").alias("MEDIAID"), F.col("title_type").alias("REPOSITORY"), F.when(F.col("tconst") % 3 != 0, F.col("primary_title")).alias("TITLE"), F.col("original_title").alias("NAME"))
    cars.write.format("xml").option("rowTag", "ASSET").option("rootTag", "ASSETS").save(path)
    return read_sidecars(spark, path)


@query("a8_profiler_log", "jobs", "SELECT job_id, stage, cast(sec AS double) AS duration_sec FROM jobs WHERE event_id % 10 <> 0")
def profiler_log(jobs: DataFrame) -> DataFrame:
    """Stages written as profiler lines, every tenth malformed, and read back without these."""
    spark = jobs.sparkSession
    path = scratch_path(spark, "profile")
    line = F.to_json(F.struct(F.lit("stage").alias("type"), "job_id", "stage", F.col("sec").cast("double").alias("duration_sec"), (F.col("status") != "error").alias("ok")))
    jobs.select(F.when(F.col("event_id") % 10 == 0, F.lit('{"type": "stage", ')).otherwise(line).alias("value")).write.text(path)
    return read_profile_log(spark, path).select("job_id", "stage", "duration_sec")


@query("h1_folder_watch", "manifest", "SELECT cast(video_id % 50 AS bigint) AS folder, count(*) AS n FROM manifest GROUP BY ALL")
def folder_watch(manifest: DataFrame) -> DataFrame:
    """H1: file names landed as files and taken up by a stream in available-now mode, each file once."""
    spark = manifest.sparkSession
    source, out, checkpoint = (scratch_path(spark, f"watch-{n}") for n in ("in", "out", "checkpoint"))
    rows = manifest.select("video_id", "filename", (F.col("video_id") % 50).alias("folder"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("folder").agg(F.count("*").alias("n"))


@query("h4_live_transcript", "segments", "SELECT video_id, seg_no, '[' || printf('%.3f', start_sec) || ' - ' || printf('%.3f', end_sec) || '] ' || coalesce(speaker, 'UNK') || ': ' || trim(text) AS line FROM segments WHERE trim(text) <> ''")
def live_transcript(segments: DataFrame) -> DataFrame:
    """H4: segments landed as JSON lines and appended by a stream as formatted rows."""
    spark = segments.sparkSession
    source, out, checkpoint = (scratch_path(spark, f"talk-{n}") for n in ("in", "out", "checkpoint"))
    segments.select("video_id", "seg_no", "start_sec", "end_sec", "speaker", "text").write.json(source)
    streams.live_transcript(spark, source, out, checkpoint).awaitTermination()
    return spark.read.schema("video_id LONG, seg_no LONG, line STRING").parquet(out)
