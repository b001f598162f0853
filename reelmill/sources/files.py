"""Manifests of recordings, side-car files, logs and catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelmill.plans.registry import query

#: File name endings of recordings; the archive's id within a name.
EXTENSIONS = ("mp4", "mkv", "avi", "mov", "mxf", "ts")
ID = r"[0-9]{4}-[0-9]{2,4}-[0-9]+-[0-9]{4}-[0-9]{2,3}-[0-9]+"

JOB_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("video", T.StringType()), T.StructField("profile", T.StringType()),
    T.StructField("stages", T.MapType(T.StringType(), T.StructType([T.StructField("sec", T.DoubleType()), T.StructField("status", T.StringType())]))),
    T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("total_sec", T.DoubleType()),
])
PROFILE_SCHEMA = "type STRING, job_id STRING, stage STRING, t DOUBLE, duration_sec DOUBLE, ok BOOLEAN, error STRING, cpu_percent DOUBLE, ram_used_gb DOUBLE, gpu_util_percent DOUBLE, vram_used_gb DOUBLE"


def scan_media(spark: SparkSession, path: str) -> DataFrame:
    """A1: recordings below a folder by name ending: path, bytes and time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(EXTENSIONS)})$")).orderBy("path")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """A5: XML side-cars, a row an asset: media id, repository, and the title with its fallbacks."""
    schema = "MEDIAID STRING, REPOSITORY STRING, TITLE STRING, NAME STRING, LABEL STRING"
    rows = spark.read.format("xml").option("rowTag", "ASSET").schema(schema).load(path)
    title = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("TITLE", "NAME", "LABEL")])
    return rows.select(F.col("MEDIAID").alias("media_id"), F.col("REPOSITORY").alias("repository"), title.alias("title"))


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of jobs, one row a stage."""
    logs = spark.read.schema(JOB_SCHEMA).json(path)
    return logs.select("job_id", F.to_timestamp("timestamp").alias("ts"), "video", F.explode("stages").alias("stage", "s")).select("job_id", "ts", "video", "stage", "s.sec", "s.status")


def read_profile_log(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """JSON lines of profiler events; malformed lines are dropped."""
    rows = spark.read.schema(PROFILE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("job_id") == job_id) if job_id else rows


def write_reports(credits: DataFrame, path: str) -> None:
    """A10: one nested JSON document a video."""
    credits.groupBy("video_id").agg(F.collect_list(F.struct("name", "job", "confidence", "raw")).alias("credits")).write.mode("overwrite").json(path)


def stem(name):
    return F.regexp_replace(name, r"\.[^.]*$", "")


@query("a1_media_manifest", "manifest", r"SELECT video_id, filename, regexp_extract(filename, '\.([^.]+)$', 1) AS extension FROM manifest WHERE regexp_matches(lower(filename), '\.(mp4|mkv|avi|mov|mxf|ts)$')")
def media_manifest(manifest: DataFrame) -> DataFrame:
    """A1, on names: recordings by ending, in order of name (a range sort; no numbering, which would be one task)."""
    rows = manifest.where(F.lower("filename").rlike(rf"\.({'|'.join(EXTENSIONS)})$"))
    return rows.select("video_id", "filename", F.regexp_extract("filename", r"\.([^.]+)$", 1).alias("extension")).orderBy("filename", "video_id")


_STEM = r"regexp_replace(filename, '\.[^.]*$', '')"
_AFTER = rf"trim(translate(regexp_replace(regexp_replace({_STEM}, '^.*?{ID}', ''), '^[-_]+', ''), '_-', '  '))"


@query("a2_manifest_parse", "manifest", rf"WITH p AS (SELECT video_id, {_STEM} AS stem, regexp_extract(filename, '{ID}') AS film_id, {_AFTER} AS local FROM manifest) SELECT video_id, film_id, CASE WHEN film_id = '' THEN stem ELSE local END AS local_title, CASE WHEN film_id = '' THEN stem WHEN local = '' THEN film_id ELSE film_id || ' ' || local END AS output_name FROM p")
def manifest_parse(manifest: DataFrame) -> DataFrame:
    """A2: archive id, local title and output name of a file; without an id its stem stands for all."""
    name = stem(F.col("filename"))
    found = F.regexp_extract("filename", f"({ID})", 1)
    local = F.trim(F.translate(F.regexp_replace(F.regexp_replace(name, f"^.*?{ID}", ""), "^[-_]+", ""), "_-", "  "))
    rows = manifest.select("video_id", name.alias("stem"), found.alias("film_id"), local.alias("local"))
    none = F.col("film_id") == ""
    return rows.select("video_id", "film_id", F.when(none, F.col("stem")).otherwise(F.col("local")).alias("local_title"), F.when(none, F.col("stem")).when(F.col("local") == "", F.col("film_id")).otherwise(F.concat_ws(" ", "film_id", "local")).alias("output_name"))


@query("a3_series_split", "manifest", rf"WITH p AS (SELECT string_split(regexp_extract(filename, '{ID}'), '-') AS b FROM manifest) SELECT b[1] AS year, CASE b[3] WHEN '0' THEN 'series' WHEN '1' THEN 'film' ELSE 'none' END AS kind, count(*) AS n, count(DISTINCT CASE WHEN b[3] = '0' THEN b[4] END) AS episodes FROM p GROUP BY ALL")
def series_split(manifest: DataFrame) -> DataFrame:
    """A3: films and series episodes by year, from the third and fourth block of the id."""
    block = lambda i: F.get("b", F.lit(i))
    rows = manifest.select(F.split(F.regexp_extract("filename", f"({ID})", 1), "-").alias("b"))
    kind = F.when(block(2) == "0", "series").when(block(2) == "1", "film").otherwise("none")
    return rows.groupBy(block(0).alias("year"), kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct(F.when(block(2) == "0", block(3))).alias("episodes"))


#: The numeric block before a title, and how a dated segment begins.
_BLOCK, _DATED = "[0-9]{4}-[0-9]{3,4}-[0-9]-[0-9]{3,4}-[0-9]{2}-[0-9]-(.+)$", "^[0-9]{4}-"


@query(
    "a4_title_from_name", "archive_names",
    rf"""WITH s AS (SELECT video_id, {_STEM} AS stem, string_split({_STEM}, '_') AS parts FROM archive_names), k AS (SELECT *, list_position(list_transform(parts, lambda p, i: i > 1 AND regexp_matches(p, '{_DATED}')), true) AS spot FROM s),
    r AS (SELECT video_id, stem, list_filter(regexp_split_to_array(replace(regexp_extract(stem, '{_BLOCK}', 1), '_', ' '), '\s+'), lambda w: w <> '') AS behind,
          CASE WHEN spot > 2 THEN list_filter(regexp_split_to_array(array_to_string(parts[2:spot - 1], ' '), '\s+'), lambda w: w <> '') ELSE [] END AS middle FROM k),
    w AS (SELECT video_id, stem, CASE WHEN len(behind) > 0 THEN behind WHEN len(middle) >= 2 THEN middle ELSE [] END AS words FROM r)
    SELECT video_id, CASE WHEN len(words) = 0 THEN stem ELSE array_to_string(list_transform(words, lambda w: w[1] || lower(translate(w[2:], 'İI', 'iı'))), ' ') END AS title FROM w""",
)
def title_from_name(names: DataFrame) -> DataFrame:
    """A4: the text behind the numeric block; else the segments between the first one and the first dated one, if these are two
    words or more; else the stem. First letters stay, the rest is lower case with dotted and dotless i apart."""
    bare = stem(F.col("filename"))
    words = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = names.select("video_id", bare.alias("stem"), F.split(bare, "_").alias("parts"))
    rows = rows.withColumn("at", F.array_position(F.transform("parts", lambda p, i: (i > 0) & p.rlike(_DATED)), True))
    behind = words(F.translate(F.regexp_extract("stem", _BLOCK, 1), "_", " "))
    middle = words(F.array_join(F.slice("parts", F.lit(2), F.greatest(F.col("at") - 2, F.lit(0))), " "))
    found = F.when(F.size(behind) > 0, behind).when((F.col("at") > 2) & (F.size(middle) >= 2), middle)
    cased = F.transform(found, lambda w: F.concat(F.substring(w, 1, 1), F.lower(F.translate(F.substring(w, F.lit(2), F.length(w)), "İI", "iı"))))
    return rows.select("video_id", F.coalesce(F.array_join(cased, " "), F.col("stem")).alias("title"))


@query("a6_sidecar_coverage", "manifest titles", rf"WITH s AS (SELECT tconst AS video_id, CASE WHEN tconst % 5 = 0 THEN '' ELSE primary_title END AS title FROM titles) SELECT m.video_id, CASE WHEN s.video_id IS NULL THEN 'missing' WHEN s.title = '' THEN 'no_title' ELSE 'ok' END AS status FROM manifest m LEFT JOIN s ON s.video_id = m.video_id")
def sidecar_coverage(manifest: DataFrame, titles: DataFrame) -> DataFrame:
    """Recordings without a side-car, with one that has no title (every fifth), or with a good one."""
    cars = titles.select(F.col("tconst").alias("video_id"), F.when(F.col("tconst") % 5 == 0, "").otherwise(F.col("primary_title")).alias("title"))
    status = F.when(F.col("title").isNull(), "missing").when(F.col("title") == "", "no_title").otherwise("ok")
    return manifest.join(cars, "video_id", "left").select("video_id", status.alias("status"))


@query("a9_catalogue_scan", "titles principals", "SELECT t.tconst, t.title_type, t.start_year, count(p.nconst) AS people FROM titles t LEFT JOIN principals p USING (tconst) GROUP BY ALL")
def catalogue_scan(titles: DataFrame, principals: DataFrame) -> DataFrame:
    """Catalogue titles with the number of their people."""
    return titles.join(principals, "tconst", "left").groupBy("tconst", "title_type", "start_year").agg(F.count("nconst").alias("people"))


#: Fixed value: how an episode is labelled.
_LABEL = r"(?i)^(?:(?:avsnitt|episode|ep\.?|episod[eio]?|folge|aflevering|bölüm|bolum|capitulo|chapitre)\s*#?\s*[0-9]+(?:\.[0-9]+)?|[0-9]+\s*\.?\s*(?:avsnitt|episode|bölüm|bolum)|S[0-9]{1,2}E[0-9]{1,3})$"
_LABELS = "CASE line_no % 7 WHEN 0 THEN concat('Bölüm ', line_no) WHEN 1 THEN concat('S01E', line_no % 100) WHEN 2 THEN concat('episode #', line_no, ' x') WHEN 3 THEN concat(line_no, '. bolum') ELSE text END"


@query("b23_episode_label", "lines", f"SELECT video_id, line_no, label FROM (SELECT video_id, line_no, {_LABELS} AS label FROM lines) WHERE regexp_matches(trim(label), '{_LABEL}')")
def episode_label(lines: DataFrame) -> DataFrame:
    """Texts that are an episode's label, in several languages (four lines of seven are made into one or nearly one)."""
    return lines.select("video_id", "line_no", F.expr(_LABELS).alias("label")).where(F.trim("label").rlike(_LABEL))


@query("e13_credit_windows", "manifest", "WITH d AS (SELECT video_id, 600.0::double + video_id % 7000 AS dur FROM manifest), w AS (SELECT video_id, dur, greatest(least(240.0, 0.15 * dur), least(10.0, 0.1 * dur)) AS entry_sec, greatest(least(480.0, 0.15 * dur), least(10.0, 0.1 * dur)) AS exit_sec FROM d) SELECT video_id, round(entry_sec, 6) AS entry_end, round(dur - exit_sec, 6) AS exit_start, cast(floor(entry_sec * 0.5) + floor(exit_sec * 1.0) AS bigint) AS frames FROM w")
def credit_windows(manifest: DataFrame) -> DataFrame:
    """Opening and closing stretch of a film, and its frames at .5 and 1 a second (lengths stand in for ids)."""
    rows = manifest.select("video_id", (600.0 + F.col("video_id") % 7000).alias("dur"))
    share = lambda most: F.greatest(F.least(F.lit(most), 0.15 * F.col("dur")), F.least(F.lit(10.0), 0.1 * F.col("dur")))
    rows = rows.withColumn("a", share(240.0)).withColumn("b", share(480.0))
    frames = rows.select("video_id", "dur", "a", "b", F.concat(F.sequence(F.lit(1), F.floor(F.col("a") * 0.5).cast("int")), F.sequence(F.lit(1), F.floor("b").cast("int"))).alias("frames"))
    return frames.select("video_id", F.round("a", 6).alias("entry_end"), F.round(F.col("dur") - F.col("b"), 6).alias("exit_start"), F.size("frames").cast("long").alias("frames"))
