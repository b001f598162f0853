"""Text lines read from credits: cleaning, filters, the funnel report, and rollups of repeated readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.keys import duck, hit_key, line_key, safe_lower
from reelmill.plans.registry import query

#: Characters of noise, and lines that are badges, links, clocks, dates or subtitle tags.
NOISE = "|_~^`{}[]<>\\©®™•§¶†‡░▒▓█▄▀"
BLACKLIST = (
    r"^hd$|^sd$|^4k$|^uhd$|^yeni$|^canli$|^canlı$|^live$|^bolum$|^[0-9]+\s*\.?\s*bolum$|^episode\s*[0-9]*$|^previously\s+on$|^daha\s+önce$|^www\.|^http|\.com$|\.tr$"
    r"|^[0-9]{1,2}:[0-9]{2}$|^[0-9]{1,2}\.[0-9]{2}\.[0-9]{4}$|^altyazı|^subtitle|^yaptirilmistir$"
)
ODD = r"[^\p{L}\p{N}\s]{3,}"
MIN_CONFIDENCE, MIN_LENGTH, SHORT_DIGITS, LONG_DIGITS, WATERMARK = 0.80, 2, 0.55, 0.70, 15
EDGE = r".\-_~=+|/\\"


def clean_text(text: Column) -> Column:
    """Trimmed, single spaces, edge marks gone; null if only symbols remain."""
    t = F.regexp_replace(F.trim(text), r"\s+", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, f"^[{EDGE}]+", ""), f"[{EDGE}]+$", ""))
    return F.when(~t.rlike(r"^[^\p{L}\p{N}]*$"), t)


def noise_ratio(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, NOISE, ""))) / F.greatest(F.length(text), F.lit(1))


def digit_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9]")) / F.greatest(F.length(text), F.lit(1))


def is_year(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"^\((.*)\)$", "$1"), r"\.+$", "")
    return bare.rlike("^(19[0-9]{2}|20[0-9]{2}|2100)$")


def passes_digits(text: Column) -> Column:
    share = digit_ratio(text)
    return is_year(text) | ~(((F.length(text) <= 8) & (share > SHORT_DIGITS)) | (share > LONG_DIGITS))


_SQL_CLEAN = rf"""trim(regexp_replace(regexp_replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '^[{EDGE}]+', ''), '[{EDGE}]+$', ''))"""
_NOISE_SQL = NOISE.replace("'", "''")
_SQL_NOISE = f"(length(text) - length(translate(text, '{_NOISE_SQL}', ''))) / cast(greatest(length(text), 1) AS double)"
_SQL_DIGITS = "len(regexp_extract_all(text, '[0-9]')) / cast(greatest(length(text), 1) AS double)"
_SQL_YEAR = r"regexp_matches(regexp_replace(regexp_replace(text, '^\((.*)\)$', '\1'), '\.+$', ''), '^(19[0-9]{2}|20[0-9]{2}|2100)$')"
_SQL_DIGIT_OK = f"({_SQL_YEAR} OR NOT ((length(text) <= 8 AND {_SQL_DIGITS} > {SHORT_DIGITS}) OR {_SQL_DIGITS} > {LONG_DIGITS}))"
_SQL_BLACK = f"regexp_matches({duck('safe_lower', 'text')}, '{BLACKLIST}')"


@query("b1_clean_line", "lines", rf"SELECT * FROM (SELECT video_id, line_no, {_SQL_CLEAN} AS clean FROM lines) WHERE NOT regexp_matches(clean, '^[^\p{{L}}\p{{N}}]*$')")
def clean_line(lines: DataFrame) -> DataFrame:
    """B1: cleaned text of each line; lines of symbols only are dropped."""
    return lines.select("video_id", "line_no", clean_text(F.col("text")).alias("clean")).where("clean IS NOT NULL")


@query("b2_noise_ratio", "lines", f"SELECT video_id, line_no, text, {_SQL_NOISE} AS noise FROM lines WHERE {_SQL_NOISE} < 0.25")
def noise_filter(lines: DataFrame) -> DataFrame:
    """B2: lines with less than a quarter of noise characters."""
    return lines.select("video_id", "line_no", "text", noise_ratio(F.col("text")).alias("noise")).where("noise < 0.25")


@query("b3_length_confidence", "lines", "SELECT video_id, line_no, text, confidence, confidence >= 0.80 AS first_engine FROM lines WHERE length(text) >= 2 AND confidence >= 0.30")
def length_confidence(lines: DataFrame) -> DataFrame:
    """Lines of two characters or more that the second engine keeps, marked if the first does too."""
    return lines.where((F.length("text") >= MIN_LENGTH) & (F.col("confidence") >= 0.30)).select("video_id", "line_no", "text", "confidence", (F.col("confidence") >= MIN_CONFIDENCE).alias("first_engine"))


@query("b4_digit_noise", "lines", f"SELECT video_id, line_no, text, {_SQL_DIGITS} AS digits FROM lines WHERE {_SQL_DIGIT_OK}")
def digit_noise(lines: DataFrame) -> DataFrame:
    """Lines without number noise; years stay."""
    return lines.where(passes_digits(F.col("text"))).select("video_id", "line_no", "text", digit_ratio(F.col("text")).alias("digits"))


@query("b5_blacklist", "lines", f"SELECT video_id, line_no, text FROM lines WHERE NOT {_SQL_BLACK}")
def blacklist(lines: DataFrame) -> DataFrame:
    """Lines that no blacklist pattern fits."""
    return lines.where(~safe_lower("text").rlike(BLACKLIST)).select("video_id", "line_no", "text")


_STEPS = ("noise", "length", "confidence", "digit", "blacklist")


def filter_flags(lines: DataFrame) -> DataFrame:
    """lines with one flag a filter: does the line pass it?"""
    text = F.col("text")
    flags = {"noise": noise_ratio(text) < 0.25, "length": F.length(text) >= MIN_LENGTH, "confidence": F.col("confidence") >= MIN_CONFIDENCE, "digit": passes_digits(text), "blacklist": ~safe_lower(text).rlike(BLACKLIST)}
    return lines.withColumns({f"ok_{k}": v for k, v in flags.items()})


_FLAGS_SQL = f"SELECT *, {_SQL_NOISE} < 0.25 AS ok_noise, length(text) >= 2 AS ok_length, confidence >= 0.80 AS ok_confidence, {_SQL_DIGIT_OK} AS ok_digit, NOT {_SQL_BLACK} AS ok_blacklist FROM lines"


@query(
    "b6_line_funnel", "lines",
    f"WITH f AS ({_FLAGS_SQL}) SELECT video_id, count(*) AS n_raw, count(*) FILTER (WHERE ok_noise) AS n_noise, count(*) FILTER (WHERE ok_noise AND ok_length) AS n_length, "
    "count(*) FILTER (WHERE ok_noise AND ok_length AND ok_confidence) AS n_confidence, count(*) FILTER (WHERE ok_noise AND ok_length AND ok_confidence AND ok_digit) AS n_digit, "
    "count(*) FILTER (WHERE ok_noise AND ok_length AND ok_confidence AND ok_digit AND ok_blacklist) AS n_blacklist FROM f GROUP BY video_id",
)
def line_funnel(lines: DataFrame) -> DataFrame:
    """Lines left after each filter, a video a row, in one pass."""
    sofar, columns = F.lit(True), [F.count("*").alias("n_raw")]
    for step in _STEPS:
        sofar = sofar & F.col(f"ok_{step}")
        columns.append(F.count_if(sofar).alias(f"n_{step}"))
    return filter_flags(lines).groupBy("video_id").agg(*columns)


def kept_lines(lines: DataFrame) -> DataFrame:
    """Lines that pass every filter of the funnel."""
    return filter_flags(lines).where(" AND ".join(f"ok_{s}" for s in _STEPS)).drop(*[f"ok_{s}" for s in _STEPS])


@query("b10_mojibake_repair", "lines")
def mojibake_repair(lines: DataFrame) -> DataFrame:
    """UTF-8 that was read as Latin-1 is read again where that gives valid text; the original stays beside it."""
    data = F.encode("text", "ISO-8859-1").cast("string")
    good = F.col("text").rlike(r"^[\x00-\xFF]*$") & F.is_valid_utf8(data)
    fixed = F.when(good, data).otherwise(F.col("text"))
    return lines.select("video_id", "line_no", fixed.alias("text"), F.col("text").alias("original"), (fixed != F.col("text")).alias("repaired"))


def is_noise(text: Column) -> Column:
    """Symbols or digits only, too short, or three odd characters in a row."""
    t = F.trim(text)
    return (F.length(t) < 2) | t.rlike(r"^[^\p{L}]*$") | t.rlike(ODD)


def sql_is_noise(text: str) -> str:
    return rf"(length({text}) < 2 OR regexp_matches({text}, '^[^\p{{L}}]*$') OR regexp_matches({text}, '{ODD}'))"


@query("b18_parser_noise", "lines", f"SELECT video_id, line_no, text, {sql_is_noise('text')} AS is_noise FROM lines")
def parser_noise(lines: DataFrame) -> DataFrame:
    """Is a line noise to the parser?"""
    return lines.select("video_id", "line_no", "text", is_noise(F.col("text")).alias("is_noise"))


#: Endings of verbs.
_VERBS = "(yor|mak|mek|dır|dir|lar|ler|miş|muş|ing)$"


def is_subtitle(text: Column) -> Column:
    """A sentence rather than a credit: neither capitals nor title case, and long, punctuated or a verb at its end."""
    capitals = (text == F.upper(F.replace(text, F.lit("ß"), F.lit("ss")))) & (text != safe_lower(text))
    titled = (F.instr(text, " ") > 0) & ~text.rlike(r"(^|\s)[^\p{Lu}\s]")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    sentence = (words > 8) | (F.regexp_count(text, F.lit("[!?;…\"']")) >= 2) | ((F.length(text) > 15) & safe_lower(text).rlike(_VERBS))
    return ~(capitals | titled) & sentence


def sql_is_subtitle(text: str) -> str:
    return rf"""(NOT (({text} = upper(replace({text}, 'ß', 'ss')) AND {text} <> lower(replace({text}, 'İ', 'i'))) OR (strpos({text}, ' ') > 0 AND NOT regexp_matches({text}, '(^|\s)[^\p{{Lu}}\s]')))
         AND (len(list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')) > 8 OR len(regexp_extract_all({text}, '[!?;…"'']')) >= 2
              OR (length({text}) > 15 AND regexp_matches({duck('safe_lower', text)}, '{_VERBS}'))))"""


@query("b19_subtitle_like", "lines", f"SELECT video_id, line_no, text, {sql_is_subtitle('text')} AS subtitle_like FROM lines")
def subtitle_like(lines: DataFrame) -> DataFrame:
    """Is a line a sentence of subtitles?"""
    return lines.select("video_id", "line_no", "text", is_subtitle(F.col("text")).alias("subtitle_like"))


@query(
    "c1_best_reading", "lines",
    f"SELECT video_id, frame_no, key, arg_max(text, (confidence, -line_no)) AS text, max(confidence) AS confidence FROM (SELECT *, {duck('line_key', 'text')} AS key FROM lines) WHERE key <> '' GROUP BY ALL",
)
def best_reading(lines: DataFrame) -> DataFrame:
    """Per frame and key the reading of highest confidence, the first on ties."""
    keyed = lines.withColumn("key", line_key("text")).where("key <> ''")
    best = F.max_by("text", F.struct("confidence", -F.col("line_no")))
    return keyed.groupBy("video_id", "frame_no", "key").agg(best.alias("text"), F.max("confidence").alias("confidence"))


@query(
    "c2_persistence_rollup", "lines",
    f"""WITH f AS ({_FLAGS_SQL}), k AS (SELECT *, {duck('line_key', 'text')} AS key FROM f WHERE ok_noise AND ok_length AND ok_confidence AND ok_digit AND ok_blacklist)
    SELECT video_id, key, arg_max(text, (confidence, -line_no)) AS text, min(first_seen) AS first_seen, max(first_seen) AS last_seen, count(*) AS seen_count,
           round(avg(cast(confidence AS decimal(18, 9))) * CASE WHEN count(*) = 1 THEN 0.7 ELSE 1.0 END, 6) AS avg_confidence
    FROM k WHERE key <> '' GROUP BY video_id, key HAVING count(*) < {WATERMARK}""",
)
def persistence_rollup(lines: DataFrame) -> DataFrame:
    """One row a key: best text, times, count and mean confidence, x 0.7 if seen once; logo text (15 or more) goes."""
    keyed = kept_lines(lines).withColumn("key", line_key("text")).where("key <> ''")
    mean = F.avg(F.col("confidence").cast("decimal(18,9)")).cast("double")
    return (
        keyed.groupBy("video_id", "key")
        .agg(
            F.max_by("text", F.struct("confidence", -F.col("line_no"))).alias("text"),
            F.min("first_seen").alias("first_seen"),
            F.max("first_seen").alias("last_seen"),
            F.count("*").alias("seen_count"),
            F.round(mean * F.when(F.count("*") == 1, 0.7).otherwise(1.0), 6).alias("avg_confidence"),
        )
        .where(F.col("seen_count") < WATERMARK)
    )


@query(
    "c3_majority_rollup", "lines",
    f"""WITH k AS (SELECT *, {duck('line_key', 'text')} AS key FROM lines), t AS (SELECT video_id, key, text, count(*) AS n, min(line_no) AS first_line, avg(cast(confidence AS decimal(18, 9))) AS mean FROM k WHERE key <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id, key ORDER BY n DESC, first_line) AS rank, sum(n) OVER (PARTITION BY video_id, key) AS total FROM t)
    SELECT video_id, key, text, cast(total AS bigint) AS seen_count, round(mean * CASE WHEN total = 1 THEN 0.8 ELSE 1.0 END, 6) AS confidence FROM r WHERE rank = 1 AND round(mean * CASE WHEN total = 1 THEN 0.8 ELSE 1.0 END, 6) >= 0.30""",
)
def majority_rollup(lines: DataFrame) -> DataFrame:
    """One row a key with its most frequent spelling (the first on ties) and that spelling's mean confidence, x 0.8 if seen once; below .30 goes."""
    keyed = lines.withColumn("key", line_key("text")).where("key <> ''")
    spelled = keyed.groupBy("video_id", "key", "text").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.avg(F.col("confidence").cast("decimal(18,9)")).cast("double").alias("mean"))
    best = spelled.groupBy("video_id", "key").agg(F.max_by(F.struct("text", "mean"), F.struct("n", -F.col("first_line"))).alias("b"), F.sum("n").alias("seen_count"))
    confidence = F.round(F.col("b.mean") * F.when(F.col("seen_count") == 1, 0.8).otherwise(1.0), 6)
    return best.select("video_id", "key", "b.text", "seen_count", confidence.alias("confidence")).where("confidence >= 0.30")


@query(
    "c4_timed_hit_rollup", "lines",
    f"SELECT video_id, {duck('hit_key', 'text')} AS key, arg_max(text, (confidence, -line_no)) AS text, min(first_seen) AS start_sec, max(first_seen + 2.0) AS end_sec, round(avg(cast(confidence AS decimal(18, 9))), 6) AS confidence FROM lines GROUP BY ALL HAVING key <> ''",
)
def timed_hit_rollup(lines: DataFrame) -> DataFrame:
    """C4: one row a key: best text, earliest start, latest end, mean confidence."""
    keyed = lines.withColumn("key", hit_key("text")).where("key <> ''")
    return keyed.groupBy("video_id", "key").agg(
        F.max_by("text", F.struct("confidence", -F.col("line_no"))).alias("text"), F.min("first_seen").alias("start_sec"), F.max(F.col("first_seen") + 2.0).alias("end_sec"),
        F.round(F.avg(F.col("confidence").cast("decimal(18,9)")).cast("double"), 6).alias("confidence"),
    )


@query(
    "c5_constant_rollup", "lines",
    f"SELECT video_id, {duck('line_key', 'text')} AS key, min_by(text, line_no) AS text, count(*) AS seen_count, CASE WHEN count(*) = 1 THEN 0.675 ELSE 0.9 END::double AS confidence FROM lines GROUP BY ALL HAVING key <> '' AND count(*) < 15",
)
def constant_rollup(lines: DataFrame) -> DataFrame:
    """Readings of an engine without scores: 0.9, x 0.75 if seen once; logo text goes."""
    keyed = lines.withColumn("key", line_key("text")).where("key <> ''")
    found = keyed.groupBy("video_id", "key").agg(F.min_by("text", "line_no").alias("text"), F.count("*").alias("seen_count"))
    return found.where(F.col("seen_count") < WATERMARK).withColumn("confidence", F.when(F.col("seen_count") == 1, 0.675).otherwise(0.9))


@query("c6_top_500", "lines", "SELECT video_id, line_no, text, confidence FROM lines QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, line_no) <= 500")
def top_lines(lines: DataFrame, k: int = 500) -> DataFrame:
    """The k lines of highest confidence a video, earlier lines first on ties."""
    order = Window.partitionBy("video_id").orderBy(F.col("confidence").desc(), "line_no")
    return lines.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("video_id", "line_no", "text", "confidence")


@query("c26_frame_summary", "lines", "SELECT video_id, frame_no, count(*) FILTER (WHERE confidence >= 0.30 AND length(text) >= 2) AS line_count, round(avg(cast(confidence AS decimal(18, 9))), 6) AS avg_confidence FROM lines GROUP BY ALL")
def frame_summary(lines: DataFrame) -> DataFrame:
    """Usable lines and mean confidence of each frame."""
    return lines.groupBy("video_id", "frame_no").agg(F.count_if((F.col("confidence") >= 0.30) & (F.length("text") >= 2)).alias("line_count"), F.round(F.avg(F.col("confidence").cast("decimal(18,9)")).cast("double"), 6).alias("avg_confidence"))


@query("g1_sort_first_seen", "lines", "SELECT video_id, line_no, first_seen, row_number() OVER (PARTITION BY video_id ORDER BY first_seen, line_no) AS position FROM lines")
def sort_first_seen(lines: DataFrame) -> DataFrame:
    """G1: a video's lines in the order in which they were seen."""
    order = Window.partitionBy("video_id").orderBy("first_seen", "line_no")
    return lines.select("video_id", "line_no", "first_seen", F.row_number().over(order).alias("position"))
