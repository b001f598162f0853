"""Derived views: text lines, words, names, credits, catalogue tables, segments, job stages and file names, each made
from the base tables by the same rule in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelmill.sources.scratch import scratch_path

#: name -> (tables and views it reads, Spark SQL, DuckDB SQL). {x} is a DataFrame in Spark and a name in DuckDB.
VIEWS: dict[str, tuple[tuple[str, ...], str, str]] = {}


def _view(name: str, reads: str, spark: str, duck: str | None = None) -> None:
    VIEWS[name] = (tuple(reads.split()), spark, duck or spark)


_view(
    "lines", "documents",
    r"""SELECT doc_id AS video_id, CAST(pos AS BIGINT) AS line_no, trim(x) AS text, pos * 2.0D AS first_seen, CAST(pos AS BIGINT) DIV 5 AS frame_no,
           0.5D + ((length(trim(x)) * 7 + pos * 13) % 50) / 100.0D AS confidence, lang, source
      FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, x WHERE trim(x) <> ''""",
    """SELECT doc_id AS video_id, CAST(i - 1 AS BIGINT) AS line_no, trim(x) AS text, (i - 1) * 2.0::DOUBLE AS first_seen, CAST((i - 1) // 5 AS BIGINT) AS frame_no,
           0.5::DOUBLE + ((length(trim(x)) * 7 + (i - 1) * 13) % 50) / 100.0::DOUBLE AS confidence, lang, source
      FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
      WHERE trim(x) <> ''""",
)
_view(
    "role_lines", "lines",
    """SELECT video_id, line_no, CASE WHEN line_no % 9 = 0 THEN CASE video_id % 11 WHEN 0 THEN 'Oyuncular' WHEN 1 THEN 'Yönetmen' WHEN 2 THEN 'KAMERA OPERATORLERi'
           WHEN 3 THEN 'Directed by' WHEN 4 THEN 'Acme Film' WHEN 5 THEN 'yonetmen: Ada Lovelace' WHEN 6 THEN 'Oyuncuiar' WHEN 7 THEN 'Yönetnem' WHEN 8 THEN 'GORUNTU YONETNENi' WHEN 9 THEN 'bu filmin müzik kayıtları 1987' ELSE 'Kurgu' END ELSE text END AS text,
           first_seen, frame_no, confidence, lang, source FROM {lines}""",
)
_view("lines2", "lines", "SELECT video_id, line_no, upper(replace(CASE WHEN line_no % 4 = 1 THEN translate(text, 'aeiou', 'eioua') ELSE text END, 'ß', 'ss')) AS text, first_seen + 1.0 AS first_seen, confidence FROM {lines} WHERE line_no % 3 <> 0 AND lang = 'en'")
_view(
    "words", "lines",
    """SELECT video_id, frame_no, line_no, CAST(wpos AS BIGINT) AS wpos, w AS text, (wpos % 8) * 110.0D + (line_no % 3) * 5.0D AS x1,
           (wpos % 8) * 110.0D + (line_no % 3) * 5.0D + length(w) * 9.0D AS x2, (line_no % 5) * 40.0D + (wpos DIV 8) * 200.0D AS y1,
           (line_no % 5) * 40.0D + (wpos DIV 8) * 200.0D + 18.0D + (length(w) % 4) AS y2, confidence
      FROM {lines} LATERAL VIEW posexplode(filter(split(text, ' '), z -> z <> '')) t AS wpos, w""",
    """SELECT video_id, frame_no, line_no, CAST(i - 1 AS BIGINT) AS wpos, w AS text, ((i - 1) % 8) * 110.0::DOUBLE + (line_no % 3) * 5.0::DOUBLE AS x1,
           ((i - 1) % 8) * 110.0::DOUBLE + (line_no % 3) * 5.0::DOUBLE + length(w) * 9.0::DOUBLE AS x2, (line_no % 5) * 40.0::DOUBLE + ((i - 1) // 8) * 200.0::DOUBLE AS y1,
           (line_no % 5) * 40.0::DOUBLE + ((i - 1) // 8) * 200.0::DOUBLE + 18.0::DOUBLE + (length(w) % 4) AS y2, confidence
      FROM (SELECT *, unnest(list_filter(string_split(text, ' '), lambda z: z <> '')) AS w,
                   generate_subscripts(list_filter(string_split(text, ' '), lambda z: z <> ''), 1) AS i FROM lines)""",
)
_view(
    "persons", "lines",
    # a name is the first two words with letters, so only a line's head goes through the patterns
    """SELECT video_id, line_no, concat(initcap(get(t, 0)), ' ', initcap(get(t, 1))) AS name, confidence
      FROM (SELECT *, split(regexp_replace(regexp_extract(lower(text), '^[^ ]*+ ++(?:[^a-z ]*+ ++)*+[^ ]*+', 0), '[^a-z ]', ''), ' +') AS t FROM {lines}) WHERE size(t) >= 2 AND length(get(t, 0)) >= 3 AND length(get(t, 1)) >= 3""",
    """SELECT video_id, line_no, concat(upper(w[1][1]), w[1][2:], ' ', upper(w[2][1]), w[2][2:]) AS name, confidence
      FROM (SELECT *, regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +') AS w FROM lines) WHERE len(w) >= 2 AND length(w[1]) >= 3 AND length(w[2]) >= 3""",
)
_view(
    "credits", "persons",
    """SELECT video_id, line_no, name, confidence, CASE line_no % 6 WHEN 0 THEN 'actor' WHEN 1 THEN 'Director' WHEN 2 THEN 'Producer' WHEN 3 THEN 'Writer' WHEN 4 THEN 'Editor' ELSE 'Stunts' END AS job,
           CASE video_id % 4 WHEN 0 THEN 'imdb' WHEN 1 THEN 'tmdb' WHEN 2 THEN 'ocr_verified' ELSE '' END AS raw, line_no % 3 = 0 AS is_verified FROM {persons}""",
)
_MISREAD = "CASE WHEN line_no % 3 = 1 THEN concat(substring(name, 1, 1), substring(name, 3, 1), substring(name, 2, 1), substring(name, 4)) ELSE name END AS name"
_view("readings", "persons", f"SELECT video_id, line_no, {_MISREAD}, confidence FROM {{persons}}")
_view("credit_readings", "credits", f"SELECT video_id, line_no, {_MISREAD}, confidence, job, raw, is_verified FROM {{credits}}")
_view(
    "titles", "part",
    """SELECT p_partkey AS tconst, p_name AS primary_title, concat(p_type, ' ', p_name) AS original_title, CASE WHEN p_size % 4 = 0 THEN 'tvSeries' ELSE 'movie' END AS title_type,
           CAST(1950 + p_size AS BIGINT) AS start_year FROM {part}""",
)
_view(
    "principals", "lineitem",
    """SELECT DISTINCT l_partkey AS tconst, l_suppkey AS nconst, CAST(l_linenumber AS BIGINT) AS ordering, CASE l_returnflag WHEN 'A' THEN 'actor' WHEN 'N' THEN 'actress' ELSE 'director' END AS category FROM {lineitem}""",
)
_view(
    "director_lists", "lineitem",
    """SELECT l_partkey AS tconst, array_join(transform(array_sort(collect_set(l_suppkey)), x -> CAST(x AS STRING)), ',') AS directors FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_partkey""",
    """SELECT l_partkey AS tconst, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS directors FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_partkey""",
)
_view(
    "name_list", "persons",
    "SELECT DISTINCT name AS primary_name, concat(substring(name, 1, 1), substring(name, 3, 1), substring(name, 2, 1), substring(name, 4)) AS ocr_name FROM {persons}",
    "SELECT DISTINCT name AS primary_name, concat(substring(name, 1, 1), substring(name, 3, 1), substring(name, 2, 1), substring(name, 4)) AS ocr_name FROM persons",
)
_view(
    "names", "persons",
    # numbered in each range of first letters, behind the names of the ranges before it: no task orders all names
    """WITH d AS (SELECT DISTINCT name, substring(name, 1, 4) AS head FROM {persons}), c AS (SELECT head, count(*) AS n FROM d GROUP BY head), o AS (SELECT head, sum(n) OVER (ORDER BY head) - n AS before FROM c)
      SELECT CAST(row_number() OVER (PARTITION BY d.head ORDER BY name) - 1 + before AS BIGINT) AS nconst, name AS primary_name, concat(substring(name, 1, 1), substring(name, 3, 1), substring(name, 2, 1), substring(name, 4)) AS ocr_name
      FROM d JOIN o ON d.head = o.head""",
    """SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS nconst, name AS primary_name, concat(substring(name, 1, 1), substring(name, 3, 1), substring(name, 2, 1), substring(name, 4)) AS ocr_name
      FROM (SELECT DISTINCT name FROM persons) d""",
)
_view(
    "segments", "conversations",
    """SELECT conv_id AS video_id, CAST(turn AS BIGINT) AS seg_no, CAST(turn * 10 AS DOUBLE) AS start_sec, CAST(turn * 10 + 4 + (length(text) % 12) AS DOUBLE) AS end_sec, role AS speaker, text,
           ((length(text) * 11) % 100) / CAST(100 AS DOUBLE) AS confidence FROM {conversations}""",
)
_view(
    "diarization", "conversations",
    """SELECT conv_id AS video_id, CAST(turn AS BIGINT) AS d_no, CAST(turn * 9 + 1 AS DOUBLE) AS d_start, CAST(turn * 9 + 7 AS DOUBLE) AS d_end, concat('SPEAKER_0', CAST(turn % 3 AS STRING)) AS d_speaker FROM {conversations}""",
)
_view(
    "match_phrases", "segments",
    """SELECT video_id, seg_no, start_sec, end_sec, speaker, confidence, CASE seg_no % 7 WHEN 0 THEN concat('34. dakikada Metin Oktay gol. ', text) WHEN 1 THEN concat('Galatasaray 2 - 1 Fenerbahce. ', text)
           WHEN 2 THEN concat('sarı kart 23. dakika Alpaslan. ', text) WHEN 3 THEN CASE WHEN video_id % 5 = 0 THEN concat('gol yok. ', text) ELSE text END
           WHEN 4 THEN concat('korner ofsayt kaleci. ', text) WHEN 5 THEN concat('kırmızı kart 61. dakika Rasim Kara. ', text) ELSE text END AS text FROM {segments}""",
)
_view(
    "match_reports", "segments",
    """SELECT video_id, seg_no, CASE seg_no % 5 WHEN 0 THEN concat('Maçın hakemi Cüneyt Çakır. ', text) WHEN 1 THEN concat('Bahattin Duran ve Tarık Ongun birinci yardımcıları, ', text) WHEN 2 THEN concat('Ali Palabıyık da dördüncü hakem. ', text)
           WHEN 3 THEN CASE WHEN video_id % 2 = 0 THEN concat('Süper Lig maçı, Lig''de ve Mersin''de. ', text) ELSE concat('PTT 1. LİG başlıyor. ', text) END ELSE text END AS text FROM {segments}""",
)
_view(
    "jobs", "events",
    """SELECT concat('job_', CAST(user_id AS STRING), '_', date_format(ts, 'yyyyMMdd')) AS job_id, event_type AS stage, value AS sec,
           CASE WHEN event_type = 'error' THEN 'error' WHEN value < 20 THEN 'skipped' WHEN value < 40 THEN 'fallback' ELSE 'ok' END AS status, ts, event_id FROM {events}""",
    """SELECT concat('job_', CAST(user_id AS VARCHAR), '_', strftime(ts, '%Y%m%d')) AS job_id, event_type AS stage, value AS sec,
           CASE WHEN event_type = 'error' THEN 'error' WHEN value < 20 THEN 'skipped' WHEN value < 40 THEN 'fallback' ELSE 'ok' END AS status, ts, event_id FROM events""",
)
_view(
    "manifest", "orders part",
    """SELECT o_orderkey AS video_id, concat('archive_TEST_', CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(o_custkey % 10000 AS STRING), 4, '0'), '-', CAST(o_orderkey % 2 AS STRING), '-',
           lpad(CAST(o_orderkey % 37 AS STRING), 4, '0'), '-00-1-', upper(replace(p_name, ' ', '_')), '.mp4') AS filename
      FROM {orders} JOIN {part} ON p_partkey = o_orderkey % (SELECT count(*) FROM {part})""",
)

_view(
    "archive_names", "manifest",
    """SELECT video_id, CASE video_id % 4 WHEN 1 THEN concat('archive_', replace(regexp_replace(filename, '^.*-1-', ''), '.mp4', ''), '_1989-0624-1.mp4') WHEN 2 THEN concat('archive_ONE_19', CAST(10 + video_id % 90 AS STRING), '-0624-1.mp4')
           ELSE filename END AS filename FROM {manifest}""",
    """SELECT video_id, CASE video_id % 4 WHEN 1 THEN concat('archive_', replace(regexp_replace(filename, '^.*-1-', ''), '.mp4', ''), '_1989-0624-1.mp4') WHEN 2 THEN concat('archive_ONE_19', CAST(10 + video_id % 90 AS VARCHAR), '-0624-1.mp4')
           ELSE filename END AS filename FROM manifest""",
)
_view(
    "language_samples", "events",
    # samples of a recording in order: two of the mix, two of either channel, a late one of each
    """SELECT user_id AS job_id, event_type AS lang, least(value / 100, 1.0D) AS p, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sample, 1 + user_id % 3 AS channels, 300 + 40 * (user_id % 10) AS seconds FROM {events}""",
    """SELECT user_id AS job_id, event_type AS lang, least(value / 100, 1.0::double) AS p, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sample, 1 + user_id % 3 AS channels, 300 + 40 * (user_id % 10) AS seconds FROM events""",
)
_view(
    "videos", "documents titles",
    """SELECT d.doc_id AS video_id, t.tconst AS true_tconst, CASE d.doc_id % 3 WHEN 0 THEN upper(t.primary_title) WHEN 1 THEN t.primary_title ELSE concat(substring(t.primary_title, 1, 4), substring(t.primary_title, 6)) END AS film_title,
           t.start_year + d.doc_id % 3 - 1 AS year, d.doc_id % 4 = 0 AS is_series
      FROM {documents} d JOIN {titles} t ON t.tconst = 1 + d.doc_id % (SELECT count(*) FROM {titles})""",
)
_view(
    "title_people", "principals names persons titles",
    """SELECT p.tconst, n.primary_name AS name, p.category, p.ordering FROM {principals} p JOIN {names} n ON p.nconst = n.nconst
      UNION ALL
      SELECT 1 + p.video_id % (SELECT count(*) FROM {titles}) AS tconst, CASE WHEN p.line_no % 4 = 1 THEN concat(substring(p.name, 1, 1), substring(p.name, 3, 1), substring(p.name, 2, 1), substring(p.name, 4)) ELSE p.name END AS name,
             CASE WHEN p.line_no % 8 = 1 THEN 'director' WHEN p.line_no % 8 = 5 THEN 'cinematographer' ELSE 'actor' END AS category, 100 + p.line_no AS ordering
      FROM {persons} p WHERE p.line_no % 4 < 2""",
)


def spread(table: DataFrame) -> DataFrame:
    """Deals a table out anew where it has fewer splits than the cluster has cores, as a small one in a single file."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def by_video(rows: DataFrame) -> DataFrame:
    """Deals rows by video into a number of parts that adaptive execution leaves as it is: what is made of a row, as its words, is many times its size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, 4 * rows.rdd.getNumPartitions()), "video_id")


#: How often one view reads another, where that is more than once.
TWICE = {("names", "persons"): 2}


def kept_views(names: tuple[str, ...], often: tuple[str, ...] = ()) -> set[str]:
    """Views to write once for a query over names: those that its operator reads often, and persons, a pass over all
    texts with patterns, where it is read more than once."""
    def reads(name: str) -> int:
        if name == "persons":
            return 1
        return sum(TWICE.get((name, r), 1) * (1 if r in often else reads(r)) for r in VIEWS[name][0]) if name in VIEWS else 0

    within = [n for n in often if n not in names and any(n in VIEWS[m][0] for m in names if m in VIEWS)]
    return {*often, *(["persons"] if sum(map(reads, [*names, *within])) > 1 else [])}


def view(spark: SparkSession, sf_dir: str, name: str, kept: set[str] | None = None, made: dict[str, DataFrame] | None = None, dealt: frozenset[str] = frozenset()) -> DataFrame:
    """A derived view, or a base table, as a DataFrame. Views in kept are written to the shared folder and read again; made holds those
    that are written already. Views in dealt are dealt by video."""
    if name not in VIEWS:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table) if name == "documents" else table
    made = {} if made is None else made
    if name not in made:
        reads, sql, _ = VIEWS[name]
        rows = spark.sql(sql, **{r: view(spark, sf_dir, r, kept, made, dealt) for r in reads})
        rows = by_video(rows) if name in dealt else rows
        if name not in (kept or ()):
            return rows
        path = scratch_path(spark, name)
        rows.write.parquet(path)
        made[name] = spark.read.parquet(path)
    return made[name]


def with_views(names: tuple[str, ...], sql: str) -> str:
    """sql behind the WITH clauses of the views that it reads."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in found:
            reads, _, duck = VIEWS[name]
            for r in reads:
                add(r)
            found[name] = duck.format(**{r: r for r in reads}) if "{" in duck else duck

    for name in names:
        add(name)
    if not found:
        return sql
    clauses = ", ".join(f"{n} AS ({q.replace(' STRING)', ' VARCHAR)')})" for n, q in found.items())
    body = sql.strip()
    return f"WITH {clauses}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {clauses} {body}"
