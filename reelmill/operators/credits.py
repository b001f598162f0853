"""Credit rows reconciled between sources: roles, departments, confidence, verification, backfill and export checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.contain import first_overlap
from reelmill.functions.keys import TR_FROM, alnum_key, ascii_key, duck, plain_key, word_key
from reelmill.functions.similarity import best_jaccard, can_reach, duck_ratio, ratio, ratio_of
from reelmill.operators.names import _SQL_VARIANT, _sql_blacklist, _sql_junk, _sql_non_person, _sql_reason, blacklist_reason, is_junk, is_non_person, structural_reason, variant_score, words
from reelmill.plans.registry import query

#: Job to output role; hints of jobs that are left out; department and job to field; field by job of a source.
ROLES = {"director": "YÖNETMEN", "directed by": "YÖNETMEN", "yönetmen": "YÖNETMEN", "producer": "YAPIMCI", "executive producer": "YAPIMCI", "yapımcı": "YAPIMCI"}
EXCLUDED = ("art direction", "casting", "music", "sound", "foley", "script supervisor", "assistant editor", "adr", "costume", "makeup", "visual effects", "vfx", "stunt")
FIELDS = {("directing", "director"): "YÖNETMEN", ("production", "producer"): "YAPIMCI", ("writing", "writer"): "SENARYO", ("editing", "editor"): "KURGU", ("acting", "actor"): "OYUNCU"}
DEPARTMENT = {"Director": "directing", "Producer": "production", "Writer": "writing", "Editor": "editing", "actor": "acting", "Stunts": "crew"}
JOB_FIELD = {"Director": "YÖNETMEN", "Producer": "YAPIMCI", "Writer": "SENARYO", "Editor": "KURGU"}
MAIN_FIELDS, OTHER_FIELDS = ("YÖNETMEN", "YAPIMCI"), ("SENARYO", "KURGU", "KAMERA", "GÖRÜNTÜ YÖNETMENİ", "YÖNETMEN YARDIMCISI")
#: Words of a role's lines, by output role.
FIELD_WORDS = {"KURGU": ("editor", "editing", "cut", "kurgu"), "YÖNETMEN": ("directed by", "yonetmen", "yönetmen"), "KAMERA": ("kamera", "camera operator", "steadicam")}


def _case(column: str, table: dict, other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def _map(column, table: dict):
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


_ACTORS = "SELECT video_id, line_no, name AS actor_name, string_split(name, ' ')[2] AS character_name, confidence, is_verified, raw FROM credits WHERE job = 'actor'"


def actors(credits: DataFrame) -> DataFrame:
    """Cast rows; the second word of a name stands for the character."""
    return credits.where("job = 'actor'").select("video_id", "line_no", F.col("name").alias("actor_name"), F.get(F.split("name", " "), 1).alias("character_name"), "confidence", "is_verified", "raw")


@query(
    "a10_report_documents", "credits",
    "SELECT video_id, count(*) AS n_credits, count(DISTINCT job) AS n_jobs, array_to_string(list_sort(list(name || '/' || job)), ';') AS people FROM credits GROUP BY video_id",
)
def report_documents(credits: DataFrame) -> DataFrame:
    """A10: one nested document a video, here with its counts and its people in order."""
    nested = credits.groupBy("video_id").agg(F.collect_list(F.struct("name", "job", "confidence", "raw")).alias("credits"))
    people = F.array_join(F.array_sort(F.transform("credits", lambda c: F.concat(c["name"], F.lit("/"), c["job"]))), ";")
    return nested.select("video_id", F.size("credits").cast("long").alias("n_credits"), F.size(F.array_distinct("credits.job")).cast("long").alias("n_jobs"), people.alias("people"))


@query(
    "a11_line_lineage", "lines credits",
    f"""WITH c AS (SELECT video_id, {duck('ascii_key', 'name')} AS key, arg_min(name, line_no) AS name, arg_min(job, line_no) AS job, min(line_no) AS place FROM credits GROUP BY ALL),
    l AS (SELECT video_id, line_no, text AS raw_text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS repaired, {duck('ascii_key', 'text')} AS key FROM lines),
    m AS (SELECT l.video_id, l.line_no, arg_min((c.name, c.job), (CASE WHEN {duck('safe_lower', 'c.name')} = {duck('safe_lower', 'l.repaired')} THEN 0 WHEN c.key = l.key THEN 1 ELSE 2 END, c.place)) AS hit
          FROM l JOIN c ON l.video_id = c.video_id AND (strpos(l.key, c.key) > 0 OR strpos(c.key, l.key) > 0) WHERE l.key <> '' AND c.key <> '' GROUP BY ALL)
    SELECT l.video_id, l.line_no, l.raw_text, l.repaired, m.hit[1] AS final_name, coalesce(m.hit[2], 'unknown') AS category FROM l LEFT JOIN m ON l.video_id = m.video_id AND l.line_no = m.line_no""",
)
def line_lineage(lines: DataFrame, credits: DataFrame) -> DataFrame:
    """Raw text, repaired text, final name and category of each line. A line belongs to the credit of its video that it equals, case
    aside, else to that with its ascii key, else to the first one whose key holds its own or the other way round.

    All of it is one search for keys inside keys, which only the keys pass through.
    """
    table = credits.groupBy("video_id", ascii_key("name").alias("key")).agg(F.min_by(F.struct("name", "job"), "line_no").alias("hit"), F.min("line_no").alias("place")).where("key <> ''")
    found = first_overlap(lines.select("video_id", "line_no", ascii_key("text").alias("key")), table).join(table.select("video_id", "place", "hit"), ["video_id", "place"])
    both = lines.join(found.select("video_id", "line_no", "hit"), ["video_id", "line_no"], "left")
    repaired = F.trim(F.regexp_replace("text", r"\s+", " "))
    return both.select("video_id", "line_no", F.col("text").alias("raw_text"), repaired.alias("repaired"), F.col("hit.name").alias("final_name"), F.coalesce("hit.job", F.lit("unknown")).alias("category"))


@query(
    "a12_ocr_verdict", "persons credits",
    f"""WITH a AS ({_ACTORS}), k AS (SELECT video_id, {duck('plain_key', 'actor_name')} AS key, confidence FROM a UNION ALL SELECT video_id, {duck('plain_key', 'character_name')}, confidence FROM a), m AS (SELECT video_id, key, max(confidence) AS pipeline_confidence FROM k WHERE key <> '' GROUP BY ALL)
    SELECT p.video_id, p.line_no, p.name AS text, p.confidence AS ocr_confidence, m.pipeline_confidence, CASE WHEN m.key IS NULL THEN 'REJECTED' ELSE 'KEEP' END AS verdict FROM persons p LEFT JOIN m ON p.video_id = m.video_id AND m.key = {duck('plain_key', 'p.name')}""",
)
def ocr_verdict(persons: DataFrame, credits: DataFrame) -> DataFrame:
    """A reading is kept if it is an actor or a character of the cast (K7), with both confidences."""
    both = actors(credits).select("video_id", F.explode(F.array("actor_name", "character_name")).alias("text"), "confidence")
    table = both.groupBy("video_id", plain_key("text").alias("key")).agg(F.max("confidence").alias("pipeline_confidence")).where("key <> ''")
    keyed = persons.withColumn("key", plain_key("name")).join(table, ["video_id", "key"], "left")
    return keyed.select("video_id", "line_no", F.col("name").alias("text"), F.col("confidence").alias("ocr_confidence"), "pipeline_confidence", F.when(F.col("pipeline_confidence").isNull(), "REJECTED").otherwise("KEEP").alias("verdict"))


def output_role(job):
    role = F.regexp_replace(F.lower(F.trim(job)), r"\s+", " ")
    return F.coalesce(_map(role, ROLES), F.when(role.rlike("|".join(EXCLUDED)), "EXCLUDED"))


_ROLE_SQL = f"coalesce({_case('lower(job)', ROLES)}, CASE WHEN regexp_matches(lower(job), '{'|'.join(EXCLUDED)}') THEN 'EXCLUDED' END)"


@query("d9_output_role", "credits", f"SELECT video_id, line_no, name, job, {_ROLE_SQL} AS role FROM credits")
def role_labels(credits: DataFrame) -> DataFrame:
    """Job to output role, EXCLUDED by a hint, else null."""
    return credits.select("video_id", "line_no", "name", "job", output_role(F.col("job")).alias("role"))


_DEPT_SQL = _case("job", DEPARTMENT)
_FIELD_VALUES = ", ".join(f"('{d}', '{j}', '{f}')" for (d, j), f in FIELDS.items())


@query("d10_department_field", "credits", f"WITH f(department, job_key, field) AS (VALUES {_FIELD_VALUES}) SELECT c.video_id, c.line_no, c.name, f.field FROM (SELECT *, {_DEPT_SQL} AS department FROM credits) c LEFT JOIN f ON f.department = c.department AND f.job_key = lower(c.job)")
def department_field(credits: DataFrame) -> DataFrame:
    """Department and job, in any case, to the canonical field."""
    table = credits.sparkSession.createDataFrame([(*k, v) for k, v in FIELDS.items()], "department string, job_key string, field string")
    keyed = credits.select("video_id", "line_no", "name", _map(F.col("job"), DEPARTMENT).alias("department"), F.lower("job").alias("job_key"))
    return keyed.join(F.broadcast(table), ["department", "job_key"], "left").select("video_id", "line_no", "name", "field")  # a fixed table


@query(
    "d27_evidence_recovery", "persons credits",
    f"""WITH e AS (SELECT video_id, arg_min(name, line_no) AS name, {duck('alnum_key', 'name')} AS key FROM persons WHERE confidence >= 0.7 GROUP BY video_id, {duck('alnum_key', 'name')}),
    x AS (SELECT DISTINCT video_id, {duck('alnum_key', 'name')} AS key FROM credits WHERE job IN ('actor', 'Director'))
    SELECT video_id, name, 0.7::double AS confidence, 'person_evidence' AS source FROM e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.video_id = e.video_id AND x.key = e.key)""",
)
def evidence_recovery(persons: DataFrame, credits: DataFrame) -> DataFrame:
    """Clear names that cast and directors lack join the credits at .7, tagged."""
    found = persons.where("confidence >= 0.7").groupBy("video_id", alnum_key("name").alias("key")).agg(F.min_by("name", "line_no").alias("name"))
    held = credits.where("job IN ('actor', 'Director')").select("video_id", alnum_key("name").alias("key"))
    return found.join(held, ["video_id", "key"], "left_anti").select("video_id", "name", F.lit(0.7).alias("confidence"), F.lit("person_evidence").alias("source"))


@query(
    "d30_top_actors", "credits",
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, line_no) AS r FROM credits WHERE job = 'actor'),
    g AS (SELECT * FROM f WHERE r <= 5 AND {_sql_reason('name')} = 'ok' AND {_sql_blacklist('name')} IS NULL)
    SELECT video_id, name, position FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY r) AS position FROM g) WHERE position <= 2""",
)
def top_actors(credits: DataFrame) -> DataFrame:
    """Of the five clearest actors the first two that pass structure and blacklist."""
    first = Window.partitionBy("video_id").orderBy(F.col("confidence").desc(), "line_no")
    five = credits.where("job = 'actor'").withColumn("r", F.row_number().over(first)).where("r <= 5")
    good = five.where((structural_reason(F.col("name")) == "ok") & blacklist_reason(F.col("name")).isNull())
    return good.withColumn("position", F.row_number().over(Window.partitionBy("video_id").orderBy("r"))).where("position <= 2").select("video_id", "name", "position")


_PAIRS31 = f"""WITH p AS (SELECT c.video_id, c.line_no, c.name, t.name AS choice FROM credits c JOIN videos v USING (video_id) JOIN (SELECT DISTINCT tconst, name FROM title_people) t ON t.tconst = v.true_tconst
  WHERE 200 * least(length(c.name), length(t.name)) >= 82 * (length(c.name) + length(t.name))), s AS (SELECT *, lower(name) AS a, lower(choice) AS b FROM p), m AS (SELECT * FROM (SELECT *, {duck_ratio('a', 'b')} AS score FROM s) WHERE score >= 82)"""


@query(
    "d31_canonical_credits", "credits videos title_people",
    f"""{_PAIRS31}, b AS (SELECT video_id, line_no, arg_min(choice, (-score, choice)) AS canonical FROM m GROUP BY ALL)
    SELECT c.video_id, c.line_no, coalesce(b.canonical, c.name) AS name, b.canonical IS NOT NULL AS hit FROM credits c LEFT JOIN b ON b.video_id = c.video_id AND b.line_no = c.line_no""",
)
def canonical_credits(credits: DataFrame, videos: DataFrame, people: DataFrame) -> DataFrame:
    """Names spelled as the accepted title has them where the ratio is 82 or more; a hit or a miss a row."""
    choices = videos.select("video_id", F.col("true_tconst").alias("tconst")).join(people.select("tconst", F.col("name").alias("choice")).distinct(), "tconst")
    able = credits.join(choices, "video_id").where("200 * least(length(name), length(choice)) >= 82 * (length(name) + length(choice))").where(can_reach(F.lower("name"), F.lower("choice"), 82.0))
    near = able.withColumn("score", ratio(F.lower("name"), F.lower("choice"))).where("score >= 82")
    best = near.groupBy("video_id", "line_no").agg(F.min_by("choice", F.struct(-F.col("score"), F.col("choice"))).alias("canonical"))
    joined = credits.join(best, ["video_id", "line_no"], "left")
    return joined.select("video_id", "line_no", F.coalesce("canonical", "name").alias("name"), F.col("canonical").isNotNull().alias("hit"))


def scorecard_sql(source: str) -> str:
    return f"""SELECT video_id, title_score, director_score, ratio_score, hits_score, penalty, round(title_score + director_score + ratio_score + hits_score + penalty, 6) AS score,
      title_score + director_score + ratio_score + hits_score + penalty >= greatest(1.0, 0.40 * (CASE WHEN compared THEN 2.5 ELSE 0 END + CASE WHEN has_directors THEN 2.5 ELSE 0 END + CASE WHEN hits + misses > 0 THEN 6.0 ELSE 0 END)) AS accepted FROM {source}"""


#: Letters of the language classes.
_TURKISH, _CYRILLIC = f"[{TR_FROM}]", "[\u0400-\u04ff]"
_sql_tr = lambda t: f"regexp_matches({t}, '{_TURKISH}')"
_sql_cyr = lambda t: f"regexp_matches({t}, '{_CYRILLIC}')"
_SQL_COMPARED = f"""CASE WHEN {_sql_cyr('t.primary_title')} THEN CASE WHEN t.original_title <> '' AND NOT {_sql_cyr('t.original_title')} AND {_sql_tr('v.film_title')} = {_sql_tr('t.original_title')} THEN t.original_title END
  WHEN {_sql_tr('v.film_title')} = {_sql_tr('t.primary_title')} THEN t.primary_title WHEN t.original_title <> '' AND {_sql_tr('v.film_title')} = {_sql_tr('t.original_title')} AND NOT {_sql_cyr('t.original_title')} THEN t.original_title END"""

_CARD = f"""{_PAIRS31}, h AS (SELECT c.video_id, count(DISTINCT c.line_no) AS n, count(DISTINCT m.line_no) AS hits FROM credits c LEFT JOIN m ON m.video_id = c.video_id AND m.line_no = c.line_no WHERE c.job = 'actor' GROUP BY c.video_id),
  dp AS (SELECT c.video_id, c.line_no, lower(c.name) AS a, lower(t.name) AS b, t.category FROM credits c JOIN videos v USING (video_id) JOIN (SELECT DISTINCT tconst, name, category FROM title_people WHERE category NOT IN ('actor', 'actress')) t ON t.tconst = v.true_tconst
    WHERE c.job = 'Director' AND 5 * levenshtein(lower(c.name), lower(t.name)) <= length(c.name) + length(t.name)),
  ds AS (SELECT video_id, line_no, max(CASE WHEN category = 'director' THEN score END) AS best, max(score) AS crew FROM (SELECT *, {duck_ratio('a', 'b')} AS score FROM dp) GROUP BY ALL),
  d AS (SELECT c.video_id, CASE WHEN bool_and({_sql_cyr('c.name')}) THEN NULL ELSE max(CASE WHEN best >= 95 THEN 2 WHEN best >= 80 OR crew >= 82 THEN 1 ELSE 0 END) END AS level FROM credits c LEFT JOIN ds ON ds.video_id = c.video_id AND ds.line_no = c.line_no WHERE c.job = 'Director' GROUP BY c.video_id),
  v AS (SELECT video_id, {duck('alnum_key', 'film_title')} AS a, {duck('alnum_key', 'compare')} AS b, compare IS NOT NULL AS compared FROM (SELECT v.video_id, v.film_title, {_SQL_COMPARED} AS compare FROM videos v JOIN titles t ON t.tconst = v.true_tconst)),
  e AS (SELECT v.video_id, v.compared, {duck_ratio('a', 'b')} AS sim, a = b AS same, strpos(a, b) > 0 OR strpos(b, a) > 0 AS within, d.level, d.video_id IS NOT NULL AS has_directors, coalesce(h.hits, 0) AS hits, coalesce(h.n, 0) - coalesce(h.hits, 0) AS misses
        FROM v LEFT JOIN d USING (video_id) LEFT JOIN h USING (video_id)),
  r AS (SELECT *, CASE WHEN hits + misses = 0 THEN 0 ELSE hits / (hits + misses)::double END AS share FROM e),
  z AS (SELECT *, CASE WHEN NOT compared THEN 0.0 WHEN same THEN 2.5 WHEN sim >= 90 THEN 2.0 WHEN sim >= 80 THEN 1.0 WHEN within THEN 0.5 ELSE 0.0 END::double AS title_score, CASE level WHEN 2 THEN 2.5 WHEN 1 THEN 1.5 WHEN 0 THEN -2.5 ELSE 0.0 END::double AS director_score,
        CASE WHEN share >= 0.5 THEN 3.0 WHEN share >= 0.3 THEN 2.0 WHEN share >= 0.15 THEN 1.0 WHEN share >= 0.05 THEN 0.5 ELSE 0.0 END::double AS ratio_score, CASE WHEN hits >= 8 THEN 3.0 WHEN hits >= 5 THEN 2.0 WHEN hits >= 3 THEN 1.0 ELSE 0.0 END::double AS hits_score,
        CASE WHEN hits >= 3 THEN 0.0 WHEN share < 0.05 THEN -3.0 WHEN share < 0.10 THEN -2.0 WHEN share < 0.15 THEN -1.0 ELSE 0.0 END::double AS penalty FROM r) {scorecard_sql('z')}"""


def compared_title(film: Column, primary: Column, original: Column) -> Column:
    """The catalogue's title that a film's may be compared with: of its own language class (Turkish letters or none), never
    a Cyrillic one; null if there is none."""
    turkish, cyrillic = lambda t: t.rlike(_TURKISH), lambda t: t.rlike(_CYRILLIC)
    second = F.when((original != "") & (turkish(film) == turkish(original)) & ~cyrillic(original), original)
    return F.when(~cyrillic(primary) & (turkish(film) == turkish(primary)), primary).otherwise(second)


@query("d32_reverse_scorecard", "credits videos title_people titles", _CARD)
def reverse_scorecard(credits: DataFrame, videos: DataFrame, people: DataFrame, titles: DataFrame) -> DataFrame:
    """Title, director and cast of a match scored; accepted from 40 % of what could be reached, 1 at least.

    The title is compared by S1 on K5 keys, with the catalogue's title of its own language class; without one it neither
    scores nor counts as reachable. A director is found at 95 among the title's directors, near at 80 among these or 82
    among all its crew; if all directors read are Cyrillic they are not judged. Names are compared by S1, in place of the
    weighted ratio.
    """
    choices = videos.select("video_id", F.col("true_tconst").alias("tconst")).join(people.select("tconst", F.col("name").alias("choice")).distinct(), "tconst")
    a, b = F.lower("name"), F.lower("choice")
    able = credits.where("job = 'actor'").join(choices, "video_id").where("200 * least(length(name), length(choice)) >= 82 * (length(name) + length(choice))").where(can_reach(a, b, 82.0))
    near = able.withColumn("score", ratio(a, b)).where("score >= 82").select("video_id", "line_no").distinct().withColumn("hit", F.lit(1))
    cast = credits.where("job = 'actor'").join(near, ["video_id", "line_no"], "left").groupBy("video_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    crew = people.where("category NOT IN ('actor', 'actress')").select(F.col("tconst").alias("true_tconst"), F.col("name").alias("choice"), "category").distinct()
    read = credits.where("job = 'Director'").select("video_id", "line_no", "name")
    met = read.join(videos.select("video_id", "true_tconst"), "video_id").join(crew, "true_tconst").where(can_reach(a, b, 80.0)).withColumn("score", ratio(a, b))
    best = met.groupBy("video_id", "line_no").agg(F.max(F.when(F.col("category") == "director", F.col("score"))).alias("best"), F.max("score").alias("crew"))
    level = F.when(F.col("best") >= 95, 2).when((F.col("best") >= 80) | (F.col("crew") >= 82), 1).otherwise(0)
    judged = ~F.bool_and(F.col("name").rlike(_CYRILLIC))
    directors = read.join(best, ["video_id", "line_no"], "left").groupBy("video_id").agg(F.when(judged, F.max(level)).alias("level")).withColumn("has_directors", F.lit(True))
    facts = videos.join(titles, videos["true_tconst"] == titles["tconst"]).withColumn("compare", compared_title(F.col("film_title"), F.col("primary_title"), F.col("original_title")))
    facts = facts.select("video_id", alnum_key("film_title").alias("a"), alnum_key("compare").alias("b"), F.col("compare").isNotNull().alias("compared")).withColumn("sim", ratio(F.col("a"), F.col("b")))
    facts = facts.join(directors, "video_id", "left").join(cast, "video_id", "left").na.fill(0, ["n", "hits"])
    facts = facts.withColumn("share", F.when(F.col("n") == 0, 0.0).otherwise(F.col("hits") / F.col("n")))
    hits, share = F.col("hits"), F.col("share")
    within = F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))
    steps = facts.select(
        "video_id", "compared", "has_directors", "n",
        F.when(~F.col("compared"), 0.0).when(F.col("a") == F.col("b"), 2.5).when(F.col("sim") >= 90, 2.0).when(F.col("sim") >= 80, 1.0).when(within, 0.5).otherwise(0.0).alias("title_score"),
        F.when(F.col("level") == 2, 2.5).when(F.col("level") == 1, 1.5).when(F.col("level") == 0, -2.5).otherwise(0.0).alias("director_score"),
        F.when(share >= 0.5, 3.0).when(share >= 0.3, 2.0).when(share >= 0.15, 1.0).when(share >= 0.05, 0.5).otherwise(0.0).alias("ratio_score"),
        F.when(hits >= 8, 3.0).when(hits >= 5, 2.0).when(hits >= 3, 1.0).otherwise(0.0).alias("hits_score"),
        F.when(hits >= 3, 0.0).when(share < 0.05, -3.0).when(share < 0.10, -2.0).when(share < 0.15, -1.0).otherwise(0.0).alias("penalty"),
    )
    total = F.col("title_score") + F.col("director_score") + F.col("ratio_score") + F.col("hits_score") + F.col("penalty")
    attainable = F.when(F.col("compared"), 2.5).otherwise(0.0) + F.when(F.col("has_directors"), 2.5).otherwise(0.0) + F.when(F.col("n") > 0, 6.0).otherwise(0.0)
    return steps.select("video_id", "title_score", "director_score", "ratio_score", "hits_score", "penalty", F.round(total, 6).alias("score"), (total >= F.greatest(F.lit(1.0), 0.40 * attainable)).alias("accepted"))


@query(
    "d34_external_credits", "title_people",
    """WITH c AS (SELECT DISTINCT tconst, name, category, ordering FROM title_people), cast_rows AS (SELECT *, row_number() OVER (PARTITION BY tconst ORDER BY ordering, name, category) AS r FROM c WHERE category IN ('actor', 'actress'))
    SELECT tconst, name, 'cast' AS part FROM cast_rows WHERE r <= 15 UNION ALL SELECT tconst, name, 'crew' FROM c WHERE category NOT IN ('actor', 'actress') UNION ALL SELECT tconst, name, 'director' FROM c WHERE category = 'director'""",
)
def external_credits(people: DataFrame) -> DataFrame:
    """The first 15 of the cast, the crew, and directors derived from it."""
    rows = people.select("tconst", "name", "category", "ordering").distinct()
    order = Window.partitionBy("tconst").orderBy("ordering", "name", "category")
    acting = F.col("category").isin("actor", "actress")
    cast = rows.where(acting).withColumn("r", F.row_number().over(order)).where("r <= 15")
    part = lambda d, p: d.select("tconst", "name", F.lit(p).alias("part"))
    return part(cast, "cast").unionByName(part(rows.where(~acting), "crew")).unionByName(part(rows.where("category = 'director'"), "director"))


CATEGORY_JOB = {"writer": "Written by", "director": "Director", "producer": "Producer", "composer": "", "editor": "Editor", "cinematographer": "Director of Photography"}


@query("d35_local_credits", "title_people", f"SELECT tconst, name, {_case('category', CATEGORY_JOB)} AS job FROM title_people WHERE category NOT IN ('actor', 'actress')")
def local_credits(people: DataFrame) -> DataFrame:
    """Crew of the local catalogue with a job by category."""
    return people.where(~F.col("category").isin("actor", "actress")).select("tconst", "name", _map(F.col("category"), CATEGORY_JOB).alias("job"))


#: Department and job of a catalogue category.
CATEGORY_HINT = {"director": ("directing", "Director"), "cinematographer": ("camera", "Cinematographer"), "actor": ("acting", "actor"), "actress": ("acting", "actor")}
_HINTS = f"""h AS (SELECT video_id, key, {_case('category', {c: d for c, (d, _) in CATEGORY_HINT.items()})} AS hint_department, {_case('category', {c: j for c, (_, j) in CATEGORY_HINT.items()})} AS hint_job
  FROM (SELECT v.video_id, {duck('ascii_key', 't.name')} AS key, arg_min(t.category, (t.ordering, t.category)) AS category FROM videos v JOIN title_people t ON t.tconst = v.true_tconst GROUP BY ALL))"""


def hints(videos: DataFrame, people: DataFrame) -> DataFrame:
    """(video_id, key, hint_department, hint_job): what the people of a video's title do, by ascii key of the name; the first in order
    where a name stands twice."""
    asked = people.join(videos.select(F.col("true_tconst").alias("tconst")).distinct(), "tconst", "left_semi")
    held = asked.select(F.col("tconst").alias("true_tconst"), ascii_key("name").alias("key"), "category", "ordering")
    first = held.groupBy("true_tconst", "key").agg(F.min_by("category", F.struct("ordering", "category")).alias("category"))
    part = lambda i: _map(F.col("category"), {c: v[i] for c, v in CATEGORY_HINT.items()})
    return videos.select("video_id", "true_tconst").join(first, "true_tconst").select("video_id", "key", part(0).alias("hint_department"), part(1).alias("hint_job"))


def credit_hints(credits: DataFrame) -> DataFrame:
    """The same of credits that catalogues gave, where these stand beside the readings."""
    rows = credits.where("raw IN ('tmdb', 'imdb')").withColumn("department", _map(F.col("job"), DEPARTMENT))
    return rows.groupBy("video_id", ascii_key("name").alias("key")).agg(F.min_by("department", "line_no").alias("hint_department"), F.min_by("job", "line_no").alias("hint_job"))


@query(
    "d36_field_mismatch", "credits videos title_people",
    f"""WITH {_HINTS}, c AS (SELECT *, {_DEPT_SQL} AS expected, {duck('ascii_key', 'name')} AS key FROM credits WHERE raw = 'ocr_verified')
    SELECT c.video_id, c.line_no, c.name, c.job AS ocr_job, h.hint_job AS job, h.hint_department AS department, CASE WHEN c.job IN ('Director', 'Producer', 'actor') THEN 1 ELSE 2 END AS category
    FROM c JOIN h ON h.video_id = c.video_id AND h.key = c.key WHERE c.expected IS NOT NULL AND h.hint_department <> c.expected""",
)
def field_mismatch(credits: DataFrame, videos: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """Verified readings whose job's department differs from the catalogue's; the catalogue's job wins, category 1 or 2. The
    catalogue is the people of the video's title or, without these, the credits that come from catalogues."""
    held = credit_hints(credits) if people is None else hints(videos, people)
    rows = credits.where("raw = 'ocr_verified'").withColumn("expected", _map(F.col("job"), DEPARTMENT)).withColumn("key", ascii_key("name"))
    wrong = rows.join(held, ["video_id", "key"]).where("expected IS NOT NULL AND hint_department <> expected")
    category = F.when(F.col("job").isin("Director", "Producer", "actor"), 1).otherwise(2)
    return wrong.select("video_id", "line_no", "name", F.col("job").alias("ocr_job"), F.col("hint_job").alias("job"), F.col("hint_department").alias("department"), category.alias("category"))


_HINT_FIELD = " ".join(f"WHEN hint_department = '{d}' AND lower(hint_job) = '{j}' THEN '{f}'" for (d, j), f in FIELDS.items())


@query(
    "d37_confidence_annotation", "credits videos title_people",
    f"""WITH {_HINTS}, m AS (SELECT video_id, bool_or(raw = 'imdb') AS imdb_matched FROM credits GROUP BY video_id),
    c AS (SELECT c.*, m.imdb_matched, {_case('c.job', JOB_FIELD, "''")} AS ocr_field, CASE {_HINT_FIELD} ELSE '' END AS hint_field FROM credits c JOIN m USING (video_id) LEFT JOIN h ON h.video_id = c.video_id AND h.key = {duck('ascii_key', 'c.name')}),
    f AS (SELECT *, CASE WHEN job = 'actor' THEN 'OYUNCU' WHEN raw = 'imdb' AND hint_field <> '' THEN hint_field WHEN ocr_field <> '' THEN ocr_field ELSE upper(job) END AS final_field FROM c)
    SELECT video_id, line_no, name, CASE WHEN raw IN ('imdb', 'tmdb') THEN raw ELSE 'ocr_only' END AS matched_source, final_field,
      CASE WHEN raw NOT IN ('imdb', 'tmdb') THEN 'low' WHEN job = 'actor' THEN 'medium' WHEN final_field IN ('YÖNETMEN', 'YAPIMCI') THEN CASE WHEN raw = 'imdb' AND hint_field = final_field THEN 'high' WHEN raw = 'imdb' THEN 'medium' WHEN imdb_matched OR is_verified THEN 'medium' ELSE 'low' END
           WHEN raw = 'tmdb' AND NOT imdb_matched AND NOT is_verified THEN 'low' ELSE 'medium' END AS source_confidence,
      array_to_string(list_filter([CASE WHEN raw NOT IN ('imdb', 'tmdb') THEN 'no_external_match' END, CASE WHEN job <> 'actor' AND raw = 'imdb' AND final_field IN ('YÖNETMEN', 'YAPIMCI') AND hint_field NOT IN ('', final_field) THEN 'source_conflict' END,
        CASE WHEN job <> 'actor' AND raw = 'tmdb' AND NOT imdb_matched THEN CASE WHEN is_verified THEN 'confirmed' ELSE 'unconfirmed' END END], lambda x: x IS NOT NULL), ',') AS flags FROM f""",
)
def confidence_annotation(credits: DataFrame, videos: DataFrame, people: DataFrame) -> DataFrame:
    """Source, final field, confidence and flags of each credit; is_verified stands for the external yes or no."""
    matched = credits.groupBy("video_id").agg(F.bool_or(F.col("raw") == "imdb").alias("imdb_matched"))
    rows = credits.withColumn("key", ascii_key("name")).join(matched, "video_id").join(hints(videos, people), ["video_id", "key"], "left")
    hint = F.lit("")
    for (d, j), f in FIELDS.items():
        hint = F.when((F.col("hint_department") == d) & (F.lower("hint_job") == j), f).otherwise(hint)
    rows = rows.withColumn("hint_field", hint).withColumn("ocr_field", F.coalesce(_map(F.col("job"), JOB_FIELD), F.lit("")))
    imdb, tmdb, actor = F.col("raw") == "imdb", F.col("raw") == "tmdb", F.col("job") == "actor"
    field = F.when(actor, "OYUNCU").when(imdb & (F.col("hint_field") != ""), F.col("hint_field")).when(F.col("ocr_field") != "", F.col("ocr_field")).otherwise(F.upper("job"))
    rows = rows.withColumn("final_field", field)
    main = F.col("final_field").isin(*MAIN_FIELDS)
    sure = F.col("imdb_matched") | F.col("is_verified")
    level = (
        F.when(~imdb & ~tmdb, "low").when(actor, "medium").when(main & imdb & (F.col("hint_field") == F.col("final_field")), "high")
        .when(main & imdb, "medium").when(main & sure, "medium").when(main, "low").when(tmdb & ~sure, "low").otherwise("medium")
    )
    conflict = ~actor & imdb & main & (F.col("hint_field") != "") & (F.col("hint_field") != F.col("final_field"))
    asked = ~actor & tmdb & ~F.col("imdb_matched")
    flags = F.array_compact(F.array(F.when(~imdb & ~tmdb, "no_external_match"), F.when(conflict, "source_conflict"), F.when(asked, F.when(F.col("is_verified"), "confirmed").otherwise("unconfirmed"))))
    return rows.select("video_id", "line_no", "name", F.when(imdb | tmdb, F.col("raw")).otherwise("ocr_only").alias("matched_source"), "final_field", level.alias("source_confidence"), F.array_join(flags, ",").alias("flags"))


@query(
    "d39_missing_crew_qa", "credits videos title_people",
    f"""WITH o AS (SELECT DISTINCT c.video_id, c.name, v.true_tconst AS tconst, {duck('word_key', 'c.name')} AS key FROM credits c JOIN videos v USING (video_id) WHERE c.job NOT IN ('actor') AND {_sql_blacklist('c.name')} IS NULL),
    t AS (SELECT DISTINCT tconst, {duck('word_key', 'name')} AS ckey FROM title_people WHERE category NOT IN ('actor', 'actress')),
    j AS (SELECT o.video_id, o.name, coalesce(len(list_intersect(string_split(o.key, ' '), string_split(t.ckey, ' '))) / len(list_distinct(list_concat(string_split(o.key, ' '), string_split(t.ckey, ' '))))::double, 0.0) AS s FROM o LEFT JOIN t USING (tconst))
    SELECT video_id, name, round(max(s), 6) AS similarity FROM j GROUP BY ALL HAVING max(s) < 0.75""",
)
def missing_crew(credits: DataFrame, videos: DataFrame, people: DataFrame) -> DataFrame:
    """Crew names that no crew member of the title is near and that are no role title."""
    rows = credits.where((F.col("job") != "actor") & blacklist_reason(F.col("name")).isNull()).select("video_id", "name").distinct()
    rows = rows.join(videos.select("video_id", F.col("true_tconst").alias("tconst")), "video_id").withColumn("key", word_key("name"))
    asked = videos.select(F.col("true_tconst").alias("tconst")).distinct()
    crew = people.where("category NOT IN ('actor', 'actress')").join(asked, "tconst", "left_semi").select("tconst", word_key("name").alias("ckey"))
    best = best_jaccard(rows, crew, ["video_id", "name"], "tconst").where("similarity < 0.75")
    return best.select("video_id", "name", F.round("similarity", 6).alias("similarity"))


@query(
    "d40_catalogue_incomplete", "lines videos title_people",
    """WITH l AS (SELECT video_id, count(*) AS n_lines FROM lines GROUP BY video_id), c AS (SELECT tconst, count(*) AS n_people FROM title_people GROUP BY tconst)
    SELECT v.video_id, coalesce(n_people, 0) AS n_people, coalesce(n_lines, 0) AS n_lines, coalesce(n_people, 0) < 10 AND coalesce(n_lines, 0) >= 20 AS incomplete,
      CASE WHEN coalesce(n_people, 0) = 0 THEN 'none' WHEN n_people <= 3 THEN 'few' ELSE 'many' END AS summary FROM videos v LEFT JOIN l USING (video_id) LEFT JOIN c ON c.tconst = v.true_tconst""",
)
def catalogue_incomplete(lines: DataFrame, videos: DataFrame, people: DataFrame) -> DataFrame:
    """A catalogue with fewer than 10 people for 20 lines or more is incomplete; a word for 0, 1-3, 4 and more."""
    n_lines = lines.groupBy("video_id").agg(F.count("*").alias("n_lines"))
    n_people = people.groupBy(F.col("tconst").alias("true_tconst")).agg(F.count("*").alias("n_people"))
    rows = videos.join(n_lines, "video_id", "left").join(n_people, "true_tconst", "left").na.fill(0, ["n_lines", "n_people"])
    word = F.when(F.col("n_people") == 0, "none").when(F.col("n_people") <= 3, "few").otherwise("many")
    return rows.select("video_id", "n_people", "n_lines", ((F.col("n_people") < 10) & (F.col("n_lines") >= 20)).alias("incomplete"), word.alias("summary"))


@query(
    "d41_export_consistency", "credits",
    f"""WITH c AS (SELECT video_id, upper(name) AS person, {_ROLE_SQL} AS role, job, line_no FROM credits), d AS (SELECT video_id, count(DISTINCT person) AS n FROM c WHERE role = 'YÖNETMEN' GROUP BY video_id),
    a AS (SELECT DISTINCT video_id, person FROM c WHERE job = 'actor'), r AS (SELECT video_id, person, min(line_no) AS first_line, arg_min(role, line_no) AS role, count(DISTINCT role) AS roles FROM c WHERE role IN ('YÖNETMEN', 'YAPIMCI') GROUP BY ALL)
    SELECT video_id, 'too_many_directors' AS warning, NULL::varchar AS person, n FROM d WHERE n > 2 UNION ALL SELECT r.video_id, 'actor_and_crew', r.person, 1 FROM r JOIN a USING (video_id, person) UNION ALL SELECT video_id, 'two_roles', person, roles FROM r WHERE roles > 1""",
)
def export_consistency(credits: DataFrame) -> DataFrame:
    """More than two directors, a person both actor and crew, a person in two crew roles."""
    rows = credits.select("video_id", F.upper("name").alias("person"), output_role(F.col("job")).alias("role"), "job")
    directors = rows.where("role = 'YÖNETMEN'").groupBy("video_id").agg(F.count_distinct("person").alias("n")).where("n > 2")
    crew = rows.where("role IN ('YÖNETMEN', 'YAPIMCI')").groupBy("video_id", "person").agg(F.count_distinct("role").alias("n"))
    both = crew.join(rows.where("job = 'actor'").select("video_id", "person"), ["video_id", "person"], "left_semi")
    warn = lambda d, w, p, n: d.select("video_id", F.lit(w).alias("warning"), p.alias("person"), n.alias("n"))
    none, one = F.lit(None).cast("string"), F.lit(1).cast("long")
    return warn(directors, "too_many_directors", none, F.col("n")).unionByName(warn(both, "actor_and_crew", F.col("person"), one)).unionByName(warn(crew.where("n > 1"), "two_roles", F.col("person"), F.col("n")))


_FIELD_RE = {k: "|".join(v) for k, v in FIELD_WORDS.items()}


@query(
    "d42_no_data_fields", "role_lines",
    "WITH f(field, pattern) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _FIELD_RE.items()) + f"), v AS (SELECT DISTINCT video_id FROM role_lines) SELECT v.video_id, f.field FROM v, f WHERE NOT EXISTS (SELECT 1 FROM role_lines l WHERE l.video_id = v.video_id AND regexp_matches({duck('safe_lower', 'l.text')}, f.pattern))",
)
def no_data_fields(lines: DataFrame) -> DataFrame:
    """Fields of a video of which no line has a word."""
    from reelmill.functions.keys import safe_lower

    seen = F.array(*[F.struct(F.lit(k).alias("field"), F.bool_or(safe_lower("text").rlike(v)).alias("found")) for k, v in _FIELD_RE.items()])
    rows = lines.groupBy("video_id").agg(seen.alias("fields"))
    return rows.select("video_id", F.explode(F.filter("fields", lambda f: ~f["found"])).alias("f")).select("video_id", "f.field")


@query("d46_uncovered_frames", "lines lines2", "WITH c AS (SELECT DISTINCT video_id, line_no // 5 AS frame_no FROM lines2) SELECT l.video_id, l.frame_no, unnest(string_split(l.text, ', ')) AS text, 0.6::double AS confidence FROM lines l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.video_id = l.video_id AND c.frame_no = l.frame_no)")
def uncovered_frames(lines: DataFrame, second: DataFrame) -> DataFrame:
    """Only frames that the second source has not read are filled, a row a part, at one confidence."""
    covered = second.select("video_id", F.expr("line_no DIV 5").alias("frame_no")).distinct()
    return lines.join(covered, ["video_id", "frame_no"], "left_anti").select("video_id", "frame_no", F.explode(F.split("text", ", ")).alias("text"), F.lit(0.6).alias("confidence"))


_LAYERS = f"""WITH k AS (SELECT c.*, {_sql_blacklist('c.name')} IS NOT NULL AS blacklisted, {_sql_reason('c.name')} <> 'ok' AS malformed, n.key IS NOT NULL AS known FROM credit_readings c LEFT JOIN (SELECT DISTINCT {duck('name_key', 'primary_name')} AS key FROM name_list) n ON n.key = {duck('name_key', 'c.name')}),
  l AS (SELECT *, CASE WHEN blacklisted THEN 'blacklist' WHEN malformed THEN 'structure' WHEN known THEN 'name_table' WHEN is_verified THEN 'catalogue' ELSE 'none' END AS layer FROM k)"""


def layered(credits: DataFrame, names: DataFrame) -> DataFrame:
    """credits with the first layer that decides on a name."""
    from reelmill.functions.keys import name_key

    known = names.select(name_key("primary_name").alias("key")).distinct().withColumn("known", F.lit(True))
    rows = credits.withColumn("key", name_key("name")).join(known, "key", "left")
    layer = F.when(blacklist_reason(F.col("name")).isNotNull(), "blacklist").when(structural_reason(F.col("name")) != "ok", "structure").when(F.col("known"), "name_table").when(F.col("is_verified"), "catalogue").otherwise("none")
    return rows.withColumn("layer", layer)


@query(
    "d50_crew_verification", "credit_readings name_list",
    f"""{_LAYERS}, w AS (SELECT *, max(CASE WHEN layer IN ('name_table', 'catalogue') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, job) AS has_verified FROM l WHERE job <> 'actor')
    SELECT video_id, line_no, name, layer, CASE WHEN layer IN ('blacklist', 'structure') THEN 'dropped' WHEN layer IN ('name_table', 'catalogue') THEN 'kept' WHEN has_verified = 1 THEN 'dropped' ELSE 'flagged' END AS action FROM w""",
)
def crew_verification(credits: DataFrame, names: DataFrame) -> DataFrame:
    """Crew names by layer; unverified ones go if their role has a verified one, else they are flagged."""
    rows = layered(credits.where("job <> 'actor'"), names)
    good = F.col("layer").isin("name_table", "catalogue")
    has = F.max(good.cast("int")).over(Window.partitionBy("video_id", "job"))
    action = F.when(F.col("layer").isin("blacklist", "structure"), "dropped").when(good, "kept").when(F.col("has") == 1, "dropped").otherwise("flagged")
    return rows.withColumn("has", has).select("video_id", "line_no", "name", "layer", action.alias("action"))


@query("d51_cast_verification", "credit_readings name_list", f"{_LAYERS} SELECT video_id, count(*) FILTER (WHERE layer NOT IN ('blacklist', 'structure')) AS kept, count(*) FILTER (WHERE layer IN ('name_table', 'catalogue')) AS verified, count(*) FILTER (WHERE layer = 'none') AS flagged, count(*) FILTER (WHERE layer IN ('blacklist', 'structure')) AS dropped FROM l WHERE job = 'actor' GROUP BY video_id")
def cast_verification(credits: DataFrame, names: DataFrame) -> DataFrame:
    """Cast names by layer, totals a video."""
    bad, good = F.col("layer").isin("blacklist", "structure"), F.col("layer").isin("name_table", "catalogue")
    return layered(credits.where("job = 'actor'"), names).groupBy("video_id").agg(F.count_if(~bad).alias("kept"), F.count_if(good).alias("verified"), F.count_if(F.col("layer") == "none").alias("flagged"), F.count_if(bad).alias("dropped"))


@query("c30_audit_funnel", "credit_readings name_list", f"{_LAYERS} SELECT layer, job, count(*) AS n FROM l GROUP BY ALL")
def audit_funnel(credits: DataFrame, names: DataFrame) -> DataFrame:
    """Rows by layer and job."""
    return layered(credits, names).groupBy("layer", "job").agg(F.count("*").alias("n"))


@query(
    "d53_name_protection", "readings name_list",
    """WITH k AS (SELECT DISTINCT lower(unnest(string_split(primary_name, ' '))) AS word FROM name_list), w AS (SELECT video_id, line_no, name, unnest(string_split(lower(name), ' ')) AS word FROM readings WHERE strpos(name, ' ') > 0)
    SELECT w.video_id, w.line_no, w.name FROM w LEFT JOIN k USING (word) GROUP BY ALL HAVING avg(CASE WHEN k.word IS NULL THEN 0.0 ELSE 1.0 END) >= 0.8""",
)
def name_protection(persons: DataFrame, names: DataFrame) -> DataFrame:
    """Names of two words or more of which 80 % are known words of names."""
    known = names.select(F.explode(F.split(F.lower("primary_name"), " ")).alias("word")).distinct().withColumn("known", F.lit(1.0))
    rows = persons.where(F.col("name").contains(" ")).select("video_id", "line_no", "name", F.explode(F.split(F.lower("name"), " ")).alias("word"))
    share = F.avg(F.coalesce("known", F.lit(0.0)))
    return rows.join(known, "word", "left").groupBy("video_id", "line_no", "name").agg(share.alias("share")).where("share >= 0.8").drop("share")


@query(
    "d54_fallback_approval", "credit_readings name_list",
    f"""WITH n AS (SELECT DISTINCT {duck('name_key', 'primary_name')} AS key FROM name_list)
    SELECT c.video_id, c.line_no, c.name, NOT {_sql_junk('c.name')} AND (n.key IS NOT NULL OR c.confidence >= 0.85) AS approved,
      CASE WHEN NOT {_sql_junk('c.name')} AND (n.key IS NOT NULL OR c.confidence >= 0.85) THEN round(least(1.0, c.confidence + 0.3), 3) ELSE 0.2 END AS confidence FROM credit_readings c LEFT JOIN n ON n.key = {duck('name_key', 'c.name')} WHERE c.job = 'actor'""",
)
def fallback_approval(credits: DataFrame, names: DataFrame) -> DataFrame:
    """Without a model's answer a cast row is approved if its name is known or its confidence .85 or more; +.3, else .2."""
    from reelmill.functions.keys import name_key

    known = names.select(name_key("primary_name").alias("key")).distinct().withColumn("known", F.lit(True))
    rows = credits.where("job = 'actor'").withColumn("key", name_key("name")).join(known, "key", "left")
    good = ~is_junk(F.col("name")) & (F.coalesce("known", F.lit(False)) | (F.col("confidence") >= 0.85))
    return rows.select("video_id", "line_no", "name", good.alias("approved"), F.when(good, F.round(F.least(F.lit(1.0), F.col("confidence") + 0.3), 3)).otherwise(0.2).alias("confidence"))


_CREW = f"""WITH c AS (SELECT video_id, line_no, name, {_ROLE_SQL} AS role FROM credits WHERE NOT {_sql_non_person('name')} AND len(string_split(name, ' ')) < 4),
  f AS (SELECT video_id, role, name, min(line_no) AS line_no FROM c WHERE role IN ('YÖNETMEN', 'YAPIMCI') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, role ORDER BY line_no) AS position FROM f)"""


def crew_by_role(credits: DataFrame) -> DataFrame:
    """(video_id, role, name, line_no, position): persons of the output roles, once each."""
    rows = credits.where(~is_non_person(F.col("name")) & (F.size(words(F.col("name"))) < 4)).select("video_id", "line_no", "name", output_role(F.col("job")).alias("role"))
    first = rows.where("role IN ('YÖNETMEN', 'YAPIMCI')").groupBy("video_id", "role", "name").agg(F.min("line_no").alias("line_no"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("video_id", "role").orderBy("line_no")))


@query("d55_crew_role_mapping", "credits", f"{_CREW} SELECT video_id, role, name, position FROM r WHERE role <> 'YÖNETMEN' OR position <= 2")
def crew_role_mapping(credits: DataFrame) -> DataFrame:
    """Crew by output role, two directors at most."""
    return crew_by_role(credits).where("role <> 'YÖNETMEN' OR position <= 2").select("video_id", "role", "name", "position")


@query("d56_crew_backfill", "credits videos title_people", f"{_CREW}, p AS (SELECT DISTINCT video_id, role FROM r), s AS (SELECT DISTINCT v.video_id, CASE t.category WHEN 'director' THEN 'YÖNETMEN' WHEN 'cinematographer' THEN 'KAMERA' END AS role, t.name FROM videos v JOIN title_people t ON t.tconst = v.true_tconst WHERE t.category IN ('director', 'cinematographer')) SELECT video_id, role, name, 'primary' AS source FROM r UNION ALL SELECT s.video_id, s.role, s.name, 'secondary' FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.video_id = s.video_id AND p.role = s.role)")
def crew_backfill(credits: DataFrame, videos: DataFrame, people: DataFrame) -> DataFrame:
    """The catalogue fills only roles that the primary source leaves empty."""
    own = crew_by_role(credits)
    role = F.when(F.col("category") == "director", "YÖNETMEN").otherwise("KAMERA")
    other = videos.select("video_id", F.col("true_tconst").alias("tconst")).join(people.where("category IN ('director', 'cinematographer')"), "tconst").select("video_id", role.alias("role"), "name").distinct()
    fill = other.join(own.select("video_id", "role").distinct(), ["video_id", "role"], "left_anti")
    return own.select("video_id", "role", "name", F.lit("primary").alias("source")).unionByName(fill.select("video_id", "role", "name", F.lit("secondary").alias("source")))


@query(
    "c11_cast_by_character", "credits",
    f"""WITH a AS ({_ACTORS}), k AS (SELECT *, {duck('ascii_key', 'character_name')} AS key FROM a), g AS (SELECT video_id, key, arg_min(actor_name, (-confidence, line_no)) AS actor_name, arg_min(character_name, (length(character_name), line_no)) AS character_name, max(confidence) AS confidence, bool_or(is_verified) AS verified, min(line_no) AS position FROM k WHERE key <> '' GROUP BY ALL)
    SELECT video_id, actor_name, character_name, confidence, verified, position FROM g QUALIFY row_number() OVER (PARTITION BY video_id, {duck('ascii_key', 'actor_name')} ORDER BY position) = 1""",
)
def cast_by_character(credits: DataFrame) -> DataFrame:
    """C11: one row a character: clearest actor, shortest character, best confidence; an actor keeps its first character only."""
    keyed = actors(credits).withColumn("key", ascii_key("character_name")).where("key <> ''")
    groups = keyed.groupBy("video_id", "key").agg(
        F.min_by("actor_name", F.struct(-F.col("confidence"), F.col("line_no"))).alias("actor_name"), F.min_by("character_name", F.struct(F.length("character_name"), F.col("line_no"))).alias("character_name"),
        F.max("confidence").alias("confidence"), F.bool_or("is_verified").alias("verified"), F.min("line_no").alias("position"),
    )
    order = Window.partitionBy("video_id", ascii_key("actor_name")).orderBy("position")
    return groups.withColumn("r", F.row_number().over(order)).where("r = 1").select("video_id", "actor_name", "character_name", "confidence", "verified", "position")


@query("c14_cast_sort", "credits", f"WITH a AS ({_ACTORS}) SELECT video_id, line_no, actor_name, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN raw = 'tmdb' THEN line_no END NULLS LAST, {duck('ascii_key', 'character_name')}, {duck('ascii_key', 'actor_name')}, line_no) AS position FROM a WHERE is_verified OR confidence >= 0.70")
def cast_sort(credits: DataFrame) -> DataFrame:
    """Catalogue order first, rows without it after by keys; verified rows or a confidence of .70."""
    rows = actors(credits).where("is_verified OR confidence >= 0.70")
    order = Window.partitionBy("video_id").orderBy(F.when(F.col("raw") == "tmdb", F.col("line_no")).asc_nulls_last(), ascii_key("character_name"), ascii_key("actor_name"), "line_no")
    return rows.select("video_id", "line_no", "actor_name", F.row_number().over(order).alias("position"))


@query(
    "c15_double_name_split", "lines",
    r"""WITH w AS (SELECT video_id, line_no, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM lines),
    s AS (SELECT *, len(w) >= 3 AND length(text) > 20 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^\p{Lu}'))) = 0 AND length(array_to_string(w[1:len(w) // 2], ' ')) >= 5 AND length(array_to_string(w[len(w) // 2 + 1:], ' ')) >= 5 AS two FROM w)
    SELECT video_id, line_no, unnest(CASE WHEN two THEN [array_to_string(w[1:len(w) // 2], ' '), array_to_string(w[len(w) // 2 + 1:], ' ')] ELSE [text] END) AS name FROM s""",
)
def double_name_split(lines: DataFrame) -> DataFrame:
    """Three capitalised words or more of over 20 characters become two rows."""
    rows = lines.select("video_id", "line_no", "text", words(F.col("text")).alias("w")).withColumn("half", F.expr("size(w) DIV 2"))
    first, second = F.array_join(F.expr("slice(w, 1, half)"), " "), F.array_join(F.expr("slice(w, half + 1, size(w))"), " ")
    able = (F.size("w") >= 3) & (F.length("text") > 20)
    titled = ~F.exists("w", lambda x: ~x.rlike(r"^\p{Lu}"))
    two = F.when(able & titled & (F.length(first) >= 5) & (F.length(second) >= 5), F.array(first, second)).otherwise(F.array("text"))
    return rows.where("size(w) > 0").select("video_id", "line_no", F.explode(two).alias("name")).unionByName(rows.where("size(w) = 0").select("video_id", "line_no", F.col("text").alias("name")))


@query(
    "c18_role_dedup", "credits",
    f"""WITH c AS (SELECT video_id, {_ROLE_SQL} AS role, {duck('ascii_key', 'name')} AS key, name AS text, line_no FROM credits), s AS (SELECT *, {_SQL_VARIANT} AS score FROM c WHERE role IN ('YÖNETMEN', 'YAPIMCI'))
    SELECT video_id, role, arg_min(text, (-score, line_no)) AS name, min(line_no) AS position FROM s GROUP BY video_id, role, key""",
)
def role_dedup(credits: DataFrame) -> DataFrame:
    """One row a role and key: the richest spelling, at the place of the first."""
    rows = credits.select("video_id", output_role(F.col("job")).alias("role"), ascii_key("name").alias("key"), "name", "line_no").where("role IN ('YÖNETMEN', 'YAPIMCI')")
    return rows.groupBy("video_id", "role", "key").agg(F.min_by("name", F.struct(-variant_score(F.col("name")), F.col("line_no"))).alias("name"), F.min("line_no").alias("position")).drop("key")


@query(
    "c19_value_merge", "credits",
    """WITH g AS (SELECT video_id, lower(name) AS key, arg_min(name, line_no) AS name, sum(cast(confidence AS decimal(18, 9))) AS total, avg(cast(confidence AS decimal(18, 9))) AS mean FROM credits WHERE job = 'Director' GROUP BY ALL),
    r AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY total DESC, key) AS rank FROM g)
    SELECT video_id, name, CASE WHEN n = 1 THEN 'HIGH' ELSE 'LOW' END AS level, round(cast(mean AS double) * CASE WHEN n = 1 THEN 1.0 ELSE 0.7 END, 6) AS confidence, n - 1 AS alternatives FROM r WHERE rank = 1""",
)
def value_merge(credits: DataFrame) -> DataFrame:
    """C19, exact: values that agree are HIGH with their mean; else the group of highest sum wins, mean x .7, LOW, with the number of alternatives."""
    exact = F.col("confidence").cast("decimal(18,9)")
    groups = credits.where("job = 'Director'").groupBy("video_id", F.lower("name").alias("key")).agg(F.min_by("name", "line_no").alias("name"), F.sum(exact).alias("total"), F.avg(exact).cast("double").alias("mean"))
    best = groups.groupBy("video_id").agg(F.count("*").alias("n"), F.min_by(F.struct("name", "mean"), F.struct(-F.col("total"), F.col("key"))).alias("b"))
    one = F.col("n") == 1
    return best.select("video_id", "b.name", F.when(one, "HIGH").otherwise("LOW").alias("level"), F.round(F.col("b.mean") * F.when(one, 1.0).otherwise(0.7), 6).alias("confidence"), (F.col("n") - 1).alias("alternatives"))


#: Levels of a single source's score; least ratio of values that count as one.
HIGH_FROM, MEDIUM_FROM, SAME_VALUE = 0.85, 0.60, 85.0


def _same(a: str, b: str, least: float) -> bool:
    return a == b or 200 * min(len(a), len(b)) >= least * (len(a) + len(b)) and ratio_of(a, b) >= least


def _merged(values: list[tuple], least: float) -> tuple:
    """values (name, total, n, score, line) in order of their first line -> (name, level, confidence, alternatives). A value
    joins the first leader that it is near to; leaders are looked up by lengths that can reach the ratio."""
    leaders: list[str] = []
    groups: list[list[tuple]] = []
    by_length: dict[int, list[int]] = {}
    for value in values:
        name = value[0]
        fits = sorted(i for n, held in by_length.items() if 200 * min(n, len(name)) >= least * (n + len(name)) for i in held)
        at = next((i for i in fits if _same(name, leaders[i], least)), None)
        if at is None:
            by_length.setdefault(len(name), []).append(len(leaders))
            leaders.append(name)
            groups.append([value])
        else:
            groups[at].append(value)
    best = max(groups, key=lambda g: (sum(v[1] for v in g), -groups.index(g)))
    name, mean = max(best, key=lambda v: (v[3], -v[4]))[0], sum(v[1] for v in best) / sum(v[2] for v in best)
    if len(groups) > 1:
        return name, "LOW", mean * 0.7, [x for x in leaders if not _same(x, name, least)]
    single = sum(v[2] for v in best) == 1
    level = "HIGH" if not single or mean >= HIGH_FROM else "MEDIUM" if mean >= MEDIUM_FROM else "LOW"
    return name, level, mean, []


@query("c19_value_merge_fuzzy", "credit_readings")
def value_merge_fuzzy(credits: DataFrame, least: float = SAME_VALUE) -> DataFrame:
    """C19 in full: values of a video in order of their first line join the first value that they are near to (ratio of 85);
    the group of highest score sum wins (the earlier on ties) and gives its surest value; one group is HIGH with its mean,
    several are LOW with the winner's mean x .7 and the other groups' first values as alternatives; a single source has the
    level of its score. Equal values are one before they travel, and one video's different values are held at a time.
    """
    values = credits.where("job = 'Director'").groupBy("video_id", "name").agg(
        F.sum("confidence").alias("total"), F.count("*").alias("n"), F.max("confidence").alias("score"), F.max_by("line_no", F.struct("confidence", -F.col("line_no"))).alias("line"), F.min("line_no").alias("first")
    )
    rows = values.repartition("video_id").sortWithinPartitions("video_id", "first").select("video_id", "name", "total", "n", "score", "line")
    columns = ["video_id", "name", "level", "confidence", "alternatives"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, held = None, []
        for frame in frames:
            out = []
            for v, *value in frame.itertuples(index=False):
                if held and v != video:
                    out.append((video, *_merged(held, least)))
                    held = []
                video = v
                held.append(tuple(value))
            yield pd.DataFrame(out, columns=columns, dtype=object)
        if held:
            yield pd.DataFrame([(video, *_merged(held, least))], columns=columns, dtype=object)

    return rows.mapInPandas(run, "video_id long, name string, level string, confidence double, alternatives array<string>")


@query("c20_ordered_distinct", "credits", "WITH f AS (SELECT video_id, lower(name) AS key, arg_min(name, line_no) AS name, min(line_no) AS line_no FROM credits GROUP BY ALL) SELECT video_id, name, position FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY line_no) AS position FROM f) WHERE position <= 50")
def ordered_distinct(credits: DataFrame) -> DataFrame:
    """C20: names of a video once each, case ignored, in order of first appearance, 50 at most."""
    first = credits.groupBy("video_id", F.lower("name").alias("key")).agg(F.min_by("name", "line_no").alias("name"), F.min("line_no").alias("line_no"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("video_id").orderBy("line_no"))).where("position <= 50").select("video_id", "name", "position")


@query("f9_prompt_list", "credits", "WITH f AS (SELECT video_id, name, min(line_no) AS line_no FROM credits WHERE job = 'actor' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY line_no) AS r FROM f) SELECT video_id, string_agg(name, ', ' ORDER BY r) AS prompt FROM r WHERE r <= 20 GROUP BY video_id")
def prompt_list(credits: DataFrame) -> DataFrame:
    """the first 20 different actors of a video as one text."""
    first = credits.where("job = 'actor'").groupBy("video_id", "name").agg(F.min("line_no").alias("line_no"))
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("video_id").orderBy("line_no"))).where("r <= 20")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"])
    return top.groupBy("video_id").agg(F.array_join(ordered, ", ").alias("prompt"))


@query("c29_anomaly_flag", "credits", "SELECT video_id, count(*) FILTER (WHERE job = 'actor') AS actors, count(*) FILTER (WHERE job <> 'actor') AS crew, count(*) FILTER (WHERE job = 'actor') > 500 OR count(*) FILTER (WHERE job <> 'actor') > 2000 AS anomaly FROM credits GROUP BY video_id")
def anomaly_flag(credits: DataFrame) -> DataFrame:
    """More than 500 actors or 2000 crew."""
    counts = credits.groupBy("video_id").agg(F.count_if(F.col("job") == "actor").alias("actors"), F.count_if(F.col("job") != "actor").alias("crew"))
    return counts.withColumn("anomaly", (F.col("actors") > 500) | (F.col("crew") > 2000))


@query("g6_keyed_difference", "persons credits", f"SELECT video_id, line_no, name FROM persons p WHERE NOT EXISTS (SELECT 1 FROM credits c WHERE c.video_id = p.video_id AND {duck('alnum_key', 'c.name')} = {duck('alnum_key', 'p.name')} AND c.job = 'actor')")
def keyed_difference(persons: DataFrame, credits: DataFrame) -> DataFrame:
    """Names that a video's cast lacks."""
    held = credits.where("job = 'actor'").select("video_id", alnum_key("name").alias("key"))
    return persons.withColumn("key", alnum_key("name")).join(held, ["video_id", "key"], "left_anti").select("video_id", "line_no", "name")


@query("g7_keyed_intersection", "credits", f"SELECT DISTINCT video_id, name FROM credits a WHERE job = 'actor' AND EXISTS (SELECT 1 FROM credits c WHERE c.video_id = a.video_id AND {duck('ascii_key', 'c.name')} = {duck('ascii_key', 'a.name')} AND c.job <> 'actor')")
def keyed_intersection(credits: DataFrame) -> DataFrame:
    """Actors who are also crew of the video."""
    crew = credits.where("job <> 'actor'").select("video_id", ascii_key("name").alias("key"))
    return credits.where("job = 'actor'").withColumn("key", ascii_key("name")).join(crew, ["video_id", "key"], "left_semi").select("video_id", "name").distinct()


