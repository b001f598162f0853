"""Matches against a second catalogue: general fuzzy name match, strategies, acceptance, evidence, merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.keys import alnum_key, duck, line_key, word_key
from reelmill.functions.shared import most_shared
from reelmill.functions.similarity import block_ratio, can_reach, containment, duck_ratio, duck_sorted_tokens, may_reach, parts, ratio, ratio_of, sorted_tokens, wratio, wratio_of
from reelmill.operators.resolution import _EVIDENCE, _MATCHES, _PEOPLE, cast_matches, evidence
from reelmill.plans.registry import query
from reelmill.sources.scratch import scratch_path


def name_match_score(query_name, choice, threshold: float = 85.0):
    """D22 on two columns: 100 for equal K5 keys; a weighted ratio of threshold or more with the guard on short surnames; the
    same on folded text at threshold - 3; the rule of strong first and last names. Null where nothing holds."""
    folded_from = max(75.0, threshold - 3)

    def strong(a: str, b: str) -> float | None:
        (a0, *_, a1), (b0, *_, b1) = a.split(" "), b.split(" ")
        if min(len(a0), len(b0)) < 4 or min(len(a1), len(b1)) < 5 or min(len(a.replace(" ", "")), len(b.replace(" ", ""))) < 10:
            return None
        full, lasts = ratio_of(a, b), ratio_of(a1, b1)
        good = (ratio_of(a0, b0) >= 92 and lasts >= 58 and full >= max(74.0, threshold - 8)) or (a0 == b0 and lasts >= 62 and full >= max(76.0, threshold - 6))
        return full if good else None

    def score(name: str | None, other: str | None, a: str | None, b: str | None, same: bool | None) -> float | None:
        if same:
            return 100.0
        if not a or not b:
            found = wratio_of(name, other, threshold)
            return found if found >= threshold and a is not None and b is not None else None
        two = " " in a and " " in b
        best = direct if (direct := wratio_of(name, other, threshold)) >= threshold else None
        if best is None and (folded := wratio_of(a, b, folded_from)) >= folded_from:
            best = folded
        if best is not None and two and a.split(" ")[0] == b.split(" ")[0]:
            x, y = a.split(" ")[-1], b.split(" ")[-1]
            if min(len(x), len(y)) < 5 and ratio_of(x, y) < max(88.0, threshold):
                best = None
        return best if best is not None or not two else strong(a, b)

    def run(*columns: pd.Series) -> pd.Series:
        # one function, which stops at the first rule that holds: a column a rule would compute all of them
        return pd.Series([score(*row) for row in zip(*columns, strict=True)], dtype="float64")

    made = F.pandas_udf(run, "double")(query_name, choice, word_key(query_name), word_key(choice), alnum_key(query_name) == alnum_key(choice))
    return F.when(~F.isnan(made), made)


def match_parts(name) -> Column:
    """What may_match() reads of a name."""
    folded = word_key(name)
    return F.struct(alnum_key(name).alias("key"), (name == F.initcap(folded)).alias("plain"), parts(folded).alias("folded"))


def may_match(x: Column, y: Column, threshold: float = 85.0) -> Column:
    """Whether name_match_score() of two names, as match_parts(), may be there: no pair with a score is lost. Names in plain title case are no
    nearer than their folded forms; any other name is let through."""
    least = min(threshold, max(75.0, threshold - 3), max(74.0, threshold - 8), max(76.0, threshold - 6))
    return (x["key"] == y["key"]) | ~(x["plain"] & y["plain"]) | may_reach(x["folded"], y["folded"], least)


@query("d22_fuzzy_name_match", _PEOPLE)
def fuzzy_name_match(videos: DataFrame, persons: DataFrame, people: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Each name read with its best person of the title."""
    # what bounds a score is made once a name, and only people of the videos' titles; written, so that no filter computes it anew
    wanted = videos.select("video_id", F.col("true_tconst").alias("tconst"))
    spark, path = videos.sparkSession, scratch_path(videos.sparkSession, "choices")
    tasks = 8 * spark.sparkContext.defaultParallelism  # few rows for the work that they make, so they get a number of tasks of their own
    wanted.join(persons.select("video_id", "name").distinct(), "video_id").withColumn("a", match_parts(F.col("name"))).write.parquet(f"{path}/read")
    held = people.select("tconst", F.col("name").alias("choice")).join(wanted.select("tconst").distinct(), "tconst", "left_semi").distinct()
    held.withColumn("b", match_parts(F.col("choice"))).write.parquet(f"{path}/held")
    met = spark.read.parquet(f"{path}/read").repartition(tasks, "tconst").join(spark.read.parquet(f"{path}/held").repartition(tasks, "tconst"), "tconst").where(may_match(F.col("a"), F.col("b"), threshold))
    met.select("video_id", "name", "choice").write.parquet(f"{path}/met")
    pairs = spark.read.parquet(f"{path}/met")
    # written, so that the filter on the score stays behind it and does not compute it for each row a second time
    pairs.select("name", "choice").distinct().write.parquet(f"{path}/once")
    once = spark.read.parquet(f"{path}/once").repartition(tasks)
    once.select("name", "choice", name_match_score(F.col("name"), F.col("choice"), threshold).alias("score")).write.parquet(f"{path}/scored")
    scored = spark.read.parquet(f"{path}/scored").where("score IS NOT NULL")
    scored = pairs.join(scored, ["name", "choice"])
    return scored.groupBy("video_id", "name").agg(F.min_by("choice", F.struct(-F.col("score"), F.col("choice"))).alias("choice"), F.round(F.max("score"), 6).alias("score"))


_SAME_TITLE = f"kk AS (SELECT v.video_id, {duck('alnum_key', 'v.film_title')} = {duck('alnum_key', 't.primary_title')} AS same FROM videos v JOIN titles t ON t.tconst = v.true_tconst)"


@query(
    "d23_second_catalogue_a", f"{_PEOPLE} titles",
    f"""{_EVIDENCE}, {_SAME_TITLE}, np AS (SELECT video_id, count(DISTINCT name) AS n_read FROM persons GROUP BY video_id)
    SELECT e.video_id, e.tconst, CASE WHEN cast_n >= 1 AND dir_n >= 1 THEN 'cast_and_director' ELSE 'title_alone' END AS via FROM e JOIN kk ON kk.video_id = e.video_id LEFT JOIN np ON np.video_id = e.video_id
    WHERE kk.same AND ((cast_n >= 1 AND dir_n >= 1) OR (dir_n = 0 AND cast_n >= CASE WHEN coalesce(n_read, 0) < 5 THEN 2 ELSE greatest(3, n_read // 3) END))""",
)
def second_catalogue_a(videos: DataFrame, persons: DataFrame, people: DataFrame, titles: DataFrame) -> DataFrame:
    """The same title with a cast member and a director, or with a third of the cast (3 at least, 2 if few were read) and no director known."""
    facts = evidence(videos, persons, people).join(titles.select(F.col("tconst").alias("true_tconst"), "primary_title"), "true_tconst")
    read = persons.groupBy("video_id").agg(F.count_distinct("name").alias("n"))
    facts = facts.where(alnum_key("film_title") == alnum_key("primary_title")).join(read, "video_id", "left").na.fill(0, ["n"])
    both = (F.col("cast") >= 1) & (F.col("directors") >= 1)
    need = F.when(F.col("n") < 5, 2).otherwise(F.greatest(F.lit(3), F.floor(F.col("n") / 3)))
    rows = facts.where(both | ((F.col("directors") == 0) & (F.col("cast") >= need)))
    return rows.select("video_id", F.col("true_tconst").alias("tconst"), F.when(both, "cast_and_director").otherwise("title_alone").alias("via"))


@query("d24_second_catalogue_b", f"{_PEOPLE} titles", f"{_EVIDENCE} SELECT video_id, tconst, dir_n AS directors, cam_n AS camera FROM e WHERE dir_n >= 1 AND (is_series OR abs(year - start_year) <= 1 OR cam_n >= 1)")
def second_catalogue_b(videos: DataFrame, persons: DataFrame, people: DataFrame, titles: DataFrame) -> DataFrame:
    """A director; a film also needs the year or the same camera."""
    facts = evidence(videos, persons, people).join(titles.select(F.col("tconst").alias("true_tconst"), "start_year"), "true_tconst")
    rows = facts.where((F.col("directors") >= 1) & (F.col("is_series") | (F.abs(F.col("year") - F.col("start_year")) <= 1) | (F.col("camera") >= 1)))
    return rows.select("video_id", F.col("true_tconst").alias("tconst"), "directors", "camera")


_WORKS = f"""r AS (SELECT DISTINCT video_id, {duck('alnum_key', 'name')} AS key, name FROM persons), f AS (SELECT DISTINCT tconst, {duck('alnum_key', 'name')} AS key, category FROM title_people),
  w AS (SELECT r.video_id, f.tconst, count(DISTINCT r.key) AS shared, count(DISTINCT r.key) FILTER (WHERE f.category IN ('actor', 'actress')) AS actors FROM r JOIN f USING (key) GROUP BY ALL)"""


@query("d25_second_catalogue_c", "persons title_people", f"WITH {_WORKS} SELECT video_id, arg_max(tconst, (shared, -tconst)) AS tconst, max(shared) AS shared FROM w WHERE shared >= 3 OR (actors = 0 AND shared >= 1) GROUP BY video_id")
def second_catalogue_c(persons: DataFrame, people: DataFrame) -> DataFrame:
    """The work that most people share: three at least, or one where it has no actor among them."""
    read = persons.select(F.col("video_id").alias("l_id"), alnum_key("name").alias("key")).distinct().withColumn("weight", F.lit(1))
    held = people.groupBy(F.col("tconst").alias("r_id"), alnum_key("name").alias("key")).agg(F.max(F.col("category").isin("actor", "actress")).alias("flag"))
    return most_shared(read, held, 3, 1).toDF("video_id", "tconst", "shared")


@query("d26_person_evidence", "persons title_people videos", f"WITH r AS (SELECT video_id, {duck('alnum_key', 'name')} AS key, arg_min(name, line_no) AS name FROM persons GROUP BY ALL), c AS (SELECT DISTINCT v.video_id, {duck('alnum_key', 't.name')} AS key FROM videos v JOIN title_people t ON t.tconst = v.true_tconst), d AS (SELECT DISTINCT {duck('alnum_key', 'name')} AS key FROM title_people) SELECT r.video_id, r.name, CASE WHEN c.key IS NOT NULL THEN 'C' ELSE 'D' END AS via FROM r LEFT JOIN c ON c.video_id = r.video_id AND c.key = r.key LEFT JOIN d ON d.key = r.key WHERE c.key IS NOT NULL OR d.key IS NOT NULL", often="title_people")
def person_evidence(persons: DataFrame, people: DataFrame, videos: DataFrame) -> DataFrame:
    """Names that the title's people have (C), then those that only other titles have (D)."""
    read = persons.groupBy("video_id", alnum_key("name").alias("key")).agg(F.min_by("name", "line_no").alias("name"))
    wanted = videos.select("video_id", F.col("true_tconst").alias("tconst"))
    # names once each before their key, and keys once each before they meet readings: a name that most titles have makes no large task
    asked = people.select("tconst", "name").join(wanted.select("tconst").distinct(), "tconst", "left_semi").distinct().withColumn("key", alnum_key("name"))
    own = wanted.join(asked, "tconst").select("video_id", "key").distinct().withColumn("own", F.lit(True))
    known = people.select("name").distinct().select(alnum_key("name").alias("key")).distinct().withColumn("known", F.lit(True))
    keys = read.select("key").distinct().join(known, "key")
    rows = read.join(own, ["video_id", "key"], "left").join(keys, "key", "left").where("own OR known")
    return rows.select("video_id", "name", F.when(F.col("own"), "C").otherwise("D").alias("via"))


@query("d28_film_acceptance", _PEOPLE, f"{_MATCHES} SELECT v.video_id, count(m.name) FILTER (WHERE m.category = 'director') > 0 OR count(t.d) = 0 AS director_ok, count(m.name) FILTER (WHERE m.category IN ('actor', 'actress')) > 0 AS actor_ok FROM videos v LEFT JOIN (SELECT DISTINCT tconst, 1 AS d FROM title_people WHERE category = 'director') t ON t.tconst = v.true_tconst LEFT JOIN m ON m.video_id = v.video_id WHERE NOT v.is_series GROUP BY v.video_id", often="title_people")
def film_acceptance(videos: DataFrame, persons: DataFrame, people: DataFrame) -> DataFrame:
    """A film needs a director (none known: fulfilled) and an actor; token-sorted ratio of 80 in place of the weighted one."""
    found = cast_matches(videos, persons, people).groupBy("video_id").agg(F.count_if(F.col("category") == "director").alias("d"), F.count_if(F.col("category").isin("actor", "actress")).alias("a"))
    known = people.where("category = 'director'").select(F.col("tconst").alias("true_tconst")).distinct().withColumn("known", F.lit(True))
    rows = videos.where("NOT is_series").join(found, "video_id", "left").join(known, "true_tconst", "left").na.fill(0, ["d", "a"])
    return rows.select("video_id", ((F.col("d") > 0) | F.col("known").isNull()).alias("director_ok"), (F.col("a") > 0).alias("actor_ok"))


@query("d29_series_acceptance", _PEOPLE, f"{_MATCHES}, s AS (SELECT video_id, count(*) FILTER (WHERE category = 'director') AS d, count(*) FILTER (WHERE category IN ('actor', 'actress')) AS a FROM m GROUP BY video_id) SELECT v.video_id, CASE WHEN coalesce(d, 0) > 0 AND coalesce(a, 0) > 0 THEN 'A' WHEN coalesce(d, 0) > 0 THEN 'B' WHEN t.tconst IS NULL THEN 'title' ELSE 'rejected' END AS via FROM videos v LEFT JOIN s USING (video_id) LEFT JOIN (SELECT DISTINCT tconst FROM title_people WHERE category = 'director') t ON t.tconst = v.true_tconst WHERE v.is_series")
def series_acceptance(videos: DataFrame, persons: DataFrame, people: DataFrame) -> DataFrame:
    """A series by director and actor, by director over its flattened jobs, or by title alone where no director is known."""
    jobs = people.groupBy("tconst", "name").agg(F.collect_set("category").alias("jobs")).select("tconst", "name", F.explode_outer("jobs").alias("category"))
    found = cast_matches(videos.where("is_series"), persons, jobs).groupBy("video_id").agg(F.count_if(F.col("category") == "director").alias("d"), F.count_if(F.col("category").isin("actor", "actress")).alias("a"))
    known = people.where("category = 'director'").select(F.col("tconst").alias("true_tconst")).distinct().withColumn("known", F.lit(True))
    rows = videos.where("is_series").join(found, "video_id", "left").join(known, "true_tconst", "left").na.fill(0, ["d", "a"])
    via = F.when((F.col("d") > 0) & (F.col("a") > 0), "A").when(F.col("d") > 0, "B").when(F.col("known").isNull(), "title").otherwise("rejected")
    return rows.select("video_id", via.alias("via"))


_GATE = f"""{_EVIDENCE}, t AS (SELECT v.video_id, {duck_sorted_tokens('lower(v.film_title)')} AS a, {duck_sorted_tokens('lower(t.primary_title)')} AS b FROM videos v JOIN titles t ON t.tconst = v.true_tconst),
  g AS (SELECT e.video_id, e.tconst FROM e JOIN t USING (video_id) WHERE cast_n >= 2 AND {duck_ratio('a', 'b')} >= 90)"""


@query("d33_enrichment_gate", f"{_PEOPLE} titles credits", f"{_GATE}, c AS (SELECT DISTINCT video_id, {duck('alnum_key', 'name')} AS key FROM credits), x AS (SELECT DISTINCT g.video_id, p.name, p.category, {duck('alnum_key', 'p.name')} AS key FROM g JOIN title_people p ON p.tconst = g.tconst WHERE p.category NOT IN ('actor', 'actress')) SELECT x.video_id, x.name, x.category, CASE WHEN c.key IS NULL THEN 'added' ELSE 'hint' END AS action FROM x LEFT JOIN c ON c.video_id = x.video_id AND c.key = x.key", often="title_people")
def enrichment_gate(videos: DataFrame, persons: DataFrame, people: DataFrame, titles: DataFrame, credits: DataFrame) -> DataFrame:
    """Where the title is near (90) and two actors fit, missing crew is added and known crew gives department hints."""
    facts = evidence(videos, persons, people).join(titles.select(F.col("tconst").alias("true_tconst"), "primary_title"), "true_tconst").where("cast >= 2")
    score = ratio(sorted_tokens(F.lower("film_title")), sorted_tokens(F.lower("primary_title")))
    passed = facts.withColumn("s", score).where("s >= 90").select("video_id", F.col("true_tconst").alias("tconst"))
    crew = passed.join(people.where("category NOT IN ('actor', 'actress')"), "tconst").select("video_id", "name", "category", alnum_key("name").alias("key")).distinct()
    held = credits.select("video_id", alnum_key("name").alias("key")).distinct().withColumn("held", F.lit(True))
    return crew.join(held, ["video_id", "key"], "left").select("video_id", "name", "category", F.when(F.col("held"), "hint").otherwise("added").alias("action"))


@query("d44_merge_fixed", "lines lines2")
def merge_fixed(lines: DataFrame, second: DataFrame) -> DataFrame:
    """Lines of a second source that no line of the first is near: token-sorted ratio of 85, in place of the
    weighted one. Lines that agree in key are found by a join first, and only lengths that allow the ratio are compared."""
    base = lines.select("video_id", sorted_tokens(F.lower("text")).alias("b"), line_key("text").alias("key"))
    more = second.select("video_id", "line_no", "text", sorted_tokens(F.lower("text")).alias("a"), line_key("text").alias("key"))
    fresh = more.join(base.select("video_id", "key"), ["video_id", "key"], "left_anti")
    able = fresh.join(base.drop("key"), "video_id").where("200 * least(length(a), length(b)) >= 85 * (length(a) + length(b))")
    near = able.withColumn("s", ratio(F.col("a"), F.col("b"))).where("s >= 85").select("video_id", "line_no").distinct()
    return fresh.join(near, ["video_id", "line_no"], "left_anti").select("video_id", "line_no", "text")


@query("d49_title_hints", "videos titles", f"WITH t AS (SELECT *, {duck('alnum_key', 'primary_title')} AS tkey FROM titles), v AS (SELECT *, {duck('alnum_key', 'film_title')} AS vkey FROM videos), p AS (SELECT v.video_id, t.tconst, t.primary_title, v.vkey, t.tkey FROM v JOIN t ON t.tconst = v.true_tconst WHERE abs(length(vkey) - length(tkey)) <= 4), s AS (SELECT *, CASE WHEN vkey = tkey THEN 100.0 ELSE {duck_ratio('vkey', 'tkey')} END AS score FROM p) SELECT video_id, tconst, primary_title AS title, round(score, 6) AS score FROM s WHERE score >= 92")
def title_hints(videos: DataFrame, titles: DataFrame) -> DataFrame:
    """A title takes its hint's spelling if their keys agree, or differ by four characters at most with a ratio of 92."""
    pairs = videos.join(titles, videos["true_tconst"] == titles["tconst"]).select("video_id", "tconst", "primary_title", alnum_key("film_title").alias("a"), alnum_key("primary_title").alias("b"))
    near = pairs.where("abs(length(a) - length(b)) <= 4").withColumn("score", F.when(F.col("a") == F.col("b"), 100.0).otherwise(ratio(F.col("a"), F.col("b")))).where("score >= 92")
    return near.select("video_id", "tconst", F.col("primary_title").alias("title"), F.round("score", 6).alias("score"))


@query("d49_title_hints_blocks", "videos titles")
def title_hints_blocks(videos: DataFrame, titles: DataFrame) -> DataFrame:
    """D49 with the ratio of common blocks in place of S1: texts whose letters agree only in scattered places fall below 92.
    S1 bounds it, so pairs that S1 can't bring to 92 are left out first."""
    pairs = videos.join(titles, videos["true_tconst"] == titles["tconst"]).select("video_id", "tconst", "primary_title", alnum_key("film_title").alias("a"), alnum_key("primary_title").alias("b"))
    able = pairs.where("abs(length(a) - length(b)) <= 4").where(can_reach(F.col("a"), F.col("b"), 92.0))
    near = able.withColumn("score", F.when(F.col("a") == F.col("b"), 100.0).otherwise(block_ratio(F.col("a"), F.col("b")))).where("score >= 92")
    return near.select("video_id", "tconst", F.col("primary_title").alias("title"), F.round("score", 6).alias("score"))


@query("s3_weighted_ratio", "names")
def weighted_ratio(names: DataFrame) -> DataFrame:
    """S3: the weighted ratio of each name with its misread form."""
    return names.select("nconst", F.round(wratio(F.col("primary_name"), F.col("ocr_name")), 6).alias("s3"))


@query("s6_containment", "videos titles", f"WITH k AS (SELECT v.video_id, {duck('alnum_key', 'v.film_title')} AS a, {duck('alnum_key', 't.original_title')} AS b FROM videos v JOIN titles t ON t.tconst = v.true_tconst) SELECT video_id, CASE WHEN a = b THEN 100.0 WHEN a <> '' AND b <> '' AND (strpos(a, b) > 0 OR strpos(b, a) > 0) THEN 80.0 ELSE 0.0 END::double AS s6 FROM k")
def title_containment(videos: DataFrame, titles: DataFrame) -> DataFrame:
    """Containment of a video's title and its original title."""
    rows = videos.join(titles, videos["true_tconst"] == titles["tconst"]).select("video_id", alnum_key("film_title").alias("a"), alnum_key("original_title").alias("b"))
    return rows.select("video_id", containment(F.col("a"), F.col("b")).alias("s6"))


@query("g2_null_last_sort", "credits", "SELECT video_id, line_no, row_number() OVER (PARTITION BY video_id ORDER BY nullif(raw, '') DESC NULLS LAST, name, line_no) AS position FROM credits")
def null_last_sort(credits: DataFrame) -> DataFrame:
    """Credits by source, those without one last."""
    order = Window.partitionBy("video_id").orderBy(F.nullif("raw", F.lit("")).desc_nulls_last(), "name", "line_no")
    return credits.select("video_id", "line_no", F.row_number().over(order).alias("position"))


@query("g3_opening_first", "lines", f"WITH g AS (SELECT video_id, {duck('line_key', 'text')} AS key, count(*) AS n, min(first_seen) AS first_seen FROM lines GROUP BY ALL) SELECT video_id, key, row_number() OVER (PARTITION BY video_id ORDER BY first_seen <= 45 DESC, n DESC, key) AS position FROM g")
def opening_first(lines: DataFrame) -> DataFrame:
    """Keys of the opening first, then the most seen."""
    rows = lines.groupBy("video_id", line_key("text").alias("key")).agg(F.count("*").alias("n"), F.min("first_seen").alias("first_seen"))
    order = Window.partitionBy("video_id").orderBy((F.col("first_seen") <= 45).desc(), F.col("n").desc(), "key")
    return rows.select("video_id", "key", F.row_number().over(order).alias("position"))
