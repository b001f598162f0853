"""Names and titles resolved against tables: exact, by key, by table of corrections, and fuzzily."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.keys import alnum_key, duck, hit_key, name_key, word_key
from reelmill.functions.similarity import best_jaccard, bits_reach, can_reach, duck_ratio, duck_sorted_tokens, fuzzy_join, jaccard, letter_bits, positional, ratio, sorted_tokens, token_sort_ratio
from reelmill.plans.registry import query
from reelmill.sources.scratch import scratch_path

#: Readings by name key and the names that they stand for.
CORRECTIONS = {
    "DERYAYARUC": "Derya Yaruç", "SENOLSENTURK": "Şenol Şentürk", "RUHISARI": "Ruhi Sarı", "OYAYUCE": "Oya Yüce", "AYCA": "Ayça", "GUNEY": "Güney", "GULDEN": "Gülden", "UGUR": "Uğur",
    "IPEK": "İpek", "CETIN": "Çetin", "SENOL": "Şenol", "SENTURK": "Şentürk", "YUCE": "Yüce", "RIZA": "Rıza", "SARI": "Sarı", "DEMIR": "Demir", "ONER": "Öner", "NITA": "Nisa",
    "SERELI": "Serezli", "NITASERELI": "Nisa Serezli", "NISASEREZLI": "Nisa Serezli",
}
_KEYS = duck("name_key", "name")


@query("d1_canonical_names", "persons", f"SELECT {_KEYS} AS key, arg_min(name, (video_id, line_no)) AS canonical FROM persons GROUP BY ALL")
def canonical_names(persons: DataFrame) -> DataFrame:
    """The first name of each name key."""
    return persons.groupBy(name_key("name").alias("key")).agg(F.min_by("name", F.struct("video_id", "line_no")).alias("canonical"))


@query("d2_name_membership", "readings name_list", f"SELECT video_id, line_no, name FROM readings WHERE strpos(trim(name), ' ') > 0 AND {_KEYS} IN (SELECT {duck('name_key', 'primary_name')} FROM name_list)")
def name_membership(persons: DataFrame, names: DataFrame) -> DataFrame:
    """Persons of two words or more whose key is in a name table."""
    known = names.select(name_key("primary_name").alias("key"))
    return persons.where(F.trim("name").contains(" ")).withColumn("key", name_key("name")).join(known, "key", "left_semi").select("video_id", "line_no", "name")


def corrections(spark) -> DataFrame:
    return spark.createDataFrame(list(CORRECTIONS.items()), "key string, corrected string")


def find_names(texts: DataFrame, table: DataFrame, threshold: float = 75.0) -> DataFrame:
    """texts (text), distinct; table (nconst, primary_name) -> (text, canonical, score, method).

    The correction table comes first, then the exact key (two words or more), then the best token-sorted ratio; only
    texts that no earlier layer found go to the fuzzy join. Rows without a match have method ''.
    """
    keyed = texts.select("text", name_key("text").alias("key"), F.trim("text").contains(" ").alias("whole"))
    known = table.groupBy(name_key("primary_name").alias("key")).agg(F.min_by("primary_name", "nconst").alias("exact"))
    found = keyed.join(F.broadcast(corrections(texts.sparkSession)), "key", "left").join(known.hint("merge"), "key", "left")  # the corrections are a fixed table
    exact = F.when(F.col("whole"), F.col("exact"))
    layered = found.select("text", "whole", F.coalesce("corrected", exact).alias("canonical"), F.when(F.col("corrected").isNotNull(), "hardcoded").when(exact.isNotNull(), "exact_db").otherwise("").alias("method"))
    spark, path = texts.sparkSession, scratch_path(texts.sparkSession, "layered")
    layered.write.parquet(path)  # read twice
    layered = spark.read.parquet(path)
    rest = layered.where("canonical IS NULL AND whole").select(F.col("text").alias("l_id"), sorted_tokens(F.col("text")).alias("l_text"))
    near = fuzzy_join(rest, table.select(F.col("nconst").alias("r_id"), sorted_tokens(F.col("primary_name")).alias("r_text")), threshold)
    near = near.join(table.select(F.col("nconst").alias("r_id"), "primary_name").hint("merge"), "r_id").select(F.col("l_id").alias("text"), "primary_name", "score")
    both = layered.join(near.hint("merge"), "text", "left")
    score = F.when(F.col("canonical").isNotNull(), 1.0).when(F.col("score").isNotNull(), F.round(F.col("score") / 100, 3)).otherwise(0.0)
    return both.select("text", F.coalesce("canonical", "primary_name").alias("canonical"), score.alias("score"), F.when(F.col("canonical").isNull() & F.col("primary_name").isNotNull(), "fuzzy").otherwise(F.col("method")).alias("method"))


@query("d3_layered_find", "names", often="names")
def layered_find(names: DataFrame) -> DataFrame:
    """D3: misread names looked up in the table of all names."""
    return find_names(names.select(F.col("ocr_name").alias("text")).distinct(), names)


@query("d4_top2_candidates", "names", often="names")
def top2_candidates(names: DataFrame) -> DataFrame:
    """The two nearest names of each misread name, from a ratio of 75 on."""
    texts = names.select(F.col("nconst").alias("l_id"), sorted_tokens(F.col("ocr_name")).alias("l_text"))
    table = names.select(F.col("nconst").alias("r_id"), sorted_tokens(F.col("primary_name")).alias("r_text"))
    return fuzzy_join(texts, table, 75.0, 2).select(F.col("l_id").alias("nconst"), F.col("r_id").alias("candidate"), "score")


@query("d5_line_correction", "readings names", often="names")
def line_correction(persons: DataFrame, names: DataFrame) -> DataFrame:
    """Names replaced by their canonical form where the score is .85 or more, with the original kept."""
    found = find_names(persons.select(F.col("name").alias("text")).distinct(), names, 85.0).where("score >= 0.85").select(F.col("text").alias("name"), "canonical")
    both = persons.join(found.hint("merge"), "name", "left")
    return both.select("video_id", "line_no", F.coalesce("canonical", "name").alias("text"), F.col("name").alias("text_original"), (F.coalesce("canonical", "name") != F.col("name")).alias("repaired"))


_SPLITS = {k: v for k, v in CORRECTIONS.items() if " " in v}
_SPLIT_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in _SPLITS.items())


@query(
    "d6_joined_split", "persons",
    f"""WITH t(key, fixed) AS (VALUES {_SPLIT_VALUES}), p AS (SELECT video_id, line_no, CASE line_no % 5 WHEN 0 THEN 'OYAYUCE' WHEN 1 THEN 'Ruhisarı' ELSE replace(name, ' ', '') END AS word FROM persons)
    SELECT video_id, line_no, word, coalesce(string_split(fixed, ' '), [word]) AS parts FROM (SELECT *, {duck('name_key', 'word')} AS key FROM p) LEFT JOIN t USING (key)""",
)
def joined_split(persons: DataFrame) -> DataFrame:
    """Words written together, split by the correction table (two of five rows are readings that it knows)."""
    word = F.when(F.col("line_no") % 5 == 0, "OYAYUCE").when(F.col("line_no") % 5 == 1, "Ruhisarı").otherwise(F.replace("name", F.lit(" "), F.lit("")))
    keyed = persons.select("video_id", "line_no", word.alias("word")).withColumn("key", name_key("word"))
    table = persons.sparkSession.createDataFrame(list(_SPLITS.items()), "key string, fixed string")
    return keyed.join(F.broadcast(table), "key", "left").select("video_id", "line_no", "word", F.coalesce(F.split("fixed", " "), F.array("word")).alias("parts"))  # a fixed table


@query(
    "d7_prefix_split", "readings name_list",
    """WITH f AS (SELECT DISTINCT lower(string_split(primary_name, ' ')[1]) AS first FROM name_list), w AS (SELECT DISTINCT lower(replace(name, ' ', '')) AS word FROM readings WHERE length(name) BETWEEN 6 AND 31),
    x AS (SELECT word, i FROM (SELECT word, unnest(range(2, length(word) - 2)) AS i FROM w) JOIN f ON first = substr(word, 1, i)), b AS (SELECT word, max(i) AS i FROM x GROUP BY word),
    r AS (SELECT word, i, substr(word, i + 1) AS rest FROM b), y AS (SELECT word, j FROM (SELECT word, rest, unnest(range(2, length(rest) - 2)) AS j FROM r) JOIN f ON first = substr(rest, 1, j)), c AS (SELECT word, min(j) AS j FROM y GROUP BY word)
    SELECT w.word, CASE WHEN r.i IS NULL THEN w.word WHEN c.j IS NULL THEN substr(w.word, 1, r.i) || ' ' || r.rest ELSE substr(w.word, 1, r.i) || ' ' || substr(r.rest, 1, c.j) || ' ' || substr(r.rest, c.j + 1) END AS split
    FROM w LEFT JOIN r USING (word) LEFT JOIN c USING (word)""",
)
def prefix_split(persons: DataFrame, names: DataFrame) -> DataFrame:
    """Names written together, split behind the longest known first name that leaves three letters, and the rest of them once
    more behind the shortest one."""
    first = names.select(F.lower(F.split("primary_name", " ")[0]).alias("prefix")).distinct()
    words = persons.where("length(name) BETWEEN 6 AND 31").select(F.lower(F.replace("name", F.lit(" "), F.lit(""))).alias("word")).distinct()

    def cuts(rows: DataFrame, text: str, best) -> DataFrame:
        able = rows.where(F.length(text) >= 5).select("word", text, F.explode(F.sequence(F.lit(2), F.length(text) - 3)).alias("i")).withColumn("prefix", F.substring(text, F.lit(1), F.col("i")))
        return able.join(first, "prefix", "left_semi").groupBy("word").agg(best("i").alias("i"))

    behind = lambda text, i: F.substring(text, F.col(i) + 1, F.length(text))
    once = words.join(cuts(words, "word", F.max), "word", "left").withColumn("rest", behind("word", "i"))
    twice = once.join(cuts(once.where("rest IS NOT NULL").select("word", "rest"), "rest", F.min).withColumnRenamed("i", "j"), "word", "left")
    head = lambda text, i: F.substring(text, F.lit(1), F.col(i))
    parts = F.array_compact(F.array(head("word", "i"), F.coalesce(head("rest", "j"), "rest"), behind("rest", "j")))
    return twice.select("word", F.when(F.col("i").isNull(), F.col("word")).otherwise(F.array_join(parts, " ")).alias("split"))


_FOLD = "lower(trim({0}))"


@query(
    "d11_title_candidates", "videos titles",
    f"""WITH t AS (SELECT tconst, primary_title AS title FROM titles UNION SELECT tconst, original_title FROM titles), v AS (SELECT *, string_split(lower(film_title), ' ')[1] AS first FROM videos),
    c AS (SELECT DISTINCT v.video_id, v.film_title, t.tconst, t.title FROM v JOIN (SELECT *, unnest(list_distinct(string_split(lower(title), ' '))) AS token FROM t) t ON t.token = v.first),
    s AS (SELECT *, {duck_sorted_tokens('lower(film_title)')} AS a, {duck_sorted_tokens('lower(title)')} AS b FROM c),
    r AS (SELECT video_id, tconst, title, {duck_ratio('a', 'b')} AS score FROM s WHERE 200 * least(length(a), length(b)) >= 80 * (length(a) + length(b)))
    SELECT video_id, tconst, title, round(score, 6) AS score FROM r WHERE score >= 80""",
)
def title_candidates(videos: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles, primary or alternative, that hold the first word of a video's title and are near it (token-sorted ratio of 80)."""
    all_titles = titles.select("tconst", F.col("primary_title").alias("title")).unionByName(titles.select("tconst", F.col("original_title").alias("title"))).distinct()
    read = videos.select("video_id", "film_title").distinct()
    # many titles share a text, so texts are compared once and rows meet by text afterwards
    tokens = all_titles.select("title").distinct().select("title", F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("token"))
    wanted = read.select("film_title").distinct().select("film_title", F.split(F.lower("film_title"), " ")[0].alias("token"))
    pairs = wanted.join(tokens, "token").select("film_title", "title", sorted_tokens(F.lower("film_title")).alias("a"), sorted_tokens(F.lower("title")).alias("b"))
    able = pairs.where("200 * least(length(a), length(b)) >= 80 * (length(a) + length(b))").where(can_reach(F.col("a"), F.col("b"), 80.0))
    near = able.withColumn("score", F.round(ratio(F.col("a"), F.col("b")), 6)).where("score >= 80").select("film_title", "title", "score")
    # few rows make the many of the result, so they get a number of tasks of their own
    tasks = 16 * videos.sparkSession.sparkContext.defaultParallelism
    return near.join(read, "film_title").repartition(tasks, "title").join(all_titles.repartition(tasks, "title"), "title").select("video_id", "tconst", "title", "score")


@query(
    "d12_title_variants", "videos",
    r"""WITH t AS (SELECT video_id, film_title, film_title = upper(film_title) AND regexp_matches(film_title, '[A-Za-z]') AS caps, array_to_string(list_transform(string_split(lower(film_title), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cased FROM videos),
    v AS (SELECT video_id, list_distinct([film_title, CASE WHEN caps THEN cased ELSE film_title END, regexp_replace(CASE WHEN caps THEN cased ELSE film_title END, '\b[Mm]adam\b', 'Madame', 'g')]) AS variants FROM t)
    SELECT DISTINCT video_id, unnest(variants) AS variant FROM v""",
)
def title_variants(videos: DataFrame) -> DataFrame:
    """A title as it is, in title case if it is all capitals, and with Madam as Madame."""
    title = F.col("film_title")
    caps = (title == F.upper(title)) & title.rlike("[A-Za-z]")
    cased = F.when(caps, F.initcap(F.lower(title))).otherwise(title)
    return videos.select("video_id", F.explode(F.array_distinct(F.array(title, cased, F.regexp_replace(cased, r"\b[Mm]adam\b", "Madame")))).alias("variant"))


@query("d13_cast_fetch", "principals names", "SELECT p.tconst, p.nconst, n.primary_name AS name, p.category, row_number() OVER (PARTITION BY p.tconst ORDER BY p.ordering, p.nconst, p.category) AS position FROM principals p JOIN names n USING (nconst) WHERE p.category IN ('actor', 'actress')")
def cast_fetch(principals: DataFrame, names: DataFrame) -> DataFrame:
    """Names of a title's cast, in order."""
    cast = principals.where("category IN ('actor', 'actress')").join(names, "nconst")
    order = Window.partitionBy("tconst").orderBy("ordering", "nconst", "category")
    return cast.select("tconst", "nconst", F.col("primary_name").alias("name"), "category", F.row_number().over(order).alias("position"))


@query("d14_director_names", "director_lists names", "SELECT tconst, i AS position, n.primary_name AS name FROM (SELECT tconst, unnest(string_split(directors, ',')) AS id, generate_subscripts(string_split(directors, ','), 1) AS i FROM director_lists) d JOIN names n ON n.nconst = cast(d.id AS bigint)")
def director_names(lists: DataFrame, names: DataFrame) -> DataFrame:
    """Comma lists of ids as names, with their place in the list."""
    ids = lists.select("tconst", F.posexplode(F.split("directors", ",")).alias("pos", "id"))
    return ids.join(names, F.col("id").cast("long") == names["nconst"]).select("tconst", (F.col("pos") + 1).cast("long").alias("position"), F.col("primary_name").alias("name"))


def cast_matches(videos: DataFrame, persons: DataFrame, people: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(video_id, tconst, name, best, score): each name read in a video with its best person of the video's title."""
    # tokens and letters once a name, not once a pair, and only people of the videos' titles; written, so that no filter computes them anew
    wanted = videos.select("video_id", F.col("true_tconst").alias("tconst"))
    keyed = lambda rows, name, key: rows.withColumn(key, sorted_tokens(F.lower(name))).withColumn(f"{key}_bits", letter_bits(F.col(key)))
    spark, path = videos.sparkSession, scratch_path(videos.sparkSession, "cast")
    keyed(wanted.join(persons.select("video_id", "name").distinct(), "video_id"), "name", "a").write.parquet(f"{path}/read")
    held = people.select("tconst", F.col("name").alias("choice"), "category").join(wanted.select("tconst").distinct(), "tconst", "left_semi").distinct()
    keyed(held, "choice", "b").write.parquet(f"{path}/held")
    pairs = spark.read.parquet(f"{path}/read").join(spark.read.parquet(f"{path}/held"), "tconst")
    able = pairs.where(f"200 * least(length(a), length(b)) >= {threshold} * (length(a) + length(b))").where(bits_reach(*map(F.col, ("a", "b", "a_bits", "b_bits")), threshold)).where(can_reach(F.col("a"), F.col("b"), threshold))
    return able.select("video_id", "tconst", "name", "choice", "category", ratio(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= threshold)


_MATCHES = f"""WITH p AS (SELECT DISTINCT v.video_id, v.true_tconst AS tconst, p.name, t.name AS choice, t.category, v.is_series, v.year FROM videos v JOIN persons p USING (video_id) JOIN title_people t ON t.tconst = v.true_tconst),
  k AS MATERIALIZED (SELECT DISTINCT name, choice, {duck_sorted_tokens('lower(name)')} AS a, {duck_sorted_tokens('lower(choice)')} AS b FROM p),
  z AS MATERIALIZED (SELECT * FROM (SELECT name, choice, {duck_ratio('a', 'b')} AS score FROM k WHERE 5 * levenshtein(a, b) <= length(a) + length(b)) WHERE score >= 80),
  m AS (SELECT p.*, z.score FROM p JOIN z ON z.name = p.name AND z.choice = p.choice)"""
_PEOPLE = "videos persons title_people"


@query("d15_cast_match_count", _PEOPLE, f"{_MATCHES} SELECT video_id, tconst, count(DISTINCT name) AS matches FROM m WHERE category IN ('actor', 'actress') GROUP BY ALL")
def cast_match_count(videos: DataFrame, persons: DataFrame, people: DataFrame) -> DataFrame:
    """Names read in a video that are near a cast member of its title."""
    found = cast_matches(videos, persons, people).where("category IN ('actor', 'actress')")
    return found.groupBy("video_id", "tconst").agg(F.count_distinct("name").alias("matches"))


def evidence(videos: DataFrame, persons: DataFrame, people: DataFrame) -> DataFrame:
    """videos with counts of near names by class."""
    found = cast_matches(videos, persons, people)
    kind = lambda *c: F.count_distinct(F.when(F.col("category").isin(*c), F.col("name")))
    counted = found.groupBy("video_id").agg(kind("actor", "actress").alias("cast"), kind("director").alias("directors"), kind("cinematographer").alias("camera"))
    return videos.join(counted, "video_id", "left").na.fill(0, ["cast", "directors", "camera"])


_EVIDENCE = f"""{_MATCHES}, n AS (SELECT video_id, count(DISTINCT name) FILTER (WHERE category IN ('actor', 'actress')) AS cast_n, count(DISTINCT name) FILTER (WHERE category = 'director') AS dir_n,
  count(DISTINCT name) FILTER (WHERE category = 'cinematographer') AS cam_n FROM m GROUP BY video_id),
  e AS (SELECT v.video_id, v.true_tconst AS tconst, v.is_series, v.year, t.start_year, coalesce(cast_n, 0) AS cast_n, coalesce(dir_n, 0) AS dir_n, coalesce(cam_n, 0) AS cam_n
        FROM videos v LEFT JOIN n USING (video_id) JOIN titles t ON t.tconst = v.true_tconst)"""
_A = "(cast_n >= 2 OR (cast_n >= 1 AND dir_n >= 1))"
_B = "(dir_n >= 1 AND (is_series OR abs(year - start_year) <= 1 OR cast_n >= 1 OR cam_n >= 1))"


def _a():
    return (F.col("cast") >= 2) | ((F.col("cast") >= 1) & (F.col("directors") >= 1))


def _b():
    return (F.col("directors") >= 1) & (F.col("is_series") | (F.abs(F.col("year") - F.col("start_year")) <= 1) | (F.col("cast") >= 1) | (F.col("camera") >= 1))


def _with_titles(videos, persons, people, titles):
    return evidence(videos, persons, people).join(titles.select(F.col("tconst").alias("true_tconst"), "start_year"), "true_tconst").withColumnRenamed("true_tconst", "tconst")


@query("d16_strategy_a", f"{_PEOPLE} titles", f"{_EVIDENCE} SELECT video_id, tconst, cast_n AS matches FROM e WHERE {_A}")
def strategy_a(videos: DataFrame, persons: DataFrame, people: DataFrame, titles: DataFrame) -> DataFrame:
    """Two cast matches, or one and a director."""
    return _with_titles(videos, persons, people, titles).where(_a()).select("video_id", "tconst", F.col("cast").alias("matches"))


@query("d17_strategy_b", f"{_PEOPLE} titles", f"{_EVIDENCE} SELECT video_id, tconst, dir_n AS directors FROM e WHERE {_B}")
def strategy_b(videos: DataFrame, persons: DataFrame, people: DataFrame, titles: DataFrame) -> DataFrame:
    """A director is enough for a series; a film also needs the year, a cast match or the cinematographer."""
    return _with_titles(videos, persons, people, titles).where(_b()).select("video_id", "tconst", "directors")


@query(
    "d21_catalogue_result", "principals names director_lists",
    """WITH p AS (SELECT DISTINCT p.tconst, n.primary_name AS name, CASE WHEN p.category IN ('actor', 'actress', 'self') THEN 'cast' ELSE 'crew' END AS part FROM principals p JOIN names n USING (nconst)),
    d AS (SELECT tconst, n.primary_name AS name FROM (SELECT tconst, unnest(string_split(directors, ',')) AS id FROM director_lists) JOIN names n ON n.nconst = cast(id AS bigint))
    SELECT tconst, name, part FROM p UNION ALL SELECT d.tconst, d.name, 'director' FROM d WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.tconst = d.tconst AND p.name = d.name AND p.part = 'crew')""",
    often="names",
)
def catalogue_result(principals: DataFrame, names: DataFrame, lists: DataFrame) -> DataFrame:
    """Cast and crew of each title, with directors of the list that the crew lacks."""
    part = F.when(F.col("category").isin("actor", "actress", "self"), "cast").otherwise("crew")
    people = principals.join(names, "nconst").select("tconst", F.col("primary_name").alias("name"), part.alias("part")).distinct()
    directors = director_names(lists, names).select("tconst", "name")
    extra = directors.join(people.where("part = 'crew'"), ["tconst", "name"], "left_anti").withColumn("part", F.lit("director"))
    return people.unionByName(extra)


_QA = f"""WITH l AS (SELECT video_id, line_no, text, first_seen, confidence, {duck('line_key', 'text')} AS lk FROM lines), g AS (SELECT video_id, lk, arg_max(text, (confidence, -line_no)) AS text, max(confidence) AS confidence, count(*) AS seen, min(first_seen) AS first_seen FROM l WHERE lk <> '' GROUP BY ALL),
  o AS (SELECT * FROM (SELECT *, {duck('word_key', 'text')} AS key FROM g) WHERE length(key) - length(replace(key, ' ', '')) BETWEEN 1 AND 3 AND confidence >= 0.88 AND (seen >= 3 OR first_seen <= 45)),
  c AS (SELECT v.video_id, {duck('word_key', 't.name')} AS ckey, t.name AS closest FROM videos v JOIN title_people t ON t.tconst = v.true_tconst),
  j AS (SELECT o.video_id, o.text, o.confidence, o.seen, o.first_seen, coalesce(len(list_intersect(string_split(o.key, ' '), string_split(c.ckey, ' '))) / nullif(len(list_distinct(list_concat(string_split(o.key, ' '), string_split(c.ckey, ' ')))), 0)::double, 0.0) AS s, c.closest
        FROM o LEFT JOIN c USING (video_id)),
  q AS (SELECT video_id, text, confidence, seen, first_seen, max(s) AS similarity FROM j GROUP BY ALL)"""


@query("d38_missing_actor_qa", "lines videos title_people", f"{_QA} SELECT video_id, text AS name, confidence, seen AS seen_frames, first_seen <= 45 AS opening_credit, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY video_id ORDER BY first_seen <= 45 DESC, seen DESC, text) AS position FROM q WHERE similarity < 0.75")
def missing_actors(lines: DataFrame, videos: DataFrame, people: DataFrame) -> DataFrame:
    """Clear names of two to four words, seen often or in the opening, that no person of the title is near (token Jaccard below .75)."""
    from reelmill.functions.keys import line_key

    # what is cheap to test goes first, and the table is read twice; a text without word characters has no key of two words
    grouped = lines.groupBy("video_id", line_key("text").alias("lk")).agg(F.max_by("text", F.struct("confidence", -F.col("line_no"))).alias("text"), F.max("confidence").alias("confidence"), F.count("*").alias("seen"), F.min("first_seen").alias("first_seen"))
    spark, path = lines.sparkSession, scratch_path(lines.sparkSession, "clear")
    grouped.where("confidence >= 0.88 AND (seen >= 3 OR first_seen <= 45)").drop("lk").withColumn("key", word_key("text")).write.parquet(path)
    keyed = spark.read.parquet(path).where("length(key) - length(replace(key, ' ', '')) BETWEEN 1 AND 3")
    titled = keyed.join(videos.select("video_id", F.col("true_tconst").alias("tconst")), "video_id", "left")
    cast = people.join(titled.select("tconst").distinct(), "tconst", "left_semi").select("tconst", word_key("name").alias("ckey"))
    best = best_jaccard(titled, cast, ["video_id", "text", "confidence", "seen", "first_seen"], "tconst", 4, longer=False).where("similarity < 0.75")
    opening = F.col("first_seen") <= 45
    order = Window.partitionBy("video_id").orderBy(opening.desc(), F.col("seen").desc(), "text")
    return best.select("video_id", F.col("text").alias("name"), "confidence", F.col("seen").alias("seen_frames"), opening.alias("opening_credit"), F.round("similarity", 6).alias("similarity"), F.row_number().over(order).alias("position"))


@query("d43_merge_exact", "lines lines2", f"""WITH a AS (SELECT video_id, {duck('hit_key', 'text')} AS key, arg_min(text, line_no) AS text, min(first_seen) AS first_seen FROM lines GROUP BY ALL HAVING key <> ''),
    b AS (SELECT video_id, {duck('hit_key', 'text')} AS key, arg_min(text, line_no) AS text, min(first_seen) AS first_seen FROM lines2 GROUP BY ALL HAVING key <> '')
    SELECT coalesce(a.video_id, b.video_id) AS video_id, coalesce(a.text, b.text) AS text, coalesce(a.first_seen, b.first_seen) AS first_seen, CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN 'both' WHEN a.key IS NOT NULL THEN 'first' ELSE 'second' END AS source
    FROM a FULL JOIN b ON a.video_id = b.video_id AND a.key = b.key""")  # fmt: skip
def merge_exact(lines: DataFrame, second: DataFrame) -> DataFrame:
    """Two sources merged by key; the first one's text stays, and each row tells which sources have it."""
    one, two = (d.withColumn("key", hit_key("text")).where("key <> ''").groupBy("video_id", "key").agg(F.min_by("text", "line_no").alias(f"text{i}"), F.min("first_seen").alias(f"seen{i}")) for i, d in enumerate((lines, second)))
    both = one.join(two, ["video_id", "key"], "full")
    source = F.when(F.col("text0").isNotNull() & F.col("text1").isNotNull(), "both").when(F.col("text0").isNotNull(), "first").otherwise("second")
    return both.select("video_id", F.coalesce("text0", "text1").alias("text"), F.coalesce("seen0", "seen1").alias("first_seen"), source.alias("source"))


_PAIR = "SELECT nconst, lower(primary_name) AS a, lower(ocr_name) AS b FROM names"


@query("s1_ratio", "names", f"SELECT nconst, round({duck_ratio('a', 'b')}, 6) AS s1 FROM ({_PAIR})")
def name_ratio(names: DataFrame) -> DataFrame:
    """Ratio of each name with its misread form."""
    return names.select("nconst", F.round(ratio(F.lower("primary_name"), F.lower("ocr_name")), 6).alias("s1"))


@query("s2_token_sort_ratio", "names", f"SELECT nconst, round({duck_ratio('a', 'b')}, 6) AS s2 FROM (SELECT nconst, {duck_sorted_tokens('a')} AS a, {duck_sorted_tokens('b')} AS b FROM ({_PAIR}))")
def name_token_sort(names: DataFrame) -> DataFrame:
    """Ratio of sorted tokens."""
    return names.select("nconst", F.round(token_sort_ratio(F.lower("primary_name"), F.lower("ocr_name")), 6).alias("s2"))


@query("s4_token_jaccard", "names", f"SELECT nconst, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))::double, 6) AS s4 FROM ({_PAIR})")
def name_jaccard(names: DataFrame) -> DataFrame:
    """Shared tokens over all tokens."""
    return names.select("nconst", F.round(jaccard(F.lower("primary_name"), F.lower("ocr_name")), 6).alias("s4"))


@query(
    "s5_positional_share", "names",
    "SELECT nconst, round(CASE WHEN a = b THEN 100.0 ELSE len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i] = b[i])) * 100.0::double / greatest(length(a), length(b)) END, 6) AS s5 FROM (SELECT nconst, lower(primary_name) AS a, lower(ocr_name) AS b FROM names)",
)
def positional_share(names: DataFrame) -> DataFrame:
    """Share of equal positions."""
    return names.select("nconst", F.round(positional(F.lower("primary_name"), F.lower("ocr_name")), 6).alias("s5"))


@query("g5_distinct_titles", "titles", "SELECT tconst, primary_title AS title FROM titles UNION SELECT tconst, original_title FROM titles")
def distinct_titles(titles: DataFrame) -> DataFrame:
    """Titles of both columns, once each."""
    return titles.select("tconst", F.col("primary_title").alias("title")).unionByName(titles.select("tconst", F.col("original_title").alias("title"))).dropDuplicates()


@query("g8_concat_sources", "lines lines2", "SELECT video_id, line_no, text, 'first' AS source FROM lines UNION ALL SELECT video_id, line_no, text, 'second' FROM lines2")
def concat_sources(lines: DataFrame, second: DataFrame) -> DataFrame:
    """Both sources, one after the other."""
    part = lambda d, s: d.select("video_id", "line_no", "text", F.lit(s).alias("source"))
    return part(lines, "first").unionByName(part(second, "second"))


