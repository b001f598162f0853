"""Rules on person names: structure, blacklists, candidates for matching, junk, and scores of spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.keys import alnum_key, ascii_key, duck, safe_lower
from reelmill.plans.registry import query

#: Terms that are no person's name.
NOT_NAMES = (
    "assistant director", "best boy electric", "best boy grip", "camera operator", "certificate", "color by", "director of photography", "film editor", "first assistant director",
    "gaffer", "key grip", "location manager", "makeup", "post production", "production designer", "production manager", "property master", "script supervisor", "second unit",
    "stunt coordinator", "wardrobe", "technicolor", "panavision", "kodak", "dolby", "the end", "the", "end", "presents", "featuring", "introducing", "with", "and", "copyright", "fin",
    "cadreur", "son", "scripte", "regie", "mixage", "maquillage", "laboratoire", "avec", "coproduction", "hotel", "france", "paris", "london", "canada", "ministere", "ecole", "edition",
)
NOT_NAME_PARTS = ("copyright", "all rights reserved", "technicolor", "eastman color", "color consultant", "certificate", "recording system", "filmed at", "filmed in", "panavision", "in hollywood", "bolum", "ministere", "les eleves", "une coproduction", "les films")
NOT_NAME_PATTERNS = (r"^[^\p{L}\p{N}_]+$", r"^[0-9][0-9\s.:,\-]*$", r"^.{0,2}$", r"(?i)copyright\s+\w", r"(?i)^no\.\s*[0-9]+", r"(?i)^[0-9]+\s+(lr|rr|mm)[0-9]+", r"(?i)styles?\s+by", r"(?i)color\s+by", r"(?i)recorded\s+in", r"(?i)filmed\s+(at|in)", r"\b[0-9]{2,}\b")
COMPANY_WORDS = (
    "productions", "production", "sa", "ltd", "inc", "corp", "musicales", "musicale", "musique", "editions", "edition", "records", "music", "films", "film", "pictures", "picture", "entertainment",
    "distribution", "distributeur", "international", "studios", "studio", "canal", "mk2", "channel", "media", "télévision", "television", "tv", "arte", "tve", "rai",
)
ROLE_TITLES = ("assistant", "directeur", "director", "producer", "editor", "operator", "yönetmen", "yonetmen", "senaryo", "kamera", "kurgu", "yapımcı", "yapimci", "producteur", "monteur", "technicien", "superviseur")
KNOWN_TITLES = ("yönetmen", "yapımcı", "senarist", "yazar", "editör", "kurgucu", "görüntü yönetmeni", "müzik", "kostüm", "director", "producer", "writer", "editor", "cinematographer", "music", "composer", "casting", "costume", "makeup")
NOT_PERSONS = ("production", "yapım", "stüdyo", "studio", "film", "tv", "trt", "show tv", "kanal d", "atv", "fox", "star tv", "copyright", "all rights reserved", "tüm hakları saklıdır")
TURKISH = "çğıöşüÇĞİÖŞÜ"
FOREIGN = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{0400}-\x{04FF}\x{0600}-\x{06FF}]"
_JFOREIGN = FOREIGN


def _list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


_SQL_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def is_upper(text: Column) -> Column:
    """Has letters, and none in lower case."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def _sql_upper(text: str) -> str:
    return rf"(regexp_matches({text}, '\p{{Lu}}') AND NOT regexp_matches({text}, '\p{{Ll}}'))"


def structural_reason(name: Column) -> Column:
    """The first rule that a name breaks, or 'ok'."""
    t = F.trim(name)
    n = F.size(words(t))
    letters, latin = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"[\p{L}&&[\x{0000}-\x{03FF}]]"))
    return (
        F.when(F.length(t) < 3, "too_short")
        .when(n > 4, "too_many_words")
        .when(is_upper(t) & (F.length(t) > 15) & ~t.contains(" "), "concatenated_noise")
        .when((letters == 0) | (latin * 2 <= letters), "non_latin")
        .when(t.rlike("^[-—–]"), "dialogue_marker")
        .when(t.rlike("[?!]"), "sentence_punctuation")
        .when(t.contains(","), "sentence_fragment")
        .when(t.contains("/"), "slash_reference")
        .when(t.endswith(".") & (n >= 3), "sentence_ending")
        .when(F.regexp_count(t, F.lit(r"[;…\[\]{}()]")) >= 2, "excessive_punctuation")
        .when((n == 1) & t.endswith(".") & is_upper(t), "technical_abbreviation")
        .otherwise("ok")
    )


def _sql_reason(text: str) -> str:
    t = f"trim({text})"
    n = f"len({_SQL_WORDS.format(t)})"
    letters, latin = rf"len(regexp_extract_all({t}, '\p{{L}}'))", rf"len(list_filter(regexp_extract_all({t}, '\p{{L}}'), lambda c: unicode(c) < 1024))"
    return rf"""CASE WHEN length({t}) < 3 THEN 'too_short' WHEN {n} > 4 THEN 'too_many_words' WHEN {_sql_upper(t)} AND length({t}) > 15 AND strpos({t}, ' ') = 0 THEN 'concatenated_noise'
      WHEN {letters} = 0 OR {latin} * 2 <= {letters} THEN 'non_latin' WHEN regexp_matches({t}, '^[-—–]') THEN 'dialogue_marker' WHEN regexp_matches({t}, '[?!]') THEN 'sentence_punctuation'
      WHEN strpos({t}, ',') > 0 THEN 'sentence_fragment' WHEN strpos({t}, '/') > 0 THEN 'slash_reference' WHEN ends_with({t}, '.') AND {n} >= 3 THEN 'sentence_ending'
      WHEN len(regexp_extract_all({t}, '[;…\[\]{{}}()]')) >= 2 THEN 'excessive_punctuation' WHEN {n} = 1 AND ends_with({t}, '.') AND {_sql_upper(t)} THEN 'technical_abbreviation' ELSE 'ok' END"""


@query("b11_structural_check", "lines", f"SELECT video_id, {_sql_reason('text')} AS reason, count(*) AS n FROM lines GROUP BY ALL")
def structural_check(lines: DataFrame) -> DataFrame:
    """Lines of a video by the first structural rule of names that they break."""
    return lines.groupBy("video_id", structural_reason(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


def blacklist_reason(name: Column) -> Column:
    """'exact', 'contains' or 'pattern' with the term, or null."""
    t, low = F.trim(name), safe_lower(F.trim(name))
    found = F.when(low.isin(*NOT_NAMES), F.concat(F.lit("exact:"), low))
    for part in NOT_NAME_PARTS:
        found = found.when(low.contains(part), f"contains:{part}")
    for i, pattern in enumerate(NOT_NAME_PATTERNS):
        found = found.when(t.rlike(pattern), f"pattern:{i}")
    return found


def _sql_blacklist(text: str) -> str:
    low = duck("safe_lower", f"trim({text})")
    parts = " ".join(f"WHEN strpos({low}, '{p}') > 0 THEN 'contains:{p}'" for p in NOT_NAME_PARTS)
    patterns = " ".join(f"WHEN regexp_matches(trim({text}), '{p}') THEN 'pattern:{i}'" for i, p in enumerate(NOT_NAME_PATTERNS))
    return f"CASE WHEN {low} IN ({_list(NOT_NAMES)}) THEN 'exact:' || {low} {parts} {patterns} END"


@query("b12_name_blacklist", "role_lines", f"SELECT video_id, line_no, text, {_sql_blacklist('text')} AS reason FROM role_lines WHERE {_sql_blacklist('text')} IS NOT NULL")
def name_blacklist(lines: DataFrame) -> DataFrame:
    """Texts that are on the blacklist, with the reason."""
    return lines.select("video_id", "line_no", "text", blacklist_reason(F.col("text")).alias("reason")).where("reason IS NOT NULL")


def is_valid_person(name: Column) -> Column:
    t = F.trim(name)
    long_caps = F.exists(words(t), lambda w: (F.length(w) > 12) & w.rlike(r"^\p{Lu}+$"))
    return ~t.rlike(_JFOREIGN) & blacklist_reason(t).isNull() & (structural_reason(t) == "ok") & (F.size(words(t)) >= 2) & ~long_caps


def _sql_valid(text: str) -> str:
    t = f"trim({text})"
    return rf"""(NOT regexp_matches({t}, '{FOREIGN}') AND {_sql_blacklist(t)} IS NULL AND {_sql_reason(t)} = 'ok' AND len({_SQL_WORDS.format(t)}) >= 2
      AND len(list_filter({_SQL_WORDS.format(t)}, lambda w: length(w) > 12 AND regexp_matches(w, '^\p{{Lu}}+$'))) = 0)"""


@query("b13_valid_person", "lines", f"SELECT video_id, line_no, text FROM lines WHERE {_sql_valid('text')}")
def valid_person(lines: DataFrame) -> DataFrame:
    """Texts that may be a full person's name."""
    return lines.where(is_valid_person(F.col("text"))).select("video_id", "line_no", "text")


def is_non_person(name: Column) -> Column:
    """The export variant."""
    low = safe_lower(F.trim(name))
    return (F.length(name) < 3) | name.rlike(_JFOREIGN) | ~F.trim(name).contains(" ") | low.isin(*KNOWN_TITLES) | low.isin(*NOT_PERSONS)


def _sql_non_person(text: str) -> str:
    low = duck("safe_lower", f"trim({text})")
    return f"(length({text}) < 3 OR regexp_matches({text}, '{FOREIGN}') OR strpos(trim({text}), ' ') = 0 OR {low} IN ({_list(KNOWN_TITLES)}) OR {low} IN ({_list(NOT_PERSONS)}))"


def is_likely_non_person(name: Column) -> Column:
    """The verifier's variant: exact terms, parts, more than four words, or a role title at the start."""
    low = safe_lower(F.trim(name))
    parts = F.lit(False)
    for part in NOT_NAME_PARTS:
        parts = parts | low.contains(part)
    return (F.length(low) < 3) | low.isin(*NOT_NAMES) | parts | (F.size(words(low)) > 4) | low.rlike(f"^({'|'.join(ROLE_TITLES)})([^\\p{{L}}\\p{{N}}_]|$)")


def _sql_likely_non_person(text: str) -> str:
    low = duck("safe_lower", f"trim({text})")
    parts = " OR ".join(f"strpos({low}, '{p}') > 0" for p in NOT_NAME_PARTS)
    return f"(length({low}) < 3 OR {low} IN ({_list(NOT_NAMES)}) OR {parts} OR len({_SQL_WORDS.format(low)}) > 4 OR regexp_matches({low}, '^({'|'.join(ROLE_TITLES)})([^\\p{{L}}\\p{{N}}_]|$)'))"


@query("b14_non_person", "role_lines", f"SELECT video_id, line_no, text, {_sql_non_person('text')} AS by_export, {_sql_likely_non_person('text')} AS by_verifier FROM role_lines")
def non_person(lines: DataFrame) -> DataFrame:
    """Both variants of the non-person test."""
    return lines.select("video_id", "line_no", "text", is_non_person(F.col("text")).alias("by_export"), is_likely_non_person(F.col("text")).alias("by_verifier"))


@query(
    "b15_person_guess", "lines",
    rf"""SELECT video_id, line_no, text, CASE WHEN likely THEN 0.4 ELSE 0.1 END::double AS confidence FROM (SELECT *, CASE WHEN length(text) < 3 THEN false
      WHEN len({_SQL_WORDS.format('text')}) = 1 THEN (length(text) >= 4 AND NOT {_sql_upper('text')}) OR length(text) >= 5 ELSE regexp_matches(text, '^\p{{Lu}}') END AS likely FROM lines)""",
)
def person_guess(lines: DataFrame) -> DataFrame:
    """0.4 if a text looks like a name, else 0.1."""
    t = F.trim("text")
    likely = F.when(F.length(t) < 3, False).when(F.size(words(t)) == 1, ((F.length(t) >= 4) & ~is_upper(t)) | (F.length(t) >= 5)).otherwise(t.rlike(r"^\p{Lu}"))
    return lines.select("video_id", "line_no", "text", F.when(likely, 0.4).otherwise(0.1).alias("confidence"))


def is_company(name: Column) -> Column:
    low = safe_lower(name)
    by_word = F.arrays_overlap(words(F.replace(low, F.lit("-"), F.lit(" "))), F.array(*map(F.lit, COMPANY_WORDS)))
    letters = F.regexp_count(name, F.lit(r"\p{L}"))
    one = ~F.trim(name).contains(" ")
    block = (letters > 0) & (F.regexp_count(name, F.lit(r"\p{Lu}")) * 5 > letters * 4) & (F.length(name) > 10) & one
    joined = one & (F.length(name) > 8) & low.rlike("|".join(w for w in COMPANY_WORDS if len(w) > 4))
    return F.coalesce(by_word, F.lit(False)) | block | joined


def _sql_company(text: str) -> str:
    low = duck("safe_lower", text)
    joined = "|".join(w for w in COMPANY_WORDS if len(w) > 4)
    return rf"""(list_has_any({_SQL_WORDS.format(f"replace({low}, '-', ' ')")}, [{_list(COMPANY_WORDS)}]) OR (len(regexp_extract_all({text}, '\p{{L}}')) > 0
      AND len(regexp_extract_all({text}, '\p{{Lu}}')) * 5 > len(regexp_extract_all({text}, '\p{{L}}')) * 4 AND length({text}) > 10 AND strpos(trim({text}), ' ') = 0)
      OR (strpos(trim({text}), ' ') = 0 AND length({text}) > 8 AND regexp_matches({low}, '{joined}')))"""


@query("b16_company_like", "role_lines", f"SELECT video_id, line_no, text FROM role_lines WHERE {_sql_company('text')}")
def company_like(lines: DataFrame) -> DataFrame:
    """Texts that look like a company's name."""
    return lines.where(is_company(F.col("text"))).select("video_id", "line_no", "text")


def is_match_candidate(name: Column) -> Column:
    t = F.trim(name)
    titled = (F.size(words(t)) >= 2) & ~is_upper(t) & ~F.exists(words(t), lambda w: ~w.rlike(r"^\p{Lu}"))
    return (F.length(t) >= 3) & (~is_company(t) | titled) & ~t.rlike("[0-9]") & is_valid_person(t)


def _sql_candidate(text: str) -> str:
    t = f"trim({text})"
    titled = rf"(len({_SQL_WORDS.format(t)}) >= 2 AND NOT {_sql_upper(t)} AND len(list_filter({_SQL_WORDS.format(t)}, lambda w: NOT regexp_matches(w, '^\p{{Lu}}'))) = 0)"
    return f"(length({t}) >= 3 AND (NOT {_sql_company(t)} OR {titled}) AND NOT regexp_matches({t}, '[0-9]') AND {_sql_valid(t)})"


@query(
    "b17_match_candidates", "persons",
    f"""WITH k AS (SELECT *, {duck('alnum_key', 'name')} AS key FROM persons), f AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY video_id, key ORDER BY line_no) = 1)
    SELECT video_id, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS rejected FROM (SELECT *, {_sql_candidate('name')} AS ok FROM f) GROUP BY video_id""",
)
def match_candidates(persons: DataFrame) -> DataFrame:
    """First occurrence of each name in a video, and how many of these are sent to matching."""
    keyed = persons.withColumn("key", alnum_key("name")).where("key <> ''")
    first = keyed.groupBy("video_id", "key").agg(F.min_by("name", "line_no").alias("name")).withColumn("ok", is_match_candidate(F.col("name")))
    return first.groupBy("video_id").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


_VOWELS = "[aeıioöuü]"
_ROLE_WORDS = ("yönetmen", "yapımcı", "senaryo", "kamera", "kurgu", "müzik", "director", "producer", "editor", "cast", "crew")


def is_junk(name: Column) -> Column:
    t, low = F.trim(name), safe_lower(F.trim(name))
    letters, vowels = F.regexp_count(low, F.lit(r"\p{L}")), F.regexp_count(low, F.lit(_VOWELS))
    return (
        (F.length(t) < 3)
        | (~t.contains(" ") & t.rlike(r"\p{Ll}") & ~t.rlike(r"\p{Lu}"))
        | low.isin(*_ROLE_WORDS)
        | ((letters > 4) & (vowels == 0))
        | ((letters > 5) & (vowels / F.greatest(letters, F.lit(1)) < 0.15))
        | t.rlike(r"[.@#$%&{}\[\]]")
        | (F.regexp_count(t, F.lit("[0-9]")) / F.greatest(F.length(t), F.lit(1)) > 0.4)
    )


def _sql_junk(text: str) -> str:
    t, low = f"trim({text})", duck("safe_lower", f"trim({text})")
    letters, vowels = rf"len(regexp_extract_all({low}, '\p{{L}}'))", f"len(regexp_extract_all({low}, '{_VOWELS}'))"
    return rf"""(length({t}) < 3 OR (strpos({t}, ' ') = 0 AND regexp_matches({t}, '\p{{Ll}}') AND NOT regexp_matches({t}, '\p{{Lu}}')) OR {low} IN ({_list(_ROLE_WORDS)}) OR ({letters} > 4 AND {vowels} = 0)
      OR ({letters} > 5 AND {vowels} / greatest({letters}, 1)::double < 0.15) OR regexp_matches({t}, '[.@#$%&{{}}\[\]]') OR len(regexp_extract_all({t}, '[0-9]')) / greatest(length({t}), 1)::double > 0.4)"""


@query("b20_junk_cast", "lines", f"SELECT video_id, line_no, text FROM lines WHERE {_sql_junk('text')}")
def junk_cast(lines: DataFrame) -> DataFrame:
    """Texts that can't be a cast name."""
    return lines.where(is_junk(F.col("text"))).select("video_id", "line_no", "text")


def turkish_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, TURKISH, ""))


def noise_score(actor: Column) -> Column:
    """Lower is cleaner. The split of joined words needs a name table and counts as not split here."""
    w = words(actor)
    caps = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")
    keys = F.transform(w, ascii_key)
    # pairs of words whose keys of four letters or more begin alike: sorted heads, each counted with its equals before it
    heads = F.array_sort(F.transform(F.filter(keys, lambda k: F.length(k) >= 4), lambda k: F.substring(k, 1, 4)))
    start = F.struct(F.lit("").alias("head"), F.lit(0).alias("run"), F.lit(0).alias("pairs"))

    def step(s, x):
        run = F.when(s["head"] == x, s["run"] + 1).otherwise(0)
        return F.struct(x.alias("head"), run.alias("run"), (s["pairs"] + run).alias("pairs"))

    twins = F.aggregate(heads, start, step, lambda s: s["pairs"])
    return (
        F.when(actor.rlike(r"\.{3,}"), 10).otherwise(0)
        + F.when(actor.contains("&"), 5).otherwise(0)
        + F.when(actor.rlike("[0-9]"), 3).otherwise(0)
        + F.greatest(F.size(w) - 2, F.lit(0)) * 3
        - F.when(turkish_count(actor) > 0, 5).otherwise(0)
        + F.when((F.size(w) >= 2) & ~F.exists(w, lambda x: ~caps(x)), 4).otherwise(0)
        + F.when(~actor.contains(" ") & caps(actor) & (F.length(actor) >= 8), 6).otherwise(0)
        + F.size(F.filter(w, lambda x: F.length(x) >= 10)) * 2
        + twins * 2
    )


def variant_score(text: Column) -> Column:
    """Higher reads better: 3 a Turkish letter, .6 a word, .05 a character, less 1 a symbol."""
    return turkish_count(text) * 3 + F.size(words(text)) * 0.6 + F.length(text) * 0.05 - F.regexp_count(text, F.lit(r"[^\p{L}\p{N} ]"))


_SQL_VARIANT = rf"""(length(text) - length(translate(text, '{TURKISH}', ''))) * 3 + len({_SQL_WORDS.format('text')}) * 0.6::double + length(text) * 0.05::double - len(regexp_extract_all(text, '[^\p{{L}}\p{{N}} ]'))"""
_SQL_NOISE = rf"""CASE WHEN regexp_matches(text, '\.{{3,}}') THEN 10 ELSE 0 END + CASE WHEN strpos(text, '&') > 0 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 3 ELSE 0 END
  + greatest(len(w) - 2, 0) * 3 - CASE WHEN length(text) > length(translate(text, '{TURKISH}', '')) THEN 5 ELSE 0 END
  + CASE WHEN len(w) >= 2 AND len(list_filter(w, lambda x: NOT {_sql_upper('x')})) = 0 THEN 4 ELSE 0 END
  + CASE WHEN strpos(text, ' ') = 0 AND {_sql_upper('text')} AND length(text) >= 8 THEN 6 ELSE 0 END + len(list_filter(w, lambda x: length(x) >= 10)) * 2
  + 2 * coalesce(list_sum(list_transform(map_values(list_histogram(list_transform(list_filter(k, lambda x: length(x) >= 4), lambda x: x[1:4]))), lambda c: c * (c - 1) // 2)), 0)"""


@query(
    "c17_spelling_scores", "lines",
    f"""WITH s AS (SELECT video_id, line_no, text, {_SQL_WORDS.format('text')} AS w FROM lines), k AS (SELECT *, list_transform(w, lambda x: {duck('ascii_key', 'x')}) AS k FROM s)
    SELECT video_id, line_no, cast({_SQL_NOISE} AS bigint) AS noise, round({_SQL_VARIANT}, 6) AS variant FROM k""",
)
def spelling_scores(lines: DataFrame) -> DataFrame:
    """C17: noise and variant score of every line."""
    t = F.col("text")
    return lines.select("video_id", "line_no", noise_score(t).cast("long").alias("noise"), F.round(variant_score(t), 6).alias("variant"))


@query(
    "d52_richer_spelling", "lines lines2",
    f"SELECT a.video_id, a.line_no, CASE WHEN length(b.text) - length(translate(b.text, '{TURKISH}', '')) > length(a.text) - length(translate(a.text, '{TURKISH}', '')) THEN b.text ELSE a.text END AS text FROM lines a JOIN lines2 b USING (video_id, line_no)",
)
def richer_spelling(lines: DataFrame, second: DataFrame) -> DataFrame:
    """Of two readings the one with more Turkish letters, the first on ties."""
    both = lines.join(second.select("video_id", "line_no", F.col("text").alias("other")), ["video_id", "line_no"])
    return both.select("video_id", "line_no", F.when(turkish_count(F.col("other")) > turkish_count(F.col("text")), F.col("other")).otherwise(F.col("text")).alias("text"))


@query(
    "g4_top_k_cast", "persons",
    "SELECT video_id, line_no, name, confidence, rank <= 15 AS stored FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, line_no) AS rank FROM persons) WHERE rank <= 20",
)
def top_cast(persons: DataFrame) -> DataFrame:
    """The 20 cast rows that are shown of a video, and which of them are among the 15 stored."""
    order = Window.partitionBy("video_id").orderBy(F.col("confidence").desc(), "line_no")
    ranked = persons.withColumn("rank", F.row_number().over(order)).where("rank <= 20")
    return ranked.select("video_id", "line_no", "name", "confidence", (F.col("rank") <= 15).alias("stored"))
