"""Role headers in seven layers, and the sequential credit parse that stands on them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions.keys import duck, name_key, safe_lower
from reelmill.functions.similarity import bits_reach, duck_ratio, letter_bits, ratio
from reelmill.operators.lines import is_noise, is_subtitle, sql_is_noise, sql_is_subtitle
from reelmill.plans.registry import query

#: Role headers by category, and phrases that make a line a header wherever they stand in it, both in order.
#: A longer table comes in as a file or a table (role_tables).
ALIASES = (
    ("cast", ("oynayanlar", "oyuncular", "cast", "başroller", "basroller", "starring", "oynayan", "oyuncu", "darsteller", "avec", "interpreti", "acteurs", "actores", "atores")),
    ("director", ("yönetmen", "yonetmen", "director", "yöneten", "yoneten", "regie", "réalisation", "realisation", "regia", "dirección", "direccion", "dirigido por", "a film by", "film by", "directed by")),
    ("crew", ("senaryo", "senarist", "screenplay", "drehbuch", "written by", "story by", "script", "görüntü yönetmeni", "goruntu yonetmeni", "director of photography", "kamera", "camera", "kamera operatorleri", "müzik", "muzik", "music", "kurgu", "montaj", "editing", "edited by", "editor", "yapımcı", "yapimci", "producer", "executive producer", "yönetmen yardımcısı", "yardımcı yönetmen", "assistant director", "sanat yönetmeni", "art director")),
    ("production", ("yapım", "yapim", "production", "produced by")),
)
PHRASES = (
    ("cast", ("oyuncular", "oynayanlar", "cast", "starring")),
    ("director", ("yönetmen", "yonetmen", "director", "regie", "réalisation", "regia", "directed by", "film by")),
    ("crew", ("senaryo", "screenplay", "drehbuch", "written by", "müzik", "muzik", "music", "kurgu", "montaj", "editor", "editing", "yapımcı", "yapimci", "producer")),
    ("production", ("yapım", "yapim", "production", "produced by")),
)
COMPANY_ENDS = ("film", "films", "filmcilik", "medya", "yapım", "yapimevi", "production", "productions", "stüdyo", "studyo", "studio", "televizyon")
#: Letters that folding replaces, what stands between a role and a name in one line, and least ratio.
FOLD_FROM, FOLD_TO = "İıIÖöÜüŞşÇçĞğ", "iiioouussccgg"
SEPARATORS = ("→", "->", ":", " – ", " - ")
LEAST_RATIO = 80
#: Phrases of a table at most: each is a pattern in one expression.
MAX_PHRASES = 1000
_EDGE = r"[^\p{L}\p{N}_]"


def _listed(groups: tuple) -> list[tuple[str, str, int]]:
    flat = [(text, category) for category, texts in groups for text in texts]
    return [(t, c, i) for i, (t, c) in enumerate(flat)]


def role_tables(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(aliases, phrases), each (alias, category, place): the fixed ones, or those of a JSON file
    {"roles": [{"category", "aliases": [..], "phrases": [..]}, ..]}, in the file's order."""
    kind = "alias string, category string, place int"
    if not path:
        return spark.createDataFrame(_listed(ALIASES), kind), spark.createDataFrame(_listed(PHRASES), kind)
    role = "roles array<struct<category: string, aliases: array<string>, phrases: array<string>>>"
    roles = spark.read.schema(role).json(path, multiLine=True).select(F.posexplode("roles").alias("at", "role"))

    def part(column: str) -> DataFrame:
        rows = roles.select("at", "role.category", F.posexplode(F.col(f"role.{column}")).alias("i", "alias"))
        return rows.where("category <> '' AND alias <> ''").select(safe_lower("alias").alias("alias"), "category", (F.col("at") * 10_000 + F.col("i")).cast("int").alias("place"))

    return part("aliases"), part("phrases")


def folded(low: Column) -> Column:
    """Letters of misread Turkish folded, letters a-z and digits with single spaces, a leading team number gone."""
    text = F.regexp_replace(F.lower(F.translate(low, FOLD_FROM, FOLD_TO)), r"[^a-z0-9\s]", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[0-9]+\s*ekip\s*", "")


def _starts(low: Column, most: int) -> Column:
    """The text itself and what stands before each of its spaces and colons, up to most characters."""
    ends = F.filter(F.sequence(F.lit(1), F.least(F.length(low), F.lit(most + 1))), lambda i: F.substring(low, i, F.lit(1)).isin(" ", ":"))
    return F.concat(F.array(F.struct(low.alias("alias"), F.lit(0).alias("step"))), F.transform(ends, lambda i: F.struct(F.substring(low, F.lit(1), i - 1).alias("alias"), F.lit(1).alias("step"))))


def role_headers_of(texts: DataFrame, aliases: DataFrame, phrases: DataFrame) -> DataFrame:
    """texts (text) -> (text, category, layer) for the distinct texts that are role headers.

    Layers in order: the text is an alias; it begins with one before a space or colon (the first of the table counts); it
    holds a phrase; the same on the folded text (`folded`, `folded phrase`); the alias of highest ratio, from 80 on
    (`fuzzy`, on the text, then folded); a company's ending. The first two layers are one equi-join on the text's
    beginnings, and the fuzzy one meets aliases on lengths that can reach the ratio; an edit distance, which no ratio of 80
    exceeds a fifth of both lengths with, sorts most pairs out on the JVM. Null and empty texts are no headers.
    """
    held = [(r["alias"], r["category"]) for r in phrases.orderBy("place").limit(MAX_PHRASES + 1).collect()]
    if len(held) > MAX_PHRASES:
        raise ValueError(f"more than {MAX_PHRASES} phrases")
    most = aliases.agg(F.max(F.length("alias"))).first()[0] or 1
    bare = aliases.select(folded(F.col("alias")).alias("alias"), "category", "place").where("alias <> ''").groupBy("alias").agg(F.min_by("category", "place").alias("category"), F.min("place").alias("place"))
    low = safe_lower(F.trim("text"))
    rows = texts.select("text").where(F.trim("text") != "").distinct().select("text", low.alias("low"))
    rows = rows.withColumn("norm", folded(F.col("low")))
    # a pattern is tried only where the line holds its first word
    holds = lambda c, p: (c.contains(p.split()[0]) if p.split() else F.lit(True)) & c.rlike(f"(^|{_EDGE}){_phrase(p)}($|{_EDGE})")
    by_phrase = lambda c: F.coalesce(*[F.when(holds(c, p), k) for p, k in held], F.lit(None).cast("string"))

    def by_start(column: str, table: DataFrame) -> DataFrame:
        asked = rows.select("text", F.explode(_starts(F.col(column), most)).alias("s")).select("text", "s.alias", "s.step")
        return asked.join(table, "alias").groupBy("text").agg(F.min_by(F.struct("category", "step"), F.struct("step", "place")).alias(f"{column}_hit"))

    found = rows.join(by_start("low", aliases), "text", "left").join(by_start("norm", bare), "text", "left")
    found = found.withColumn("phrase", F.when(F.col("low_hit").isNull(), by_phrase(F.col("low")))).withColumn("norm_phrase", F.when(F.col("low_hit").isNull() & F.col("phrase").isNull() & F.col("norm_hit").isNull(), by_phrase(F.col("norm"))))
    open_ = F.coalesce("low_hit.category", "phrase", "norm_hit.category", "norm_phrase").isNull()
    short = F.least(F.length("low"), F.length("norm")) <= most * 3 / 2  # longer texts are near no alias
    fuzzy = _fuzzy(found.where(short).where(open_).select("text", "low", "norm"), aliases, bare)
    company = F.when(F.greatest(*[F.when(F.col("low").endswith(e) & (F.length("low") > len(e) + 2), 1).otherwise(0) for e in COMPANY_ENDS]) == 1, "company")
    near = found.join(fuzzy, "text", "left")
    category = F.coalesce("low_hit.category", "phrase", "norm_hit.category", "norm_phrase", "near", company)
    layer = (
        F.when(F.col("low_hit").isNotNull(), F.when(F.col("low_hit.step") == 0, "exact").otherwise("prefix"))
        .when(F.col("phrase").isNotNull(), "phrase")
        .when(F.col("norm_hit").isNotNull(), "folded")
        .when(F.col("norm_phrase").isNotNull(), "folded phrase")
        .when(F.col("near").isNotNull(), "fuzzy")
        .otherwise("company")
    )
    return near.select("text", category.alias("category"), layer.alias("layer")).where("category IS NOT NULL")


def _phrase(text: str) -> str:
    return r"\s+".join("".join(c if c.isalnum() else "\\" + c for c in word) for word in text.split())


def _fuzzy(rest: DataFrame, aliases: DataFrame, bare: DataFrame) -> DataFrame:
    """(text, near): the category of the alias of highest ratio, the text as it is before the folded one."""
    n = F.length("alias")
    reach = F.explode(F.sequence(F.ceil(n * 2 / 3).cast("int"), F.floor(n * 3 / 2).cast("int"))).alias("n")

    def pairs(column: str, table: DataFrame, kind: int) -> DataFrame:
        asked = rest.where(f"{column} <> ''").select("text", F.col(column).alias("a"), F.length(column).alias("n"), letter_bits(F.col(column)).alias("a_bits"))
        both = asked.join(table.select("alias", "category", "place", letter_bits(F.col("alias")).alias("bits"), reach), "n")
        able = both.where(bits_reach(F.col("a"), F.col("alias"), F.col("a_bits"), F.col("bits"), LEAST_RATIO))
        return able.where(5 * F.levenshtein("a", "alias") <= F.col("n") + F.length("alias")).select("text", "a", "alias", "category", "place", F.lit(kind).alias("kind"))

    scored = pairs("low", aliases, 0).unionByName(pairs("norm", bare, 1)).withColumn("score", ratio(F.col("a"), F.col("alias")))
    return scored.where(F.col("score") >= LEAST_RATIO).groupBy("text").agg(F.min_by("category", F.struct("kind", -F.col("score"), "place")).alias("near"))


def _values(groups: tuple) -> str:
    return ", ".join(f"('{t}', '{c}', {p})" for t, c, p in _listed(groups))


def _sql_folded(low: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(regexp_replace(lower(translate({low}, '{FOLD_FROM}', '{FOLD_TO}')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), '^[0-9]+\s*ekip\s*', '')"


def _sql_phrases(c: str) -> str:
    return "CASE " + " ".join(rf"WHEN regexp_matches({c}, '(^|{_EDGE}){_phrase(t)}($|{_EDGE})') THEN '{k}'" for t, k, _ in _listed(PHRASES)) + " END"


#: Role headers of the distinct texts of role_lines: table hd (text, category, layer).
SQL_HEADERS = f"""al(alias, category, place) AS (VALUES {_values(ALIASES)}), bare AS (SELECT {_sql_folded('alias')} AS alias, arg_min(category, place) AS category, min(place) AS place FROM al GROUP BY 1),
  tx AS (SELECT *, {_sql_folded('low')} AS norm FROM (SELECT DISTINCT text, {duck('safe_lower', 'trim(text)')} AS low FROM role_lines)),
  st AS (SELECT text, arg_min((category, step), (step, place)) AS hit FROM (SELECT text, category, place, CASE WHEN low = alias THEN 0 ELSE 1 END AS step FROM tx JOIN al ON low = alias OR starts_with(low, alias || ' ') OR starts_with(low, alias || ':')) GROUP BY text),
  sn AS (SELECT text, arg_min(category, (step, place)) AS hit FROM (SELECT text, category, place, CASE WHEN norm = alias THEN 0 ELSE 1 END AS step FROM tx JOIN bare ON norm = alias OR starts_with(norm, alias || ' ')) GROUP BY text),
  f0 AS (SELECT tx.*, st.hit AS low_hit, sn.hit AS norm_hit, CASE WHEN st.hit IS NULL THEN {_sql_phrases('low')} END AS phrase FROM tx LEFT JOIN st USING (text) LEFT JOIN sn USING (text)),
  f1 AS (SELECT *, CASE WHEN low_hit IS NULL AND phrase IS NULL AND norm_hit IS NULL THEN {_sql_phrases('norm')} END AS norm_phrase FROM f0),
  cd AS (SELECT text, low AS a, alias, category, place, 0 AS kind FROM f1 JOIN al ON 5 * levenshtein(low, alias) <= length(low) + length(alias) WHERE low_hit IS NULL AND coalesce(phrase, norm_hit, norm_phrase) IS NULL
         UNION ALL SELECT text, norm, alias, category, place, 1 FROM f1 JOIN bare ON 5 * levenshtein(norm, alias) <= length(norm) + length(alias) WHERE low_hit IS NULL AND coalesce(phrase, norm_hit, norm_phrase) IS NULL AND norm <> ''),
  fz AS (SELECT text, arg_min(category, (kind, -score, place)) AS near FROM (SELECT *, {duck_ratio('a', 'alias')} AS score FROM cd) WHERE score >= {LEAST_RATIO} GROUP BY text),
  hc AS (SELECT *, CASE WHEN {' OR '.join(f"(low LIKE '%{e}' AND length(low) > {len(e) + 2})" for e in COMPANY_ENDS)} THEN 'company' END AS company FROM f1 LEFT JOIN fz USING (text)),
  hd AS (SELECT text, coalesce(low_hit[1], phrase, norm_hit, norm_phrase, near, company) AS category,
           CASE WHEN low_hit IS NOT NULL THEN CASE WHEN low_hit[2] = 0 THEN 'exact' ELSE 'prefix' END WHEN phrase IS NOT NULL THEN 'phrase' WHEN norm_hit IS NOT NULL THEN 'folded' WHEN norm_phrase IS NOT NULL THEN 'folded phrase' WHEN near IS NOT NULL THEN 'fuzzy' ELSE 'company' END AS layer
         FROM hc WHERE coalesce(low_hit[1], phrase, norm_hit, norm_phrase, near, company) IS NOT NULL)"""  # fmt: skip


@query("d8_role_headers", "role_lines", f"WITH {SQL_HEADERS} SELECT video_id, line_no, text, category, layer FROM role_lines JOIN hd USING (text)")
def role_headers(lines: DataFrame, aliases: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """Lines that are role headers, with their category and the layer that found it."""
    own = role_tables(lines.sparkSession)
    found = role_headers_of(lines, aliases or own[0], phrases or own[1])
    return lines.join(found, "text").select("video_id", "line_no", "text", "category", "layer")


def inline_name(text: Column) -> Column:
    """The name behind a role in one line, of three characters or more with a letter; '' if there is none."""
    behind = [F.trim(F.substring(text, F.instr(text, s) + len(s), F.length(text))) for s in SEPARATORS]
    return F.coalesce(*[F.when((F.instr(text, s) > 0) & (F.length(b) >= 3) & b.rlike(r"\p{L}"), b) for s, b in zip(SEPARATORS, behind, strict=True)], F.lit(""))


def _sql_inline(text: str) -> str:
    behind = [f"trim(substr({text}, strpos({text}, '{s}') + {len(s)}))" for s in SEPARATORS]
    cases = " ".join(rf"WHEN strpos({text}, '{s}') > 0 AND length({b}) >= 3 AND regexp_matches({b}, '\p{{L}}') THEN {b}" for s, b in zip(SEPARATORS, behind, strict=True))
    return f"CASE {cases} ELSE '' END"


def parsed_lines(lines: DataFrame, aliases: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """lines that are neither noise nor subtitles, with header, the category that a line is a header of, and inline, the
    name that stands in a crew's or director's header."""
    text, own = F.col("text"), role_tables(lines.sparkSession)
    kept = lines.where(~(is_noise(text) | is_subtitle(text)))
    headers = role_headers_of(kept, aliases or own[0], phrases or own[1]).select("text", F.col("category").alias("header"))
    return kept.join(headers, "text", "left").withColumn("inline", F.when(F.col("header").isin("crew", "director"), inline_name(text)).otherwise(""))


@query(
    "e1_credit_parse", "role_lines",
    f"""WITH {SQL_HEADERS}, k AS (SELECT video_id, line_no, text, hd.category AS header, CASE WHEN hd.category IN ('crew', 'director') THEN {_sql_inline('text')} ELSE '' END AS inline
        FROM role_lines LEFT JOIN hd USING (text) WHERE NOT ({sql_is_noise('text')} OR {sql_is_subtitle('text')})),
    s AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'cast') AS category FROM k)
    SELECT video_id, line_no, CASE WHEN header IS NULL THEN text ELSE inline END AS name, category FROM s WHERE header IS NULL OR inline <> ''""",
)
def credit_parse(lines: DataFrame) -> DataFrame:
    """E1 without streak rules: noise and subtitles go, the last header sets the category, cast at first; the names behind it
    follow, also one in a crew's or director's own line."""
    from pyspark.sql import Window

    by = Window.partitionBy("video_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = parsed_lines(lines).withColumn("category", F.coalesce(F.last("header", ignorenulls=True).over(by), F.lit("cast")))
    name = F.when(F.col("header").isNull(), F.col("text")).otherwise(F.col("inline"))
    return rows.where(F.col("header").isNull() | (F.col("inline") != "")).select("video_id", "line_no", name.alias("name"), "category")


#: Categories whose unknown rows count; the third such row in a row is noise, the fifth outside cast ends the block.
STREAKS, NOISE_FROM, BACK_FROM = ("director", "crew", "noise"), 3, 5
CREDIT = "video_id long, line_no long, name string, job string, category string, confidence double, is_verified boolean, match_method string, is_title boolean, year int"


class Parse:
    """The parse of one video, a row at a time: what is kept between rows does not grow with them."""

    def __init__(self):
        self.category, self.role, self.unknown, self.general = "cast", "", 0, 0
        self.title, self.people, self.year = False, False, False

    def header(self, text: str, category: str, inline: str) -> tuple | None:
        self.category, self.unknown, self.general = category, 0, 0
        if inline:
            self.people = True
            self.role = text.split(next(s for s in SEPARATORS if s in text), 1)[0].strip()
            return inline, self.role, category, 0.7, False, "", False, None
        self.role = text
        return (text, "", "company", 0.6, False, "", False, None) if category == "company" and len(text) > 3 else None

    def row(self, text: str, known: bool, year: int | None, confidence: float) -> tuple | None:
        if self.category in STREAKS:
            if known:
                self.unknown, self.category = 0, "director" if self.category == "noise" else self.category
            elif len(text.split()) == 1 and (text.isupper() and len(text) > 3 or len(text) <= 3):
                self.category, self.unknown = "noise", NOISE_FROM
                return None
            else:
                self.unknown += 1
                self.category = "noise" if self.unknown >= NOISE_FROM else self.category
        if self.category != "cast":
            self.general = 0 if known else self.general + 1
            if self.general >= BACK_FROM:
                self.category, self.role, self.general = "cast", "", 0
                return None
        if self.category == "noise":
            return None
        new_year = year if year and not self.year else None
        self.year |= bool(year)
        title = not self.title and not self.people and all(w[0].isupper() for w in text.split())
        self.title |= title
        self.people |= self.category in ("cast", "director", "crew")
        if self.category == "director":
            return text, "Yönetmen", "director", 0.7, False, "", title, new_year
        if self.category == "crew":
            return text, self.role or "Ekip", "crew", 0.6, False, "", title, new_year
        if self.category in ("production", "company"):
            return text, "", self.category, 0.6, False, "", title, new_year
        return text, self.role or "Cast", "cast", round(min(1.0, confidence + 0.2) if known else confidence, 3), known, "exact_db" if known else "", title, new_year


@query("e1_credit_parse_full", "role_lines name_list")
def credit_parse_full(lines: DataFrame, names: DataFrame | None = None, aliases: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """The rows of a video in order. A header sets category and job; under director, crew and noise a brand-like row turns
    the block to noise at once and the third row in a row that the name table lacks does; the fifth such row outside cast goes
    and ends the block; a known name ends noise. Noise rows give nothing. The first year and the first row in title case before
    any name are marked. Known cast names have .2 more confidence.

    Rows are dealt by video and sorted, and one pass holds a few values a video, so a long video needs no more memory.
    """
    rows = parsed_lines(lines if "confidence" in lines.columns else lines.withColumn("confidence", F.lit(0.6)), aliases, phrases)
    key = F.when(F.trim("text").contains(" "), name_key("text"))
    if names is None:
        rows = rows.withColumn("known", F.lit(False))
    else:
        table = names.select(name_key("primary_name").alias("key")).distinct().withColumn("known", F.lit(True))
        rows = rows.withColumn("key", key).join(table, "key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    year = F.regexp_extract("text", r"(?<![\p{L}\p{N}_])(19[0-9]{2}|20[0-9]{2})(?![\p{L}\p{N}_])", 1)
    rows = rows.select("video_id", "line_no", F.trim("text").alias("text"), "header", "inline", "known", F.when(year != "", year.cast("int")).alias("year"), "confidence")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, parse = object(), Parse()
        for frame in frames:
            out = []
            for v, line, text, header, inline, known, year, confidence in frame.itertuples(index=False):
                if v != video:
                    video, parse = v, Parse()
                made = parse.header(text, header, inline) if isinstance(header, str) else parse.row(text, known, None if pd.isna(year) else int(year), confidence)
                if made:
                    out.append((v, line, *made))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CREDIT.split(", ")], dtype=object)

    return rows.repartition("video_id").sortWithinPartitions("video_id", "line_no").mapInPandas(run, CREDIT)


@query("e1_title_year", "role_lines name_list")
def title_year(lines: DataFrame, names: DataFrame) -> DataFrame:
    """The film title and year that E1 finds in a video's lines; a video whose parse finds neither has nulls."""
    found = credit_parse_full(lines, names)
    return found.groupBy("video_id").agg(F.max(F.when(F.col("is_title"), F.col("name"))).alias("film_title"), F.max("year").alias("year"), F.count("*").alias("n_rows"))
