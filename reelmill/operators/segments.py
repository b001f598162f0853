"""Transcript segments: speakers by overlap, interval merges, sampling windows, evidence, events of a match, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.keys import duck, safe_lower
from reelmill.plans.registry import query

#: Words of each sport, and those that only one sport has.
SPORTS = {
    "futbol": ("gol", "penaltı", "korner", "ofsayt", "faul", "kaleye", "kaleci", "defans", "forvet", "orta saha", "sarı kart", "kırmızı kart", "serbest vuruş", "taç atışı", "devre arası", "aut", "goal", "penalty", "corner", "offside", "halftime", "free kick", "yellow card", "red card"),
    "basketbol": ("faul", "serbest atış", "üç sayı", "çeyrek", "ribaund", "asist", "blok", "top çalma", "periyot", "uzatma", "sayı", "slam dunk", "fast break", "three pointer", "free throw", "rebound", "quarter", "overtime"),
    "voleybol": ("set", "servis", "smaç", "blok", "pas", "manşet", "çapraz", "paralel", "deuce", "sayı", "libero", "ace", "spike", "dig", "rally"),
}
ONLY = {
    "futbol": ("gol", "goal", "korner", "corner", "ofsayt", "offside", "kaleci", "taç atışı"),
    "basketbol": ("serbest atış", "free throw", "üç sayı", "three pointer", "ribaund", "rebound", "çeyrek", "quarter", "periyot"),
    "voleybol": ("set", "smaç", "spike", "manşet", "libero", "ace", "servis"),
}
#: Patterns of goals, cards, scores and of sentences that deny a goal.
#: How a goal and a card are told, each with the groups of minute and player (and kind).
_PLAYER = r"[\p{L}\p{N}_][\p{L}\p{N}_\s]{2,30}"
GOALS = (
    (rf"(?i)([0-9]{{1,3}})[.\x27]?\s*(?:dakika(?:da|sında)?|dk)\s+({_PLAYER}?)(?:\s+gol)", 1, 2),
    (rf"(?i)gol[üu]?\s+(?:att[ıi]|bul[\p{{L}}\p{{N}}_]*|geldi)\s*[,.:!]?\s*({_PLAYER}?)\s*[,.:!]?\s*([0-9]{{1,3}})", 2, 1),
    (rf"(?i)({_PLAYER}?)\s+gol[üu]?\s*[,.:!]?\s*([0-9]{{1,3}})", 2, 1),
)
_CAPITAL = r"[A-ZÇĞİÖŞÜ][\p{L}\p{N}_]+(?:\s+[A-ZÇĞİÖŞÜ][\p{L}\p{N}_]+){0,3}"
CARDS = (
    (rf"(?i)(sar[ıi]\s+kart|yellow\s+card|k[ıi]rm[ıi]z[ıi]\s+kart|red\s+card)\s*[,.:!]?\s*([0-9]{{1,3}})[.\x27]?\s*(?:dakika[\p{{L}}\p{{N}}_]*)?\s*[,.:!]?\s*({_PLAYER})", 1, 2, 3),
    (rf"(?i)(k[ıi]rm[ıi]z[ıi]\s+kart|red\s+card)\s*[,.:!]?\s*({_PLAYER}?)\s*[,.:!]?\s*([0-9]{{1,3}})", 1, 3, 2),
    (rf"(?i)({_PLAYER}?)\s+(sar[ıi]\s+kart|k[ıi]rm[ıi]z[ıi]\s+kart)\s*[\p{{L}}\p{{N}}_]*\s*([0-9]{{1,3}})", 2, 3, 1),
    (rf"([0-9]{{1,3}})[.\x27]?\s*dakikas[ıi]nda\s+({_CAPITAL})\s+(sar[ıi]\s+kart|k[ıi]rm[ıi]z[ıi]\s+kart)\s+g[öo]rd[üu]", 3, 1, 2),
)
FALSE_GOAL = "gole çok yaklaşt|gol pozisyonu|gol sesi|gol yok|gol izleyemedik"
SCORE = r"([0-9]{1,3})\s*[-–—:]\s*([0-9]{1,3})"
NO_GOAL = r"(^|[^\p{L}])gol yok([^\p{L}]|$)|gol izleyemedik|gol sesi [\p{L}]* gelmedi"
EVIDENCE = r"(?i)(^|[^\p{L}])(gol|penalt|kart|skor|sonu|hakem)[\p{L}]*"


@query("a13_transcript_flatten", "segments", """SELECT video_id, string_agg('[' || ts(start_sec) || ' - ' || ts(end_sec) || '] ' || coalesce(speaker, 'UNK') || ': ' || trim(text), chr(10) ORDER BY seg_no) AS transcript FROM segments WHERE trim(text) <> '' GROUP BY video_id""".replace("ts(start_sec)", "printf('%02d:%02d:%02d.%03d', cast(start_sec AS bigint) // 3600, cast(start_sec AS bigint) // 60 % 60, cast(start_sec AS bigint) % 60, 0)").replace("ts(end_sec)", "printf('%02d:%02d:%02d.%03d', cast(end_sec AS bigint) // 3600, cast(end_sec AS bigint) // 60 % 60, cast(end_sec AS bigint) % 60, 0)"))
def transcript_flatten(segments: DataFrame) -> DataFrame:
    """Segments that aren't empty, as [hh:mm:ss.mmm - ...] SPEAKER: text, a text a video."""

    def stamp(c: str):
        t = F.col(c).cast("long")
        ms = F.round((F.col(c) - t) * 1000).cast("long")
        return F.format_string("%02d:%02d:%02d.%03d", F.expr(f"CAST({c} AS BIGINT) DIV 3600"), F.expr(f"CAST({c} AS BIGINT) DIV 60 % 60"), t % 60, ms)

    line = F.concat(F.lit("["), stamp("start_sec"), F.lit(" - "), stamp("end_sec"), F.lit("] "), F.coalesce("speaker", F.lit("UNK")), F.lit(": "), F.trim("text"))
    rows = segments.where("trim(text) <> ''").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", line.alias("line")))).alias("lines"))
    return rows.select("video_id", F.array_join("lines.line", "\n").alias("transcript"))


@query("b21_confidence_masking", "segments", """WITH s AS (SELECT *, confidence >= 0.40 AND confidence < 0.75 AS review FROM segments)
    SELECT video_id, seg_no, CASE WHEN confidence < 0.40 THEN '[unclear]' ELSE text END AS text, text AS original, review, CASE WHEN review THEN cast(floor((row_number() OVER (PARTITION BY video_id, review ORDER BY seg_no) - 1) / 10) AS bigint) END AS batch FROM s""")  # fmt: skip
def confidence_masking(segments: DataFrame) -> DataFrame:
    """Segments below .40 are masked, those from .40 to .75 numbered in batches of 10 for correction."""
    rows = segments.withColumn("review", (F.col("confidence") >= 0.40) & (F.col("confidence") < 0.75))
    n = F.row_number().over(Window.partitionBy("video_id", "review").orderBy("seg_no"))
    return rows.select("video_id", "seg_no", F.when(F.col("confidence") < 0.40, "[unclear]").otherwise(F.col("text")).alias("text"), F.col("text").alias("original"), "review", F.when(F.col("review"), F.floor((n - 1) / 10)).alias("batch"))


@query(
    "d47_speaker_overlap", "segments diarization",
    """WITH o AS (SELECT s.video_id, s.seg_no, d.d_speaker, d.d_no, least(s.end_sec, d.d_end) - greatest(s.start_sec, d.d_start) AS overlap FROM segments s JOIN diarization d ON s.video_id = d.video_id AND s.start_sec < d.d_end AND d.d_start < s.end_sec),
    b AS (SELECT video_id, seg_no, arg_max(d_speaker, (overlap, -d_no)) AS speaker, max(overlap) AS overlap FROM o GROUP BY ALL) SELECT s.video_id, s.seg_no, b.speaker, b.overlap FROM segments s LEFT JOIN b USING (video_id, seg_no)""",
)
def speaker_overlap(segments: DataFrame, diarization: DataFrame, width: float = 60.0) -> DataFrame:
    """The speaker whose interval overlaps a segment most, the first on ties.

    A range join by buckets: both sides stand in each bucket of `width` seconds that they touch, and a pair counts in
    the bucket where its overlap begins.
    """
    left = segments.select("video_id", "seg_no", "start_sec", "end_sec", F.explode(F.expr(f"sequence(floor(start_sec / {width}), floor(end_sec / {width}))")).alias("bucket"))
    right = diarization.select("video_id", "d_no", "d_speaker", "d_start", "d_end", F.explode(F.expr(f"sequence(floor(d_start / {width}), floor(d_end / {width}))")).alias("bucket"))
    begin = F.greatest("start_sec", "d_start")
    pairs = left.join(right, ["video_id", "bucket"]).where((F.col("start_sec") < F.col("d_end")) & (F.col("d_start") < F.col("end_sec")) & (F.floor(begin / width) == F.col("bucket")))
    overlap = F.least("end_sec", "d_end") - begin
    best = pairs.groupBy("video_id", "seg_no").agg(F.max_by("d_speaker", F.struct(overlap.alias("o"), -F.col("d_no"))).alias("speaker"), F.max(overlap).alias("overlap"))
    return segments.select("video_id", "seg_no").join(best, ["video_id", "seg_no"], "left")


@query(
    "d48_speaker_naming", "segments persons",
    """WITH w AS (SELECT video_id, seg_no, speaker, t, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM (SELECT video_id, seg_no, speaker, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' +'), lambda x: x <> '') AS t FROM segments)),
    p AS (SELECT video_id, line_no, name, list_filter(string_split(lower(name), ' '), lambda x: x <> '') AS parts FROM persons),
    m AS (SELECT p.video_id, w.speaker, w.seg_no, p.line_no, p.name, p.parts, len(p.parts) AS n, w.t[w.i:w.i + len(p.parts)] AS near FROM p JOIN w ON w.video_id = p.video_id AND w.word = p.parts[1])
    SELECT video_id, speaker, arg_min(name, (seg_no, line_no)) AS name FROM m WHERE near[1:n] = parts OR len(list_filter(range(2, n + 1), lambda k: list_concat(near[1:k - 1], near[k + 1:n + 1]) = parts)) > 0 GROUP BY ALL""",
)
def speaker_naming(segments: DataFrame, persons: DataFrame) -> DataFrame:
    """A speaker is named by the first segment that has all n words of a person's name in order within n + 1 words; of
    several such persons by the first in the list. A name of one word is named by that word."""
    tokens = F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " +"), lambda w: w != "")
    parts = F.filter(F.split(F.lower("name"), " "), lambda w: w != "")
    table = persons.select("video_id", "line_no", "name", parts.alias("parts")).where(F.size("parts") > 0)
    most = table.agg(F.max(F.size("parts"))).first()[0] or 1
    said = segments.select("video_id", "seg_no", "speaker", tokens.alias("t")).where(F.size("t") > 0)
    spots = F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.slice("t", i, F.lit(most + 1)))).alias("near")
    met = said.select("video_id", "seg_no", "speaker", spots).withColumn("word", F.get("near", F.lit(0))).join(table.withColumn("word", F.get("parts", F.lit(0))), ["video_id", "word"])
    n = F.size("parts")
    gapped = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.concat(F.slice("near", F.lit(1), k), F.slice("near", k + 2, n - k)) == F.col("parts"))
    whole = (F.slice("near", F.lit(1), n) == F.col("parts")) | ((n > 1) & gapped)
    return met.where(whole).groupBy("video_id", "speaker").agg(F.min_by("name", F.struct("seg_no", "line_no")).alias("name"))


_WINDOWS = [("first", "0.0", "600.0"), ("middle", "(dur - 900.0) / 2", "(dur + 900.0) / 2"), ("last", "dur - 900.0", "dur")]


@query("e10_sampling_windows", "segments", "WITH d AS (SELECT video_id, max(end_sec) * 20 AS dur FROM segments GROUP BY video_id), w AS (" + " UNION ALL ".join(f"SELECT video_id, dur, '{n}' AS label, {a} AS a, {b} AS b FROM d" for n, a, b in _WINDOWS) + ") SELECT video_id, label, greatest(0.0, a) AS start_sec, least(dur, b) AS end_sec FROM w WHERE least(dur, b) > greatest(0.0, a)")
def sampling_windows(segments: DataFrame) -> DataFrame:
    """The first 10, the middle 15 and the last 15 minutes, clamped (a segment second stands for 20)."""
    dur = segments.groupBy("video_id").agg((F.max("end_sec") * 20).alias("dur"))
    windows = F.array(*[F.struct(F.lit(n).alias("label"), F.expr(a).alias("a"), F.expr(b).alias("b")) for n, a, b in _WINDOWS])
    rows = dur.select("video_id", "dur", F.explode(windows).alias("w"))
    out = rows.select("video_id", "w.label", F.greatest(F.lit(0.0), "w.a").alias("start_sec"), F.least("dur", "w.b").alias("end_sec"))
    return out.where("end_sec > start_sec")


def merge_intervals(rows: DataFrame, start: str, end: str, label: str, order: str) -> DataFrame:
    """rows (video_id, start, end, label) -> intervals that overlap or touch joined, their labels in order."""
    by = Window.partitionBy("video_id").orderBy(start, end, order)
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    groups = rows.withColumn("__gap", gap).withColumn("__group", F.sum("__gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    labels = F.array_join(F.array_sort(F.collect_set(label)), "+")
    return groups.groupBy("video_id", "__group").agg(F.min(start).alias("start_sec"), F.max(end).alias("end_sec"), labels.alias("labels"), F.count("*").alias("n")).drop("__group")


@query(
    "e11_interval_merge", "diarization",
    """WITH g AS (SELECT *, CASE WHEN max(d_end) OVER w IS NULL OR d_start > max(d_end) OVER w THEN 1 ELSE 0 END AS gap FROM diarization WINDOW w AS (PARTITION BY video_id ORDER BY d_start, d_end, d_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, sum(gap) OVER (PARTITION BY video_id ORDER BY d_start, d_end, d_no ROWS UNBOUNDED PRECEDING) AS grp FROM g) SELECT video_id, min(d_start) AS start_sec, max(d_end) AS end_sec, array_to_string(list_sort(list(DISTINCT d_speaker)), '+') AS labels, count(*) AS n FROM s GROUP BY video_id, grp""",
)
def interval_merge(diarization: DataFrame) -> DataFrame:
    """Overlapping intervals of a video merged, with their speakers."""
    return merge_intervals(diarization, "d_start", "d_end", "d_speaker", "d_no")


@query("e12_time_offset", "segments", "SELECT video_id, seg_no, start_sec + 30.0::double AS start_sec, end_sec + 30.0::double AS end_sec, array_to_string(list_transform(range(0, len(string_split(text, ' '))), lambda i: cast(cast(start_sec + 30 + i AS bigint) AS varchar)), ',') AS word_starts FROM segments")
def time_offset(segments: DataFrame, offset: float = 30.0) -> DataFrame:
    """Segments and their nested words moved by an offset (a word a second)."""
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (F.col("start_sec") + i).alias("start")))
    moved = segments.withColumn("words", F.transform(words, lambda w: w.withField("start", w["start"] + offset)))
    return moved.select("video_id", "seg_no", (F.col("start_sec") + offset).alias("start_sec"), (F.col("end_sec") + offset).alias("end_sec"), F.array_join(F.transform("words", lambda w: w["start"].cast("long").cast("string")), ",").alias("word_starts"))


@query("e14_head_and_tail", "segments", "WITH s AS (SELECT *, max(end_sec) OVER (PARTITION BY video_id) AS dur FROM segments) SELECT video_id, seg_no, start_sec < 30 AS in_head, end_sec > dur - 30 AS in_tail FROM s WHERE start_sec < 30 OR end_sec > dur - 30")
def head_and_tail(segments: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Segments of the first and of the last stretch of a video."""
    dur = F.max("end_sec").over(Window.partitionBy("video_id"))
    rows = segments.withColumn("dur", dur).select("video_id", "seg_no", (F.col("start_sec") < seconds).alias("in_head"), (F.col("end_sec") > F.col("dur") - seconds).alias("in_tail"))
    return rows.where("in_head OR in_tail")


_TOKENS = "SELECT video_id, seg_no, confidence, unnest(list_filter(regexp_split_to_array(lower(translate(text, 'İ', 'i')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(lower(translate(text, 'İ', 'i')), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), 1) AS i FROM segments"


def tokens(segments: DataFrame) -> DataFrame:
    """(video_id, seg_no, confidence, i, w): words of each segment, by place."""
    return segments.select("video_id", "seg_no", "confidence", F.posexplode(F.filter(F.split(safe_lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("i", "w"))


@query("e16_repeat_rate", "segments", f"WITH t AS ({_TOKENS}), r AS (SELECT *, lag(w) OVER (PARTITION BY video_id ORDER BY seg_no, i) AS prev FROM t) SELECT video_id, round(sum(CASE WHEN w = prev THEN 1 ELSE 0 END) / greatest(count(*) - 1, 1)::double, 6) AS repeat_rate FROM r GROUP BY video_id")
def repeat_rate(segments: DataFrame) -> DataFrame:
    """Share of tokens that repeat the one before."""
    rows = tokens(segments).withColumn("prev", F.lag("w").over(Window.partitionBy("video_id").orderBy("seg_no", "i")))
    return rows.groupBy("video_id").agg(F.round(F.sum(F.when(F.col("w") == F.col("prev"), 1).otherwise(0)) / F.greatest(F.count("*") - 1, F.lit(1)), 6).alias("repeat_rate"))


_SCORE = f"""WITH t AS ({_TOKENS}), r AS (SELECT *, lag(w) OVER (PARTITION BY video_id, seg_no ORDER BY i) AS prev FROM t),
  a AS (SELECT video_id, seg_no, count(*) AS n, count(DISTINCT w) / count(*)::double AS uniq, sum(CASE WHEN w = prev THEN 1 ELSE 0 END) / greatest(count(*) - 1, 1)::double AS rep, count(*) FILTER (WHERE w IN ('gol', 'kart', 'hakem', 'skor')) AS kw FROM r GROUP BY ALL),
  s AS (SELECT s.video_id, s.seg_no, length(s.text) AS len, CASE WHEN a.n IS NULL THEN -1000.0 ELSE 0.22 * least(n, 180) + 28 * least(1.0, (s.end_sec - s.start_sec) / 15) + 14 * greatest(0.0, least(2.0, s.confidence * 2)) + 16 * (1 - s.confidence / 2) + 1.6 * least(kw, 12) + 10 * uniq - 14 * rep + CASE WHEN s.speaker = 'user' THEN 1.5 ELSE 0 END END AS score
        FROM segments s LEFT JOIN a USING (video_id, seg_no))"""


def transcript_scores(segments: DataFrame) -> DataFrame:
    """(video_id, seg_no, len, score)."""
    prev = F.lag("w").over(Window.partitionBy("video_id", "seg_no").orderBy("i"))
    counted = tokens(segments).withColumn("prev", prev).groupBy("video_id", "seg_no").agg(
        F.count("*").alias("n"), (F.count_distinct("w") / F.count("*")).alias("uniq"),
        (F.sum(F.when(F.col("w") == F.col("prev"), 1).otherwise(0)) / F.greatest(F.count("*") - 1, F.lit(1))).alias("rep"), F.count_if(F.col("w").isin("gol", "kart", "hakem", "skor")).alias("kw"),
    )
    c = F.col("confidence")
    score = (
        0.22 * F.least("n", F.lit(180)) + 28 * F.least(F.lit(1.0), (F.col("end_sec") - F.col("start_sec")) / 15) + 14 * F.greatest(F.lit(0.0), F.least(F.lit(2.0), c * 2)) + 16 * (1 - c / 2)
        + 1.6 * F.least("kw", F.lit(12)) + 10 * F.col("uniq") - 14 * F.col("rep") + F.when(F.col("speaker") == "user", 1.5).otherwise(0)
    )
    return segments.join(counted, ["video_id", "seg_no"], "left").select("video_id", "seg_no", F.length("text").alias("len"), F.when(F.col("n").isNull(), -1000.0).otherwise(score).alias("score"))


@query("e17_transcript_score", "segments", f"{_SCORE} SELECT video_id, seg_no, round(score, 6) AS score FROM s")
def transcript_score(segments: DataFrame) -> DataFrame:
    """Evidence score of a transcript: tokens, coverage, confidence in place of the recogniser's log-probabilities, keywords, variety, repeats."""
    return transcript_scores(segments).select("video_id", "seg_no", F.round("score", 6).alias("score"))


@query("e18_best_candidate", "segments", f"{_SCORE} SELECT video_id, seg_no FROM s QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(score, 6) DESC, len DESC, seg_no) = 1")
def best_candidate(segments: DataFrame) -> DataFrame:
    """Of a video's candidates the one of highest score, then length."""
    return transcript_scores(segments).groupBy("video_id").agg(F.max_by("seg_no", F.struct(F.round("score", 6).alias("s"), "len", -F.col("seg_no"))).alias("seg_no"))


def _sport_sql() -> str:
    low = duck("safe_lower", "text")
    count = lambda ws: " + ".join(f"(length({low}) - length(replace({low}, '{w}', ''))) // {len(w)}" for w in ws)
    only = lambda ws: " + ".join(f"CASE WHEN strpos({low}, '{w}') > 0 THEN 2 ELSE 0 END" for w in ws)
    parts = ", ".join(f"{count(SPORTS[s])} + {only(ONLY[s])} AS {s}" for s in SPORTS)
    return f"""WITH v AS (SELECT video_id, string_agg(text, ' ' ORDER BY seg_no) AS text FROM match_phrases GROUP BY video_id), c AS (SELECT video_id, {parts} FROM v)
      SELECT video_id, CASE WHEN greatest(futbol, basketbol, voleybol) = 0 THEN 'bilinmiyor' WHEN futbol >= basketbol AND futbol >= voleybol THEN 'futbol' WHEN basketbol >= voleybol THEN 'basketbol' ELSE 'voleybol' END AS sport, cast(greatest(futbol, basketbol, voleybol) AS bigint) AS score FROM c"""


def full_text(segments: DataFrame) -> DataFrame:
    """(video_id, text): a video's segments as one text."""
    rows = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "text"))).alias("s"))
    return rows.select("video_id", F.array_join("s.text", " ").alias("text"))


@query("f1_topic", "match_phrases", _sport_sql())
def topic(segments: DataFrame) -> DataFrame:
    """the sport with most keyword occurrences plus 2 for each exclusive keyword present; the first on ties."""
    low = safe_lower("text")

    def score(s: str):
        total = F.lit(0)
        for w in SPORTS[s]:
            total = total + F.expr(f"(length(low) - length(replace(low, '{w}', ''))) DIV {len(w)}")
        for w in ONLY[s]:
            total = total + F.when(F.col("low").contains(w), 2).otherwise(0)
        return total.cast("long").alias(s)

    rows = full_text(segments).select("video_id", low.alias("low")).select("video_id", *[score(s) for s in SPORTS])
    top = F.greatest(*SPORTS)
    return rows.select("video_id", F.when(top == 0, "bilinmiyor").when(F.col("futbol") == top, "futbol").when(F.col("basketbol") == top, "basketbol").otherwise("voleybol").alias("sport"), top.alias("score"))


_CUT_SQL = r"string_split(regexp_replace(regexp_replace(regexp_replace(text, '([0-9])\.\s+(L[İI]G)', '\1.__\2', 'g'), '([!?])\s+|[\r\n]+', '\1' || chr(1), 'g'), '\.\s+([A-ZÇĞİÖŞÜ])', '.' || chr(1) || '\1', 'g'), chr(1))"
_SENTENCES = f"SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY seg_no, i) - 1 AS pos, trim(regexp_replace(replace(s, '.__', '. '), '\\s+', ' ', 'g')) AS sentence FROM (SELECT video_id, seg_no, unnest({_CUT_SQL}) AS s, generate_subscripts({_CUT_SQL}, 1) AS i FROM match_phrases) WHERE trim(regexp_replace(replace(s, '.__', '. '), '\\s+', ' ', 'g')) <> ''"


def sentences(segments: DataFrame) -> DataFrame:
    """(video_id, pos, sentence): sentences in order; '1. Lig' isn't cut."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"([0-9])\.\s+(L[İI]G)", "$1.__$2"), r"([!?])\s+|[\r\n]+", "$1\u0001"), r"\.\s+([A-ZÇĞİÖŞÜ])", ".\u0001$1")
    rows = segments.select("video_id", "seg_no", F.posexplode(F.split(marked, "\u0001")).alias("i", "s"))
    rows = rows.withColumn("sentence", F.trim(F.regexp_replace(F.replace("s", F.lit(".__"), F.lit(". ")), r"\s+", " "))).where("sentence <> ''")
    return rows.select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("seg_no", "i")) - 1).cast("long").alias("pos"), "sentence")


@query("f2_sentence_split", "match_phrases", _SENTENCES)
def sentence_split(segments: DataFrame) -> DataFrame:
    """sentences of a video."""
    return sentences(segments)


@query(
    "e9_evidence_windows", "match_phrases",
    f"""WITH s AS ({_SENTENCES}), h AS (SELECT *, regexp_matches(sentence, '{EVIDENCE}') AS hit FROM s), w AS (SELECT *, bool_or(hit) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h),
    c AS (SELECT *, sum(length(sentence) + 1) OVER (PARTITION BY video_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total FROM w WHERE near) SELECT video_id, pos, sentence, hit FROM c WHERE total <= 1600""",
)
def evidence_windows(segments: DataFrame, budget: int = 1600) -> DataFrame:
    """Sentences with a hint and their neighbours, in order, within a budget of characters."""
    by = Window.partitionBy("video_id").orderBy("pos")
    rows = sentences(segments).withColumn("hit", F.col("sentence").rlike(EVIDENCE))
    near = rows.withColumn("near", F.max("hit").over(by.rowsBetween(-1, 1))).where("near")
    total = F.sum(F.length("sentence") + 1).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("total", total).where(F.col("total") <= budget).select("video_id", "pos", "sentence", "hit")


_SCORES_SQL = f"SELECT video_id, seg_no, unnest(regexp_extract_all(text, '{SCORE}')) AS score, generate_subscripts(regexp_extract_all(text, '{SCORE}'), 1) AS i FROM match_phrases"


def score_mentions(segments: DataFrame) -> DataFrame:
    """(video_id, score, position): scores said, once each, in order."""
    rows = segments.select("video_id", "seg_no", F.posexplode(F.regexp_extract_all("text", F.lit(SCORE), F.lit(0))).alias("i", "score"))
    first = rows.groupBy("video_id", "score").agg(F.min(F.struct("seg_no", "i")).alias("at"))
    return first.select("video_id", "score", F.row_number().over(Window.partitionBy("video_id").orderBy("at")).alias("position"))


@query("f3_score_mentions", "match_phrases", f"WITH s AS ({_SCORES_SQL}), f AS (SELECT video_id, score, min((seg_no, i)) AS place FROM s GROUP BY ALL) SELECT video_id, score, row_number() OVER (PARTITION BY video_id ORDER BY place) AS position FROM f")
def score_list(segments: DataFrame) -> DataFrame:
    """distinct scores of a video in order of mention."""
    return score_mentions(segments)


_FINAL = f"""WITH s AS ({_SCORES_SQL}), f AS (SELECT video_id, score, min((seg_no, i)) AS place FROM s GROUP BY ALL), a AS (SELECT video_id, arg_max(score, place) AS spoken FROM f GROUP BY video_id),
  x AS (SELECT video_id, line_no, regexp_extract(text || CASE WHEN line_no % 5 = 2 THEN ' 2 - 1' WHEN line_no % 5 = 3 AND video_id % 3 = 0 THEN ' 3-0' ELSE '' END, '{SCORE}') AS score FROM lines), b AS (SELECT video_id, arg_min(score, line_no) AS screen FROM x WHERE score <> '' GROUP BY video_id),
  j AS (SELECT coalesce(a.video_id, b.video_id) AS video_id, spoken, screen FROM a FULL JOIN b ON a.video_id = b.video_id)"""


def score_sources(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """(video_id, spoken, screen): the last score said and the first one on screen (two lines of five show one)."""
    spoken = score_mentions(segments).groupBy("video_id").agg(F.max_by("score", "position").alias("spoken"))
    shown = F.concat("text", F.expr("CASE WHEN line_no % 5 = 2 THEN ' 2 - 1' WHEN line_no % 5 = 3 AND video_id % 3 = 0 THEN ' 3-0' ELSE '' END"))
    screen = lines.select("video_id", "line_no", F.regexp_extract(shown, SCORE, 0).alias("score")).where("score <> ''").groupBy("video_id").agg(F.min_by("score", "line_no").alias("screen"))
    return spoken.join(screen, "video_id", "full")


@query("f4_score_reconciliation", "match_phrases lines", f"{_FINAL} SELECT video_id, spoken, screen, coalesce(screen, spoken) AS final_score, CASE WHEN spoken = screen THEN 'both' WHEN spoken IS NOT NULL AND screen IS NOT NULL THEN 'screen over speech' WHEN spoken IS NOT NULL THEN 'speech only' ELSE 'screen only' END AS source FROM j")
def score_reconciliation(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """the final score: the screen wins over speech where they differ."""
    rows = score_sources(segments, lines)
    source = F.when(F.col("spoken") == F.col("screen"), "both").when(F.col("spoken").isNotNull() & F.col("screen").isNotNull(), "screen over speech").when(F.col("spoken").isNotNull(), "speech only").otherwise("screen only")
    return rows.select("video_id", "spoken", "screen", F.coalesce("screen", "spoken").alias("final_score"), source.alias("source"))


def _told(segments: DataFrame, pattern: str, **groups: int) -> DataFrame:
    """(video_id, m, and one column a group) of each place where the pattern holds."""
    parts = {"m": 0, **groups}
    rows = segments.select("video_id", *[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(c) for c, g in parts.items()])
    return rows.select("video_id", F.explode(F.arrays_zip(*parts)).alias("z")).select("video_id", "z.*")


def _sql_told(pattern: str, **groups: int) -> str:
    return "SELECT video_id, " + ", ".join(f"unnest(regexp_extract_all(text, '{pattern}', {g})) AS {c}" for c, g in {"m": 0, **groups}.items()) + " FROM match_phrases"


_GOALS = f"""n AS (SELECT DISTINCT video_id FROM match_phrases WHERE regexp_matches({duck('safe_lower', 'text')}, '{NO_GOAL}')),
  g AS ({" UNION ALL ".join(_sql_told(p, minute=m, player=n) for p, m, n in GOALS)}), e AS (SELECT video_id, cast(minute AS integer) AS minute, trim(player) AS player FROM g WHERE NOT regexp_matches({duck('safe_lower', 'm')}, '{FALSE_GOAL}')),
  u AS (SELECT DISTINCT video_id, minute, player FROM e WHERE video_id NOT IN (SELECT video_id FROM n))"""


@query("f5_goals", "match_phrases", f"WITH {_GOALS} SELECT * FROM u")
def goals(segments: DataFrame) -> DataFrame:
    """minute and player of each goal by three ways to tell it, once; chances that sound like goals don't count, and none
    does in a video that says there was no goal."""
    none = segments.where(safe_lower("text").rlike(NO_GOAL)).select("video_id").distinct()
    found = reduce(DataFrame.unionByName, [_told(segments, p, minute=m, player=n) for p, m, n in GOALS]).where(~safe_lower("m").rlike(FALSE_GOAL))
    return found.select("video_id", F.col("minute").cast("int").alias("minute"), F.trim("player").alias("player")).distinct().join(none, "video_id", "left_anti")


_CARDS_SQL = " UNION ALL ".join(_sql_told(p, kind=k, minute=m, player=n) for p, k, m, n in CARDS)


@query("f6_cards", "match_phrases", f"SELECT DISTINCT video_id, CASE WHEN regexp_matches(kind, '(?i)^(k|red)') THEN 'kırmızı kart' ELSE 'sarı kart' END AS kind, cast(minute AS integer) AS minute, trim(player) AS player FROM ({_CARDS_SQL})")
def cards(segments: DataFrame) -> DataFrame:
    """kind, minute and player of each card by four ways to tell it, summaries included, once; a minute right behind the
    kind is taken for red cards too."""
    found = reduce(DataFrame.unionByName, [_told(segments, p, kind=k, minute=m, player=n) for p, k, m, n in CARDS])
    kind = F.when(F.col("kind").rlike("(?i)^(k|red)"), "kırmızı kart").otherwise("sarı kart")
    return found.select("video_id", kind.alias("kind"), F.col("minute").cast("int").alias("minute"), F.trim("player").alias("player")).distinct()


_TEAMS = r"([A-ZÇĞİÖŞÜ][\p{L}]+)\s+[0-9]{1,3}\s*[-–—:]\s*[0-9]{1,3}\s+([A-ZÇĞİÖŞÜ][\p{L}]+)"


@query("f7_teams", "match_phrases manifest", rf"""WITH t AS (SELECT video_id, seg_no, regexp_extract(text, '{_TEAMS}', 1) AS home, regexp_extract(text, '{_TEAMS}', 2) AS away FROM match_phrases), f AS (SELECT video_id, arg_min(home, seg_no) AS home, arg_min(away, seg_no) AS away FROM t WHERE home <> '' GROUP BY video_id),
    n AS (SELECT video_id, regexp_extract(filename, '-([A-Z]+)_', 1) AS home, regexp_extract(filename, '_([A-Z]+)\.mp4$', 1) AS away FROM manifest), v AS (SELECT DISTINCT video_id FROM match_phrases)
    SELECT v.video_id, coalesce(f.home, nullif(n.home, '')) AS home, coalesce(f.away, nullif(n.away, '')) AS away, CASE WHEN f.home IS NOT NULL THEN 'transcript' WHEN n.home <> '' THEN 'filename' ELSE 'none' END AS source FROM v LEFT JOIN f USING (video_id) LEFT JOIN n USING (video_id)""")  # fmt: skip
def teams(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """the two teams by the first score sentence, else by the file name."""
    said = segments.select("video_id", "seg_no", F.regexp_extract("text", _TEAMS, 1).alias("home"), F.regexp_extract("text", _TEAMS, 2).alias("away")).where("home <> ''")
    first = said.groupBy("video_id").agg(F.min_by(F.struct("home", "away"), "seg_no").alias("f"))
    named = manifest.select("video_id", F.regexp_extract("filename", "-([A-Z]+)_", 1).alias("nh"), F.regexp_extract("filename", r"_([A-Z]+)\.mp4$", 1).alias("na"))
    rows = segments.select("video_id").distinct().join(first, "video_id", "left").join(named, "video_id", "left")
    source = F.when(F.col("f").isNotNull(), "transcript").when(F.col("nh") != "", "filename").otherwise("none")
    return rows.select("video_id", F.coalesce("f.home", F.nullif("nh", F.lit(""))).alias("home"), F.coalesce("f.away", F.nullif("na", F.lit(""))).alias("away"), source.alias("source"))


#: How officials, league and city are told, and words that look like a city's.
_OFFICIAL = r"[A-ZÇĞİÖŞÜ][\p{L}\p{N}_]+"
_CUT, _CUT_END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
FACTS = {
    "referee": rf"(?i)ma[çc][ıi]n hakemi\s+({_OFFICIAL}(?:\s+{_OFFICIAL})+)",
    "assistant": rf"(?i)({_OFFICIAL}(?:\s+{_OFFICIAL})*)\s+ve\s+{_OFFICIAL}(?:\s+{_OFFICIAL})*\s+birinci yard[ıi]mc[ıi]lar[ıi]",
    "second_assistant": rf"(?i){_OFFICIAL}(?:\s+{_OFFICIAL})*\s+ve\s+({_OFFICIAL}(?:\s+{_OFFICIAL})*)\s+birinci yard[ıi]mc[ıi]lar[ıi]",
    "fourth_official": rf"(?i)({_OFFICIAL}(?:\s+{_OFFICIAL})+)\s+da\s+d[öo]rd[üu]nc[üu]\s+hakem",
    "league": rf"(?i){_CUT}((?:PTT|TFF|BANK ASYA)\s*1\.\s*L[İI]G(?:DE|D[EI])?|S[ÜU]PER L[İI]G){_CUT_END}",
}
CITY = rf"{_CUT}([A-ZÇĞİÖŞÜ][a-zçğıöşü]+)'de{_CUT_END}"
NO_CITY = ("lig", "maç", "dakika", "skor", "gol", "set", "periyot")
_FACTS_SQL = ", ".join(f"arg_min({n}, seg_no) FILTER (WHERE {n} <> '') AS {n}" for n in [*FACTS, "city"])
_FACT_SQL = ", ".join(f"regexp_extract(text, '{p}', 1) AS {n}" for n, p in FACTS.items())
_CITY_SQL = f"""coalesce(list_filter(regexp_extract_all(text, '{CITY.replace("'", "''")}', 1), lambda c: lower(c) NOT IN ({', '.join(f"'{w}'" for w in NO_CITY)}))[1], '')"""


@query("f7_match_facts", "match_reports", f"WITH f AS (SELECT video_id, seg_no, {_FACT_SQL}, {_CITY_SQL} AS city FROM match_reports) SELECT video_id, {_FACTS_SQL} FROM f GROUP BY video_id")
def match_facts(segments: DataFrame) -> DataFrame:
    """F7's officials, league and city: of each the first segment that tells it; null where none does."""
    cities = F.filter(F.regexp_extract_all("text", F.lit(CITY), F.lit(1)), lambda c: ~F.lower(c).isin(*NO_CITY))
    told = segments.select("video_id", "seg_no", *[F.regexp_extract("text", p.replace("(?i)", "(?iu)"), 1).alias(n) for n, p in FACTS.items()], F.coalesce(F.get(cities, F.lit(0)), F.lit("")).alias("city"))
    first = lambda n: F.min_by(n, F.when(F.col(n) != "", F.col("seg_no"))).alias(n)
    return told.groupBy("video_id").agg(*[first(n) for n in [*FACTS, "city"]])


@query("f8_cross_check", "match_phrases lines", f"{_FINAL}, {_GOALS}, k AS (SELECT video_id, count(*) AS goals FROM u GROUP BY video_id) SELECT j.video_id, CASE WHEN spoken = screen THEN 'confirmed' WHEN spoken IS NOT NULL AND screen IS NOT NULL THEN 'differs' ELSE 'one source' END AS score_state, coalesce(k.goals, 0) AS goals FROM j LEFT JOIN k USING (video_id)")
def cross_check(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """F8: does the screen confirm the spoken score, and how many goals were told?"""
    state = F.when(F.col("spoken") == F.col("screen"), "confirmed").when(F.col("spoken").isNotNull() & F.col("screen").isNotNull(), "differs").otherwise("one source")
    counted = goals(segments).groupBy("video_id").agg(F.count("*").alias("goals"))
    return score_sources(segments, lines).join(counted, "video_id", "left").select("video_id", state.alias("score_state"), F.coalesce("goals", F.lit(0)).alias("goals"))


@query("c22_event_dedup", "match_phrases", "SELECT video_id, lower(trim(speaker)) AS speaker, lower(trim(text)) AS text, min(seg_no) AS seg_no FROM match_phrases GROUP BY ALL")
def event_dedup(segments: DataFrame) -> DataFrame:
    """Events once each by their trimmed, lower-cased columns; the first stays."""
    return segments.groupBy("video_id", F.lower(F.trim("speaker")).alias("speaker"), F.lower(F.trim("text")).alias("text")).agg(F.min("seg_no").alias("seg_no"))


#: Marker words of both languages, word endings, and endings behind an apostrophe.
_MARKERS = "ve bir bu ile icin için gibi daha sonra ancak kadar degil değil film hikaye karar olur eder olan olarak kendi ona onu onun bunu böyle yine artik artık".split()
_ENGLISH = "the and with from that this into after before while when their they his her ultimately chooses teacher soldier exchange relationship secret".split()
_ENDINGS = "(iyor|iyorlar|erek|arak|madan|meden|ince|unca|ip)$"
_APOSTROPHE = r"['’](i|ı|u|ü|in|ın|un|ün|e|a|de|da|den|dan|ye|ya|nin|nın|nun|nün)($|[^\p{L}\p{N}_])"
_WORD = "[A-Za-zÀ-ÖØ-öø-ÿÇĞİÖŞÜçğıöşü']+"
_OWN_LETTERS = "[çÇğĞıİöÖşŞüÜ]"


@query(
    "b27_language_validity", "documents",
    rf"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL), w AS (SELECT *, {duck('safe_lower', 'text')} AS low, regexp_extract_all({duck('safe_lower', 'text')}, '{_WORD.replace("'", "''")}') AS w FROM d),
    m AS (SELECT doc_id, text, len(regexp_extract_all(text, '\p{{L}}')) AS n, len(regexp_extract_all(text, '\p{{Latin}}')) AS latin, regexp_matches(text, '{_OWN_LETTERS}') AS own, regexp_matches(low, '{_APOSTROPHE.replace("'", "''")}') AS apostrophe,
          len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in _MARKERS)}))) AS marker_hits, len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in _ENGLISH)}))) AS english_hits, len(list_filter(w, lambda x: regexp_matches(x, '{_ENDINGS}'))) AS ending_hits FROM w)
    SELECT doc_id, marker_hits, english_hits, ending_hits, CASE WHEN text = '' THEN 'empty' WHEN length(text) < 20 OR n = 0 OR latin < 0.7 * n OR NOT (own OR apostrophe OR (marker_hits >= 2 AND marker_hits > english_hits) OR (ending_hits >= 1 AND english_hits = 0)) THEN 'not_turkish'
      WHEN latin < n THEN 'non_latin_script' ELSE 'valid' END AS verdict FROM m""",
)
def language_validity(documents: DataFrame) -> DataFrame:
    """A text of 20 characters or more whose letters are Latin to 70 % is Turkish by one of its letters, an ending behind an
    apostrophe, two marker words or more that outnumber the English ones, or a word ending without any English marker; a
    Turkish text with a letter of another script is rejected all the same."""
    rows = documents.where("text IS NOT NULL").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).withColumn("low", safe_lower("text"))
    w = F.regexp_extract_all("low", F.lit(_WORD), F.lit(0))
    count = lambda test: F.size(F.filter(w, test)).cast("long")
    rows = rows.select(
        "doc_id", "text", F.regexp_count("text", F.lit(r"\p{L}")).alias("n"), F.regexp_count("text", F.lit(r"\p{IsLatin}")).alias("latin"),
        (F.col("text").rlike(_OWN_LETTERS) | F.col("low").rlike(_APOSTROPHE)).alias("own"),
        count(lambda x: x.isin(*_MARKERS)).alias("marker_hits"), count(lambda x: x.isin(*_ENGLISH)).alias("english_hits"), count(lambda x: x.rlike(_ENDINGS)).alias("ending_hits"),
    )
    votes = ((F.col("marker_hits") >= 2) & (F.col("marker_hits") > F.col("english_hits"))) | ((F.col("ending_hits") >= 1) & (F.col("english_hits") == 0))
    turkish = (F.length("text") >= 20) & (F.col("n") > 0) & (F.col("latin") >= 0.7 * F.col("n")) & (F.col("own") | votes)
    verdict = F.when(F.col("text") == "", "empty").when(~turkish, "not_turkish").when(F.col("latin") < F.col("n"), "non_latin_script").otherwise("valid")
    return rows.select("doc_id", "marker_hits", "english_hits", "ending_hits", verdict.alias("verdict"))


@query("f10_tagged_words", "documents", r"SELECT doc_id, i AS position, tag FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([A-Z][a-z]+)([.,])', '[[\1]]\2', 'g'), '\[\[([^\]]+)\]\]', 1)) AS tag, generate_subscripts(regexp_extract_all(regexp_replace(text, '([A-Z][a-z]+)([.,])', '[[\1]]\2', 'g'), '\[\[([^\]]+)\]\]', 1), 1) AS i FROM documents)")
def tagged_words(documents: DataFrame) -> DataFrame:
    """tagged foreign words of a text in order (here capitalised words before a comma or full stop are tagged first)."""
    tagged = F.regexp_replace("text", "([A-Z][a-z]+)([.,])", r"[[$1]]$2")
    rows = documents.select("doc_id", F.posexplode(F.regexp_extract_all(tagged, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("pos", "tag"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("position"), "tag")
