"""Words with boxes: font classes, votes, columns, rows, pairs and stacked names; frames by score and by confidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.keys import duck, name_key
from reelmill.plans.registry import query

#: Width of a frame's text area, in the boxes' units.
WIDTH = 880.0


@query("b7_adaptive_threshold", "lines", """WITH p AS (SELECT video_id, quantile_cont(confidence, 0.80) AS p80 FROM lines GROUP BY video_id), t AS (SELECT video_id, CASE WHEN p80 < 0.75 THEN greatest(0.36, 0.85 * p80) ELSE 0.75 END AS thr FROM p)
    SELECT l.video_id, l.line_no, round(t.thr, 6) AS threshold FROM lines l JOIN t USING (video_id) WHERE l.confidence >= t.thr AND (length(l.text) >= 4 OR l.confidence >= 0.95)""")  # fmt: skip
def adaptive_threshold(lines: DataFrame, base: float = 0.75, floor: float = 0.36) -> DataFrame:
    """A video's threshold falls to .85 of its 80th percentile where that is below the preset; presets here are three times those of
    textness scores, as the score column is a confidence. Rows without much text need a high score."""
    p80 = lines.groupBy("video_id").agg(F.percentile("confidence", 0.80).alias("p80"))
    thr = p80.select("video_id", F.when(F.col("p80") < base, F.greatest(F.lit(floor), 0.85 * F.col("p80"))).otherwise(base).alias("thr"))
    rows = lines.join(thr, "video_id").where((F.col("confidence") >= F.col("thr")) & ((F.length("text") >= 4) | (F.col("confidence") >= 0.95)))
    return rows.select("video_id", "line_no", F.round("thr", 6).alias("threshold"))


@query("b8_quota_sampling", "lines", """WITH r AS (SELECT video_id, line_no, frame_no % 2 AS segment, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY video_id, frame_no % 2) AS n FROM lines WINDOW w AS (PARTITION BY video_id, frame_no % 2 ORDER BY line_no)),
    k AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment ORDER BY r) AS pick FROM r WHERE r % greatest(n // 4, 1) = 0) SELECT video_id, segment, line_no, 0.5::double AS score FROM k WHERE pick <= 4""")  # fmt: skip
def quota_sampling(lines: DataFrame, limit: int = 4) -> DataFrame:
    """Every (n / limit)-th row of a segment, the first `limit` of them, with a default score."""
    by = Window.partitionBy("video_id", "segment")
    rows = lines.withColumn("segment", F.col("frame_no") % 2).withColumn("r", F.row_number().over(by.orderBy("line_no")) - 1).withColumn("n", F.count("*").over(by))
    step = F.greatest(F.floor(F.col("n") / limit), F.lit(1))
    picked = rows.where(F.col("r") % step == 0).withColumn("pick", F.row_number().over(by.orderBy("r"))).where(F.col("pick") <= limit)
    return picked.select("video_id", "segment", "line_no", F.lit(0.5).alias("score"))


@query("b9_textness", "words", """WITH f AS (SELECT video_id, frame_no, sum((x2 - x1) * (y2 - y1)) / (880.0 * 200.0) AS edge, avg((x2 - x1) / 880.0) AS horiz, count(*) AS blobs, avg(cast(confidence AS decimal(18, 9)))::double AS contrast FROM words GROUP BY ALL)
    SELECT video_id, frame_no, round(0.35 * least(edge / 0.15, 1.0) + 0.30 * least(horiz / 0.05, 1.0) + 0.35 * least(blobs / 15.0::double, 1.0), 6) AS textness, CASE WHEN contrast >= 0.8 THEN 'easy' WHEN contrast >= 0.6 THEN 'medium' ELSE 'hard' END AS difficulty FROM f""")  # fmt: skip
def textness(words: DataFrame) -> DataFrame:
    """Three features of a frame in one score, and how hard it is to read."""
    features = words.groupBy("video_id", "frame_no").agg(
        (F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / (WIDTH * 200.0)).alias("edge"), F.avg((F.col("x2") - F.col("x1")) / WIDTH).alias("horiz"), F.count("*").alias("blobs"), F.avg(F.col("confidence").cast("decimal(18,9)")).cast("double").alias("contrast"),
    )
    one = F.lit(1.0)
    score = 0.35 * F.least(F.col("edge") / 0.15, one) + 0.30 * F.least(F.col("horiz") / 0.05, one) + 0.35 * F.least(F.col("blobs") / 15.0, one)
    return features.select("video_id", "frame_no", F.round(score, 6).alias("textness"), F.when(F.col("contrast") >= 0.8, "easy").when(F.col("contrast") >= 0.6, "medium").otherwise("hard").alias("difficulty"))


_FONT = "CASE WHEN count(*) < 2 THEN 'unknown' WHEN round(stddev_pop(y2 - y1) / avg(y2 - y1), 9) < 0.05 AND round(avg(cast(confidence AS decimal(18, 9)))::double, 9) < 0.80 THEN 'standard' WHEN round(stddev_pop(y2 - y1) / avg(y2 - y1), 9) > 0.062 OR round(avg(cast(confidence AS decimal(18, 9)))::double, 9) > 0.90 THEN 'handwriting' ELSE 'decorative' END"


def font_classes(words: DataFrame) -> DataFrame:
    """(video_id, frame_no, font_type) by the spread of box heights and a density (here the mean confidence)."""
    h = F.col("y2") - F.col("y1")
    cv, density = F.round(F.stddev_pop(h) / F.avg(h), 9), F.round(F.avg(F.col("confidence").cast("decimal(18,9)")).cast("double"), 9)
    kind = F.when(F.count("*") < 2, "unknown").when((cv < 0.05) & (density < 0.80), "standard").when((cv > 0.062) | (density > 0.90), "handwriting").otherwise("decorative")
    return words.groupBy("video_id", "frame_no").agg(kind.alias("font_type"))


@query("c27_font_class", "words", f"SELECT video_id, frame_no, {_FONT} AS font_type FROM words GROUP BY ALL")
def font_class(words: DataFrame) -> DataFrame:
    """Font class of each frame."""
    return font_classes(words)


@query("c28_name_table_ratio", "lines readings name_list", f"WITH k AS (SELECT DISTINCT {duck('name_key', 'primary_name')} AS key FROM name_list) SELECT video_id, count(*) AS n, round(count(k.key) / count(*)::double, 6) AS ratio FROM readings p LEFT JOIN k ON k.key = {duck('name_key', 'p.name')} WHERE length(trim(p.name)) >= 4 GROUP BY video_id")
def name_table_ratio(_lines: DataFrame, persons: DataFrame, names: DataFrame) -> DataFrame:
    """Share of a video's texts of four characters or more that the name table has."""
    known = names.select(name_key("primary_name").alias("key")).distinct().withColumn("hit", F.lit(1))
    rows = persons.where(F.length(F.trim("name")) >= 4).withColumn("key", name_key("name")).join(known, "key", "left")
    return rows.groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.count("hit") / F.count("*"), 6).alias("ratio"))


@query(
    "b22_recheck_selection", "lines name_list",
    f"""WITH k AS (SELECT DISTINCT {duck('name_key', 'primary_name')} AS key FROM name_list), l AS (SELECT *, length(text) - length(replace(text, ' ', '')) BETWEEN 1 AND 3 AS name_like, len(regexp_extract_all(text, '[\\p{{L}} ]')) >= 0.8 * length(text) AS good FROM lines)
    SELECT l.video_id, l.frame_no, count(*) AS n FROM l LEFT JOIN k ON k.key = {duck('name_key', 'l.text')} WHERE l.confidence >= 0.60 AND NOT (l.confidence >= 0.80 AND l.good AND NOT (l.name_like AND k.key IS NULL)) GROUP BY ALL""",
)
def recheck_selection(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Lines worth a second reading, by frame: not too unclear, and not clear and good unless like a name that the table lacks."""
    known = names.select(name_key("primary_name").alias("key")).distinct().withColumn("known", F.lit(True))
    text = F.col("text")
    rows = lines.withColumn("key", name_key("text")).join(known, "key", "left")
    name_like = (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).between(1, 3)
    good = F.regexp_count(text, F.lit(r"[\p{L} ]")) >= 0.8 * F.length(text)
    skip = (F.col("confidence") >= 0.80) & good & ~(name_like & F.col("known").isNull())
    return rows.where((F.col("confidence") >= 0.60) & ~skip).groupBy("video_id", "frame_no").agg(F.count("*").alias("n"))


@query(
    "b24_frame_routing", "lines words readings name_list",
    f"""WITH k AS (SELECT DISTINCT {duck('name_key', 'primary_name')} AS key FROM name_list), r AS (SELECT video_id, count(k.key) / count(*)::double AS ratio FROM readings p LEFT JOIN k ON k.key = {duck('name_key', 'p.name')} GROUP BY video_id),
    f AS (SELECT video_id, frame_no, {_FONT} AS font_type FROM words GROUP BY ALL), c AS (SELECT video_id, frame_no, avg(cast(confidence AS decimal(18, 9)))::double - 0.45 AS conf FROM lines GROUP BY ALL)
    SELECT c.video_id, c.frame_no, f.font_type FROM c LEFT JOIN f USING (video_id, frame_no) LEFT JOIN r USING (video_id) WHERE coalesce(r.ratio, 0) < 0.60 AND (c.conf < 0.20 OR (c.conf < 0.30 AND coalesce(f.font_type, 'unknown') <> 'standard'))""",
)
def frame_routing(lines: DataFrame, words: DataFrame, persons: DataFrame, names: DataFrame) -> DataFrame:
    """Frames for the second reader: very unclear, or unclear and not of standard font; none of a video whose names are mostly known (confidences less .45)."""
    ratio = name_table_ratio(lines, persons, names).select("video_id", "ratio")
    conf = lines.groupBy("video_id", "frame_no").agg((F.avg(F.col("confidence").cast("decimal(18,9)")).cast("double") - 0.45).alias("conf"))
    rows = conf.join(font_classes(words), ["video_id", "frame_no"], "left").join(ratio, "video_id", "left")
    unclear = (F.col("conf") < 0.20) | ((F.col("conf") < 0.30) & (F.coalesce("font_type", F.lit("unknown")) != "standard"))
    return rows.where((F.coalesce("ratio", F.lit(0.0)) < 0.60) & unclear).select("video_id", "frame_no", "font_type")


@query(
    "b25_escalation", "lines persons",
    """WITH l AS (SELECT video_id, avg(cast(confidence AS decimal(18, 9)))::double AS conf, count(*) AS n, count(DISTINCT frame_no) AS frames, count(*) FILTER (WHERE confidence < 0.6) AS repaired FROM lines GROUP BY video_id), p AS (SELECT video_id, count(*) AS people FROM persons GROUP BY video_id)
    SELECT video_id, array_to_string(list_filter([CASE WHEN conf < 0.65 THEN 'confidence' END, CASE WHEN n / frames::double < 3.0 THEN 'few_lines' END, CASE WHEN coalesce(people, 0) < 3 THEN 'few_people' END, CASE WHEN repaired / n::double > 0.30 THEN 'repairs' END], lambda x: x IS NOT NULL), ',') AS triggers FROM l LEFT JOIN p USING (video_id)""",
)
def escalation(lines: DataFrame, persons: DataFrame, least_lines: float = 3.0) -> DataFrame:
    """What speaks for another reading of a video: low confidence, few lines a frame, few people, many repairs."""
    facts = lines.groupBy("video_id").agg(F.avg(F.col("confidence").cast("decimal(18,9)")).cast("double").alias("conf"), F.count("*").alias("n"), F.count_distinct("frame_no").alias("frames"), F.count_if(F.col("confidence") < 0.6).alias("repaired"))
    rows = facts.join(persons.groupBy("video_id").agg(F.count("*").alias("people")), "video_id", "left").na.fill(0, ["people"])
    found = F.array(F.when(F.col("conf") < 0.65, "confidence"), F.when(F.col("n") / F.col("frames") < least_lines, "few_lines"), F.when(F.col("people") < 3, "few_people"), F.when(F.col("repaired") / F.col("n") > 0.30, "repairs"))
    return rows.select("video_id", F.array_join(F.array_compact(found), ",").alias("triggers"))


_PAIRS = "p AS (SELECT a.video_id, a.frame_no, a.line_no, lower(a.text) AS left_text, lower(b.text) AS right_text, a.text AS l, b.text AS r, (a.confidence + b.confidence) / 2 * (0.60 + 0.40 * least(1.0, (b.x1 - a.x2) / 132.0)) AS confidence FROM words a JOIN words b ON a.video_id = b.video_id AND a.line_no = b.line_no AND b.wpos = a.wpos + 1 WHERE b.x1 - a.x2 > 44.0)"


def pairs(words: DataFrame) -> DataFrame:
    """Neighbouring words of a line with a gap of over 5 % of the width, as (left, right) pairs."""
    by = Window.partitionBy("video_id", "line_no").orderBy("wpos")
    rows = words.withColumn("r", F.lead("text").over(by)).withColumn("rx", F.lead("x1").over(by)).withColumn("rc", F.lead("confidence").over(by)).where("rx - x2 > 44.0")
    conf = (F.col("confidence") + F.col("rc")) / 2 * (0.60 + 0.40 * F.least(F.lit(1.0), (F.col("rx") - F.col("x2")) / 132.0))
    return rows.select("video_id", "frame_no", "line_no", F.col("text").alias("l"), "r", conf.alias("confidence"))


@query("e6_left_right_pairs", "words", f"WITH {_PAIRS} SELECT video_id, line_no, l AS character_name, r AS actor_name, round(confidence, 6) AS confidence FROM p", dealt="lines")
def left_right_pairs(words: DataFrame) -> DataFrame:
    """Pairs of a character and an actor across a gap; the confidence falls with a narrow gap."""
    return pairs(words).select("video_id", "line_no", F.col("l").alias("character_name"), F.col("r").alias("actor_name"), F.round("confidence", 6).alias("confidence"))


@query("c8_first_pair", "words", f"WITH {_PAIRS} SELECT video_id, left_text, right_text, min(line_no) AS line_no FROM p GROUP BY ALL", dealt="lines")
def first_pair(words: DataFrame) -> DataFrame:
    """Each pair once, the first stays."""
    return pairs(words).groupBy("video_id", F.lower("l").alias("left_text"), F.lower("r").alias("right_text")).agg(F.min("line_no").alias("line_no"))


@query("c9_best_pair", "words", f"WITH {_PAIRS} SELECT video_id, left_text, right_text, round(max(confidence), 6) AS confidence FROM p GROUP BY ALL", dealt="lines")
def best_pair(words: DataFrame) -> DataFrame:
    """Each pair once, of highest confidence."""
    return pairs(words).groupBy("video_id", F.lower("l").alias("left_text"), F.lower("r").alias("right_text")).agg(F.round(F.max("confidence"), 6).alias("confidence"))


_GAPS = "g AS (SELECT video_id, frame_no, line_no, max(CASE WHEN nx - x2 > 80.0 THEN 1 ELSE 0 END) AS gap, count(*) AS n FROM (SELECT *, lead(x1) OVER (PARTITION BY video_id, line_no ORDER BY wpos) AS nx FROM words) GROUP BY ALL), t AS (SELECT video_id, frame_no, sum(gap) / count(*)::double AS share, count(*) AS n_rows FROM g GROUP BY ALL)"


def column_shares(words: DataFrame) -> DataFrame:
    nx = F.lead("x1").over(Window.partitionBy("video_id", "line_no").orderBy("wpos"))
    rows = words.withColumn("nx", nx).groupBy("video_id", "frame_no", "line_no").agg(F.max(F.when(F.col("nx") - F.col("x2") > 80.0, 1).otherwise(0)).alias("gap"))
    return rows.groupBy("video_id", "frame_no").agg((F.sum("gap") / F.count("*")).alias("share"), F.count("*").alias("n_rows"))


@query("e4_two_columns", "words", f"WITH {_GAPS} SELECT video_id, frame_no, round(share, 6) AS share, share >= 0.4 AS two_columns FROM t")
def two_columns(words: DataFrame) -> DataFrame:
    """A frame has two columns if 40 % of its rows have a wide gap."""
    return column_shares(words).select("video_id", "frame_no", F.round("share", 6).alias("share"), (F.col("share") >= 0.4).alias("two_columns"))


@query("c10_layout_vote", "words", f"WITH {_GAPS}, k AS (SELECT video_id, CASE WHEN share >= 0.4 THEN 'two_columns' ELSE 'single' END AS layout FROM t), c AS (SELECT video_id, layout, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY video_id) AS total FROM c), b AS (SELECT video_id, arg_max(layout, (n, layout)) AS layout, max(n) AS n, max(total) AS total FROM s GROUP BY video_id) SELECT video_id, CASE WHEN n / total::double < 0.4 THEN 'single' ELSE layout END AS layout, round(n / total::double, 6) AS share FROM b")
def layout_vote(words: DataFrame) -> DataFrame:
    """The most frequent layout of a video's frames, single if it has less than 40 %."""
    kinds = column_shares(words).select("video_id", F.when(F.col("share") >= 0.4, "two_columns").otherwise("single").alias("layout")).groupBy("video_id", "layout").agg(F.count("*").alias("n"))
    best = kinds.groupBy("video_id").agg(F.max_by("layout", F.struct("n", "layout")).alias("layout"), F.max("n").alias("n"), F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return best.select("video_id", F.when(share < 0.4, "single").otherwise(F.col("layout")).alias("layout"), F.round(share, 6).alias("share"))


@query("e3_row_grouping", "words", "WITH c AS (SELECT *, (y1 + y2) / 2 AS y FROM words), g AS (SELECT *, CASE WHEN y - lag(y) OVER w > 12.0 THEN 1 ELSE 0 END AS gap FROM c WINDOW w AS (PARTITION BY video_id, frame_no ORDER BY y, line_no, wpos)), r AS (SELECT *, sum(gap) OVER (PARTITION BY video_id, frame_no ORDER BY y, line_no, wpos ROWS UNBOUNDED PRECEDING) AS row_no FROM g) SELECT video_id, frame_no, cast(row_no AS bigint) AS row_no, count(*) AS n, round(avg(y), 6) AS y_center FROM r GROUP BY ALL")
def row_grouping(words: DataFrame, gap: float = 12.0) -> DataFrame:
    """E3, by fixed gaps: words of a frame in rows."""
    by = Window.partitionBy("video_id", "frame_no").orderBy("y", "line_no", "wpos")
    rows = words.withColumn("y", (F.col("y1") + F.col("y2")) / 2)
    rows = rows.withColumn("gap", F.when(F.col("y") - F.lag("y").over(by) > gap, 1).otherwise(0)).withColumn("row_no", F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("video_id", "frame_no", "row_no").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("y_center"))


@query("e3_row_grouping_exact", "words")
def row_grouping_exact(words: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """Rows by the running mean of their centres: a word joins the row in hand while it is within the tolerance of its mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, mean, n = None, -1, 0.0, 0
        for batch in batches:
            out = []
            for video, frame, y in zip(*(batch.column(c).to_pylist() for c in ("video_id", "frame_no", "y")), strict=True):
                if (video, frame) != now:
                    now, row, mean, n = (video, frame), -1, 0.0, 0
                if n and abs(y - mean) <= tolerance:
                    mean, n = (mean * n + y) / (n + 1), n + 1
                else:
                    row, mean, n = row + 1, y, 1
                out.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int64())], [*batch.schema.names[:4], "row_no"])

    centre = F.coalesce((F.col("y1") + F.col("y2")) / 2, F.lit(float("nan")))
    boxes = words.select("video_id", "frame_no", "line_no", "wpos", centre.alias("y")).repartition("video_id", "frame_no")
    boxes = boxes.sortWithinPartitions("video_id", "frame_no", "y", "line_no", "wpos")
    return boxes.mapInArrow(run, "video_id long, frame_no long, line_no long, wpos long, row_no long")


@query("e5_column_separator", "words")
def column_separator(words: DataFrame, rounds: int = 10) -> DataFrame:
    """E5: where a frame's two columns part: two means of the words' centres from the quartiles, midway between them, kept within 25-75 % of the width; half the width for fewer than four words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = batch.column("x").flatten().to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
            first, at = np.cumsum(size) - size, np.full(len(size), WIDTH / 2)
            live = np.flatnonzero(size >= 4)
            a, b = np.zeros(len(size)), np.zeros(len(size))
            a[live], b[live] = x[first[live] + size[live] // 4], x[first[live] + 3 * size[live] // 4]
            able, of = live, np.repeat(np.arange(len(size)), size)
            for _ in range(rounds):
                if not len(live):
                    break
                moving = np.zeros(len(size), dtype=bool)
                moving[live] = True
                rows = moving[of]
                x, of = x[rows], of[rows]
                left = np.abs(x - a[of]) <= np.abs(x - b[of])
                n_left = np.bincount(of[left], minlength=len(size))
                live = live[(n_left[live] > 0) & (n_left[live] < size[live])]
                sums = [np.bincount(of[side], weights=x[side], minlength=len(size)) for side in (left, ~left)]
                na, nb = sums[0][live] / n_left[live], sums[1][live] / (size - n_left)[live]
                changed = (na != a[live]) | (nb != b[live])
                live = live[changed]
                a[live], b[live] = na[changed], nb[changed]
            at[able] = np.clip((a[able] + b[able]) / 2, 0.25 * WIDTH, 0.75 * WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at)], ["video_id", "frame_no", "separator"])

    centres = F.array_sort(F.collect_list((F.col("x1") + F.col("x2")) / 2))
    frames = words.groupBy("video_id", "frame_no").agg(centres.alias("x")).withColumn("n", F.size("x"))
    return frames.mapInArrow(run, "video_id long, frame_no long, separator double")


#: A header word, least gap between words and largest shift of centres as shares of the width, and the
#: distance of rows in heights of the upper one.
HEADER_WORD = "^(the|cast|actor|der|le|la|el)$"
LEAST_GAP, MOST_SHIFT, NEAREST, FARTHEST = 0.05 * WIDTH, 0.10 * WIDTH, 0.5, 2.5


@query(
    "e7_stacked_names", "words",
    f"""WITH g AS (SELECT *, lead(x1) OVER (PARTITION BY video_id, frame_no, line_no ORDER BY x1, wpos) - x2 AS gap FROM words),
    r AS (SELECT video_id, frame_no, line_no, count(*) AS n, avg((y1 + y2) / 2) AS y, avg(y2 - y1) AS h, coalesce(min(gap) >= {LEAST_GAP}, true) AS apart, list({{'x': (x1 + x2) / 2, 'wpos': wpos, 'text': text}} ORDER BY (x1 + x2) / 2, wpos) AS w FROM g GROUP BY ALL),
    p AS (SELECT *, n >= 3 AND apart AND NOT regexp_matches(lower(w[1].text), '{HEADER_WORD}') AS able FROM r),
    q AS (SELECT *, lead(able) OVER f AND able AND lead(n) OVER f = n AND lead(y) OVER f - y BETWEEN {NEAREST} * h AND {FARTHEST} * h AS near, lead(w) OVER f AS b FROM p WINDOW f AS (PARTITION BY video_id, frame_no ORDER BY line_no)),
    o AS (SELECT *, coalesce(near AND len(list_filter(range(1, n + 1), lambda i: abs(w[i].x - b[i].x) > {MOST_SHIFT})) = 0, false) AS ok FROM q),
    i AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY video_id, frame_no ORDER BY line_no) AS island FROM o),
    u AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_no, island ORDER BY line_no) AS place FROM i WHERE ok)
    SELECT video_id, line_no, w[k].wpos AS wpos, w[k].text || ' ' || b[k].text AS name FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM u WHERE place % 2 = 1)""",
)
def stacked_names(words: DataFrame) -> DataFrame:
    """Two rows that follow each other with as many words, three at least, clear gaps between them, centres above each other
    and half to two and a half heights apart: the words above each other form a name. No row joins twice: of a run of such
    pairs every other one counts. Rows that begin with a header word stay out."""
    centre = (F.col("x1") + F.col("x2")) / 2
    gap = F.lead("x1").over(Window.partitionBy("video_id", "frame_no", "line_no").orderBy("x1", "wpos")) - F.col("x2")
    rows = words.withColumn("gap", gap).groupBy("video_id", "frame_no", "line_no").agg(
        F.array_sort(F.collect_list(F.struct(centre.alias("x"), "wpos", "text"))).alias("w"), F.avg((F.col("y1") + F.col("y2")) / 2).alias("y"), F.avg(F.col("y2") - F.col("y1")).alias("h"), F.min("gap").alias("gap")
    )
    able = (F.size("w") >= 3) & F.coalesce(F.col("gap") >= LEAST_GAP, F.lit(True)) & ~F.lower(F.col("w")[0]["text"]).rlike(HEADER_WORD)
    frame = Window.partitionBy("video_id", "frame_no").orderBy("line_no")
    below = lambda c: F.lead(c).over(frame)
    both = rows.withColumn("able", able).withColumn("b", below("w")).withColumn("down", below("y") - F.col("y")).withColumn("able", F.col("able") & below("able"))
    near = F.col("able") & (F.size("w") == F.size("b")) & F.col("down").between(NEAREST * F.col("h"), FARTHEST * F.col("h"))
    shifted = F.exists(F.arrays_zip(F.col("w").alias("a"), F.col("b").alias("b")), lambda z: F.abs(z["a"]["x"] - z["b"]["x"]) > MOST_SHIFT)
    pairs = both.withColumn("ok", F.coalesce(near & ~shifted, F.lit(False)))
    pairs = pairs.withColumn("island", F.count_if(~F.col("ok")).over(frame)).where("ok")
    place = F.row_number().over(Window.partitionBy("video_id", "frame_no", "island").orderBy("line_no"))
    used = pairs.withColumn("place", place).where("place % 2 = 1")
    zipped = used.select("video_id", "line_no", F.explode(F.arrays_zip(F.col("w").alias("a"), F.col("b").alias("b"))).alias("z"))
    return zipped.select("video_id", "line_no", F.col("z.a.wpos").alias("wpos"), F.concat_ws(" ", "z.a.text", "z.b.text").alias("name"))


@query("e8_table_header", "words", "WITH f AS (SELECT video_id, frame_no, min(line_no) AS line_no FROM words GROUP BY ALL) SELECT f.video_id, f.frame_no, bool_or(regexp_matches(lower(w.text), '^(the|cast|actor|der|le|la|el)$')) AS has_header FROM f JOIN words w ON w.video_id = f.video_id AND w.line_no = f.line_no GROUP BY ALL")
def table_header(words: DataFrame, pattern: str = "^(the|cast|actor|der|le|la|el)$") -> DataFrame:
    """Does the first row of a frame have a header word?"""
    first = F.min("line_no").over(Window.partitionBy("video_id", "frame_no"))
    rows = words.withColumn("f", first).where("line_no = f")
    return rows.groupBy("video_id", "frame_no").agg(F.bool_or(F.lower("text").rlike(pattern)).alias("has_header"))
