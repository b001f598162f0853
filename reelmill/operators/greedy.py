"""Passes that go by order within a group: greedy fuzzy dedup and clusters, report casing.

A group is a video or a video's role, capped by C6 where the rules cap it; Spark deals groups out, and a pass keeps one
group in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.grouped import by_group
from reelmill.functions.similarity import ratio_of, wratio_of
from reelmill.operators.lines import top_lines
from reelmill.operators.names import noise_score
from reelmill.plans.registry import query

def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Text columns as plain objects, which Arrow takes as one array."""
    return frame.astype({c: object for c in frame.columns if not pd.api.types.is_numeric_dtype(frame[c])})


@query("e2_split_name_merge", "readings name_list", "WITH f AS (SELECT DISTINCT lower(string_split(primary_name, ' ')[1]) AS w FROM name_list), p AS (SELECT video_id, line_no, string_split(name, ' ')[1] AS word, lead(name) OVER (PARTITION BY video_id ORDER BY line_no) AS next_name FROM readings) SELECT p.video_id, p.line_no, p.word || ' ' || p.next_name AS name FROM p JOIN f a ON a.w = lower(p.word) JOIN f b ON b.w = lower(string_split(p.next_name, ' ')[1])")
def split_name_merge(persons: DataFrame, names: DataFrame) -> DataFrame:
    """A row of one first name (here the first word of each) before a row that begins with one is joined with it."""
    first = names.select(F.lower(F.split("primary_name", " ")[0]).alias("w")).distinct()
    rows = persons.select("video_id", "line_no", F.split("name", " ")[0].alias("word"), F.lead("name").over(Window.partitionBy("video_id").orderBy("line_no")).alias("next_name"))
    both = rows.join(first.withColumnRenamed("w", "a"), F.col("a") == F.lower("word")).join(first.withColumnRenamed("w", "b"), F.col("b") == F.lower(F.split("next_name", " ")[0]))
    return both.select("video_id", "line_no", F.concat_ws(" ", "word", "next_name").alias("name"))


def _leaders(texts: list[str], near) -> list[int]:
    """For each text the first earlier leader that it is near, or itself."""
    leaders: list[int] = []
    out = []
    for i, _ in enumerate(texts):
        found = next((j for j in leaders if near(j, i)), i)
        if found == i:
            leaders.append(i)
        out.append(found)
    return out


#: Counters of letter pairs of a text.
PAIRS = 256


def _pair_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount((codes[:-1] * np.uint32(31) + codes[1:]) % PAIRS, minlength=PAIRS).astype(np.int32)


def _time_leaders(low: list[str], seen: np.ndarray) -> list[int]:
    """_leaders with a ratio of 82, or 70 within two seconds. Two texts with s letters in a common order share 3 s - 1 - (all
    their letters) letter pairs at least, as each lost letter parts one pair; these are counted before a pair is scored."""
    size, counts = np.array([len(t) for t in low]), np.stack([_pair_counts(t) for t in low])
    leaders: list[int] = []
    out = []
    for i, text in enumerate(low):
        at = np.array(leaders, dtype=np.int64)
        need = np.where(np.abs(seen[at] - seen[i]) <= 2.0, 70, 82)
        able = 200 * np.minimum(size[at], size[i]) >= need * (size[at] + size[i])
        at, need = at[able], need[able]
        shared = np.minimum(counts[at], counts[i]).sum(axis=1)
        least = need * (size[at] + size[i]) / 200.0
        able = shared >= 3 * least - 1 - size[at] - size[i] - 1e-6
        found = next((j for j, n in zip(at[able].tolist(), need[able].tolist(), strict=True) if ratio_of(low[j], text) >= n), i)
        if found == i:
            leaders.append(i)
        out.append(found)
    return out


@query("c7_time_dedup", "lines")
def time_dedup(lines: DataFrame) -> DataFrame:
    """In order of time the first unused line leads and takes up later ones with a ratio of 82, or 70 within two seconds; of a group the best text, highest confidence and earliest time stay. Input is capped by C6."""
    rows = top_lines(lines).join(lines.select("video_id", "line_no", "first_seen"), ["video_id", "line_no"])
    rows = rows.select("video_id", "line_no", "first_seen", "text", "confidence", F.lower("text").alias("low"))

    def run(group: list[tuple]) -> list[tuple]:
        low, seen = [r[5] for r in group], np.array([r[2] for r in group])
        leaders = _time_leaders(low, seen)
        parts: dict[int, list[tuple]] = {}
        for leader, row in zip(leaders, group, strict=True):
            parts.setdefault(leader, []).append(row)
        out = []
        for part in parts.values():
            best = min(part, key=lambda r: (-r[4], r[1]))
            out.append((best[0], best[3], best[4], min(r[2] for r in part), len(part)))
        return out

    return by_group(rows, ["video_id"], ["first_seen", "line_no"], run, "video_id long, text string, confidence double, first_seen double, n long")


def words_match(a: str, b: str) -> bool:
    """All word pairs have a ratio of 70; a weighted ratio of 75 where word counts differ."""
    x, y = a.split(), b.split()
    return wratio_of(a, b) >= 75 if len(x) != len(y) else all(ratio_of(p, q) >= 70 for p, q in zip(x, y, strict=True))


def _cluster(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters of near names in each group of keys: cleanest name, highest confidence, number of rows. A repeated name joins
    the leader of its first row, so names are reduced to one row before they travel."""
    names = rows.groupBy(*keys, "name").agg(F.max("confidence").alias("confidence"), F.min("line_no").alias("position"), F.count("*").alias("n"))
    scored = names.select(*keys, "name", "confidence", "position", "n", noise_score(F.col("name")).cast("double").alias("noise"))
    k = len(keys)

    def run(group: list[tuple]) -> list[tuple]:
        names = [r[k] for r in group]
        parts: dict[int, list[tuple]] = {}
        for leader, row in zip(_leaders(names, lambda j, i: words_match(names[j], names[i])), group, strict=True):
            parts.setdefault(leader, []).append(row)
        out = []
        for part in parts.values():
            best = min(part, key=lambda r: (r[k + 4], r[k + 2]))
            out.append((*best[: k + 1], max(r[k + 1] for r in part), min(r[k + 2] for r in part), sum(r[k + 3] for r in part), best[k + 4]))
        return out

    kinds = ", ".join(f"{c} {scored.schema[c].dataType.simpleString()}" for c in keys)
    return by_group(scored, keys, ["position", "name"], run, f"{kinds}, name string, confidence double, position long, n long, noise double")


@query("c12_cast_clusters", "credits")
def cast_clusters(credits: DataFrame) -> DataFrame:
    """Cast names without a character in greedy clusters; unclear one-off noise goes."""
    found = _cluster(credits.where("job = 'actor'"), ["video_id"])
    return found.where("NOT (n <= 1 AND noise >= 8 AND confidence < 0.90)").select("video_id", "name", "confidence", "position", "n")


@query("c13_final_sweep", "credits")
def final_sweep(credits: DataFrame) -> DataFrame:
    """Actors with the same character (here the second word) and near names become one, of higher confidence."""
    rows = credits.where("job = 'actor'").withColumn("character_name", F.get(F.split("name", " "), 1))
    return _cluster(rows, ["video_id", "character_name"]).select("video_id", "character_name", "name", "confidence", "n")


@query("c16_crew_clusters", "credits")
def crew_clusters(credits: DataFrame) -> DataFrame:
    """Crew names of a role in greedy clusters."""
    return _cluster(credits.where("job <> 'actor'"), ["video_id", "job"]).select("video_id", "job", "name", "confidence", "n")


@query("d45_growing_merge", "lines lines2")
def growing_merge(lines: DataFrame, second: DataFrame) -> DataFrame:
    """Lines of a second source that are near (ratio 85) neither the first source's nor those already added."""
    base = lines.groupBy("video_id").agg(F.collect_list(F.lower("text")).alias("base"))
    more = second.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "confidence"))).alias("more"))

    def run(batches):
        for frame in batches:
            rows = []
            for video, held, fresh in zip(frame["video_id"], frame["base"], frame["more"], strict=True):
                known = list(dict.fromkeys([] if held is None else held))
                equal = set(known)
                for row in fresh:
                    low = row["text"].lower()
                    if low not in equal and not any(200 * min(len(k), len(low)) >= 85 * (len(k) + len(low)) and ratio_of(k, low) >= 85 for k in known):
                        known.append(low)
                        equal.add(low)
                        rows.append((video, row["line_no"], row["text"], row["confidence"]))
            yield _plain(pd.DataFrame(rows, columns=["video_id", "line_no", "text", "confidence"]))

    return more.join(base, "video_id", "left").mapInPandas(run, "video_id long, line_no long, text string, confidence double")


_UPPER = r"array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN regexp_matches(w, '^(?:[A-Z][a-z]+)[.,]$') OR lower(w) IN ('the', 'of', 'la', 'de', 'der') THEN w ELSE upper(replace(replace(w, 'i', 'İ'), 'ß', 'ss')) END), ' ')"


@query("r1_report_casing", "lines", f"SELECT video_id, line_no, {_UPPER} AS text FROM lines")
def report_casing(lines: DataFrame) -> DataFrame:
    """Words in capitals with a dotted capital I, but for foreign words and names before a stop."""
    upper = lambda w: F.upper(F.replace(F.replace(w, F.lit("i"), F.lit("İ")), F.lit("ß"), F.lit("ss")))
    keep = lambda w: w.rlike("^(?:[A-Z][a-z]+)[.,]$") | F.lower(w).isin("the", "of", "la", "de", "der")
    return lines.select("video_id", "line_no", F.array_join(F.transform(F.split("text", " "), lambda w: F.when(keep(w), w).otherwise(upper(w))), " ").alias("text"))


@query("r2_wrapped_text", "documents", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, w, unnest(range(0, (len(w) + 19) // 20)) AS row_no FROM w) SELECT doc_id, row_no, array_to_string(w[row_no * 20 + 1:row_no * 20 + 20], ' ') AS line FROM r")
def wrapped_text(documents: DataFrame) -> DataFrame:
    """R2: a text in rows of 20 words."""
    rows = documents.where("text IS NOT NULL").select("doc_id", F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "").alias("w"))
    numbered = rows.where("size(w) > 0").select("doc_id", "w", F.explode(F.expr("sequence(0, (size(w) + 19) DIV 20 - 1)")).alias("row_no"))
    return numbered.select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.array_join(F.expr("slice(w, CAST(row_no AS INT) * 20 + 1, 20)"), " ").alias("line"))
