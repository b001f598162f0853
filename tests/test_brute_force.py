"""Operators that SQL can't express, or only too slowly, against plain versions on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.functions.similarity import ratio_of, wratio_of
from reelmill.operators import greedy, layout, lines, matching, resolution, roles
from reelmill.operators.names import noise_score
from reelmill.views import view

FIRST, LAST = "Ada Adda Bela Cem Dana Mary Marry Jon John".split(), "Lovelace Lovelance Hopper Hoper Turing Kaya Kayaa".split()


def sorted_tokens(text):
    return " ".join(sorted(text.split()))


def people(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice(FIRST)} {rng.choice(LAST)}" for _ in range(n)]


def leaders(items, near):
    """For each item the first earlier leader that it is near, or itself."""
    found, out = [], []
    for i, item in enumerate(items):
        at = next((j for j in found if near(items[j], item)), i)
        found += [i] if at == i else []
        out.append(at)
    return out


def test_mojibake(spark):
    rows = ["Ã–zlem", "Åžebnem", "plain", "naïve", "Ä°pek Ã‡etin", "漢字", "é", ""]

    def fixed(text):
        try:
            return text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return text

    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "video_id long, line_no long, text string")
    got = {r["line_no"]: (r["text"], r["original"], r["repaired"]) for r in lines.mojibake_repair(df).collect()}
    assert got == {i: (fixed(t), t, fixed(t) != t) for i, t in enumerate(rows)}
    assert fixed("é".encode().decode("latin-1")) == "é"


def test_two_best_candidates(spark):
    names = [(i, n, n[0] + n[2] + n[1] + n[3:]) for i, n in enumerate(dict.fromkeys(people(60, 1)))]
    df = spark.createDataFrame(names, "nconst long, primary_name string, ocr_name string")
    want = set()
    for i, _, read in names:
        scores = sorted((-ratio_of(sorted_tokens(read), sorted_tokens(n)), j) for j, n, _ in names)
        want |= {(i, j, round(-s, 6)) for s, j in scores[:2] if -s >= 75}
    assert {(r["nconst"], r["candidate"], round(r["score"], 6)) for r in resolution.top2_candidates(df).collect()} == want


def test_line_correction(spark):
    table = spark.createDataFrame([(0, "Ada Lovelace"), (1, "John Turing")], "nconst long, primary_name string")
    rows = spark.createDataFrame([(1, 0, "Ada Lovelcae"), (1, 1, "John Turing"), (1, 2, "Nobody Known"), (1, 3, "Nita Sereli")], "video_id long, line_no long, name string")
    got = {r["line_no"]: (r["text"], r["repaired"]) for r in resolution.line_correction(rows, table).collect()}
    assert got == {0: ("Ada Lovelace", True), 1: ("John Turing", False), 2: ("Nobody Known", False), 3: ("Nisa Serezli", True)}


def credit_rows(spark, n=80):
    rng = random.Random(3)
    rows = [(rng.randint(1, 3), i, name, rng.choice([0.6, 0.7, 0.95]), rng.choice(["actor", "Editor", "Writer"])) for i, name in enumerate(people(n, 2))]
    df = spark.createDataFrame(rows, "video_id long, line_no long, name string, confidence double, job string")
    noise = {r["name"]: float(r["s"]) for r in df.select("name", noise_score(F.col("name")).alias("s")).collect()}
    return df, rows, noise


def clusters(rows, noise):
    rows = sorted(rows, key=lambda r: r[1])
    out, at = [], leaders([r[2] for r in rows], greedy.words_match)
    for leader in sorted(set(at)):
        group = [r for r, x in zip(rows, at) if x == leader]
        best = min(group, key=lambda r: (noise[r[2]], r[1]))
        out.append((best[2], max(r[3] for r in group), len(group)))
    return out


def test_crew_clusters_and_final_sweep(spark):
    df, rows, noise = credit_rows(spark)
    want = [(v, j, *c) for v in (1, 2, 3) for j in ("Editor", "Writer") for c in clusters([r for r in rows if r[0] == v and r[4] == j], noise)]
    assert sorted(map(tuple, greedy.crew_clusters(df).collect())) == sorted(want)
    cast = [r for r in rows if r[4] == "actor"]
    want = [(v, ch, *c) for v in (1, 2, 3) for ch in {r[2].split()[1] for r in cast if r[0] == v} for c in clusters([r for r in cast if r[0] == v and r[2].split()[1] == ch], noise)]
    assert sorted(map(tuple, greedy.final_sweep(df).collect())) == sorted(want)


def test_general_name_match_loses_no_length(spark):
    videos = spark.createDataFrame([(1, 7, 2000, False)], "video_id long, true_tconst long, year long, is_series boolean")
    read, held = ["ADA", "Ada Lovelace", "Zzz Qqq", "Mary Hoper"], ["ADA LOVELACE", "Ada Lovelace", "Mary Hopper", "Xavier"]
    persons = spark.createDataFrame([(1, i, n) for i, n in enumerate(read)], "video_id long, line_no long, name string")
    cast = spark.createDataFrame([(7, n, "actor") for n in held], "tconst long, name string, category string")
    got = {r["name"]: (r["choice"], r["score"]) for r in matching.fuzzy_name_match(videos, persons, cast).collect()}
    assert got["ADA"] == ("ADA LOVELACE", 90.0) and got["Ada Lovelace"] == ("ADA LOVELACE", 100.0)
    assert got["Mary Hoper"][0] == "Mary Hopper" and "Zzz Qqq" not in got


def test_bound_of_the_weighted_ratio():
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4)))
    for _ in range(400):
        a, b = text(), text()
        whole, bounded = wratio_of(a, b), wratio_of(a, b, 80.0)
        assert bounded == whole if whole >= 80.0 else bounded < 80.0, (a, b)


def source_lines(spark):
    rng = random.Random(5)
    one = [(v, i, " ".join(people(2, 100 * v + i))) for v in (1, 2) for i in range(20)]
    two = [(v, i, (t if i % 3 else t.replace("a", "x").replace("e", "y")).upper(), 0.5) for v, i, t in one] + [(2, 50, "QQ WW", 0.5), (2, 51, "QQ WV", 0.5), (2, 52, "ADA", 0.5)]
    rng.shuffle(one)
    return spark.createDataFrame(one, "video_id long, line_no long, text string"), spark.createDataFrame(two, "video_id long, line_no long, text string, confidence double"), one, two


def test_merge_against_a_fixed_set(spark):
    a, b, one, two = source_lines(spark)
    want = {(v, i) for v, i, t, _ in two if not any(w == v and ratio_of(sorted_tokens(t.lower()), sorted_tokens(x.lower())) >= 85 for w, _, x in one)}
    assert {(r["video_id"], r["line_no"]) for r in matching.merge_fixed(a, b).collect()} == want and len(want) > 2


def test_merge_against_a_growing_set(spark):
    a, b, one, two = source_lines(spark)
    want = set()
    for video in (1, 2):
        known = [t.lower() for v, _, t in one if v == video]
        for _, i, t, _ in sorted(r for r in two if r[0] == video):
            if all(ratio_of(k, t.lower()) < 85 for k in known):
                known.append(t.lower())
                want.add((video, i))
    assert {(r["video_id"], r["line_no"]) for r in greedy.growing_merge(a, b).collect()} == want and len(want) > 2


def test_sequential_parse(spark):
    names = ["Ada King", "Bob Lee", "Cem Kaya", "Dan Poe", "Eva Roe", "Fay Lim"]
    rows = ["Ada Star", "Directed by", *names, "Oyuncular", "KOLA", "Kurgu: Jon Snow", "KOLA", "Ada King", "production", *names[:4], "###", "they were walking in the long cold night again, friend"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "video_id long, line_no long, text string")
    got = [(r["name"], r["category"]) for r in roles.credit_parse_full(df).orderBy("line_no").collect()]
    assert got == [("Ada Star", "cast"), ("Ada King", "director"), ("Bob Lee", "director"), ("Fay Lim", "cast"), ("KOLA", "cast"), ("Jon Snow", "crew"), *[(n, "production") for n in names[:4]]]


@pytest.fixture(scope="module")
def words(spark, small):
    return view(spark, small, "words").where("video_id < 20").cache()


def frames(words):
    return words.toPandas().sort_values(["video_id", "frame_no"]).groupby(["video_id", "frame_no"])


def test_rows_by_running_mean(words):
    want = set()
    for (video, frame), part in frames(words):
        boxes = sorted(((a + b) / 2, i, p) for a, b, i, p in zip(part["y1"], part["y2"], part["line_no"], part["wpos"]))
        row, held = -1, []
        for y, i, p in boxes:
            if not held or abs(y - sum(held) / len(held)) > 12.0:
                row, held = row + 1, []
            held.append(y)
            want.add((video, frame, i, p, row))
    assert set(map(tuple, layout.row_grouping_exact(words).collect())) == want


def test_column_separator(words):
    want = {}
    for key, part in frames(words):
        x = np.sort(((part["x1"] + part["x2"]) / 2).to_numpy())
        if len(x) < 4:
            want[key] = 440.0
            continue
        a, b = x[len(x) // 4], x[3 * len(x) // 4]
        for _ in range(10):
            left = [v for v in x if abs(v - a) <= abs(v - b)]
            right = [v for v in x if abs(v - a) > abs(v - b)]
            if not left or not right:
                break
            a, b = np.mean(left), np.mean(right)
        want[key] = min(max((a + b) / 2, 220.0), 660.0)
    got = {(r["video_id"], r["frame_no"]): r["separator"] for r in layout.column_separator(words).collect()}
    assert got == pytest.approx(want)
