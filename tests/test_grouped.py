"""Passes over many small groups: results against plain versions, and no frame of Python a group."""

import random

import numpy as np

from reelmill.functions.similarity import ratio_of
from reelmill.operators import greedy, layout
from reelmill.views import view


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_python_call_a_group(spark, small):
    words, lines, credits = (view(spark, small, n) for n in ("words", "lines", "credits"))
    for df in (layout.row_grouping_exact(words), layout.column_separator(words), greedy.time_dedup(lines), greedy.cast_clusters(credits), greedy.final_sweep(credits), greedy.crew_clusters(credits)):
        assert "FlatMapGroupsInPandas" not in plan(df)


def test_rows_over_batches_and_null_frames(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        boxes = [(1, None, 0, i, 0.0, 20.0 * i, 0.0, 20.0 * i) for i in range(5)] + [(1, 0, 1, i, 0.0, 2.0 * i, 0.0, 2.0 * i) for i in range(5)]
        df = spark.createDataFrame(boxes, "video_id long, frame_no long, line_no long, wpos long, x1 double, y1 double, x2 double, y2 double")
        got = sorted((r["frame_no"] is None, r["wpos"], r["row_no"]) for r in layout.row_grouping_exact(df).collect())
        assert got == [(False, i, 0) for i in range(5)] + [(True, i, i) for i in range(5)]
        assert layout.column_separator(df).count() == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_time_dedup_against_a_plain_pass(spark):
    rng = random.Random(4)
    base = ["the quick brown fox jumps over it", "directed by ada lovelace", "music: john turing", "short"]

    def misread():
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 7)):
            text[rng.randrange(len(text))] = rng.choice("abcdefg ")
        return "".join(text)

    rows = [(v, i, misread(), float(rng.randint(0, 40)), rng.choice([0.5, 0.7, 0.9])) for v in range(3) for i in range(60)]
    want = []
    for video in range(3):
        part = sorted((r for r in rows if r[0] == video), key=lambda r: (r[3], r[1]))
        groups = []
        for r in part:
            near = lambda g: ratio_of(g[0][2].lower(), r[2].lower()) >= (70 if abs(g[0][3] - r[3]) <= 2.0 else 82)  # noqa: B023, E731
            found = next((g for g in groups if near(g)), None)
            groups.append([r]) if found is None else found.append(r)
        for g in groups:
            best = min(g, key=lambda r: (-r[4], r[1]))
            want.append((video, best[2], best[4], min(r[3] for r in g), len(g)))
    df = spark.createDataFrame(rows, "video_id long, line_no long, text string, first_seen double, confidence double")
    assert sorted(map(tuple, greedy.time_dedup(df).collect())) == sorted(want)


def test_repeated_names_count_once_each_row(spark):
    rows = [(1, 0, "Ada Kaya", 0.6), (1, 1, "Ada Kaya", 0.9), (1, 2, "Ada Kayaa", 0.7), (1, 3, "Jon Poe", 0.95), (None, 4, "Ada Kaya", 0.95)]
    df = spark.createDataFrame([(*r, "actor") for r in rows], "video_id long, line_no long, name string, confidence double, job string")
    got = sorted(((r["video_id"], r["confidence"], r["position"], r["n"]) for r in greedy.cast_clusters(df).collect()), key=str)
    assert got == sorted([(1, 0.9, 0, 3), (1, 0.95, 3, 1), (None, 0.95, 4, 1)], key=str)


def test_letter_pairs_lose_no_leader():
    rng = random.Random(6)
    for _ in range(100):
        low = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(12)]
        seen = np.array([float(rng.randint(0, 6)) for _ in low])
        want = greedy._leaders(low, lambda j, i: ratio_of(low[j], low[i]) >= (70 if abs(seen[j] - seen[i]) <= 2.0 else 82))  # noqa: B023
        assert greedy._time_leaders(low, seen) == want
