"""C19's fuzzy mode against a plain version that goes source by source."""

import random

import pytest

from reelmill.functions.similarity import ratio_of
from reelmill.operators import credits


def slow(sources):
    if len(sources) == 1:
        score = sources[0][1]
        return sources[0][0], "HIGH" if score >= credits.HIGH_FROM else "MEDIUM" if score >= credits.MEDIUM_FROM else "LOW", score, []
    groups = {}
    for value, score in sources:
        key = next((k for k in groups if ratio_of(value, k) >= 85), value)
        groups.setdefault(key, []).append((value, score))
    best = max(groups.values(), key=lambda g: sum(s for _, s in g))
    pool = sources if len(groups) == 1 else best
    value, mean = max(pool, key=lambda x: x[1])[0], sum(s for _, s in pool) / len(pool)
    if len(groups) == 1:
        return value, "HIGH", mean, []
    return value, "LOW", mean * 0.7, [k for k in groups if ratio_of(k, value) < 85]


def test_groups(spark):
    rng = random.Random(2)
    names = ["Ada Lovelace", "Ada Lovelance", "Adda Lovelace", "Jon Turing", "John Turing", "Mary Hopper", "Mary Hoper", "X", ""]
    rows = [(v, i, rng.choice(names), rng.choice([0.25, 0.5, 0.75]) + rng.random() / 8, "Director") for v in range(60) for i in range(rng.choice([1, 1, 2, 4, 9]))]
    shuffled = rng.sample(rows, len(rows)) + [(99, 0, "Nobody", 0.9, "Editor")]
    df = spark.createDataFrame(shuffled, "video_id long, line_no long, name string, confidence double, job string")
    got = {r["video_id"]: (r["name"], r["level"], r["confidence"], r["alternatives"]) for r in credits.value_merge_fuzzy(df).collect()}
    want = {v: slow([(r[2], r[3]) for r in rows if r[0] == v]) for v in range(60)}
    assert got.keys() == want.keys()
    for v, (name, level, confidence, others) in want.items():
        assert got[v] == (name, level, pytest.approx(confidence), others), v
    assert {x[1] for x in want.values()} == {"HIGH", "MEDIUM", "LOW"} and any(len(x[3]) > 1 for x in want.values())
    assert credits.value_merge_fuzzy(df.limit(0)).collect() == []
