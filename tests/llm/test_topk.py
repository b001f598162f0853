import math

import numpy as np
import pytest

from reelmill.llm import topk


def slow(rows, every=50, k=5):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def check(spark, rows, params=topk.Params()):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, topk.top_k(df, params).collect())) == slow(rows, params.query_every, params.k)


def test_embeddings(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    check(spark, [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_blocks_ties_nulls(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(500)] + [(1000 + i, [0.5] * 40) for i in range(60)]
    rows += [(2000, None), (2050, [None] * 40), (2100, [float("nan")] * 40), (2150, [float("inf")] + [0.0] * 39), (None, [0.1] * 40), (2200, [0.0] * 40)]
    check(spark, rows, topk.Params(query_block=7, candidate_block=30, dimension_block=8))


def test_few_candidates_and_empty(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (50, [])])
    check(spark, [])
    check(spark, [(100, [1.0])])


def test_very_large_components(spark):
    check(spark, [(i, [float(4e6 * (i % 3 - 1)), 1e-3 * i]) for i in range(101)])


def test_bounds_prune_without_loss():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(3000, 64)) * np.linspace(400, 1, 64))
    ids = np.arange(3000)
    got = topk.search_block(rows[:20], ids[:20], rows, ids)
    want = [(q, i, int(s)) for q in range(20) for s, i in sorted(((-(rows[q] @ rows[i])), i) for i in ids if i != q)[:5] for s in [-s]]
    assert got == want


def test_scores_past_exact_doubles_keep_the_bound():
    """One large component changes neither the result nor, by much, the time."""
    import time

    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(4096, 64)) * 300)
    ids = np.arange(4096)
    rows[17, 3] = 2.0**26
    began = time.time()
    got = topk.search_block(rows[:20], ids[:20], rows, ids)
    assert time.time() - began < 2
    whole = [[int(x) for x in r] for r in rows]
    want = [(q, i, -s) for q in range(20) for s, i in sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in range(4096) if i != q)[:5]]
    assert got == want


def test_scores_past_long_are_ranked_in_full(spark):
    rows = [(i, [float(2.0 ** (40 + i % 7)), -1.0 * (i % 3), 3e38 if i % 11 == 0 else 1.0]) for i in range(120)] + [(500, [-3e38, 0.0, -3e38]), (550, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    clip = lambda s: max(-topk.LARGEST, min(topk.LARGEST, s))
    for params in (topk.Params(), topk.Params(query_block=2, candidate_block=9, seeds=3)):
        assert sorted(map(tuple, topk.top_k(df, params).collect())) == [(q, r, i, clip(s)) for q, r, i, s in slow(rows)]


def test_repeated_ids_and_query_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(50 * (i % 4), [float(x) for x in rng.normal(size=6)]) for i in range(60)] + [(i, [float(x) for x in rng.normal(size=6)]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = topk.top_k(df).collect()
    assert sorted(map(tuple, topk.top_k(df, topk.Params(query_block=7, candidate_block=10, seeds=11, dimension_block=2)).collect())) == sorted(map(tuple, want))
    assert all(r["query_id"] != r["vec_id"] for r in want) and len(want) == 20


def test_order_of_scores_as_text():
    scores = [-(10**40), -(2**63), -100, -99, -10, -9, -1, 0, 1, 9, 10, 99, 2**63, 10**40]
    assert sorted(scores, key=topk._order) == scores
