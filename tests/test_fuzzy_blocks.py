"""The fuzzy join's sides never pass for small tables, and a text travels to few blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.functions import similarity
from reelmill.functions.similarity import ratio_of


@pytest.mark.parametrize(("n", "m", "letters"), [(6, 7, "abc"), (5, 5, "abç\U0001f600"), (70, 66, "ab"), (4, 7, "ab")])
def test_block_matches_by_tiles(monkeypatch, n, m, letters):
    monkeypatch.setattr(similarity, "LEFT_TILE", 7)
    monkeypatch.setattr(similarity, "RIGHT_TILE", 11)
    rng = random.Random(4)
    text = lambda size, of: "".join(rng.choice(of) for _ in range(size))
    left, right = [text(n, letters) for _ in range(40)], [text(m, letters + "q") for _ in range(60)]
    least = np.array([rng.choice([40.0, 75.0, 85.0]) for _ in left])
    for k in (1, 3):
        want = sorted((i, j, -s) for i, a in enumerate(left) for s, j in sorted((-ratio_of(a, b), j) for j, b in enumerate(right) if ratio_of(a, b) >= least[i])[:k])
        assert sorted(zip(*(v.tolist() for v in similarity.block_matches(left, right, least, k)), strict=True)) == want


def test_pieces_of_small_files_are_not_broadcast(spark, tmp_path):
    """A file of texts is small, but a text has dozens of pieces: 4 MB of names made 2,147 MB of broadcast at 0.1 GB."""
    for side in "lr":
        spark.range(300).selectExpr(f"id AS {side}_id", f"concat('name ', id) AS {side}_text").write.parquet(f"{tmp_path}/{side}")
    pairs = similarity._close_pairs(spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r"))
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_a_text_travels_to_few_blocks(spark, monkeypatch):
    """2,500 texts of one length were three blocks a side of 1,000 texts, so each text travelled three times."""
    monkeypatch.setattr(similarity, "DEALT", 1)
    rng = random.Random(2)
    table = [(i, "".join(rng.choice("abcdefgh") for _ in range(7))) for i in range(2500)]
    left, right = (spark.createDataFrame(table, f"{s}_id long, {s}_text string") for s in "lr")
    calls = spark.sparkContext.accumulator(0)
    scored = similarity.block_matches

    def counted(*args):
        calls.add(1)
        return scored(*args)

    monkeypatch.setattr(similarity, "block_matches", counted)
    found = similarity._all_pairs(left.withColumn("least", F.lit(100.0)), right, 75.0).collect()
    assert {(r["l_id"], r["score"]) for r in found} == {(i, 100.0) for i, _ in table}
    assert calls.value == 1
