"""D11's result is made in many tasks, however few rows of texts make it."""

from reelmill.operators.resolution import title_candidates


def test_many_tasks_make_the_result(spark):
    words = [a + b for a in "abcdefgh" for b in "aeiou"]
    videos = spark.createDataFrame([(i, f"red sea {w}") for i, w in enumerate(words)], "video_id long, film_title string")
    titles = spark.createDataFrame([(i, f"red sea {w}", f"blue sky {w}") for i, w in enumerate(words)], "tconst long, primary_title string, original_title string")
    found = title_candidates(videos, titles)
    assert {(r["video_id"], r["tconst"]) for r in found.collect()} >= {(i, i) for i in range(len(words))}
    assert found.rdd.getNumPartitions() > 16
