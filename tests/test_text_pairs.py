"""Texts are compared once however many rows have them, and bounds lose no pair."""

import random

from reelmill.functions import similarity
from reelmill.functions.similarity import ratio_of
from reelmill.operators import resolution


def test_titles_of_one_text_are_scored_once(spark):
    videos = spark.createDataFrame([(i, "Red Sea" if i % 2 else "red sea") for i in range(40)], "video_id long, film_title string")
    titles = spark.createDataFrame([(i, "red sea", "sea red" if i % 2 else "blue sea") for i in range(30)], "tconst long, primary_title string, original_title string")
    found = resolution.title_candidates(videos, titles)
    rows = found.collect()
    assert len(rows) == len(set(rows)) == 40 * 45 and {r["score"] for r in rows} == {100.0}
    text = found._jdf.queryExecution().optimizedPlan().toString()
    # video_id and tconst join after the score: the scored relation holds texts only
    scored = text[text.index("ArrowEvalPython") :].split("\n")[0]
    assert "video_id" not in scored and "tconst" not in scored


def test_fuzzy_join_settles_near_texts_by_an_equi_join(spark):
    rng = random.Random(8)
    base = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(2)) for _ in range(120)] + ["a" * 40, "a" * 70 + "b"]

    def misread(text):
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "e" + text[at:], text[:at] + text[at : at + 2][::-1] + text[at + 2 :]]) or "a"
        return text

    read = [misread(t) for t in base] + ["", None]
    left = spark.createDataFrame(list(enumerate(read)), "l_id long, l_text string")
    right = spark.createDataFrame(list(enumerate([*base, None])), "r_id long, r_text string")
    for threshold, k in ((75.0, 1), (75.0, 2), (85.0, 1)):
        want = set()
        for i, a in enumerate(read):
            best = sorted((-ratio_of(a, b), j) for j, b in enumerate(base) if a and ratio_of(a, b) >= threshold)[:k]
            want |= {(i, j, round(-s, 6)) for s, j in best}
        assert {(r["l_id"], r["r_id"], round(r["score"], 6)) for r in similarity.fuzzy_join(left, right, threshold, k).collect()} == want
    near = {r["l_id"] for r in similarity._close_pairs(left, right).collect()}
    assert len(near) > 60
