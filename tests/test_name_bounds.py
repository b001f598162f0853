"""D22 scores only pairs that a bound lets through, and the bound loses none that has a score."""

import random

from pyspark.sql import functions as F

from reelmill.operators.matching import fuzzy_name_match, match_parts, may_match, name_match_score


def test_no_scored_pair_is_lost(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 7))).capitalize() for _ in range(60)] + ["Şen", "İpek", "McAda", "O'Neil", "a b", ""]

    def misread(text):
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(text) + 1)
            text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("ae ") + text[at:], text.upper(), " ".join(reversed(text.split())), text + " " + rng.choice(words), text[: at + 3]])
        return text

    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(150)]
    pairs = [(a, misread(a)) for a in names * 8] + [(a, rng.choice(names)) for a in names * 8]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (70.0, 85.0, 92.0):
        made = rows.select(name_match_score(F.col("a"), F.col("b"), threshold).alias("score"), may_match(match_parts(F.col("a")), match_parts(F.col("b")), threshold).alias("able"), "a", "b").collect()
        assert sum(r["score"] is not None for r in made) > 300
        assert not [r for r in made if r["score"] is not None and not r["able"]]


def test_far_pairs_are_not_scored(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)).capitalize()
    videos = spark.createDataFrame([(1, 5, 1990, False)], "video_id long, true_tconst long, year long, is_series boolean")
    read, held = [f"{word()} {word()}" for _ in range(60)], [f"{word()} {word()}" for _ in range(60)]
    persons = spark.createDataFrame([(1, n) for n in [*read, "Ada Lovelace"]], "video_id long, name string")
    people = spark.createDataFrame([(5, n, "actor") for n in [*held, "Ada Lovelacc"]], "tconst long, name string, category string")
    found = fuzzy_name_match(videos, persons, people)
    assert [(r["name"], r["choice"]) for r in found.collect()] == [("Ada Lovelace", "Ada Lovelacc")]
    rows = spark.createDataFrame([(a, b) for a in read for b in held], "a string, b string")
    assert rows.where(may_match(match_parts(F.col("a")), match_parts(F.col("b")))).count() < 36
