"""Scenarios of single operators."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelmill.functions import keys, similarity
from reelmill.operators import credits, greedy, lines, logs, names, resolution, segments


def values(spark, texts, column, schema="text string"):
    df = spark.createDataFrame([(t,) for t in texts], schema)
    return [r[0] for r in df.select(column(F.col("text"))).collect()]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs(a, b):
    assert similarity.lcs(a, b) == slow_lcs(a, b)


def test_block_scores_agree():
    rng = random.Random(2)
    make = lambda n, k: ["".join(rng.choice("abcde") for _ in range(n)) for _ in range(k)]
    for n, m in ((3, 5), (12, 9), (7, 64), (5, 70)):
        left, right = make(n, 6), make(m, 7)
        assert similarity.block_scores(left, right).tolist() == [[similarity.ratio_of(a, b) for b in right] for a in left]


@pytest.mark.parametrize("threshold", [60.0, 75.0, 90.0])
def test_fuzzy_join_loses_no_pair(spark, threshold, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    left, right = list(enumerate(words[:30] + [None, ""])), list(enumerate(words[25:] + [""]))
    got = similarity.fuzzy_join(spark.createDataFrame(left, "l_id long, l_text string"), spark.createDataFrame(right, "r_id long, r_text string"), threshold, 2)
    want = []
    for i, a in left:
        if a:
            best = sorted((-similarity.ratio_of(a, b), j) for j, b in right if b and similarity.ratio_of(a, b) >= threshold)[:2]
            want += [(i, j, -s) for s, j in best]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_wratio():
    assert similarity.wratio_of("Nisa Serezli", "Serezli Nisa") == pytest.approx(95.0)
    assert similarity.wratio_of("abc", "abc") == 100.0
    assert similarity.wratio_of("", "abc") == 0.0
    assert similarity.wratio_of("Hanks", "Tom Hanks the actor") == pytest.approx(90.0)


def test_keys(spark):
    assert values(spark, ["İpek ÇETİN"], keys.ascii_key) == ["ipekcetin"]
    assert values(spark, ["Nisa Serezli"], keys.name_key) == ["NISASEREZLI"]
    assert values(spark, ["CAMAAN", "WALQ"], keys.phonetic_key) == ["CAMAN", "NALG"]
    assert values(spark, ["ShannaReed"], keys.word_key) == ["shanna reed"]


@pytest.mark.parametrize(
    ("text", "reason"),
    [("Ada, Lovelace", "sentence_fragment"), ("a/b c", "slash_reference"), ("who is it?", "sentence_punctuation"), ("J. Smith", "ok"), ("Анна Иванова", "non_latin"), ("This is it.", "sentence_ending"), ("ab", "too_short"), ("A.S.C.", "technical_abbreviation"), ("one two three four five", "too_many_words")],
)
def test_structure(spark, text, reason):
    assert values(spark, [text], names.structural_reason) == [reason]


def test_junk(spark):
    assert values(spark, ["Brtkls", "Strngthlng", "a@b.co", "12345 ab", "Tom Hanks", "Ayşe Öz"], names.is_junk) == [True, True, True, True, False, False]


def test_correction_table_and_layers(spark):
    table = spark.createDataFrame([(1, "Tom Hanks"), (2, "Julia Roberts")], "nconst long, primary_name string")
    texts = spark.createDataFrame([("Nita Sereli",), ("tom hanks",), ("Julia Robrets",), ("Hanks",), ("nobody at all",)], "text string")
    got = {r["text"]: (r["canonical"], r["method"]) for r in resolution.find_names(texts, table).collect()}
    assert got == {"Nita Sereli": ("Nisa Serezli", "hardcoded"), "tom hanks": ("Tom Hanks", "exact_db"), "Julia Robrets": ("Julia Roberts", "fuzzy"), "Hanks": (None, ""), "nobody at all": (None, "")}


def test_digit_noise_keeps_years(spark):
    assert values(spark, ["2023", "(2023)", "2023.", "12:34:56", "34AB1234", "Tom"], lines.passes_digits) == [True, True, True, False, False, True]


def test_funnel_never_rises(spark, small):
    from reelmill.views import view

    for r in lines.line_funnel(view(spark, small, "lines")).collect():
        counts = [r["n_raw"], *[r[f"n_{s}"] for s in ("noise", "length", "confidence", "digit", "blacklist")]]
        assert counts == sorted(counts, reverse=True)


def test_merged_intervals_do_not_overlap(spark):
    rows = [(1, 0.0, 10.0, "a", 0), (1, 5.0, 7.0, "b", 1), (1, 10.0, 12.0, "a", 2), (1, 20.0, 30.0, "c", 3), (2, 0.0, 1.0, "a", 0)]
    df = spark.createDataFrame(rows, "video_id long, s double, e double, who string, n long")
    got = segments.merge_intervals(df, "s", "e", "who", "n").orderBy("video_id", "start_sec").collect()
    assert [(r["video_id"], r["start_sec"], r["end_sec"], r["labels"]) for r in got] == [(1, 0.0, 12.0, "a+b"), (1, 20.0, 30.0, "c"), (2, 0.0, 1.0, "a")]


def test_overlap_join_across_buckets(spark):
    s = spark.createDataFrame([(1, 0, 50.0, 130.0), (1, 1, 500.0, 501.0)], "video_id long, seg_no long, start_sec double, end_sec double")
    d = spark.createDataFrame([(1, 0, "A", 0.0, 70.0), (1, 1, "B", 70.0, 200.0), (1, 2, "C", 60.0, 80.0)], "video_id long, d_no long, d_speaker string, d_start double, d_end double")
    got = {r["seg_no"]: (r["speaker"], r["overlap"]) for r in segments.speaker_overlap(s, d).collect()}
    assert got == {0: ("B", 60.0), 1: (None, None)}


def test_greedy_dedup_is_idempotent(spark):
    rows = [(1, i, t, 2.0 * i, 0.9 - i / 100) for i, t in enumerate(["MARGUERITE HICKEY", "MARGUERITE HICKFY", "TOM HANKS", "MARGUERITE H1CKEY", "TOM HANKS"])]
    df = spark.createDataFrame(rows, "video_id long, line_no long, text string, first_seen double, confidence double")
    once = greedy.time_dedup(df).select("video_id", F.col("first_seen").cast("long").alias("line_no"), "text", "first_seen", "confidence")
    twice = greedy.time_dedup(once)
    assert sorted(r["text"] for r in once.collect()) == sorted(r["text"] for r in twice.collect()) == ["MARGUERITE HICKEY", "TOM HANKS"]


def test_clusters(spark):
    rows = [(1, 0, "Ali Ozoqwz", 0.9, "actor"), (1, 1, "Ali Ozogwz", 0.95, "actor"), (1, 2, "Ayşe Demir", 0.9, "actor")]
    df = spark.createDataFrame(rows, "video_id long, line_no long, name string, confidence double, job string")
    got = greedy.cast_clusters(df).orderBy("position").collect()
    assert [(r["n"], r["confidence"]) for r in got] == [(2, 0.95), (1, 0.9)]


def test_field_mismatch(spark):
    rows = [(2, 0, "Ada King", 0.9, "Director", "ocr_verified", True), (2, 1, "Ada King", 0.9, "Writer", "tmdb", True), (2, 2, "Bob Lee", 0.9, "Editor", "ocr_verified", True), (2, 3, "Bob Lee", 0.9, "Editor", "tmdb", True)]
    df = spark.createDataFrame(rows, "video_id long, line_no long, name string, confidence double, job string, raw string, is_verified boolean")
    got = credits.field_mismatch(df).collect()
    assert [(r["name"], r["ocr_job"], r["job"], r["department"], r["category"]) for r in got] == [("Ada King", "Director", "Writer", "writing", 1)]


def test_stage_status(spark):
    df = spark.createDataFrame([("a", "ok"), ("a", "error"), ("b", "skipped"), ("b", "ok"), ("c", "skipped")], "job_id string, status string")
    assert {r["job_id"]: r["status"] for r in logs.stage_status(df).collect()} == {"a": "error", "b": "ok", "c": "skipped"}


@pytest.mark.parametrize("most", [1, 2, 4])
def test_best_jaccard_is_the_best_of_all_pairs(spark, most):
    rng = random.Random(11)
    text = lambda: " ".join(rng.choice("ada ben cem dan eva".split()) for _ in range(rng.randint(0, 6)))
    left = [(i, i % 3, text()) for i in range(40)] + [(40, None, "ada"), (41, 9, "ada"), (42, 0, None)]
    right = [(i % 3, text()) for i in range(20)] + [(0, None), (0, "ada ben"), (0, "ada ben")]
    got = similarity.best_jaccard(spark.createDataFrame(left, "id long, g long, key string"), spark.createDataFrame(right, "g long, ckey string"), ["id"], "g", most)

    def score(a, b):
        x, y = set((a or "").split()), set((b or "").split())
        return len(x & y) / len(x | y) if x and y else 0.0

    want = {i: max((score(a, b) for h, b in right if h == g), default=0.0) for i, g, a in left}
    assert {r["id"]: r["similarity"] for r in got.collect()} == pytest.approx(want)
