"""Language classes and directors of the reverse scorecard."""

import pytest

from reelmill.operators import credits


@pytest.mark.parametrize(
    ("film", "primary", "original", "want"),
    [
        ("Uzun Yol", "Long Road", "Uzun Yol", "Long Road"), ("Güneş", "The Sun", "Güneş", "Güneş"), ("Güneş", "The Sun", "Soleil", None), ("Sun", "Солнце", "Sun", "Sun"), ("Güneş", "Солнце", "Sun", None), ("Sun", "Güneş", "Солнце", None),
        ("Sun", "Güneş", "", None),
    ],
)
def test_compared_title(spark, film, primary, original, want):
    df = spark.createDataFrame([(film, primary, original)], "f string, p string, o string")
    assert df.select(credits.compared_title(df.f, df.p, df.o)).first()[0] == want


@pytest.mark.parametrize(
    ("read", "score"),
    [(["Anna Berg"], 2.5), (["Anna Bergg"], 1.5), (["Carl Cameran"], 1.5), (["Nobody Else"], -2.5), (["Анна Берг"], 0.0), (["Анна Берг", "Nobody Else"], -2.5), ([], 0.0), (["Nobody Else", "Anna Berg"], 2.5)],
)
def test_directors(spark, read, score):
    videos = spark.createDataFrame([(1, "Sun", 7)], "video_id long, film_title string, true_tconst long")
    titles = spark.createDataFrame([(7, "Sun", "Sun")], "tconst long, primary_title string, original_title string")
    people = spark.createDataFrame([(7, "Anna Berg", "director"), (7, "Carl Cameron", "cinematographer"), (7, "Nobody Else", "actor")], "tconst long, name string, category string")
    rows = spark.createDataFrame([(1, i, n, "Director") for i, n in enumerate(read)] + [(1, 99, "Nobody Else", "actor")], "video_id long, line_no long, name string, job string")
    got = credits.reverse_scorecard(rows, videos, people, titles).first()
    assert (got["title_score"], got["director_score"], got["ratio_score"]) == (2.5, score, 3.0)
