"""Views that a query reads several times are made once."""

import pytest

from reelmill.operators import matching
from reelmill.plans import registry
from reelmill.views import kept_views


def optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["d21_catalogue_result", "d26_person_evidence", "d28_film_acceptance", "d33_enrichment_gate", "d38_missing_actor_qa"])
def test_persons_are_read_once(spark, small, name):
    """The patterns that make persons of lines stand in no plan behind the table that they are written to."""
    assert "regexp_extract" not in optimized(registry.queries()[name](spark, small))


def test_kept_views():
    assert kept_views(("persons",)) == set()
    assert kept_views(("principals", "names")) == {"persons"}
    assert kept_views(("principals", "names"), ("names",)) == {"names", "persons"}
    assert kept_views(("credits", "videos")) == set()
    assert kept_views(("persons", "title_people"), ("title_people",)) == {"persons", "title_people"}
    assert kept_views(("titles", "part")) == set()


def test_evidence_meets_keys_once_each(spark):
    """A name of many titles and of several spellings: one row a reading, C before D."""
    persons = spark.createDataFrame([(1, 0, "Ada Love"), (1, 1, "ada love"), (1, 2, "Bob Ray"), (2, 0, "Ada Love"), (2, 1, "No One"), (3, 0, "Bob-Ray")], "video_id long, line_no long, name string")
    people = spark.createDataFrame([(t, n) for t in range(10, 40) for n in ("Ada Love", "ADA LOVE") if t > 11] + [(11, "Bob Ray"), (10, "Zed Zee")], "tconst long, name string")
    videos = spark.createDataFrame([(1, 12), (2, 10), (3, 11)], "video_id long, true_tconst long")
    rows = matching.person_evidence(persons, people, videos)
    assert sorted(map(tuple, rows.collect())) == [(1, "Ada Love", "C"), (1, "Bob Ray", "D"), (2, "Ada Love", "D"), (3, "Bob-Ray", "C")]


def test_clear_names_are_keyed_once(spark, small):
    """D38's grouped lines are read twice and made once."""
    assert "max_by" not in optimized(registry.queries()["d38_missing_actor_qa"](spark, small))


def test_cast_keys_are_stored(spark, small):
    """Tokens and letters of a name are columns of a table where names meet."""
    assert "array_sort" not in optimized(registry.queries()["d28_film_acceptance"](spark, small))
