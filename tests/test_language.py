"""Language validity, vote by vote."""

import pytest

from reelmill.operators import segments


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("", "empty"), ("   ", "empty"), ("kısa", "not_turkish"), ("Bu güzel hikaye şehirde başlar", "valid"), ("Ankara'da yasanan olaylar uzun", "valid"), ("bir film ve kadar uzun oldu", "valid"),
        ("bir film the and with his hers", "not_turkish"), ("kosarak eve donmek zorunda kaldi", "valid"), ("kosarak eve the donmek zorunda", "not_turkish"), ("de la en le maison avec les enfants", "not_turkish"),
        ("Güzel bir şehir hikayesi Москва", "non_latin_script"), ("Москва Москва Москва ş Москва", "not_turkish"), ("12345 67890 12345 67890", "not_turkish"), ("plain latin words of no marker", "not_turkish"),
    ],
)
def test_verdict(spark, text, verdict):
    rows = segments.language_validity(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["verdict"]) for r in rows] == [(1, verdict)]
