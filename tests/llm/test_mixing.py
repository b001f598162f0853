from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reelmill.llm import mixing


def slow_targets(sizes):
    """The excess over three times a source's size is shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while True:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if total and left * weight[s] / total > 3 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total if total else 0.0 for s in open_}
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)


def check(docs):
    import re

    rows = docs.select("doc_id", "text", "source").collect()
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    want = slow_targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))


def test_documents(small_docs):
    check(small_docs)


def test_hot_and_odd_sources(make_docs, awkward):
    rows = [(i, "w " * (i % 7 + 1), "hot") for i in range(300)] + [(1000 + i, "some few words", s) for i, s in enumerate(["é", "Z", "a", None, "", "😀", None, "null", "=null"])]
    check(make_docs([*rows, *[(2000 + i, t, "odd") for i, t in awkward], (5000, None, "empty"), (5001, "", "empty"), (None, "no id here", "a"), (None, "no id here", "a")]))


def test_nothing_to_take(make_docs):
    assert mixing.mix(make_docs([])).collect() == []
    got = mixing.mix(make_docs([(1, None, "a"), (2, "", None)])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_documents_are_emitted_as_often(make_docs):
    docs = make_docs([(i, f"text {i} " * (i % 5), f"s{i % 4}") for i in range(40)] + [(7, "twin words", "s1")] * 3)
    chosen = mixing.mix(docs).groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("n")).where("n > 0").select("doc_id", "n")
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    counted = made.groupBy("doc_id", "text").count().select("doc_id", "count")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, chosen.collect()))
