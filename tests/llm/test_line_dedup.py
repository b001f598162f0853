import hashlib
import re

import pytest

from reelmill.llm import line_dedup

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def slow(rows, least=10):
    last = line_dedup.LAST_DOC
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    owner = {}
    for doc, text in rows:
        doc = last if doc is None else doc
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                owner[key(line)] = min(owner.get(key(line), doc), doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), last if doc is None else doc) == (last if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (7, "Shared line number one\nown line of seven\nshort"),
    (3, "  shared LINE number one\t\r\nshort\nown line of three"),
    (9, "Shared line number one\nShared line number one\n"),
    (3, "shared line number one\nmore of three, another row"),
    (None, "own line of three\nonly here, no id"),
    (None, "only here, no id"),
    (11, "Shared line number one"),
    (12, "ÉCOLE ÉCOLE ÉCOLE\nécole école école\nshared line number one"),
    (13, "ÉCOLE École ÉCOLE"),
]


@pytest.mark.parametrize("params", [line_dedup.Params(), line_dedup.Params(batches=1), line_dedup.Params(batches=7, fanout=3)])
def test_rows(make_docs, awkward, params):
    rows = [*ROWS, *[(100 + i, t) for i, t in awkward], *[(200 + i, t) for i, t in awkward]]
    assert sorted(map(tuple, line_dedup.report(make_docs(rows), params).collect()), key=str) == slow(rows)


def test_documents(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    assert sorted(map(tuple, line_dedup.report(small_docs).collect()), key=str) == slow(rows)


def test_empty_table_and_columns(make_docs):
    assert line_dedup.report(make_docs([])).collect() == []
    got = line_dedup.line_dedup(make_docs(ROWS))
    assert {"extra", "line", "size", "source"} <= set(got.columns)
    assert got.where("doc_id = 11").first()["text"] == ""


def test_runs_are_compacted(spark, make_docs):
    index = line_dedup.RunIndex(spark, 2, 4)
    for i in range(5):
        index.add(spark.createDataFrame([(i, i, i)], "h1 long, h2 long, first_doc long"))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    probed = index.probe(spark.createDataFrame([(2, 2), (8, 8)], "h1 long, h2 long"))
    assert sorted(map(tuple, probed.select("h1", "owner").collect())) == [(2, 2), (8, None)]
    index.release()
    assert index.tables() == []
