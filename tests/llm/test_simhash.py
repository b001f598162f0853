import re

import pytest
import xxhash

from reelmill.llm import simhash
from reelmill.llm._graph import connected_components


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows if r["doc_id"] is not None}
    want = slow_components(fps)
    got = simhash.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])
        else:
            assert r["component_id"] is None


def test_documents(small_docs):
    check(small_docs)


def test_awkward(make_docs, awkward):
    check(make_docs([*awkward, (20, "One two"), (20, "One two"), (None, "one two"), (21, None), (22, "one Two")]))


def test_empty_table(make_docs):
    assert simhash.report(make_docs([])).collect() == []


def test_links_at_two_bits_in_chains(spark, make_docs, monkeypatch):
    fps = {1: 0, 2: 3, 3: 3 | 12, 4: 3 | 12 | (1 << 63), 5: 0b111 << 30, 6: (0b111 << 30) | 1, 9: 2**64 - 1}
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in fps.items()], "fp long, node long")
    found = {r["node"]: r["component"] for r in connected_components(simhash.links(nodes)).collect()}
    want = slow_components(fps)
    assert {i: found.get(i, i) for i in fps} == want
    assert want[4] == 1 and want[6] == 5 and want[9] == 9


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(60, 61), (61, 60)]])
def test_components(spark, edges):
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else root(parent[i])

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == sorted((i, root(i)) for i in parent)


def test_keeps_one_of_each_group(make_docs):
    docs = make_docs([(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "other words stand here"), (None, "a b c d")])
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "a b c d"), (2, "a b c d"), (9, "other words stand here")]
