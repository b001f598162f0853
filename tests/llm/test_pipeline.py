import re

import zstandard
from test_bpe import expected, reference  # noqa: F401
from test_mixing import slow_targets
from test_near_copies import slow_set

import corpus_pipeline
from reelmill.llm import quality
from reelmill.llm._shared import materialize


def slow_lines(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for doc, text in rows.items():
        for line in text.split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), doc), doc)
    return {d: "\n".join(x for x in t.split("\n") if owner.get(key(x), d) == d) for d, t in rows.items()}


def slow_near(texts):
    """For each document the smallest one of its component under a five-word Jaccard similarity of 0.8 or more."""
    sets, label = {d: slow_set(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return {d: root(d) for d in ids}


def test_stages(spark, small, small_docs, reference):  # noqa: F811
    docs, kept = small_docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, small), "test-stage")
        assert docs.columns == small_docs.columns
        kept[name] = docs.collect()
    rows = {r["doc_id"]: r["text"] for r in small_docs.collect()}
    press = zstandard.ZstdCompressor(level=3)
    good = {}
    for d, t in rows.items():
        n, _, _, _, repeat, *_, verdict = quality.measure(t, press)
        if n >= 50 and 100 * repeat <= 50 * n and verdict is None:
            good[d] = t
    assert {r["doc_id"]: r["text"] for r in kept["quality rules"]} == good
    lined = slow_lines(good)
    assert {r["doc_id"]: r["text"] for r in kept["line dedup"]} == lined
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line dedup"])
    first = set(slow_near(lined).values())
    assert {r["doc_id"]: r["text"] for r in kept["near dedup"]} == {d: lined[d] for d in first}
    source = {r["doc_id"]: r["source"] for r in small_docs.collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = {}
    for d in first:
        sizes[source[d]] = sizes.get(source[d], 0) + size(lined[d])
    targets, taken = slow_targets(sizes), dict.fromkeys(sizes, 0)
    for r in kept["source mix"]:
        taken[r["source"]] += size(r["text"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(size(lined[d]) for d in first if source[d] == s) + 1
    got = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()))
    assert got == sorted((r["doc_id"], *expected(reference, r["text"])) for r in kept["source mix"])


def test_empty_and_awkward_documents(spark, make_docs, awkward, small):
    for rows in ([], [*awkward, (None, "no id " * 60), (3, None), (3, "again " * 3)]):
        docs = make_docs(rows)
        for _name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, small), "test-stage")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

