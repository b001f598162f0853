import hashlib
import random

import numpy as np
import pytest

from reelmill.llm import suffix_dedup


def slow(rows, length=50):
    doc = lambda d: suffix_dedup.LAST_DOC if d is None else d
    owner = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            owner[s] = min(owner.get(s, doc(d)), doc(d))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if owner[b[i : i + length]] < doc(d):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs, params=suffix_dedup.Params()):
    out = suffix_dedup.report(docs, params)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("segments", [[b"banana", b"bananas", b"ananas", b"b", b"", b"banana"], [b"aaaaaaa"] * 3, [bytes([0, 255, 0, 255]), bytes([255, 0])]])
def test_transform_is_that_of_the_sorted_suffixes(segments):
    suffixes = sorted((s[i:], k, i) for k, s in enumerate(segments) for i in range(len(s) + 1))
    bwt, common = suffix_dedup.build(segments, 4)
    # equal suffixes come in the order of the segments' earlier rounds; the symbols of a stretch of equal suffixes may change places
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert common.tolist() == [0] + [min(4, shared(a[0], b[0])) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    want = [0 if i == 0 else segments[k][i - 1] + 1 for _, k, i in suffixes]
    at = 0
    while at < len(suffixes):
        end = at
        while end < len(suffixes) and suffixes[end][0] == suffixes[at][0]:
            end += 1
        assert sorted(bwt[at:end].tolist()) == sorted(want[at:end])
        at = end


def test_owners_of_random_segments():
    rng = random.Random(5)
    segments = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 20))).encode() for _ in range(200)]
    docs = np.array([rng.randint(0, 50) for _ in segments])
    least = {}
    for s, d in zip(segments, docs, strict=True):
        for i in range(len(s) - 5):
            least[s[i : i + 6]] = min(least.get(s[i : i + 6], d), d)
    found = suffix_dedup.owners(segments, docs, 6)
    assert [o.tolist() for o in found] == [[least[s[i : i + 6]] for i in range(len(s) - 5)] for s in segments]


def test_equal_strings_have_equal_keys():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    params = suffix_dedup.Params(length=12, anchors=(5, 8, 12), piece_bytes=700)
    for level in range(3):
        seen = {}
        for start, count, key in zip(*suffix_dedup.cut(data, level, params), strict=True):
            for i in range(start, start + count):
                assert seen.setdefault(data[i : i + 12].tobytes(), key) == key
        assert sum(suffix_dedup.cut(data, level, params)[1]) == 4000 - 11


def test_documents(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    want = slow(rows)
    assert got(small_docs) == want
    assert any(0 < r[2] < r[1] for r in want)


def mixed():
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, passage[rng.randint(0, 120) : rng.randint(170, 300)] + "".join(rng.choice("abcdefgh ") for _ in range(60))) for i in range(60)]
    rows += [(70 + i, "=" * rng.randint(40, 200) + rng.choice("xyz") * 60) for i in range(12)]
    return rows + [(90, "é" * 40), (91, "x" + "é" * 40), (None, passage), (None, passage), (5, passage), (5, passage[:100])]


@pytest.mark.parametrize("params", [suffix_dedup.Params(), suffix_dedup.Params(max_group=2, block_bytes=400, built_bytes=500, piece_bytes=64)])
def test_repeats(make_docs, params):
    assert got(make_docs(mixed()), params) == slow(mixed())


def test_awkward(make_docs, awkward):
    rows = [*awkward, *[(40 + i, t) for i, t in awkward[::-1]]]
    assert got(make_docs(rows)) == slow(rows)
    assert got(make_docs([])) == []


def test_columns(make_docs):
    docs = make_docs(mixed()).selectExpr("*", "1 as doc", "2 as row_hash", "3 as marks", "4 as rest", "5 as n_spans")
    out = suffix_dedup.dedup(docs)
    assert out.columns == [c for c in docs.columns if c not in ("text", "n_spans")] + ["data", "n_bytes", "n_removed", "n_spans"]
    assert out.where("doc_id = 0 and n_removed = 0 and marks = 3 and extra = 'x'").count() == 1
