import random
import re
import zlib
from collections import Counter

import pytest

from reelmill.llm import spelling

LETTERS = "[A-Za-zÀ-ÿ]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def slow(rows, params=spelling.Params()):
    count = Counter()
    for doc, text in rows:
        for run in re.findall(LETTERS, text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if params.noise and h % params.noise == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            count[run] += len(run) >= params.least_chars
    count = {w: n for w, n in count.items() if n >= params.least_count}
    holes = {}
    for w in count:
        for i in range(len(w)):
            holes.setdefault((i, w[:i], w[i + 1 :]), set()).add(w)
            if w[:i] + w[i + 1 :] in count:
                holes.setdefault(("gap", w, w[:i] + w[i + 1 :]), set()).update((w, w[:i] + w[i + 1 :]))
    near = {w: set() for w in count}
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        if best is not None and count[best] >= params.form_ratio * count[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), count.get(form.get(w))) for w, n in count.items())


def got(docs, params=spelling.Params()):
    assert spelling.report(docs, params).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, spelling.report(docs, params).collect()))


def test_documents(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    want = slow(rows)
    assert got(small_docs) == want
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)


@pytest.mark.parametrize("params", [spelling.Params(noise=0, least_count=1), spelling.Params(noise=3, least_chars=2, least_count=1, form_ratio=2, max_list=3, queries=5, held_letters=50)])
def test_dense_words(make_docs, params):
    """Few letters, so that nearly all words are near one another, ties abound, and crowded lists are split to one letter."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(40)] + [(None, "aaaaaaa aaaaaa aaaaaaaa"), (3, "aaaaaab Aaaaaab")]
    assert got(make_docs(rows), params) == slow(rows, params)


def test_awkward(make_docs, awkward):
    rows = [*awkward, (None, "letter Letter LETTER lettr×s"), (4, "letters " * 30 + "lettrs " * 6 + "x" * 30_000 + " "), *[(9, ("x" * 30_000 + " ") * 2 + "x" * 30_001 + " ")] * 5]
    want = slow(rows)
    assert got(make_docs(rows)) == want
    assert got(make_docs([])) == []


def test_chain(make_docs):
    rows = [(1, "abcdefgh " * 130 + "abcdefg " * 26 + "abcdef " * 5)]
    out = {r[0]: r for r in got(make_docs(rows), spelling.Params(noise=0))}
    assert out["abcdef"] == ("abcdef", "abcdefg", "abcdefgh", 5, 1, 26)
    assert out["abcdefgh"][1:3] == (None, "abcdefgh")
