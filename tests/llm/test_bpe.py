import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from reelmill.llm import bpe


@pytest.fixture(scope="module")
def reference():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(reference, text):
    ids = reference.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def check(reference, docs, params=bpe.Params()):
    want = sorted((r["doc_id"], *expected(reference, r["text"])) for r in docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, bpe.report(docs, params).collect())) == want


def test_agrees_with_library_on_documents(small_docs, reference):
    check(reference, small_docs)


def test_awkward_texts_and_small_blocks(make_docs, awkward, reference):
    docs = make_docs([*awkward, (3, "repeated row"), (3, "repeated row")])
    check(reference, docs)
    check(reference, docs, bpe.Params(block_chars=50, remembered_words=3, piece_words=2))


def test_empty_table(make_docs):
    assert bpe.report(make_docs([])).collect() == []


def test_ids_and_decoding(make_docs, reference):
    texts = ["Hello wörld, it's 5.", "", None, "漢字 naïve"]
    docs = make_docs(list(enumerate(texts)))
    ids = bpe.encode_ids(docs)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode_ids(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_replay_of_many_words_at_once(reference, small_docs, monkeypatch):
    vocab = bpe.vocabulary(None, None)
    words = sorted({w for r in small_docs.collect() for w in vocab.words(r["text"] or "")} | {" " * n for n in range(1, 90)} | {"a" * n for n in range(1, 60)} | {"=-" * n for n in range(40)})
    want = [i for w in words for i in vocab.merge_alone(w.encode())]
    for many in (1, 40, 10**9):
        monkeypatch.setattr(bpe, "MANY", many)
        assert vocab.replay([w.encode() for w in words])[0] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aaabe th'sn \n\t.é"), st.characters(codec="utf-8"))), max_size=5))
def test_replay_agrees_on_any_text(reference, texts):
    vocab = bpe.vocabulary(None, None)
    for text in texts:
        words = vocab.words(text)
        assert "".join(words) == text
        ids, counts = vocab.replay([w.encode() for w in words])
        assert ids == reference.encode_ordinary(text) and sum(counts) == len(ids)
        assert [i for w in words for i in vocab.merge_alone(w.encode())] == ids
