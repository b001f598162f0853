import base64
import os
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
import zstandard

from reelmill.llm import quality


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def check(docs):
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]] = r["text"]
    for r in quality.report(docs).collect():
        want = slow(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["band_verdict"] is None)


def test_documents(small_docs):
    check(small_docs)


def test_awkward(make_docs, awkward):
    check(make_docs([*awkward, (50, "a b c a b c d"), (51, "# *\n# *\n\n\n|x|"), (52, "a a a a")]))


def test_empty_table(make_docs):
    assert quality.report(make_docs([])).collect() == []
    assert quality.keep_good(make_docs([])).collect() == []


def prose():
    """A labelled-good text of the smallest tables, of more than a chunk's bytes."""
    docs, labels = (pq.read_table(f"/root/testdata/sf0.001/{t}.parquet").to_pylist() for t in ("documents", "labels"))
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    return min((r["text"] for r in docs if r["doc_id"] in good and len(r["text"].encode()) > 4100), key=len)


PROSE = prose()


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("", None),
        ("spam " * 200, "repetitive"),
        (base64.b64encode(os.urandom(4000)).decode(), "incompressible"),
        (PROSE, None),
        (PROSE + "spam " * 4000, "repetitive"),
    ],
)
def test_bands(text, verdict):
    got = quality.measure(text, zstandard.ZstdCompressor(level=3))[-1]
    assert got == verdict


def test_bad_chunks_in_a_text_with_an_ordinary_mean():
    text = "".join(f"{i * i * 7919 % 100003:x} tion the " for i in range(4000)) + "spam " * 5500
    *_, chunks, bad, verdict = quality.measure(text, zstandard.ZstdCompressor(level=3), quality.Params(bands=((1000, 1.0, 9.0),)))
    assert chunks > 2 and bad / chunks > 0.25 and verdict == "repetitive chunks"


def test_labelled_good_documents_stay(spark, small_docs, small):
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    got = quality.report(small_docs).join(good, "doc_id").where("n_words >= 50")
    assert got.where("NOT kept").count() == 0


def test_labelled_bad_documents_with_high_ratios_go(spark, small_docs, small):
    bad = spark.read.parquet(f"{small}/labels.parquet").where("quality = 0").select("doc_id")
    got = quality.report(small_docs).join(bad, "doc_id").where("NOT base_failed")
    assert got.where("NOT kept AND band_verdict LIKE 'repetitive%'").count() > 0


def test_tail_and_single_full_chunk_are_judged(small_docs, spark, small):
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    clean = next(r["text"] for r in small_docs.join(good, "doc_id").orderBy("doc_id").collect() if len(r["text"]) > 7000)
    press = zstandard.ZstdCompressor(level=3)
    assert quality.measure(clean, press)[-1] is None
    hidden = clean.encode()[:3300].decode("utf-8", "ignore") + "spam " * 320
    *_, ratio, chunks, bad, verdict = quality.measure(hidden, press)
    assert (chunks, bad) == (2, 2) and verdict.startswith("repetitive") and ratio < 4.2


@pytest.mark.parametrize("share", [4, 6, 9])
def test_one_text_has_one_verdict_at_neighbouring_lengths(share):
    """Repetitive to one degree, cut around the chunk's size and around a full chunk with the shortest tail of a band."""
    text = "".join(f"{i * i * 7919 % 100003:x} tion the " + "again and again " * (i % share == 0) for i in range(2000))
    found = {quality.measure(text[:n], zstandard.ZstdCompressor(level=3))[-1] for n in (4000, 4095, 4096, 4097, 4200, 4295, 4296, 4297, 4999, 5000)}
    assert len(found) == 1


def test_short_tail_belongs_to_the_chunk_before():
    sizes = lambda n: [len(p) for p in quality._parts(b"x" * n, quality.Params())]
    assert (sizes(0), sizes(100), sizes(4096), sizes(4097), sizes(4295), sizes(4296)) == ([0], [100], [4096], [4097], [4295], [4096, 200])
    assert sizes(8192 + 150) == [4096, 4246]
    noisy_tail = (PROSE[:4000] + "spam " * 900).encode()[: 8192 + 150].decode("utf-8", "ignore")
    assert quality.measure(noisy_tail, zstandard.ZstdCompressor(level=3))[-1] is not None


def test_fitted_bands(spark, small_docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    fitted = quality.fit_bands(small_docs, labels)
    assert [b[:2] for b in fitted] == [b[:2] for b in quality.Params().bands]
    good = small_docs.join(labels.where("quality = 1"), "doc_id")
    most, press = {}, zstandard.ZstdCompressor(level=3)
    for r in good.collect():
        n, *_, repeat, _, _, _, _ = quality.measure(r["text"], press)
        data = r["text"].encode()
        for part in [data, *quality._parts(data, quality.Params())] if n >= 50 and 2 * repeat <= n else []:
            at = max((i for i, b in enumerate(fitted) if b[0] <= len(part)), default=None)
            most[at] = max(most.get(at, 0), len(part) / len(press.compress(part)))
    assert all(fitted[i][2] == (round(most[i] * 1.03, 3) if i in most else b[2]) for i, b in enumerate(quality.Params().bands))
    assert quality.report(small_docs, quality.Params(bands=fitted)).join(good.select("doc_id"), "doc_id").where("n_words >= 50 AND NOT base_failed AND NOT kept").count() == 0


def test_clashing_column_names(make_docs):
    docs = make_docs([(1, PROSE), (2, "spam " * 400)]).selectExpr("*", "1 as __quality", "2 as __quality_", "3 as ratio", "4 as verdict")
    got = quality.keep_good(docs)
    assert got.columns == docs.columns and [r["doc_id"] for r in got.collect()] == [1]
