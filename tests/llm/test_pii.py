import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelmill.llm import pii


def slow(text):
    """The base kinds by their stated patterns."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: slow(r["text"] or "") for r in rows}
    got = pii.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        base = want[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(joined(base).split(",") if base else []) <= set(spans)
    return {r["doc_id"]: r["spans"] for r in got}


def test_documents(small_docs):
    check(small_docs)


def test_awkward_texts(make_docs, awkward):
    more = ["a@b.co@d.com x@y.z..w", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111-1111 1111 0000000000000", "+1 (988) 555-2485 +12 +1    ", "é@é.com ü1.2.3.4ü", "9" * 30_000 + ".1.2.3", "@" * 1000, "😀 a@b.cc 😀"]
    check(make_docs([*awkward, *[(100 + i, t) for i, t in enumerate(more)], (107, more[7])]))


def test_empty_table(make_docs):
    assert pii.report(make_docs([])).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab@.@.-_ 1234+()05\né"))))
def test_base_spans_agree(text):
    assert pii.base_spans(text) == slow(text)


def test_added_spans(make_docs, small_docs):
    """Weak labels find what no base pattern has, and leave numbers with another meaning alone."""
    good = {
        1: ("Please write mail to jane.doe (at) mail (dot) com today", "email"),
        2: ("you can call (415) 555-2671 now", "phone"),
        3: ("her social security ssn 536-22-1234 is on file", "ssn"),
        4: ("Mein Konto iban DE89 3704 0044 0532 0130 00 danke", "iban"),
        5: ("He was born 12.04.1975 in Rome", "birthdate"),
        6: ("signed by Mary Johnson yesterday", "name"),
        7: ("She lives at 221 Baker Street in town", "address"),
    }
    bad = {20: "release version 536-22-1234 of part", 21: "order number 415-555-2671 shipped", 22: "iban DE00 1234 1234 1234 1234 00", 23: "The Quick Brown fox met Old King Cole"}
    rows = [(1000 + 100 * n + i, t) for n in range(3) for i, (t, _) in good.items()] + [(i + 5000, t) for i, t in bad.items()]
    spans = check(small_docs.select("doc_id", "text").where("doc_id < 100").unionByName(make_docs(rows).select("doc_id", "text")))
    for i, (text, kind) in good.items():
        assert spans[1000 + i].startswith(f"{kind}:"), (text, spans[1000 + i])
    for i, text in bad.items():
        assert spans[5000 + i] == "", (text, spans[5000 + i])


def test_labelers_are_weighed_by_their_agreement():
    """Two labelers that agree with the truth come out reliable, one that guesses doesn't."""
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    good = lambda p: np.where(rng.random(4000) < p, truth, ~truth)
    cast = np.stack([good(0.9), good(0.85), good(0.9), good(0.5), good(0.8), good(0.9)], axis=1) * 2
    keys = np.array([pii._key("phone", list(map(int, c)), 0) for c in cast])
    unique, counts = np.unique(keys, return_counts=True)
    belief, chances = pii.reliabilities(unique, counts.astype(float))
    assert chances[0, 1, 2] == pytest.approx(0.9, abs=0.05) and chances[0, 0, 0] == pytest.approx(0.9, abs=0.05)
    assert chances[3, 1, 2] == pytest.approx(0.5, abs=0.06)
    guess = belief[np.searchsorted(unique, keys)] > 0.5
    assert (guess == truth).mean() > 0.95


def test_spelled_addresses_are_candidates():
    for text in ("jane.doe at mail (dot) com", "jane.doe (at) mail.example", "jane.doe[at]mail[dot]com", "jane at mail dot example dot org", "write jane.doe(at)mail(dot)com!"):
        assert [text[a:b].strip("!").startswith("jane") for a, b in pii.spelled_emails(text)] == [True], text
    for text in ("arrived at example.com", "look at mail and post", "at noon", "(at) x.com", ""):
        assert list(pii.spelled_emails(text)) == [], text


def test_no_labeler_has_a_veto():
    """Failed checks and unknown names reach the models as votes against or without opinion."""
    for text, kind, labeler, vote in [("iban DE00 1234 1234 1234 1234 00", "iban", 1, 0), ("ssn 000-12-3456", "ssn", 1, 0), ("The Quick fox", "name", 2, 1), ("on 45.13.1999 it", "birthdate", 1, 0)]:
        (_, k, _, key), = pii.candidates(text, [])
        assert pii.KINDS[k] == kind and pii._unpack(np.array([key]))[1][0, labeler] == vote, text


def test_a_name_may_begin_at_the_second_capitalised_word():
    text = "Contact Anna Smith or Call Mary Jones"
    assert {text[a:b] for a, _, b, _ in pii.candidates(text, [])} >= {"Mary Jones"}
    text = "Contact Mary Smith"
    assert [text[a:b] for a, _, b, _ in pii.candidates(text, [])] == ["Mary Smith"]


@pytest.mark.parametrize("unit", ["123-45-6789 ", "A", "a@b.c ", "1.", "+1 ", "jane (at) mail (dot) com ", "AB12", "1 Old ", "9"])
def test_very_long_dense_texts_take_linear_time(unit):
    text = unit * (300_000 // len(unit))
    began = time.time()
    pii.candidates(text, pii.base_spans(text))
    assert time.time() - began < 5


def planted(n, rng):
    """(kind, is it personal data, text): spans of each kind in and out of context, and look-alikes."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    pick = lambda *options: rng.choice(options)
    first, last = sorted(pii.FIRST_NAMES), "Lovelace Hopper Turing Curie Noether Gauss Euler".split()

    def iban():
        body = digits(18)
        text = f"DE{98 - int(body + '131400') % 97:02d}{body}"
        return " ".join(text[i : i + 4] for i in range(0, len(text), 4))

    ssn = lambda: f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    phone = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{digits(4)}"
    good = {
        "email": lambda: pick(f"write to {rng.choice(last).lower()}.{digits(2)} (at) mail (dot) org now", f"contact {rng.choice(last).lower()} at post (dot) com please", f"reach me {rng.choice(last).lower()}[at]example.org today"),
        "phone": lambda: pick(f"call ({rng.randint(200, 999)}) 555-{digits(4)} today", f"phone {phone()}", f"his mobile is {phone()} since"),
        "ssn": lambda: pick(f"social security number {ssn()} on file", f"ssn: {ssn()}"),
        "iban": lambda: pick(f"pay to account {iban()} soon", f"IBAN: {iban()}", f"the transfer to {iban()} arrived"),
        "birthdate": lambda: pick(f"born {rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1930, 2005)} in town", f"date of birth: {rng.randint(1930, 2005)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"),
        "name": lambda: pick(f"signed by {rng.choice(first)} {rng.choice(last)} there", f"we saw {rng.choice(first)} {rng.choice(last)} again", f"and Mr Zoltan {rng.choice(last)} came"),
        "address": lambda: pick(f"lives at {rng.randint(1, 999)} {pick('Baker', 'Old Mill', 'High')} {pick('Street', 'Road', 'Lane')} now", f"our address is {rng.randint(1, 99)} Elm Avenue"),
    }
    bad = {
        "email": lambda: pick("arrived at example.com today", "look at mail and post", "(at) noon"),
        "phone": lambda: pick(f"order {digits(3)}-{digits(3)}-{digits(4)} shipped", f"part number {digits(3)}.{digits(3)}.{digits(4)}"),
        "ssn": lambda: pick(f"version {ssn()} of it", f"ssn 000-{digits(2)}-{digits(4)} is void", f"code 9{digits(2)}-{digits(2)}-{digits(4)}"),
        "iban": lambda: pick(f"iban DE00 {digits(4)} {digits(4)} {digits(4)} {digits(4)} 0{digits(1)} is wrong", f"serial AB12 {digits(4)} {digits(4)} {digits(4)}"),
        "birthdate": lambda: pick(f"invoice {rng.randint(30, 39)}.{rng.randint(13, 29)}.{rng.randint(1930, 2005)} is", f"release {rng.randint(1930, 2005)}-{rng.randint(13, 39)}-{rng.randint(32, 38)}"),
        "name": lambda: pick("then The Quick fox ran", "Old King Cole sat", "see Section Two Begins here"),
        "address": lambda: pick(f"page {rng.randint(1, 99)} Great Way of it", f"section {rng.randint(1, 99)} Open Court rules"),
    }
    return [(kind, truth, f"words go on here\n{source[kind]()}\nand there") for kind in good for _ in range(n) for truth, source in ((True, good), (False, bad))]


def test_recall_and_precision_on_planted_spans(spark, small_docs, make_docs):
    rows = planted(150, random.Random(4))
    docs = small_docs.select("doc_id", "text").unionByName(make_docs([(10_000 + i, t) for i, (_, _, t) in enumerate(rows)]).select("doc_id", "text"))
    found = {r["doc_id"]: {pii.KINDS[s["kind"]] for s in r["added"]} for r in pii.find(docs).collect()}
    for kind in {k for k, _, _ in rows}:
        hits = [(truth, kind in found[10_000 + i]) for i, (k, truth, _) in enumerate(rows) if k == kind]
        caught, wrong = sum(t and h for t, h in hits), sum(h and not t for t, h in hits)
        print(kind, "recall", caught / 150, "precision", caught / max(1, caught + wrong))
        assert caught >= 0.9 * 150 and wrong <= 0.1 * 150, kind


def test_gazetteers_come_from_tables(spark, make_docs):
    table = spark.createDataFrame([("Zaphod",), ("Zaphod",), (None,)], "name string")
    params = pii.Params(first_names=pii.gazetteer(table, "name"))
    (_, _, _, key), = pii.candidates("we met Zaphod Beeblebrox there", [], params)
    assert params.first_names == {"Zaphod"} and pii._unpack(np.array([key]))[1][0, 2] == 2
