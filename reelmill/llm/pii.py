"""Personal data by weak supervision.

Four base kinds have fixed patterns and checks. Beside them, looser patterns and a gazetteer propose candidate spans,
and labelers of three sorts vote on each candidate: patterns (well-formed, check digits, loose shape), gazetteers
(names, domains, street words) and context (words before the span that speak for or against it). No labeler decides
alone: a failed check or a name that no gazetteer has is a vote like any other. Expectation maximisation over all
candidates of the corpus estimates how far each labeler can be trusted, and a logistic span classifier is fitted to the
posteriors, with features of the span's shape and of what stands around it. Candidates that it accepts are added.

A candidate is seen by the models only as (kind, votes, shape, setting), of which there are at most
KINDS x 3^6 x 16 x 8. The corpus is therefore one table of counts of that bounded size, summed on Spark over all rows;
no row is sampled. The classifier is applied as a column expression.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm._shared import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
#: All kinds, in the order in which spans of one start are listed.
KINDS = (*BASE_KINDS, "name", "ssn", "iban", "birthdate", "address")

#: Gazetteers. First names of four languages, top-level domains, words that end a street's name.
FIRST_NAMES = frozenset(
    "James Robert Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Joshua Kevin Brian George Edward "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Emily Michelle Laura Hannah Olivia "
    "Hans Klaus Jürgen Wolfgang Ursula Sabine Heike Stefan Matthias Pierre Jacques Marie François Camille Nathalie José Carlos María Carmen Lucía Pablo Javier".split()
)
DOMAINS = frozenset("com org net edu gov io co info de fr es uk us eu ch at it nl".split())
STREETS = frozenset("Street St Avenue Ave Road Rd Boulevard Blvd Lane Ln Drive Dr Court Ct Way Square Place".split())
#: Context words by kind, for and against.
FOR = {
    "email": "mail e-mail email contact write reach correo courriel",
    "ip": "ip address host server client login from",
    "card": "card visa mastercard credit debit payment karte carte tarjeta",
    "phone": "phone tel call mobile cell fax telefon téléphone teléfono contact reach",
    "name": "name mr mrs ms dr prof herr frau monsieur madame señor señora dear contact signed by",
    "ssn": "ssn social security",
    "iban": "iban account konto compte cuenta bank",
    "birthdate": "born birth birthday dob geboren né née nacido nacida",
    "address": "address live lives at residing home wohnhaft",
}
WANTED = {kind: frozenset(words.split()) for kind, words in FOR.items()}
AGAINST = frozenset("version ver v release isbn issn order invoice ref no number page section chapter figure id sku part model build example".split())

#: A match never starts within a run of digits, so the look behind changes none; it keeps very long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"

#: An address spelled out: what stands for @, and the domain behind it with at least one dot, plain or spelled.
_AT = re.compile(r" ?[(\[]at[)\]] ?| at ")
_SPELLED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[(\[]dot[)\]] ?| dot |\.)[A-Za-z0-9-]{2,63}){1,4}")
_DOT = re.compile(r"[(\[ ]dot[)\] ]")
#: What proposes further candidates: kind and pattern. A span must not touch a letter or digit. Each is tried once a run
#: of its first characters, so the time of a text grows with its length.
PROPOSALS = (
    ("phone", re.compile(r"\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}")),
    ("ssn", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?")),
    ("birthdate", re.compile(r"[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}")),
    ("address", re.compile(rf"(?<![0-9])[0-9]{{1,5}} (?:[A-Z][{_LATIN}]++ ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Square|Place)\b")),
)
#: A capitalised word before another one; the second is only looked at, since it may begin the name that is meant.
_NAME = re.compile(rf"(?<![{_LATIN}'-])([A-ZÀ-ÖØ-Þ][{_LATIN}]++) (?=([A-ZÀ-ÖØ-Þ][{_LATIN}'-]++))")
_WORDS = re.compile(rf"[{_LATIN}'-]+")

#: Values of a candidate's shape and setting.
SHAPES, SETTINGS = 16, 8
LABELERS = ("pattern", "check", "gazetteer", "context_for", "context_against", "shape")


@dataclass(frozen=True)
class Params:
    """window: code points before a span that context labelers read; a span is added from `threshold` on. prior_share: weight of what
    is assumed beforehand of a kind's labelers, as a share of its candidates. The word lists
    are the gazetteers; `gazetteer` makes one of a reference table."""

    window: int = 40
    threshold: float = 0.5
    rounds: int = 100
    ridge: float = 1.0
    prior_share: float = 2.0
    first_names: frozenset[str] = FIRST_NAMES
    domains: frozenset[str] = DOMAINS
    streets: frozenset[str] = STREETS


#: Entries that a gazetteer may have; it travels to every task.
MAX_GAZETTEER = 1_000_000


def gazetteer(table: DataFrame, column: str) -> frozenset[str]:
    """The values of a reference table's column, which may have MAX_GAZETTEER of them."""
    rows = table.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_GAZETTEER + 1).collect()
    if len(rows) > MAX_GAZETTEER:
        raise ValueError(f"a gazetteer has more than {MAX_GAZETTEER} entries")
    return frozenset(r[0] for r in rows)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @: the name before it is as long
    as it can be, but for what an earlier match has taken."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _vote(yes: bool, no: bool = False) -> int:
    """2 for, 0 against, 1 no opinion."""
    return 2 if yes else 0 if no else 1


def votes(kind: str, span: str, before: str, params: Params = Params()) -> list[int]:
    """What each of LABELERS says."""
    digits = [c for c in span if c.isdigit()]
    words = [w.strip(".'-").lower() for w in _WORDS.findall(before)]
    near = words[-5:]
    check = 1
    if kind == "card":
        check = _vote(luhn("".join(digits)), True)
    elif kind == "iban":
        check = _vote(_iban_ok(span), True)
    elif kind == "ssn":
        check = _vote(span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000", True)
    elif kind == "birthdate":
        parts = [int(p) for p in re.split(r"[./-]", span)]
        day, month = (parts[2], parts[1]) if parts[0] > 31 else (parts[0], parts[1])
        check = _vote(1 <= min(day, month) <= 12 and max(day, month) <= 31, True)
    elif kind == "email":
        check = _vote(bool(re.search(r"[A-Za-z0-9]$", span)), True)
    gazetteer = 1
    if kind == "name":
        gazetteer = _vote(span.split(" ")[0] in params.first_names)
    elif kind == "email":
        gazetteer = _vote(re.split(r"[^A-Za-z0-9-]+", span)[-1].lower() in params.domains, True)
    elif kind == "address":
        gazetteer = _vote(span.split(" ")[-1] in params.streets)
    written = {"email": "@" in span or "(" in span or "[" in span, "phone": span[0] in "+(" or "-" in span, "card": len(digits) in (15, 16), "ip": True}.get(kind, False)
    repeated = len(digits) > 5 and len(set(digits)) < 3
    shape = _vote(False, repeated or kind == "name" and any(len(w) < 3 for w in span.split(" ")))
    wanted = WANTED[kind]
    against = any(w in AGAINST for w in near[-2:]) and not any(w in wanted for w in near[-3:])  # a "card number" speaks for a card
    return [_vote(written, kind == "email"), check, gazetteer, _vote(any(w in wanted for w in near)), _vote(False, against), shape]


def _shape(span: str) -> int:
    """0 to 15: length in four steps, share of digits in four steps."""
    share = sum(c.isdigit() for c in span) / len(span)
    return sum(len(span) > n for n in (12, 18, 26)) * 4 + sum(share > s for s in (0.0, 0.5, 0.9))


def _setting(text: str, start: int, end: int) -> int:
    """0 to 7: what stands before the span (line start, a colon or like, other punctuation, a word) and whether a word follows it."""
    before = text[max(0, start - 2) : start].rstrip(" ")[-1:]
    where = 0 if start == 0 or before in ("", "\n") else 1 if before in ":=(<" else 3 if before.isalnum() else 2
    return where * 2 + (end < len(text) and text[end] == " " and text[end + 1 : end + 2].isalnum())


def _key(kind: str, cast: list[int], shape: int, setting: int = 0) -> int:
    code = 0
    for v in cast:
        code = code * 3 + v
    return ((KINDS.index(kind) * 3 ** len(LABELERS) + code) * SHAPES + shape) * SETTINGS + setting


def spelled_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses like `jane.doe (at) mail (dot) com`, found from what stands for @. A plain ` at ` needs a spelled dot."""
    free = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > free and m.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELLED.match(text, m.end()) if start < m.start() else None
        if domain and (m[0] != " at " or _DOT.search(domain[0])):
            free = domain.end()
            yield start, free


def _apart(spans: Iterable[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ascending spans that overlap neither one before nor a taken one; taken spans are ascending and disjoint."""
    out, at, reach = [], 0, 0
    for start, end in spans:
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= reach and (at == len(taken) or taken[at][0] >= end):
            out.append((start, end))
            reach = end
    return out


def candidates(text: str, base: list[tuple[int, int, int]], params: Params = Params()) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, key) of candidates: base spans first, for the labelers' sake, then proposals that touch none.

    Of proposals of two kinds that overlap the earlier kind in KINDS' order of proposal stays. Of names that overlap, one with a
    first name of the gazetteer goes before one behind a context word, and that before any other; then the first.
    """
    found: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int]] = []

    def judged(kind: str, start: int, end: int) -> tuple[list[int], tuple[int, int, int, int]]:
        span = text[start:end]
        cast = votes(kind, span, text[max(0, start - params.window) : start], params)
        return cast, (start, KINDS.index(kind), end, _key(kind, cast, _shape(span), _setting(text, start, end)))

    for start, kind, end in base:
        found.append(judged(KINDS[kind], start, end)[1])
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))

    def clear(start: int, end: int) -> bool:
        return not (start and (text[start - 1].isalnum() or text[start - 1] in "@+-./") or end < len(text) and text[end].isalnum())

    for kind, spans in (("email", spelled_emails(text)), *((k, (m.span() for m in p.finditer(text))) for k, p in PROPOSALS)):
        if fresh := _apart((s for s in spans if clear(*s)), taken):
            found += [judged(kind, *s)[1] for s in fresh]
            taken = list(merge(taken, fresh))
    names: tuple[list, list, list] = ([], [], [])
    rows = {}
    for m in _NAME.finditer(text):
        start, end = m.start(1), m.end(2)
        if clear(start, end):
            cast, rows[start] = judged("name", start, end)
            names[0 if cast[2] == 2 else 1 if cast[3] == 2 else 2].append((start, end))
    for some in names:
        if fresh := _apart(some, taken):
            found += [rows[start] for start, _ in fresh]
            taken = list(merge(taken, fresh))
    return found


SCAN = "doc_id long, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,kind:int,end:int,key:int,own:boolean>>"


def scan(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One pass over the texts: base spans and candidates of each row, base spans marked as own. Null text counts as empty."""
    one = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    more = pa.struct([*one, ("key", pa.int32()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
                found.append([dict(zip(("start", "kind", "end", "key", "own"), (*c, i < len(spans)), strict=True)) for i, c in enumerate(candidates(text, spans, params))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, type=pa.list_(one)), pa.array(found, type=pa.list_(more))], ["doc_id", "base", "found"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCAN)


def _unpack(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kind, votes (n, labelers), shape, setting."""
    setting, rest = keys % SETTINGS, keys // SETTINGS
    shape, rest = rest % SHAPES, rest // SHAPES
    n = len(LABELERS)
    cast = np.stack([rest // 3 ** (n - 1 - i) % 3 for i in range(n)], axis=1) if len(keys) else np.zeros((0, n), dtype=np.int64)
    return rest // 3**n, cast, shape, setting


#: Chances of a vote against, without opinion and for that each labeler has beforehand: of a false span, of a true one.
PRIOR = np.array([[[0.25, 0.60, 0.15]] * 6, [[0.08, 0.50, 0.42]] * 6])
for _name, _chances in {
    "check": ([0.54, 0.36, 0.10], [0.005, 0.375, 0.62]),
    "gazetteer": ([0.52, 0.40, 0.08], [0.08, 0.40, 0.52]),
    "context_for": ([0.01, 0.87, 0.12], [0.01, 0.50, 0.49]),
    "context_against": ([0.30, 0.69, 0.01], [0.04, 0.95, 0.01]),
}.items():
    PRIOR[:, LABELERS.index(_name)] = _chances
#: The same of a check that most numbers of the shape pass.
WEAK_CHECK = np.array([[0.35, 0.20, 0.45], [0.02, 0.38, 0.60]])
WEAKLY_CHECKED = ("ssn", "birthdate", "email")


def _prior(kind: int) -> np.ndarray:
    found = PRIOR.copy()
    if KINDS[kind] in WEAKLY_CHECKED:
        found[:, LABELERS.index("check")] = WEAK_CHECK
    return found


def reliabilities(keys: np.ndarray, counts: np.ndarray, params: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation: (posterior of each key that its spans are personal data, (labelers, 2, 3) chances of
    each vote given the truth, over all kinds). Each kind has its own share of true spans and its own reliabilities,
    which start from PRIOR; labelers are independent given the truth."""
    kind, cast, *_ = _unpack(keys)
    belief = np.zeros(len(keys))
    votes_of = [(cast == v).astype(float) for v in range(3)]
    for k in np.unique(kind):
        at, prior = kind == k, _prior(k)
        n, held = counts[at], [v[at] for v in votes_of]
        odds = np.log(prior[1] / prior[0])
        belief[at] = 1 / (1 + np.exp(-sum(odds[j, cast[at, j]] for j in range(len(LABELERS)))))
        weight = params.prior_share * n.sum()
        for _ in range(params.rounds):
            fresh = belief[at]
            share = ((n * fresh).sum() / n.sum() + params.prior_share) / (1 + 2 * params.prior_share)
            log = [np.log(1 - share), np.log(share)]
            for truth, mass in enumerate((n * (1 - fresh), n * fresh)):
                chances = np.stack([mass @ v for v in held], axis=1) + weight * prior[truth]
                chances = np.log(chances / chances.sum(axis=1, keepdims=True))
                log[truth] = log[truth] + sum(v @ chances[:, i] for i, v in enumerate(held))
            belief[at] = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            if np.abs(fresh - belief[at]).max(initial=0) < 1e-6:
                break
    total = np.stack([np.stack([(counts * m) @ v for v in votes_of], axis=1) for m in (1 - belief, belief)], axis=1) + 1
    return belief, total / total.sum(axis=2, keepdims=True)


def _features(keys: np.ndarray) -> np.ndarray:
    """One column each for the kind, each vote for and against, each shape and setting but the first, and a constant."""
    kind, cast, shape, setting = _unpack(keys)
    columns = [(kind == k) for k in range(len(KINDS))] + [(cast[:, j] == v) for j in range(len(LABELERS)) for v in (0, 2)]
    columns += [(shape == s) for s in range(1, SHAPES)] + [(setting == s) for s in range(1, SETTINGS)] + [np.ones(len(keys), dtype=bool)]
    return np.stack(columns, axis=1).astype(float)


def fit(keys: np.ndarray, counts: np.ndarray, belief: np.ndarray, params: Params = Params()) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the posteriors, by Newton steps with a ridge. Counts
    enter by their logarithm, so that the frequent base kinds don't drown the rest."""
    x, mass = _features(keys), 1 + np.log1p(counts.astype(float))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (mass * (belief - p)) - params.ridge * 0.1 * w
        curve = (x * (mass * p * (1 - p))[:, None]).T @ x + params.ridge * 0.1 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(counted: DataFrame, params: Params = Params()) -> np.ndarray | None:
    """The span classifier's weights, or None without candidates. counted (key, n) is of bounded size."""
    rows = counted.orderBy("key").collect()
    if not rows:
        return None
    keys, counts = np.array([r["key"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=float)
    return fit(keys, counts, reliabilities(keys, counts, params)[0], params)


def score(key: Column, weights: np.ndarray) -> Column:
    """The classifier's log-odds of a candidate, by its key."""
    w = [float(x) for x in weights]
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    part = lambda under, size: F.floor(key / under) % size
    n, at = len(LABELERS), len(KINDS)
    total = F.lit(w[-1]) + pick(w[:at], F.floor(key / (SETTINGS * SHAPES * 3**n)))
    for j in range(n):
        total += pick([w[at + 2 * j], 0.0, w[at + 2 * j + 1]], part(SETTINGS * SHAPES * 3 ** (n - 1 - j), 3))
    at += 2 * n
    total += pick([0.0, *w[at : at + SHAPES - 1]], part(SETTINGS, SHAPES))
    return total + pick([0.0, *w[at + SHAPES - 1 : -1]], part(1, SETTINGS))


def find(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, base, added): arrays of (start, kind number, end) for every row of docs."""
    scanned = materialize(scan(docs, params), "pii-scan")
    counted = scanned.select(F.explode("found.key").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    weights = train(counted, params)
    good = lambda c: F.lit(False) if weights is None else score(c["key"], weights) >= math.log(params.threshold / (1 - params.threshold))
    fresh = F.filter("found", lambda c: ~c["own"] & good(c))
    added = F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", "base", added.alias("added"))


def report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The columns of op1. Null and empty texts have no spans; a text of any length is read whole, in time that grows with
    its length; spans that start together are listed in KINDS' order; repeated rows are judged alike; an empty table gives an
    empty table; other columns are not read."""
    found = find(docs, params)
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
