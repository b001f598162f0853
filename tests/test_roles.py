"""Role headers and the credit parse against plain versions."""

import json
import random
import re

import pytest

from reelmill.functions.similarity import ratio_of
from reelmill.operators import roles

LISTED = [(t, c) for c, texts in roles.ALIASES for t in texts]
PHRASES = [(t, c) for c, texts in roles.PHRASES for t in texts]


def fold(low):
    t = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", low.translate(str.maketrans(roles.FOLD_FROM, roles.FOLD_TO)).lower())).strip()
    return re.sub(r"^\d+\s*ekip\s*", "", t)


def slow_header(text, listed=LISTED, phrases=PHRASES):
    low = text.strip().replace("İ", "i").lower()
    if not low:
        return None
    bare = {}
    for a, c in listed:
        bare.setdefault(fold(a), c)

    def start(t, pairs):
        exact = [c for a, c in pairs if a == t]
        return exact[0] if exact else next((c for a, c in pairs if t.startswith((a + " ", a + ":"))), None)

    def phrase(t):
        return next((c for p, c in phrases if re.search(r"(?<!\w)" + r"\s+".join(map(re.escape, p.split())) + r"(?!\w)", t)), None)

    def near(t, pairs):
        best = max(((ratio_of(t, a), -i, c) for i, (a, c) in enumerate(pairs)), default=(0, 0, None))
        return best[2] if t and best[0] >= 80 else None

    pairs = list(bare.items())
    norm = fold(low)
    end = next(("company" for e in roles.COMPANY_ENDS if low.endswith(e) and len(low) > len(e) + 2), None)
    return start(low, listed) or phrase(low) or start(norm, pairs) or phrase(norm) or near(low, listed) or near(norm, pairs) or end


def misread(text, rng):
    i = rng.randrange(len(text))
    return rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("lıxe") + text[i:], text[:i] + rng.choice("lıxe") + text[i + 1 :], text.upper()])


TEXTS = [
    None, "", "  ", "Oyuncular", "OYUNCULAR", "oyuncular:", "Oyuncuiar", "Yönetnem", "GORUNTU YONETNENi", "2. Ekip Kamera", "2.EKiP KAMERA OPERATORLERi", "bir müzik gecesi", "Ada Lovelace",
    "Acme Film", "film", "a film", "directed  by x", "edited by", "Edited by: Jon", "Kurgu - Ann Lee", "castle", "Cast of shadows", "é cast", "écast", "director of photography", "Görüntü Yönetmeni", "x" * 5000,
]


def test_layers(spark):
    rng = random.Random(4)
    texts = TEXTS + [misread(misread(a, rng), rng) for a, _ in LISTED for _ in range(3)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "video_id long, line_no long, text string")
    got = {r["line_no"]: (r["category"], r["layer"]) for r in roles.role_headers(df).collect()}
    want = {i: c for i, t in enumerate(texts) if t and (c := slow_header(t))}
    assert {i: c for i, (c, _) in got.items()} == want
    assert {layer for _, layer in got.values()} == {"exact", "prefix", "phrase", "folded", "fuzzy", "company"} | ({"folded phrase"} & {v[1] for v in got.values()})
    for misread_header, category in (("Oyuncuiar", "cast"), ("Yönetnem", "director"), ("GORUNTU YONETNENi", "crew")):
        assert got[texts.index(misread_header)] == (category, "fuzzy")


def test_own_tables(spark, tmp_path):
    made = {"roles": [{"category": "light", "aliases": ["gaffer", "Best Boy"], "phrases": ["lighting by"]}, {"category": "stunt", "aliases": ["stunts"]}]}
    path = tmp_path / "roles.json"
    path.write_text(json.dumps(made))
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Gaffer", "best bot", "stunts: Al", "all lighting by Al", "Cast"])], "video_id long, line_no long, text string")
    got = [(r["line_no"], r["category"], r["layer"]) for r in roles.role_headers(df, *roles.role_tables(spark, str(path))).orderBy("line_no").collect()]
    assert got == [(0, "light", "exact"), (1, "light", "fuzzy"), (2, "stunt", "prefix"), (3, "light", "phrase")]


@pytest.mark.parametrize("known", [(), ("Dan Poe",), ("Cem Kaya", "Ada Star", "Fay Lim")])
def test_parse(spark, known):
    names = ["Ada King", "Bob Lee", "Cem Kaya", "Dan Poe", "Eva Roe", "Fay Lim"]
    rows = ["The Long Road", "Ada Star", "made 1987", "Directed by", *names, "Oyuncular", "KOLA", "Kurgu: Jon Snow", "KOLA", "Dan Poe", "Ada King 1990", "production", *names, "Acme Film", "###"]
    lines = spark.createDataFrame([(1, i, t, 0.9) for i, t in enumerate(rows)] + [(2, 0, "ada", 0.5)], "video_id long, line_no long, text string, confidence double")
    table = spark.createDataFrame([(i, n) for i, n in enumerate(known)] or [(0, "No One")], "nconst long, primary_name string")
    found = roles.credit_parse_full(lines, table).orderBy("video_id", "line_no").collect()
    got = [(r["name"], r["category"]) for r in found if r["video_id"] == 1]
    want = [("The Long Road", "cast"), ("Ada Star", "cast"), ("made 1987", "cast"), ("Ada King", "director"), ("Bob Lee", "director")]
    if known == ("Dan Poe",):
        want += [("Dan Poe", "director"), ("Eva Roe", "director"), ("Fay Lim", "director"), ("KOLA", "cast"), ("Jon Snow", "crew"), ("Dan Poe", "director"), ("Ada King 1990", "director")]
        want += [*[(n, "production") for n in names], ("Acme Film", "company")]
    elif known:
        want += [("Cem Kaya", "director"), ("Dan Poe", "director"), ("Eva Roe", "director"), ("Fay Lim", "director"), ("KOLA", "cast"), ("Jon Snow", "crew")]
        want += [*[(n, "production") for n in names], ("Acme Film", "company")]
    else:
        want += [("Fay Lim", "cast"), ("KOLA", "cast"), ("Jon Snow", "crew"), *[(n, "production") for n in names[:4]], ("Fay Lim", "cast"), ("Acme Film", "company")]
    assert got == want
    first = next(r for r in found if r["line_no"] == 0 and r["video_id"] == 1)
    assert (first["is_title"], first["year"], first["job"], first["confidence"]) == (True, None, "Cast", 0.9)
    assert sum(r["is_title"] for r in found) == 1 and sum(r["year"] is not None for r in found) == 1
    star = next(r for r in found if r["name"] == "Ada Star")
    assert (star["is_verified"], star["confidence"], star["match_method"]) == ((True, 1.0, "exact_db") if "Ada Star" in known else (False, 0.9, ""))
    facts = {r["video_id"]: (r["film_title"], r["year"]) for r in roles.title_year(lines, table).collect()}
    assert facts == {1: ("The Long Road", 1987), 2: (None, None)}


def test_long_lines_and_split_phrases(spark):
    """Lines too long for any alias keep the layers that need no ratio; a phrase's words may stand apart."""
    long = "x" * 200
    rows = [(f"{long} directed   by {long}",), (f"{long} directedby {long}",), (f"{long} film",), ("Yönetnem",), (f"Yönetnem {long}",)]
    found = {r["text"][-210:]: (r["category"], r["layer"]) for r in roles.role_headers_of(spark.createDataFrame(rows, "text string"), *roles.role_tables(spark)).collect()}
    assert found == {rows[0][0][-210:]: ("director", "phrase"), rows[2][0][-210:]: ("company", "company"), "Yönetnem": ("director", "fuzzy")}
