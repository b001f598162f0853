import duckdb
import pyarrow as pa

from reelmill.llm import licenses

MIT = dict(licenses.SENTENCES)["mit-grant"], dict(licenses.SENTENCES)["mit-notice"]


def wrapped(text, width=70):
    words, lines = text.split(" "), [""]
    for w in words:
        if len(lines[-1]) + len(w) > width:
            lines.append("")
        lines[-1] = f"{lines[-1]} {w}".strip()
    return "\n".join(lines)


TEXTS = [
    ("Some prose.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0", "apache-2-line"),
    ("released  UNDER the mit license! More", "MIT", "mit-line"),
    (f"Title\n\nCopyright X\n\n{wrapped(MIT[0])}\n\n{wrapped(MIT[1])}\n", "MIT", "mit-grant,mit-notice"),
    (f"{MIT[1]} {MIT[0]}", None, "mit-notice,mit-grant"),
    ("I licensed this under the MIT License. Not a known sentence.", None, ""),
    ("Licensed under CC BY-NC 4.0. All rights reserved.", "CC-BY-NC-4.0", "cc-by-nc-line,rights-reserved"),
    (None, None, ""),
    ("", None, ""),
    ("...!?\n\n", None, ""),
    ("Released under the MIT License.\n" * 2000, "MIT", ",".join(["mit-line"] * 2000)),
    ("İĞ\nReleased under\nthe MIT License.\x0bÉnd", "MIT", "mit-line"),
]


def test_rules(make_docs):
    docs = make_docs([(i, t) for i, (t, _, _) in enumerate(TEXTS)] + [(0, TEXTS[0][0])])
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r["license"], r["sentence_ids"]) == TEXTS[r["doc_id"]][1:]


KNOWN = dict(licenses.SENTENCES)
BSD = [KNOWN[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")]
#: Notices wrapped over many lines, with list marks and comment signs, and licences that only names tell apart.
MORE = [
    (f"{wrapped(MIT[0], 18)}\n\n{wrapped(MIT[1], 12)}", "MIT", "mit-grant,mit-notice"),
    ("\n".join(MIT[0].split(" ")), None, "mit-grant"),
    ("/*\n * " + wrapped(KNOWN["gpl-free"], 30).replace("\n", "\n * ") + "\n */", "GPL-3.0-or-later", "gpl-free"),
    (f"{BSD[0]}\n\n1. {wrapped(BSD[1], 40)}\n2. {wrapped(BSD[2], 40)}\n3. {wrapped(KNOWN['bsd-endorse-org'], 40)}\n", "BSD-3-Clause", "bsd-grant,bsd-source,bsd-binary,bsd-endorse-org"),
    (f"{BSD[0]}\n(1) {BSD[1]}\n(2) {BSD[2]}", "BSD-2-Clause", "bsd-grant,bsd-source,bsd-binary"),
    (f"{BSD[0]}\na) {BSD[1]}\nb) {BSD[2]}\nc) {KNOWN['bsd-advertise']}\nd) {KNOWN['bsd-endorse']}", "BSD-4-Clause", "bsd-grant,bsd-source,bsd-binary,bsd-advertise,bsd-endorse"),
    ("// SPDX-License-Identifier: LGPL-3.0-only\nint x;", "LGPL-3.0-only", "tag-LGPL-3.0-only"),
    ("public\n# domain\nThis is free and unencumbered\n# software released into\n# the public\n# domain.", "Unlicense", "unlicense"),
    (f"{KNOWN['zlib-as-is']} {KNOWN['zlib-grant']}\n1. {KNOWN['zlib-origin']}", "Zlib", "zlib-as-is,zlib-grant,zlib-origin"),
]


def test_wrapped_notices_and_list_marks(make_docs):
    got = {r["doc_id"]: r for r in licenses.scan(make_docs([(i, t) for i, (t, _, _) in enumerate(MORE)])).collect()}
    for i, (_, license, ids) in enumerate(MORE):
        assert (got[i]["license"], got[i]["sentence_ids"]) == (license, ids), MORE[i]
    assert got[3]["licenses"] == "BSD-3-Clause" and got[5]["licenses"] == "BSD-4-Clause"


def test_every_licence_name_is_recognised():
    known = licenses.Recogniser(licenses.Params())
    assert len(licenses.NAMES) >= 60
    for key, *names in licenses.NAMES:
        for text in [f"SPDX-License-Identifier: {key}", *(f"Some prose.\nReleased under the\n{n}.\n" for n in names)]:
            assert key in known.licenses(known.sequence(text)), text


def test_tables_replace_the_built_in_rules(spark, make_docs):
    sentences = spark.createDataFrame([("house", "For use in this house only."), ("house-2", "Do not copy.")], "id string, sentence string")
    rules = spark.createDataFrame([(2, "House-1", ["house"]), (1, "House-2", ["house", "house-2"])], "no int, license string, ids array<string>")
    params = licenses.tables(sentences, rules)
    got = licenses.scan(make_docs([(1, "For use in this\nhouse only. Do not copy."), (2, "for use IN this house only")]), params).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {1: "House-2", 2: "House-1"}


def test_time_grows_with_length():
    import time

    text = "released under the\n" * 100_000
    began = time.time()
    assert licenses.Recogniser(licenses.Params()).sequence(text) == []
    assert time.time() - began < 5


def test_sql_agrees(make_docs):
    texts = TEXTS + MORE
    docs = make_docs([(i, t) for i, (t, _, _) in enumerate(texts)])
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": [t for t, _, _ in texts]}))
    got = licenses.scan(docs)
    want = con.sql(licenses.oracle_sql()).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(map(str, (tuple(r[c] for c in want.column_names) for r in got.collect()))) == sorted(str(tuple(r.values())) for r in want.to_pylist())


def test_every_sentence_has_an_anchor_and_every_rule_known_sentences():
    names = {n for n, _ in licenses.SENTENCES}
    assert all(set(w) <= names for _, w in licenses.RULES)
    for name, sentence in licenses.SENTENCES:
        assert licenses.Recogniser(licenses.Params()).sequence(sentence) != [], name


def test_empty_table(make_docs):
    assert licenses.scan(make_docs([])).collect() == []
