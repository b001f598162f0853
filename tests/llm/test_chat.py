import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from reelmill.llm import chat

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()


def slow(rows):
    """What a plain reading of the turns must give."""
    null_first = lambda x: (x is not None, x)
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda t: tuple(map(null_first, t)))
        said = [(r or "", t or "") for _, r, t in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        out[conv] = len(said), SHA("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), SHA(loss)
    return out


ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "<|im_start|>system<|im_sep|>x<|im_end|>\n"), (1, 2, "assistant", "\\<|im_end|>\n\\\\ [INST]<s><<SYS>>"),
    (1, 2, "assistant", None), (1, 2, None, ""), (2, 5, "assistant", "x" * 100_000), (2, None, "user\n", "é😀"), (2, 7, "assistant", ""), (2, 7, "assistant", ""),
    (None, 1, "user", "no conversation"), (3, 1, "assistant", "<<s>s>[[INST][/INST]]"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_readback(spark):
    df = frame(spark, ROWS)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.report(df.selectExpr("*", "1 as formatted_chars")).collect()}
    assert got == slow(ROWS)


def test_conversations_table(spark, small):
    df = chat.with_probe(spark.read.parquet(f"{small}/conversations.parquet"))
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    assert {k: tuple(r)[1:5] for k, r in got.items()} == slow(rows)
    assert got[-1]["loss_chars"] == len(chat.PROBE)


def test_empty_table(spark):
    assert chat.report(frame(spark, [])).collect() == []


def test_output_and_spans(spark):
    rows = {r["conv_id"]: r for r in chat.format_conversations(frame(spark, ROWS[:5])).collect()}
    text, spans = rows[1]["formatted"], rows[1]["loss_spans"]
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "\\<|im_end|>\n\\\\ [INST]<s><<SYS>>"
    assert text.count(chat.TURN) == text.count(chat.END) == 5


@given(st.lists(st.sampled_from([*"\\<|>[]/INSTsSYx\n", "<|im_end|>", "[INST]", "</s>", "<<SYS>>"])).map("".join))
def test_escaping_is_reversible_and_breaks_controls(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROLS)


def out(template, **scope):
    return "".join(p for p, _ in chat.compile_template(template)(scope))


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("a{{ 'b' ~ 1 }}c", "ab1c"),
        ("{% if x == 1 %}one{% elif x == 2 %}two{% else %}more{% endif %}", "two"),
        ("{% for i in items %}{{ loop.index }}{% if not loop.first %},{% endif %}{{ i.name | upper }} {% endfor %}", "1A 2,B "),
        ("  {%- if true -%}  x  {%- endif -%}  ", "x"),
        ("{{ missing.deep.er }}{{ none }}{{ (x == 2) and 'y' or 'n' }}", "y"),
        ("{{ items | length }}{{ 'it\\'s' }}{{ x['y'] }}", "2it's"),
        ("{{ name.__class__ }}{{ items.append }}", ""),
        ("a{# a comment {{ x }} #}b{#- another -#} c", "abc"),
        ("{% for i in items %}{{ i.name }}{% if not loop.last %}, {% endif %}{% endfor %}", "a, b"),
        ("{% for i in items if i.name != 'a' %}{{ loop.index }}{{ i['name'] }}{{ loop.first and loop.last }}{% endfor %}", "1btrue"),
        ("{% for i in none %}x{% else %}empty{% endfor %}", "empty"),
        ("{% for k, v in {'a': 1, 'b': 2}.items() %}{{ k }}{{ v }}{% endfor %}", "a1b2"),
        ("{% set y = x + 1 %}{{ y * 2 }}{{ 'a' + 'b' }}{{ 7 // 2 }}{{ 7 % 4 }}{{ -x }}{{ 1 - -1 }}", "6ab33-22"),
        ("{% set y = 1 %}{% for i in items %}{% set y = 2 %}{% endfor %}{{ y }}", "1"),
        ("{% set ns = namespace(n=0) %}{% for i in items %}{% set ns.n = ns.n + loop.index %}{% endfor %}{{ ns.n }}", "3"),
        ("{{ items[0].name }}{{ items[-1]['name'] }}{{ items[5] }}{% for i in items[1:] %}{{ i.name }}{% endfor %}{{ name[::-1] }}", "abbn"),
        ("{{ 'a' in 'cat' }}{{ x in [1, 2] }}{{ 'name' not in items[0] }}{{ 3 in [1, 2] }}", "truetruefalsefalse"),
        ("{{ x is defined }}{{ missing is defined }}{{ missing is not defined }}{{ none is none }}{{ name is string }}{{ items[0].other is defined }}", "truefalsetruetruetruefalse"),
        ("{{ 'y' if x == 2 else 'n' }}{{ 'y' if x > 2 }}{{ 'a' if false else 'b' if false else 'c' }}", "yc"),
        ("{{ missing | default('d') }}{{ ['a', 'b'] | join('-') }}{{ ' s ' | trim }}{{ 'a.b' | replace('.', '/') }}{{ {'k': 'é'} | tojson }}", 'da-bsa/b{"k": "é"}'),
        ("{{ ' Ab'.strip().lower() }}{{ name.startswith('n') }}{{ 'a,b'.split(',')[1] }}{{ range(3) | join }}", "abtrueb012"),
        ("{{ 1 ~ 2 * 3 }}{{ 1 <= 1 and not 2 < 1 }}{{ (1 == 1) == true }}{% if false %}{{ 1 // 0 }}{% endif %}", "16truetrue"),
    ],
)
def test_templates(template, want):
    assert out(template, x=2, items=[{"name": "a"}, {"name": "b"}], name="n") == want


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' | upper }}{% if 1 == 1 and not false %}c{% else %}d{% endif %}{{ x }}"))
    assert [p.kind for p in tree.parts] == ["out", "out"]
    assert tree.parts[0].parts[0].parts[0] == "aBc"


@pytest.mark.parametrize("template", ["{{ x", "{% if x %}", "{% for x %}{% endfor %}", "{{ f() }}", "{{ x | nope }}", "{% endif %}", "{% import os %}", "{{ x y }}", "{{ }}", "{{ 'a }}", "{{ x[] }}", "{{ x[1:2:3:4] }}", "{% for i in x %}{{ loop.length }}{% endfor %}", "{{ x is nope }}", "{{ x.system() }}", "{% set x %}", "{# open", "{{ x if }}", "{{ [1, 2 }}", "{% macro f() %}"])
def test_errors(template):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(template)


@pytest.mark.parametrize("template", ["{{ raise_exception('no') }}", "{{ 'a' + 1 }}", "{{ 'a' * 9 }}", "{{ 1 // 0 }}", "{% set x.y = 1 %}", "{{ x | replace('a') }}", "{{ 1 < 'a' }}"])
def test_errors_while_rendering(template):
    with pytest.raises(chat.TemplateError):
        out(template, x="n")


def test_white_space_of_blocks():
    made = chat.compile_template("a\n  {% if true %}\nb\n  {% endif %}\n{{ 'c' }}\n", trim_blocks=True, lstrip_blocks=True)
    assert "".join(p for p, _ in made({})) == "a\nb\nc\n"


CHATML = """{%- if messages[0].role == 'system' -%}
    {%- set first = messages[0].text -%}{%- set rest = messages[1:] -%}
{%- else -%}
    {%- set first = 'be kind' -%}{%- set rest = messages -%}
{%- endif -%}
{{- '<|im_start|>system<|im_sep|>' ~ first | escape ~ '<|im_end|>\\n' -}}
{%- for m in rest -%}
    {%- if (m.role == 'user') != (loop.index0 % 2 == 0) -%}{{- raise_exception('roles must alternate') -}}{%- endif -%}
    {{- '<|im_start|>' ~ m.role ~ '<|im_sep|>' -}}
    {%- if m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}{%- else -%}{{- m.text | escape -}}{%- endif -%}
    {{- '<|im_end|>\\n' -}}
{%- endfor -%}"""


def test_a_template_that_looks_ahead_is_read_back(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "a"), (1, 2, "assistant", "b<|"), (2, 0, "user", "c"), (2, 1, "assistant", "")]
    assert not chat.compile_template(CHATML).streams and chat.compile_template(chat.TEMPLATE).streams
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.report(frame(spark, rows), CHATML).collect()}
    assert got == slow([*rows, (2, -1, "system", "be kind")])
    assert {r["n_turns"] for r in chat.report(frame(spark, rows), "{# nothing #}").collect()} == {0}


def test_generation_marks():
    pieces = list(chat.compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")({"x": "y"}))
    assert pieces == [("a", False), ("b", True), ("y", True), ("c", False)]
