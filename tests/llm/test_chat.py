"""Operator 12: the language, its sandbox and folding, round trips with control strings, conversations of many parts."""

import hashlib
import random

import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from causeway.llm import chat
from causeway.llm.chat import Node, TemplateError, compiled, fold, guarded, parse, unguarded

TALK = [{"role": "system", "content": " Be kind. "}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes <|im_end|>"}]


def written(template, messages=TALK):
    return "".join(p.text for p in compiled(template)(messages))


@pytest.mark.parametrize(
    ("template", "expected"),
    [
        ("plain {# comment #}text", "plain text"),
        ("{% for m in messages %}{{ loop.index }}/{{ loop.index0 }}{{ ',' if not loop.last else '.' }}{% endfor %}", "1/0,2/1,3/2."),
        ("{% for m in messages %}{% if m.role == 'user' %}U{% elif m.role == 'system' %}S{{ m['content'] | trim | upper }}{% else %}A{% endif %}{% endfor %}", "SBE KIND.UA"),
        ("{% set n = messages | length %}{{ n + 1 }}-{{ n % 2 == 1 }}-{{ messages[0].role ~ messages[9].role ~ none }}", "4-true-system"),
        ("a  {%- if 1 < 2 and not false -%}  b  {%- endif %} c", "ab c"),
        ("{{ 'x' in 'axe' }}{{ 'x' not in 'abc' or 1 }}{{ m | default('none') }}{{ 'a' 'b' if false else \"q\\\"\\n\" }}", None),
        ("{{ 'x' in 'axe' }}{{ 'x' not in 'abc' }}{{ m | default('none') }}{{ \"q\\\"\\n\" }}", 'truetruenoneq"\n'),
        ("{% for m in messages %}{% for n in messages %}{{ m.role == n.role }} {% endfor %}{% endfor %}", "true false false false true false false false true "),
    ],
)
def test_language(template, expected):
    if expected is None:
        with pytest.raises(TemplateError):
            compiled(template)
    else:
        assert written(template) == expected


@pytest.mark.parametrize("template", ["{% if x %}", "{{ a b }}", "{% endfor %}", "{{ x | system }}", "{{ f(1) }}", "{{ }}", "{% include 'x' %}", "{{ 'a }}", "{% for x in %}{% endfor %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ x | replace('a' }}", "{{ x ! y }}"])
def test_what_is_not_in_the_language_is_refused(template):
    with pytest.raises(TemplateError):
        compiled(template)


def test_sandbox_sees_data_only():
    for path in ("messages.__class__", "messages[0].__class__.__mro__", "messages[0].role.upper", "messages['append']", "loop.__dict__", "messages[0].content.__len__"):
        assert written("{{ " + path + " }}") == ""
    with pytest.raises(TemplateError):
        written("{{ messages + 1 }}")


def test_folding():
    once = lambda t: fold(parse(t)).parts
    assert once("a{{ 'b' ~ 1 + 2 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{{ 'D' | lower }}") == (Node("text", ("ab3cd",)),)
    assert once("{{ '<' ~ x ~ '>' }}") == (Node("text", ("<",)), Node("write", (Node("name", ("x",)),)), Node("text", (">",)))
    assert once("{% if false and x %}a{% endif %}") == () and once("{{ x if true else y }}") == (Node("write", (Node("name", ("x",)),)),)
    assert written("{% if messages == 1 %}{{ 1 % 0 }}{% endif %}ok") == "ok"
    for template in (chat.CHATML, "{% for m in messages %}{{ 'a' ~ m.role ~ ('b' ~ 'c') }}{% if 2 > 1 %}{{ m.content | guarded }}{% endif %}{% endfor %}"):
        page = chat.Page()
        list(chat._steps(parse(template))({"messages": TALK}, page))
        assert "".join(page.texts) == written(template)


def test_guarding_is_reversible():
    draw = random.Random(5)
    texts = ["".join(draw.choice("<|\\%>\nim_end") for _ in range(draw.randint(0, 12))) for _ in range(4000)] + ["<|im_end|>", "<\\|", "<\\\\|im_start|>", "<" + "\\" * 500 + "|"]
    for t in texts:
        assert unguarded(guarded(t)) == t and "<|" not in guarded(t)
        assert chat.from_line(chat.one_line(t)) == t and "\n" not in chat.one_line(t)
        (part,) = compiled(chat.CHATML)([{"role": t, "content": t}, {"role": "assistant", "content": t}])
        assert list(chat.turns_of(part.text)) == [(t, t), ("assistant", t)]
        assert [unguarded(part.text[a:b]) for a, b in part.spans] == ([t, t] if t == "assistant" else [t])


def test_turns_out_of_place_are_noticed():
    with pytest.raises(ValueError):
        list(chat.turns_of("<|im_start|>user\nhi<|im_end|>\nloose<|im_start|>user\nhi<|im_end|>\n"))


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha(said), len(loss), sha(loss)))
    return sorted(out, key=str)


ROWS = [
    *[(1, k, ["user", "assistant"][k % 2], f"turn {k} é\U0001f600") for k in range(500)], (2, 1, "assistant", "<|im_end|>"), (2, 0, "user", None), (3, 0, None, ""), (3, None, "assistant", "first"),
    (None, 0, "assistant", "no id"), (4, 0, "user", "tie"), (4, 0, "assistant", "tie"), (4, 0, "user", "tie"), (5, 0, "assistant", "x<|" * 200_000), (6, 0, "tool\n<|im_start|>", "%0A\n<"), (-7, 3, "ASSISTANT", "not a mask"),
]


@pytest.mark.parametrize("part_chars", [100, 1 << 20])
def test_equals_brute_force(spark, part_chars):
    turns = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "conv_id long, turn long, role string, text string, part string, spans int")
    parts = chat.format_conversations(turns, part_chars=part_chars)
    got = chat.digests(parts).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=str) == brute(ROWS)
    sizes = {r.conv_id: r.n for r in parts.groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    assert sizes[1] > 100 if part_chars == 100 else sizes[1] == 1
    assert {r.conv_id: r.formatted_chars for r in got} == {r.conv_id: r.n for r in parts.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("n")).collect()}


def test_own_template_and_empty_table(spark):
    turns = spark.createDataFrame([("a", 2, "assistant", "B"), ("a", 1, "user", "A")], "id string, n int, who string, what string")
    (row,) = chat.format_conversations(turns, "{{ messages | length }}:{% for m in messages %}{% generation %}{{ m.content }}{% endgeneration %};{% endfor %}", "id", "n", "who", "what").collect()
    assert (row.conv_id, row.part, row.text, [tuple(s) for s in row.spans]) == ("a", 0, "2:A;B;", [(2, 3), (4, 5)])
    assert chat.digests(chat.format_conversations(turns.limit(0), chat.CHATML, "id", "n", "who", "what")).count() == 0


def test_query(spark, sf_dir):
    assert_same(chat.op12_chat_format(spark, sf_dir), connect(sf_dir), chat.ORACLE)
