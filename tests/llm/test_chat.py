import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from panelcast.llm import chat, template
from panelcast.llm.template import Const, If, Output, Text, compile_template, fold, parse

parts = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "|end|>", "/s>", "x", "\n", "é漢"]), max_size=12).map("".join)


@given(parts)
def test_escape_is_reversible_and_hides_control_strings(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROL)


@given(st.lists(st.tuples(parts, parts), max_size=5))
def test_turns_come_back(messages):
    render = compile_template(chat.TEMPLATE, chat.escape)
    out = list(render(messages=[{"role": r, "text": t} for r, t in messages]))
    assert list(chat.turns(t for t, _ in out)) == messages
    loss = "".join(chat.unescape(t) for t, g in out if g)
    assert loss == "".join(t for r, t in messages if r == "assistant")


def run(source, **variables):
    return "".join(t for t, _ in compile_template(source)(**variables))


def test_template_language():
    assert run("{% for m in ms %}{{ loop.index }}{{ m['a'] }}{% if not loop.last %},{% endif %}{% endfor %}",
               ms=[{"a": "x"}, {"a": "y"}]) == "1x,2y"
    assert run("{% if a == 1 and b != 2 %}p{% elif b == 2 or a %}q{% else %}r{% endif %}", a=1, b=2) == "q"
    assert run("{% set x = a + '!' %}{{ x|upper ~ 3 }}", a="hi") == "HI!3"
    assert run("{{ 'b' in 'abc' }}{{ none }}{{ missing.field }}{{ ('a' ~ 'b')|length }}") == "True2"
    assert run("{{ x|trim|lower }}", x="  AB ") == "ab"
    with pytest.raises(template.TemplateError):
        parse("{{ x.__class__ }}")
    for bad in ("{% for x in y %}", "{% endfor %}", "{{ a b }}", "{{ a. }}", "{% else %}", "{{ f(x) }}", "{% for a %}{% endfor %}"):
        with pytest.raises(template.TemplateError):
            parse(bad)


def test_constants_are_folded():
    tree = fold(parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}d{% if false %}no{% endif %}{{ x }}"), {})
    assert tree[0] == Text("ab1cd") and isinstance(tree[1], Output) and len(tree) == 2
    assert fold([If([(Const(False), [Text("x")])], [Text("y")])], {}) == [Text("y")]


def test_rendering_is_lazy():
    seen = []

    def messages():
        for i in range(5):
            seen.append(i)
            yield {"role": "user", "text": str(i)}
    pieces = compile_template(chat.TEMPLATE, chat.escape)(messages=messages())
    next(pieces)
    assert len(seen) <= 2


ROWS = [(1, 0, "user", "a"), (1, 1, "assistant", "b</s>"), (1, 2, "assistant", "c\n"), (2, 1, None, None), (2, 0, "system", ""),
        (3, None, "user", "null turn"), (3, 0, "assistant", "é漢"), (None, 0, "user", "no id"), (4, 0, "user", "same"),
        (4, 0, "user", "same"), (5, 0, "assistant", "<|end|>\n" * 30000), (6, 0, "us<|say|>er", "x")]


def test_digest_of_odd_conversations(spark):
    table = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn int, role string, text string, part int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for conv, r in got.items():
        turns = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in ROWS if c == conv)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(table.limit(0))).count() == 0


def test_query_adds_its_own_conversation(spark, tmp_path):
    spark.createDataFrame([r for r in ROWS if r[0]], "conv_id long, turn int, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op6_chat_format(spark, str(tmp_path)).collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(text)
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
