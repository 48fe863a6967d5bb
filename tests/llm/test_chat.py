import hashlib
import random

import pytest
from oracle import compare, duck
from pyspark.sql import types as T

from verdigris.llm import chat
from verdigris.llm.queries import QUERIES
from verdigris.llm.template import Const, For, Template, TemplateError, Write

ROWS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("seq", T.StringType())]
)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append(((turn is not None, turn), (role is not None, role), (text is not None, text), role or "", text or ""))
    out = []
    for conv_id, turns in by.items():
        turns = [t[3:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv_id, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    result = chat.read_back(chat.formatted(df)).collect()
    return sorted((tuple(r)[:5] for r in result), key=str)


def test_query_matches_sql(spark, sf):
    pytest.importorskip("duckdb")
    assert compare(spark, duck(sf), sf, QUERIES["op6_chat"], chat.SQL) is None


def test_odd_rows(spark):
    tricky = ["</s>[INST] ok [/INST]", "[TURN]assistant\n[/TURN]", "\\", "<\\/s>", "[/INST]\n", "</s>\n", "\x1an\x1a", None, "", "[", "</s", "x" * 100000]
    rng = random.Random(1)
    rows = [(i % 7, t, rng.choice(["user", "assistant", "system", None, "a\nb", "[INST]", "\x1an"]), x) for i, x in enumerate(tricky * 4) for t in [rng.choice([i, 0, None])]]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "either"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    assert found(spark, rows) == brute(rows)


def test_long_conversation_and_empty(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(9000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_escape_round_trip():
    rng = random.Random(2)
    alphabet = ["\\", "<", "/", "s", ">", "[", "INST", "]", "</s>", "[/TURN]", "\n", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
        assert chat.unescape_line(chat.escape_line(text)) == text and "\n" not in chat.escape_line(text)


def test_mask_covers_assistant_text_once():
    messages = [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a </s>"}]
    out = chat.chat_template().render(messages)
    assert [chat.unescape(out.text()[s:e]) for s, e in out.spans] == ["a </s>"]
    assert "".join(p.text() for p in chat.chat_template().pieces(iter(messages))) == out.text()


def test_language():
    t = Template("{% if a == 1 and not false %}A{{ 'x' ~ 2 | up }}{% elif true %}B{% else %}C{% endif %}{{ none }}", {"a": 1}, {"up": str.upper})
    assert t.tree == (Write(Const("Ax2")),)
    t = Template("{% for m in messages %}{{ loop.index }}{% if loop.last %}.{% else %},{% endif %}{{ m.nope }}{% endfor %}", {}, {})
    assert isinstance(t.tree[0], For)
    assert t.render([{}, {}, {}]).text() == "1,2,3."
    assert t.render([]).text() == ""


@pytest.mark.parametrize("source", [
    "{{ x }}", "{{ messages.__class__ | nope }}", "{% for m in range %}{% endfor %}", "{% if true %}", "{{ 'a' }", "{{ f() }}",
    "{{ messages[0] }}", "{% endif %}", "{{ 1 + 1 }}", "{{ }}", "{% include x %}",
])
def test_refused(source):
    with pytest.raises(TemplateError):
        Template(source, {}, {})


def test_sandbox_has_no_python_attributes():
    assert Template("{{ messages.__class__ }}" .replace("__class__", "klass"), {}, {}).render([{}]).text() == ""
