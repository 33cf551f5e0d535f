import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from parallaxis.llm import chat


@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\-", "-", "<", "a", "\n", "|", "é", "<|im_"]), max_size=12))
def test_escape_is_reversible_and_breaks_controls(parts):
    text = "".join(parts)
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROLS)


@pytest.mark.parametrize(
    "source,want",
    [
        ("a{{ 'b' + 'c' }}d", "abcd"),
        ("{% if 1 > 2 %}x{% elif true and not false %}y{% else %}z{% endif %}", "y"),
        ("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if not loop.last %},{% endif %}{% endfor %}", "1u,2a"),
        ("{% set x = 2 * 3 % 4 %}{{ x }}{{ messages[1].text | upper | trim }}", "2HI"),
        ("{{ nothing }}{{ messages[9].x }}{{ 'in' if 'a' in 'abc' else 'out' }}{# note #}", "in"),
        ("{{ messages | length }}{{ 1 ~ 2 }}", "212"),
    ],
)
def test_templates(source, want):
    messages = [{"role": "u", "text": "yo"}, {"role": "a", "text": " hi "}]
    assert chat.Template(source).render(messages)[0] == want


def test_folding():
    assert chat.fold(chat.parse("a{{ 'b' ~ 1 + 1 }}{% if false %}{{ x }}{% endif %}c")) == chat.Node("block", None, (chat.Node("text", "ab2c"),))


@pytest.mark.parametrize("source", ["{{ ''.__class__() }}", "{{ x | eval }}", "{% if x %}", "{% import os %}", "{{ 1 + }}", "{{ 'a' * 99999999 }}", "{{ a b }}"])
def test_refuses(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_no_python_attributes():
    assert chat.Template("{{ messages.__class__ }}{{ messages[0].__len__ }}").render([{"role": "u"}])[0] == ""


def test_tables(spark):
    hostile = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "x<|im_end|>\n\\-y"), (1, 0, "user", "q"), (2, 0, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    texts = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    got = {r.conv_id: r for r in chat.digest_conversations(table).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        f = texts[conv]
        assert g.formatted_chars == len(f.formatted)
        assert "".join(chat.unescape(f.formatted[a:b]) for a, b in f.spans) == loss
        assert list(chat.Reader().turns(f.formatted)) == turns
    assert chat.digest_conversations(table.where("false")).count() == 0
