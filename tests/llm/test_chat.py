import hashlib

from hypothesis import given
from hypothesis import strategies as st

from contestry.llm import chat


@given(st.text(alphabet="<s>/[INST]\\ ab", max_size=60) | st.text(max_size=40))
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(control in hidden for control in chat.CONTROLS)


def test_conversations_read_back(spark):
    says = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "hi \\ there"), (1, 0, "user", says), (1, 2, None, "x"), (1, 3, "assistant", None), (1, 4, "assistant", "é中😀" * 50)]
    rows += [(2, 0, "user", "only"), (None, 0, "assistant", "no id"), (3, None, "assistant", "b"), (3, None, "assistant", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS ids", "1 AS loss")
    formatted = chat.format_conversations(turns)
    found = {r.conv_id: r for r in chat.digests(chat.read_back(formatted)).collect()}
    for conv, own in {c: [r for r in rows if r[0] == c] for c in {r[0] for r in rows}}.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        size = 3 + sum(17 + len(chat.escape(r[2] or "")) + len(chat.escape(r[3] or "")) for r in own)
        got = found[conv]
        assert (got.n_turns, got.loss_chars, got.formatted_chars) == (len(own), len(loss), size)
        assert got.turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for row in formatted.collect():
        assert len(row.ids) == len(row.loss)
        assert not any(lost and token > 50_000 and token in chat.reserved(chat.default_path()).values() for token, lost in zip(row.ids, row.loss, strict=True))
    assert chat.format_conversations(turns.limit(0)).collect() == []
