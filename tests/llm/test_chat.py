import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sillage.llm import chat, sql
from sillage.llm.queries import QUERIES
from tests.oracle import same

PARTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "/s>", "[", "INST]", "a", "\n", " ", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS, st.one_of(st.sampled_from(["user", "assistant", "system"]), PARTS))
def test_round_trip(text, role):
    turn, a, b = chat.render(role, text)
    assert chat.parse(turn) == (role, text)
    assert chat.unescape(turn[a:b]) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_fold():
    e = lambda turn, kind, text, role="assistant": chat.Event(1, turn, kind, role, text)
    events = [e(0, "message", "q", "user"), e(1, "message", "a"), e(1, "delta", "b"), e(1, "edit", "c"), e(1, "delta", "d"), e(2, "delta", "x"), e(2, "regenerate", None), e(2, "delta", "y"), e(2, "message", "z")]
    assert [(m.turn, m.text) for m in chat.fold(events)] == [(0, "q"), (1, "cd"), (2, "y"), (2, "z")]


def test_oracle(spark, sf_dir):
    same(spark, sf_dir, QUERIES["op6_chat_formatting"], sql.ORACLES["op6_chat_formatting"])


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, seq int"
    rows = [(1, 1, "assistant", "b", 0), (1, 0, None, None, 0), (None, 0, "user", "x", 0), (2, None, "tool", "y\\", 0), (2, None, "tool", "y\\", 0), (3, 0, "assistant", "w" * 300_000, 0)]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat.format_digests(chat.as_events(df)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\nb\n").hexdigest() and got[1]["loss_chars"] == 1
    assert got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1 and got[3]["loss_chars"] == 300_000
    turns = chat.format_turns(chat.as_events(df)).where("conv_id = 1").orderBy("position").collect()
    assert "".join(t["formatted"] for t in turns).startswith("<s>[ROLE] ") and [t["loss_start"] is None for t in turns] == [True, False]
    assert chat.format_digests(chat.as_events(df.limit(0))).count() == 0
