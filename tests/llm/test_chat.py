"""Chat formatting against plain digests of the source rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernwork.llm.chat import Unreadable, format_turn, format_turns, read_back, read_turn
from quernwork.llm.q01_chat import run
from quernwork.sources import Tables

PIECES = st.lists(
    st.sampled_from(["\\", "<", "[", "]", "</s>", "<s>", "[INST] ", " [/INST]", "[TURN", " ", "é", "\n"])
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "to[ol] \\"]), PIECES)))
def test_turns_read_back_the_same(turns):
    source = [(role, "".join(parts)) for role, parts in turns]
    whole = "".join(format_turn(r, t) for r, t in source)
    pos, found = 0, []
    while pos < len(whole):
        turn = read_turn(whole, pos)
        found.append((turn.role, turn.text))
        pos = turn.end
    assert found == source


def test_plain_text_is_not_escaped():
    assert format_turn("user", "a [b] \\c") == "<s>[INST] a [b] \\c [/INST]"
    assert format_turn("assistant", "x</s>") == " x\\</s></s>"


def test_broken_text_is_refused():
    for source in ("text", "<s>[INST] a", " a<s></s>", "<s>[TURN x"):
        with pytest.raises(Unreadable):
            read_turn(source)


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        out[conv] = (len(turns), sha[0], len(loss), sha[1])
    return out


def test_query_on_all_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    text = "</s>[INST] ok [/INST]"
    wanted = expected(rows + [(-7, 0, "user", text), (-7, 1, "assistant", text)])
    found = {r[0]: tuple(r[1:5]) for r in run(Tables(spark, folder)).collect()}
    assert found == wanted


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None),
        (1, None, "user", ""),
        (1, 1, "assistant", "long " * 100_000),
        (1, 1, "assistant", "long " * 100_000),
        (None, 0, "assistant", "</s>"),
        (None, 5, "tool", "]"),
        (2, 0, "user", None),
    ]
    schema = "conv_id long, turn long, role string, text string"
    turns = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS formatted", "2 AS n_turns")
    found = {r[0]: tuple(r[1:5]) for r in read_back(format_turns(turns)).collect()}
    assert found == expected(rows)
    assert read_back(format_turns(turns.limit(0))).collect() == []
