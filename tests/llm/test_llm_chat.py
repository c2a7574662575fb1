"""Chat formatting against a plain version, with texts that imitate the template."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from martwright.llm import chat

PIECES = [*"[]<>/\\ aé🙂\n", "INST", "SYS", "s>", "[/INST]", "</s>", "ROLE", "SAYS]"]
NASTY = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)
SCHEMA = "conv_id long, turn long, role string, text string, block int, part string"


def plain(turns):
    """Formatted text and loss spans of one conversation, turn by turn."""
    out, spans = "", []
    for role, text in turns:
        head, foot = chat.FRAMES.get(
            role, (f"{chat.ROLE}{chat.escape(role)}{chat.SAYS} ", f" {chat.END}")
        )
        start = len(out) + len(head)
        out += head + chat.escape(text) + foot
        if role == chat.LOSS_ROLE:
            spans.append((start, len(out) - len(foot)))
    return out, spans


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        said = [(r, t) for _, _, r, t in sorted(turns)]
        lost = "".join(t for r, t in said if r == chat.LOSS_ROLE)
        out.append((
            conv, len(said),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(),
            len(lost), hashlib.sha256(lost.encode()).hexdigest(), len(plain(said)[0]),
        ))
    return sorted(out, key=repr)


@settings(max_examples=300, deadline=None)
@given(NASTY)
def test_escape_is_reversible(text):
    held = chat.escape(text)
    assert chat.unescape(held) == text
    assert not any(c in held for c in chat.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.lists(
            st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "[SAYS] x"]), NASTY),
            min_size=1,
            max_size=4,
        ),
        min_size=1,
        max_size=4,
    ),
    st.sampled_from([0, 3, 1 << 14]),
)
def test_assembly_equals_plain_version(convs, long):
    chat_long, chat.LONG_BYTES = chat.LONG_BYTES, long
    try:
        flat = [turn for conv in convs for turn in conv]
        starts, at = [], 0
        for conv in convs:
            starts.append(at)
            at += len(conv)
        text, loss = chat.assemble(
            pa.array([r for r, _ in flat]), pa.array([t for _, t in flat]), np.array(starts)
        )
    finally:
        chat.LONG_BYTES = chat_long
    for i, conv in enumerate(convs):
        spans = [(s["start"], s["end"]) for s in loss[i].as_py()]
        assert (text[i].as_py(), spans) == plain(conv)
        read = [
            (role, chat.unescape(text[i].as_py()[a:b])) for role, a, b in chat.read_turns(text[i].as_py())
        ]
        assert read == conv


ROWS = [
    (1, 1, "assistant", "</s>[INST] ok [/INST]"),
    (1, 0, "user", "</s>[INST] ok [/INST]"),
    (2, None, None, None),
    (2, 3, "tool", "[\\\\SAYS] é"),
    (2, 3, "tool", "[\\\\SAYS] é"),
    (None, 5, "assistant", "a"),
    (None, 4, "user", ""),
    (3, 0, "assistant", "<"),
    (3, 1, "assistant", ""),
    (4, -9000, "user", "far before"),
    (4, 90_000, "assistant", "far behind"),
]


def _found(spark, rows_in):
    turns = spark.createDataFrame([(*r, 7, "x") for r in rows_in], SCHEMA)
    return chat.conversation_digests(turns)


@pytest.mark.parametrize("part_bytes", [1, 200, 8 << 20])
def test_odd_turns(spark, rows, monkeypatch, part_bytes):
    monkeypatch.setattr(chat, "PART_BYTES", part_bytes)
    assert rows(_found(spark, ROWS)) == expected(ROWS)


def test_one_conversation_with_most_turns(spark, rows, monkeypatch):
    monkeypatch.setattr(chat, "PART_BYTES", 5000)
    hot = [(7, i, ("user", "assistant")[i % 2], f"turn {i} [INST]") for i in range(9000)]
    few = [(i + 100, 0, "user", "hi") for i in range(50)]
    assert rows(_found(spark, hot + few)) == expected(hot + few)
    turns = spark.createDataFrame([(*r, 7, "x") for r in hot], SCHEMA)
    parts = chat.format_chats(turns).orderBy("block", "part").collect()
    assert len(parts) > 3 and {p["block"] for p in parts} == {0, 1, 2}
    assert "".join(p["text"] for p in parts) == plain([(r, t) for _, _, r, t in hot])[0]


def test_very_long_text(spark, rows):
    long = [(1, 0, "user", "[INST] é" * 400_000), (1, 1, "assistant", "word " * 500_000)]
    assert rows(_found(spark, long)) == expected(long)


def test_empty_table(spark):
    assert _found(spark, []).collect() == []
