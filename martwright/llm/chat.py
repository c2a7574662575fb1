"""Chat formatting: conversations become one training text each, with the spans a loss is taken on.

Template: each turn is a header, its text and a footer (``FRAMES``); a turn of any other role names the
role in its header. A control string inside a text (or a role) gets a backslash after its first
character, and one that already has backslashes there gets one more, so formatted texts hold
control strings as marks only and :func:`unescape` gives the text back exactly.

Method (columnar byte assembly): a batch of turns is escaped as one Arrow column. The lengths of all
headers, texts and footers give cumulative offsets; scatter indices copy the framing and the
texts from their byte buffers into one preallocated buffer, which becomes the data of the Arrow
string column, with the conversations' bounds as its offsets. No text becomes a Python string.

Scale: turns are dealt out by (conversation, block of ``BLOCK`` turn numbers) and sorted in their
partition, so a conversation with a third of all turns is spread over many tasks. A task carries the
last unfinished conversation from batch to batch and gives it out in parts of about ``PART_BYTES``, so
memory is bounded by that and by the longest single turn. Digests stream over the parts.

Defined results: a null text or role is empty; a null turn number comes first, turns with one
number are ordered by role and text; rows without a conversation id make up one conversation; repeated rows are
turns of their own; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import stored

FRAMES = {
    "system": ("<<SYS>> ", " <</SYS>>"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
}
ROLE, SAYS, END = "[ROLE]", "[SAYS]", "[/ROLE]"
LOSS_ROLE = "assistant"

BLOCK = 4096
PART_BYTES = 8 << 20
#: Texts above this are copied as slices, as their scatter indices would take eight times their size.
LONG_BYTES = 1 << 14

CONTROLS = sorted({f.strip() for pair in FRAMES.values() for f in pair} | {ROLE, SAYS, END})
#: For Arrow's regex engine and Python's: a control string with any number of backslashes inside.
MARKED = rf"([\[<])(\\*)({'|'.join(re.escape(c[1:]) for c in CONTROLS)})"
_MARK = re.compile(MARKED)
_HELD = re.compile(MARKED.replace(r"(\\*)", r"\\(\\*)"))

FORMATTED = "block long, part int, text string, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _HELD.sub(r"\1\2\3", text)


def _escaped(column: pa.Array) -> pa.Array:
    """:func:`escape` for a column; only texts with a control string go through the replacement."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    held = pc.match_substring_regex(column, MARKED)
    if not pc.any(held).as_py():
        return column
    changed = pc.replace_substring_regex(column.filter(held), MARKED, r"\1\\\2\3")
    return pc.replace_with_mask(column, held, changed)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large string column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)


def _copy(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Copy each ``data[start : start + length]`` to ``out[to:]``."""
    long = length > LONG_BYTES
    for i in np.flatnonzero(long):
        out[to[i] : to[i] + length[i]] = data[start[i] : start[i] + length[i]]
    to, start, length = (a[~long] for a in (to, start, length))
    before = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(before, length)
    out[place + np.repeat(to, length)] = data[place + np.repeat(start, length)]


def _framing(roles: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Header and footer of each turn."""
    coded = roles.dictionary_encode()
    names = coded.dictionary.to_pylist()
    pairs = [FRAMES.get(n, (f"{ROLE}{escape(n)}{SAYS} ", f" {END}")) for n in names]
    return tuple(
        pa.array([pair[side] for pair in pairs], pa.large_string()).take(coded.indices)
        for side in (0, 1)
    )


def assemble(roles: pa.Array, texts: pa.Array, starts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Formatted texts and loss spans (in code points) of the conversations beginning at ``starts``."""
    roles = pc.fill_null(roles.cast(pa.large_string()), "")
    texts = _escaped(texts)
    heads, feet = _framing(roles)
    segments = [heads, texts, feet]
    parts = [_bytes_of(s) for s in segments]
    lengths = np.stack([np.diff(at) for at, _ in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, dtype=np.uint8)
    for side, (at, data) in enumerate(parts):
        _copy(out, begins[:, side], data, at[:-1], lengths[:, side])
    bounds = np.r_[begins[starts, 0], len(out)].astype(np.int64)
    formatted = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(out)]
    )
    # The same sums in code points give the spans, counted from the start of their conversation.
    points = np.stack([pc.utf8_length(s).to_numpy() for s in segments], axis=1)
    upto = np.cumsum(points.ravel()).reshape(points.shape)
    turns = np.diff(np.r_[starts, len(points)])
    origin = np.repeat(upto[starts, 0] - points[starts, 0], turns)
    learned = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
    spans = pa.StructArray.from_arrays(
        [
            pa.array((upto[:, 1] - points[:, 1] - origin)[learned]),
            pa.array((upto[:, 1] - origin)[learned]),
        ],
        ["start", "end"],
    )
    in_each = np.add.reduceat(learned.astype(np.int64), starts) if len(starts) else []
    return formatted, pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(in_each)], pa.int32()), spans
    )


def _changes(rows: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Positions where a new group of equal values in ``names`` begins."""
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for name in names:
        column = rows.column(name)
        a, b = column[1:], column[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), pc.not_equal(a.is_null(), b.is_null()))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches) if len(batches) > 1 else batches[0]


def _cuts(rows: pa.RecordBatch) -> list[int]:
    """Where to cut a batch so that no piece has much more than PART_BYTES."""
    sizes = pc.fill_null(pc.binary_length(rows.column("_text")), 0).to_numpy()
    return [*np.flatnonzero(np.diff(np.cumsum(sizes.astype(np.int64)) // PART_BYTES)) + 1, len(rows)]


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted parts of sorted turns; a conversation block within the bound is one part."""
    key, held, held_bytes, part, last = ["_conv", "_block"], [], 0, 0, None

    def out(rows: pa.RecordBatch) -> pa.RecordBatch:
        nonlocal part, last
        starts = _changes(rows, key)
        first, final = (tuple(rows.column(k)[i].as_py() for k in key) for i in (0, len(rows) - 1))
        numbers = np.zeros(len(starts), dtype=np.int32)
        if first == last:  # goes on with a conversation that was given out in part
            part += 1
            numbers[0] = part
        if final != last:
            part = 0
        last = final
        text, loss = assemble(rows.column("_role"), rows.column("_text"), starts)
        columns = [rows.column(k).take(pa.array(starts)) for k in key]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(numbers), text.cast(pa.string()), loss],
            names=["conv", "block", "part", "text", "loss"],
        )

    for batch in batches:
        begin = 0
        for end in _cuts(batch):
            piece = batch.slice(begin, end - begin)
            begin = end
            if not len(piece):
                continue
            held.append(piece)
            held_bytes += piece.nbytes
            rows = _joined(held)
            tail = int(_changes(rows, key)[-1])
            if held_bytes > PART_BYTES and rows.nbytes - rows.slice(0, tail).nbytes > PART_BYTES:
                tail = len(rows)  # the open conversation alone is too large to be carried on
            if tail:
                yield out(rows.slice(0, tail))
            held = [rows.slice(tail)] if tail < len(rows) else []
            held_bytes = sum(b.nbytes for b in held)
    if held:
        yield out(_joined(held))


def _dealt(turns: DataFrame, conv: str, turn: str, role: str, text: str, whole: bool) -> DataFrame:
    block = F.lit(0).cast("long") if whole else F.floor(F.col(turn) / BLOCK).cast("long")
    rows = turns.select(
        F.col(conv).alias("_conv"),
        block.alias("_block"),
        F.col(turn).alias("_turn"),
        F.col(role).alias("_role"),
        F.col(text).alias("_text"),
    )
    order = ["_conv", "_block", "_turn", "_role", "_text"]
    return rows.repartition("_conv", "_block").sortWithinPartitions(*order).drop("_turn")


def format_chats(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    whole: bool = False,
) -> DataFrame:
    """``conv``, ``block``, ``part``, ``text`` and ``loss`` (code point spans of assistant texts).

    Read in order of block and part, the texts of a conversation are its formatted text. ``whole``
    keeps all blocks of a conversation in one partition, in order.
    """
    kind = turns.schema[conv].dataType.simpleString()
    dealt = _dealt(turns, conv, turn, role, text, whole)
    return dealt.mapInArrow(_parts, f"conv {kind}, {FORMATTED}")


_FOOTERS = {name: frame[1] for name, frame in FRAMES.items()}
_HEADERS = {frame[0]: name for name, frame in FRAMES.items()}


def read_turns(text: str) -> Iterator[tuple[str, int, int]]:
    """Role and span (still escaped) of each turn of a formatted text."""
    at = 0
    while at < len(text):
        for header, role in _HEADERS.items():
            if text.startswith(header, at):
                start, footer = at + len(header), _FOOTERS[role]
                break
        else:
            if not text.startswith(ROLE, at):
                raise ValueError(f"no turn begins at {at}")
            says = text.index(SAYS, at)
            role = unescape(text[at + len(ROLE) : says])
            start, footer = says + len(SAYS) + 1, f" {END}"
        # A text may end in blanks, so the footer's mark is looked for and its blank is before it.
        end = text.index(footer.strip(), start) - (len(footer) - len(footer.strip()))
        yield role, start, end
        at = end + len(footer)


class _Digest:
    def __init__(self) -> None:
        self.turns, self.lost, self.n, self.chars, self.formatted = (
            hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        )

    def add(self, text: str, loss: Iterable[tuple[int, int]]) -> None:
        self.formatted += len(text)
        for role, start, end in read_turns(text):
            said = unescape(text[start:end])
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        for start, end in loss:
            said = unescape(text[start:end])
            self.lost.update(said.encode("utf-8", "surrogatepass"))
            self.chars += len(said)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.chars, self.lost.hexdigest(), self.formatted


DIGESTS = (
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def digests(formatted: DataFrame) -> DataFrame:
    """One row for each run of parts with one ``conv`` and ``block``, read back from the texts.

    Parts must lie in order in their partitions, as :func:`format_chats` gives them.
    """
    kind = formatted.schema["conv"].dataType.simpleString()
    names = ["conv", "block", *[c.split()[0] for c in DIGESTS.split(", ")]]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, schema = None, None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

        for part in batches:
            if schema is None:
                schema = pa.schema(
                    [part.schema.field("conv"), part.schema.field("block")]
                    + [(n, pa.string() if n.endswith("256") else pa.int64()) for n in names[2:]]
                )
            done = []
            for i in range(len(part)):
                conv, block, text, loss = (
                    part.column(c)[i].as_py() for c in ("conv", "block", "text", "loss")
                )
                if state is None or (conv, block) != key:
                    if state is not None:
                        done.append((*key, *state.row()))
                    key, state = (conv, block), _Digest()
                state.add(text, [(s["start"], s["end"]) for s in loss])
            if done:
                yield batch(done)
        if state is not None:
            yield batch([(*key, *state.row())])

    return formatted.mapInArrow(read, f"conv {kind}, block long, {DIGESTS}")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """:data:`DIGESTS` of every conversation (``conv``), read back from its formatted text.

    A digest of several blocks cannot be put together from theirs, so the few conversations of more
    than one block are formatted again in one sequence each, which streams through one task.
    """
    each = stored(digests(format_chats(turns)), "chat-digests")
    blocks = each.groupBy("conv").agg(F.count("*").alias("_n"))
    several = stored(blocks.where(F.col("_n") > 1).select(F.col("conv").alias("_c")), "chat-several")
    if several.isEmpty():
        return each.drop("block")
    one = each.join(several, F.col("conv").eqNullSafe(F.col("_c")), "left_anti")
    again = turns.join(several, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    return one.unionByName(digests(format_chats(again, whole=True))).drop("block")
