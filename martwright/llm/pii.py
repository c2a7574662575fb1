"""Personal data: fixed patterns, and a BiLSTM-CRF that adds spans the patterns miss.

The patterns find base spans (email, ip, card, phone). A character-level tagger is trained from
labelled spans: windows round base spans, half of them with the span rewritten in a form that the
patterns miss. All documents are labelled, and a bounded number of windows is drawn of each kind
of span and of windows without one, however rare a kind is in the table. It then reads every whole text in overlapping
windows. A personal datum has a digit or an ``@``, or is an email with the words ``at`` and ``dot``
(or a full stop), and all other spans are refused; a window without these can therefore hold no
span and is not decoded, unless a span runs on into it. A span that a window's edge cuts lies whole
in a neighbouring window if it is shorter than the overlap; of a longer one, the pieces of
the windows in a row are stitched together. All windows of a document are
reconciled at once: base spans stay, and among the others the non-overlapping set with the highest
total weight is kept.

Defined results: a null text is empty; nothing is added when there is nothing to learn from.
Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from martwright.llm.common import smallest, stored
from martwright.llm.tagger import Tagger

KINDS = ("email", "ip", "card", "phone")
TRIGGER = "[0-9@]"
# Signs of an email that is spelled out.
AT, DOT = re.compile(r"\bat\b", re.I), re.compile(r"\.|\bdot\b", re.I)
WIDTH, STRIDE = 96, 48
TRAINING_WINDOWS = 1200
TRAINING_STEPS, TRAINING_BATCH, TRAINING_RATE = 400, 32, 0.02
CONFIDENCE = 0.9
WINDOWS_AT_ONCE = 1024

LOCAL_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, end, kind


def passes_luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    doubled = sum(2 * v - 9 * (v > 4) for v in values[1::2])
    return (sum(values[::2]) + doubled) % 10 == 0


def _is_ip(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in found.split("."))


def _is_card(found: str) -> bool:
    digits = NOT_DIGITS.sub("", found)
    return 14 <= len(digits) <= 19 and passes_luhn(digits)


def _is_phone(found: str) -> bool:
    return 10 <= len(NOT_DIGITS.sub("", found)) <= 15


def _emails(text: str) -> list[Span]:
    """Matches are found from the ``@`` outwards, so that long words cost no second look."""
    spans, free = [], 0
    for found in DOMAIN.finditer(text):
        at = found.start()
        before = text[free:at]
        length = len(before) - len(before.rstrip(LOCAL_CHARACTERS))
        if length:
            spans.append((at - length, found.end(), 0))
        # Without a local part nothing is matched, so the domain may be part of the next address.
        free = found.end() if length else at + 1
    return spans


def base_spans(text: str) -> list[Span]:
    spans = _emails(text) if "@" in text else []
    for kind, pattern, valid in ((1, IP, _is_ip), (2, CARD, _is_card), (3, PHONE, _is_phone)):
        spans += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(m[0])]
    return sorted(spans, key=lambda span: (span[0], span[2], span[1]))


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


# Character classes: signs that matter stand for themselves, the rest is grouped.
SIGNS = "@.+-()_%,:;/[]\"'= \n"
N_CLASSES = len(SIGNS) + 8
N_TAGS = 1 + 2 * len(KINDS)
GROUPS = len(KINDS) + 2  # of training windows: by kind, and two without a span


def _class(point: int) -> int:
    sign = chr(point)
    if sign in SIGNS:
        return SIGNS.index(sign) + 8
    if "0" <= sign <= "9":
        return 1
    if sign in "atdo":  # letters of spelled-out signs
        return 2 + "atdo".index(sign)
    return 6 if sign.isalpha() else 7


CLASSES = np.array([_class(i) for i in range(128)])


def encoded(window: str) -> np.ndarray:
    points = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ids = np.zeros(WIDTH, dtype=np.intp)
    ids[: len(points)] = np.where(points < 128, CLASSES[np.minimum(points, 127)], 6)
    return ids


def _rewritten(value: str, kind: int, choice: int) -> str:
    """A form of a datum that the patterns do not match."""
    if kind == 0:
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."))[choice]
        return value.replace("@", at).replace(".", dot)
    if kind == 1:
        return value.replace(".", (" . ", "[.]", " dot ", ", ")[choice])
    digits = NOT_DIGITS.sub("", value)
    if kind == 2:
        return (".", " . ", "/", "  ")[choice].join(
            digits[i : i + 4] for i in range(0, len(digits), 4)
        )
    tail = digits[-10:]
    return (
        f"({tail[:3]}) {tail[3:6]}-{tail[6:]}",
        f"{tail[:3]}.{tail[3:6]}.{tail[6:]}",
        f"{tail[:3]}-{tail[3:6]}-{tail[6:]}",
        f"00{digits[:-10] or '1'} {tail[:3]} {tail[3:6]} {tail[6:]}",
    )[choice]


def labelled_windows(text: str, seed: int) -> list[tuple[str, list[Span]]]:
    """Training windows of a text: one round each of its spans, and one without any."""
    rng = np.random.default_rng(seed)
    spans, made = base_spans(text), []
    starts = [span[0] for span in spans]
    for start, end, kind in spans:
        value = text[start:end]
        if rng.random() < 0.5:
            value = _rewritten(value, kind, int(rng.integers(4)))
        lead = int(rng.integers(0, STRIDE))
        before = text[max(0, start - lead) : start]
        after = text[end : end + WIDTH]
        window = (before + value + after)[:WIDTH]
        inside = [(len(before), len(before) + len(value), kind)]
        shift = len(before) + len(value) - end
        near = slice(bisect_left(starts, start - lead), bisect_right(starts, end + WIDTH))
        for other in spans[near]:
            moved = (other[0] + shift, other[1] + shift, other[2])
            if other[0] >= end and moved[1] <= WIDTH:
                inside.append(moved)
            elif other[1] <= start and other[0] >= start - lead:
                place = other[0] - max(0, start - lead)
                inside.append((place, place + other[1] - other[0], other[2]))
        if inside[0][1] <= WIDTH:
            made.append((window, inside))
    plain = int(rng.integers(0, max(1, len(text) - WIDTH)))
    if not any(start < plain + WIDTH and plain < end for start, end, _ in spans):
        made.append((text[plain : plain + WIDTH], []))
    return made


def group_of(window: str, spans: Sequence[Span]) -> int:
    """The kind of a training window's first span; without spans, if it is one to be decoded."""
    return spans[0][2] if spans else len(KINDS) + (not may_hold(window))


def sampled_windows(docs: DataFrame, doc_id: str, text: str, windows: int) -> list[Row]:
    """Of the windows of all documents, those with the smallest hashes of each group.

    There are GROUPS groups of equal size, so that rare kinds are not crowded out by windows
    without a span.
    """

    def label(frames):
        for frame in frames:
            rows = [
                (seed, i, group_of(window, spans), window, [x for span in spans for x in span])
                for seed, whole in zip(frame["_hash"], frame["_text"])
                for i, (window, spans) in enumerate(labelled_windows(whole, seed % (1 << 32)))
            ]
            yield pd.DataFrame(rows, columns=["seed", "place", "group", "window", "spans"])

    rows = docs.where(F.col(text).isNotNull()).select(
        F.xxhash64(F.col(doc_id), F.col(text)).alias("_hash"), F.col(text).alias("_text")
    )
    schema = "seed long, place int, group int, window string, spans array<int>"
    labelled = rows.mapInPandas(label, schema).withColumn("hash", F.xxhash64("seed", "place"))
    labelled = stored(labelled, "pii-windows")
    sizes = dict(map(tuple, labelled.groupBy("group").count().collect()))  # one row a group
    return [
        row
        for group, size in sorted(sizes.items())
        for row in smallest(
            labelled.where(F.col("group") == group),
            "hash",
            windows // GROUPS,
            "seed",
            "place",
            "window",
            rows=size,
        ).collect()
    ]


def train(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", windows: int = TRAINING_WINDOWS
) -> Tagger | None:
    """Fit the tagger on at most ``windows`` labelled windows, as many of each group."""
    labelled = sampled_windows(docs, doc_id, text, windows)
    if not any(row["spans"] for row in labelled):
        return None
    ids = np.stack([encoded(row["window"]) for row in labelled])
    tags = np.zeros(ids.shape, dtype=np.intp)
    for row, path in zip(labelled, tags):
        for start, end, kind in zip(row["spans"][::3], row["spans"][1::3], row["spans"][2::3]):
            path[start:end] = 2 + 2 * kind
            path[start] = 1 + 2 * kind
    tagger = Tagger.new(N_CLASSES, N_TAGS, size=12, hidden=16, seed=1)
    tagger.fit(ids, tags, TRAINING_STEPS, TRAINING_BATCH, TRAINING_RATE, seed=2)
    return tagger


def may_hold(window: str) -> bool:
    """True wherever some part of the window is ``_plausible``."""
    if re.search(TRIGGER, window):
        return True
    return bool(AT.search(window)) and bool(DOT.search(window))


def _plausible(whole: str, start: int, end: int, kind: int) -> bool:
    """What any datum of a kind must have, however it is written; words are words of the text."""
    found = whole[start:end]
    if kind == 0:
        # One character more shows whether a word ends with the span.
        signs = [sign.search(whole, start, end + 1) for sign in (AT, DOT)]
        at, dot = (sign is not None and sign.end() <= end for sign in signs)
        return dot and (at or "@" in found)
    if kind == 1:
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return _is_card(found) if kind == 2 else _is_phone(found)


def _spans_of(path: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, least marginal) of the tagged stretches of a window."""
    spans, t = [], 0
    while t < len(path):
        tag = int(path[t])
        if tag == 0:
            t += 1
            continue
        kind, start = (tag - 1) // 2, t
        t += 1
        while t < len(path) and path[t] == 2 + 2 * kind:
            t += 1
        spans.append((start, t, kind, float(sure[start:t].min())))
    return spans


def reconcile(
    candidates: list[tuple[int, int, int, float]], base: Sequence[Span]
) -> list[Span]:
    """The heaviest set of candidates that overlap neither each other nor a base span."""
    best: dict[Span, float] = {}
    for start, end, kind, sure in candidates:
        best[start, end, kind] = max(sure, best.get((start, end, kind), 0.0))
    ends = [end for _, end in sorted((s, e) for s, e, _ in base)]
    starts = sorted(s for s, _, _ in base)
    furthest = np.maximum.accumulate(ends) if ends else []

    def free(span: Span) -> bool:
        i = bisect_right(starts, span[1] - 1)
        return i == 0 or furthest[i - 1] <= span[0]

    spans = sorted((s for s in best if free(s)), key=lambda s: (s[1], s[0], s[2]))
    stops = [s[1] for s in spans]
    weight, kept = [0.0], []
    for i, span in enumerate(spans):
        before = bisect_right(stops, span[0], hi=i)
        with_it = weight[before] + best[span] * (span[1] - span[0])
        kept.append(before if with_it > weight[i] else None)
        weight.append(max(with_it, weight[i]))
    chosen, i = [], len(spans)
    while i:
        if kept[i - 1] is None:
            i -= 1
        else:
            chosen.append(spans[i - 1])
            i = kept[i - 1]
    return chosen[::-1]


Piece = tuple[int, int, int, float]  # start, end, kind, least marginal


@dataclass
class _Cut:
    """Stretches that a window's edge cuts, by the window's offset."""

    at_start: dict[int, Piece]
    at_end: dict[int, Piece]
    through: dict[int, Piece]

    def stitched(self) -> list[Piece]:
        """Spans longer than the overlap, put together from the pieces of windows in a row.

        Shorter ones lie whole in some window. Each piece must go on in the next window, which
        sees the same stretch again in the overlap.
        """
        found = []
        for offset, (start, end, kind, sure) in self.at_end.items():
            while True:
                offset += STRIDE
                last = self.at_start.get(offset)
                piece = last or self.through.get(offset)
                if piece is None or piece[2] != kind or piece[0] >= end:
                    break
                end, sure = piece[1], min(sure, piece[3])
                if last:
                    if end - start >= STRIDE:
                        found.append((start, end, kind, sure))
                    break
        return found


def added_spans(
    texts: Sequence[str], bases: Sequence[Sequence[Span]], tagger: Tagger
) -> list[list[Span]]:
    """Spans of each text that the tagger adds to its base spans.

    Windows that may hold a datum are decoded, and then the neighbours into which a stretch runs on.
    """
    found: list[list[Piece]] = [[] for _ in texts]
    cuts = [_Cut({}, {}, {}) for _ in texts]
    seen: set[tuple[int, int]] = set()
    places = [
        (i, start)
        for i, whole in enumerate(texts)
        for start in range(0, max(len(whole) - WIDTH + STRIDE, 1), STRIDE)
        if may_hold(whole[start : start + WIDTH])
    ]
    while places:
        seen.update(places)
        beyond: set[tuple[int, int]] = set()
        for begin in range(0, len(places), WINDOWS_AT_ONCE):
            part = places[begin : begin + WINDOWS_AT_ONCE]
            ids = np.stack([encoded(texts[i][start : start + WIDTH]) for i, start in part])
            for (i, offset), path, sure in zip(part, *tagger.decode(ids)):
                stop = min(WIDTH, len(texts[i]) - offset)
                for start, end, kind, least in _spans_of(path[:stop], sure[:stop]):
                    if least < CONFIDENCE:
                        continue
                    before = start == 0 and offset > 0
                    after = end == WIDTH and offset + end < len(texts[i])
                    piece = (offset + start, offset + end, kind, least)
                    if before and after:
                        cuts[i].through[offset] = piece
                    elif before:
                        cuts[i].at_start[offset] = piece
                    elif after:
                        cuts[i].at_end[offset] = piece
                    else:
                        found[i].append(piece)
                    if before:
                        beyond.add((i, offset - STRIDE))
                    if after:
                        beyond.add((i, offset + STRIDE))
        places = sorted(beyond - seen)
    return [
        reconcile([p for p in (*some, *cut.stitched()) if _plausible(whole, *p[:3])], base)
        for whole, some, cut, base in zip(texts, found, cuts, bases)
    ]


def find(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """``row`` (all columns of a document), ``base`` and ``added`` (spans as start, end, kind)."""
    parameters = None if tagger is None else tagger.parameters
    shared = docs.sparkSession.sparkContext.broadcast(parameters)

    @F.pandas_udf("base array<array<int>>, added array<array<int>>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        base: list[list] = [[] for _ in texts]
        added: list[list] = [[] for _ in texts]
        some = [(i, whole) for i, whole in enumerate(texts) if whole is not None]
        for i, whole in some:
            base[i] = base_spans(whole)
        if shared.value is not None:
            network = Tagger(shared.value)
            extra = added_spans([w for _, w in some], [base[i] for i, _ in some], network)
            for (i, _), spans in zip(some, extra):
                added[i] = spans
        return pd.DataFrame({"base": base, "added": added})

    # Other texts are not sent to Python: none of their windows may hold anything.
    whole = F.col(text)
    spelled = whole.rlike(r"(?i)\bat\b") & (whole.contains(".") | whole.rlike("(?i)dot"))
    searched = F.when(whole.rlike(TRIGGER) | spelled, whole)
    return docs.select(F.struct("*").alias("row"), scan(searched).alias("_found")).select(
        "row", "_found.base", "_found.added"
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s[2] + 1), s[0], s[1])),
        ",",
    )


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s[2] == kind)).cast("long")


def digest_columns(found: DataFrame) -> DataFrame:
    """``row``, the counts of base spans, their SHA-256, and all spans as text."""

    def swapped(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.array(s[0], s[2], s[1]))

    ordered = swapped(F.array_sort(swapped(F.concat("base", "added"))))
    return found.select(
        "row",
        *[_count("base", kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(ordered).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def sha256_of(spans: Sequence[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
