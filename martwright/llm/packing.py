"""Packing documents into sequences of bounded length by minimum bin slack.

Documents are tokenized and cut into pieces: full windows of the capacity, then the rest. How the
rests share windows depends on their lengths alone, so the plan is made from the histogram of
lengths, which has at most ``capacity`` entries at any data size. For each window the largest
remaining length is taken, and a subset-sum dynamic program over bitsets finds the multiset of
remaining lengths that fills the window closest to capacity; counts are backtracked from the
bitsets. The multiset is used as often as the remaining counts allow, so the number of different
windows does not grow with the data either.

A piece finds its place by its rank among the pieces of its length. Ranks come from slices of
bounded size and the totals of earlier slices, never from one group of all pieces of a length.

Defined results: a null or empty text is the end token alone; rows with the same ``doc_id`` are
packed one by one; equal rows are interchangeable. Other columns are ignored. A sequence is padded to
the capacity unless its length is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import stored
from martwright.llm.tokens import encoder

CAPACITY = 2048
END_TOKEN = 1
ROWS_A_SLICE = 50_000
VOCABULARY = "byte_bpe_50k.tiktoken"  # the ids of byte_bpe_50k.json

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: start, length, CRC-32 of the ids; the ids if asked for."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(frames):
        encode = encoder(path, special=True)
        for frame in frames:
            rows = []
            for doc, whole in zip(frame["_id"], frame["_text"]):
                ids = np.append(encode(whole or ""), np.array([END_TOKEN], dtype="<u4"))
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    row = (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                    rows.append((*row, piece.astype(np.int64)) if with_ids else row)
            yield pd.DataFrame(rows, columns=[*names, "ids"] if with_ids else names)

    rows = docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(text).alias("_text"))
    schema = PIECES + (", ids array<long>" if with_ids else "")
    return rows.mapInPandas(cut, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def padding(total: int, capacity: int) -> int:
    return 0 if total & (total - 1) == 0 else capacity - total


def fill(target: int, counts: dict[int, int], lengths: Sequence[int], capacity: int):
    """Total and counts of the best multiset of ``lengths`` that fits into ``target``.

    ``lengths`` are in falling order. Bit s of a bitset says that the sum s can be reached with
    the lengths up to there. The best sum pads the window least, and is the largest of those.
    """
    reach, trail, used = 1, [], capacity - target
    window = (1 << (target + 1)) - 1
    for length in lengths:
        if length > target:
            continue
        trail.append((length, reach))
        left, step = min(counts[length], target // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (step * length)) & window
            left -= step
            step *= 2
        if reach >> target & 1:
            break
    sums = [s for s in range(target, -1, -1) if reach >> s & 1]
    total = min(sums, key=lambda s: (padding(used + s, capacity), -s))
    picked, rest = {}, total
    for length, before in reversed(trail):
        n = 0
        while not before >> rest & 1:
            rest -= length
            n += 1
        if n:
            picked[length] = n
    return total, picked


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: count}) of the windows that use up all lengths."""
    left = {length: n for length, n in counts.items() if n}
    lengths, windows = sorted(left, reverse=True), []
    while lengths:
        largest = lengths[0]
        left[largest] -= 1
        own = [x for x in lengths if left[x]]
        _, picked = fill(capacity - largest, left, own, capacity)
        left[largest] += 1
        picked[largest] = picked.get(largest, 0) + 1
        times = min(left[length] // n for length, n in picked.items())
        for length, n in picked.items():
            left[length] -= n * times
        lengths = [x for x in lengths if left[x]]
        windows.append((times, picked))
    return windows


def _places(windows: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for times, picked in windows:
        offset = 0
        for length in sorted(picked, reverse=True):
            n = picked[length]
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (the columns of ``pieces``) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    cut = stored(cut, "packing-pieces")
    slices = max(1, -(-cut.count() // ROWS_A_SLICE))
    identity = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    sliced = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)))
    counts = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    totals = counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # capacity rows at most
    plan = plan_windows({row["length"]: row["n"] for row in totals}, capacity)
    shared = spark.sparkContext.broadcast(_places(plan))

    earlier = Window.partitionBy("length").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        F.col("length").alias("_length"),
        F.col("_slice").alias("_of"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy("length", "_slice").orderBy(*identity)
    ranked = (
        sliced.withColumn("_number", F.row_number().over(within))
        .join(offsets, (F.col("length") == F.col("_length")) & (F.col("_slice") == F.col("_of")))
        .withColumn("_rank", F.col("_before") + F.col("_number") - 1)
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        places = shared.value
        length, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        order = (places[:, 0] << 48) + places[:, 1]
        at = np.searchsorted(order, (length << 48) + rank, side="right") - 1
        _, first, count, sequence, offset = places[at].T
        return pd.DataFrame(
            {
                "sequence_id": sequence + (rank - first) // count,
                "offset": offset + (rank - first) % count * length,
            }
        )

    return ranked.withColumn("_place", place("length", "_rank")).select(
        *cut.columns, "_place.sequence_id", "_place.offset"
    )
