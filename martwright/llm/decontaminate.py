"""Benchmark decontamination: BM25 with block-max pruning, then question and answer overlap.

Index: benchmark items are cut into segments of at most ``SEGMENT`` words, and a segment's BM25
term weights are divided by their sum, so a passage that holds all its words scores 1. Statistics
cover all segments. Segments lie in ``BLOCKS`` blocks; for each term the largest weight in each
block is kept (block maxima), and postings are sorted by (term, segment).

Search: every document is read whole, in passages of ``2 * SEGMENT`` words that overlap by half, so
any ``SEGMENT`` words in a row lie in some passage. As in block-max WAND, a block is opened for a
passage only if the block maxima of the passage's terms add up to the threshold; all other blocks
are skipped, as no segment in them can reach it. In opened blocks every segment is scored, and all
at or above the threshold are retrieved. The arithmetic is done for all passages of a batch at
once.

Verification: an item is found in a document if at least ``OVERLAP`` of its five-word shingles are,
or at least ``OVERLAP`` of the shingles of its question and of the words of its answer. Without
own columns, the answer is an item's last sentence and the question is what comes before.

The index is broadcast in shards of at most ``SHARD`` segments, and each shard takes one pass over
the documents: memory does not depend on the size of the benchmark.

Defined results: null and empty texts, items and documents, match nothing; items of fewer than
five words have their whole text as one shingle; several rows with one ``doc_id`` or ``item_id``
give one row a pair, with the largest overlaps. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import stored

SEGMENT = 64
SHARD = 4096
BLOCKS = 64
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75

WORD = re.compile(r"\w+")
LAST_SENTENCE = re.compile(r"[.!?\n]\s+(?=[^.!?\n]*[.!?\n]*\s*$)")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles_of(words: Sequence[str]) -> set[tuple[str, ...]]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def question_and_answer(text: str) -> tuple[str, str]:
    cuts = [m.end() for m in LAST_SENTENCE.finditer(text.rstrip())]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, "")


def postings(
    benchmark: DataFrame, item_id: str = "item_id", question: str = "text", answer: str | None = None
) -> DataFrame:
    """``shard``, ``place`` (in the shard), ``item``, ``term`` and normalized ``weight``."""

    names = ["item", "version", "number", "length", "term", "n"]

    def segments(frames):
        for frame in frames:
            rows = []
            for item, version, text in zip(frame["_item"], frame["_version"], frame["_text"]):
                found = words_of(text)
                for number, start in enumerate(range(0, len(found), SEGMENT)):
                    part = found[start : start + SEGMENT]
                    terms, counts = np.unique(part, return_counts=True)
                    rows += [
                        (item, version, number, len(part), str(t), int(n))
                        for t, n in zip(terms, counts)
                    ]
            yield pd.DataFrame(rows, columns=names)

    whole = F.concat_ws("\n", question, answer) if answer else F.col(question)
    texts = (
        benchmark.where(F.col(item_id).isNotNull())
        .select(F.col(item_id).alias("_item"), whole.alias("_text"))
        .distinct()
        .withColumn("_version", F.xxhash64("_text"))
    )
    schema = "item long, version long, number int, length int, term string, n int"
    rows = stored(texts.mapInPandas(segments, schema), "benchmark-terms")
    each = rows.select("item", "version", "number", "length").distinct()
    total = each.agg(F.count("*").alias("segments"), F.avg("length").alias("mean")).first()
    if not total["segments"]:
        return rows.select(
            F.lit(0).alias("shard"), F.lit(0).alias("place"), "item", "term",
            F.lit(0.0).alias("weight"),
        )
    shards = -(-total["segments"] // SHARD)
    frequency = rows.groupBy("term").agg(F.count("*").alias("df"))
    n, mean = F.col("n"), total["mean"]
    idf = F.log1p((F.lit(total["segments"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("length") / mean))
    segment = Window.partitionBy("item", "version", "number")
    # At most SHARD segments on average: hashing evens out the rest.
    shard = F.pmod(F.xxhash64("item", "version", "number"), F.lit(shards)).cast("int")
    weighted = (
        rows.join(frequency, "term")
        .withColumn("weight", weight)
        .withColumn("weight", F.col("weight") / F.sum("weight").over(segment))
        .withColumn("shard", shard)
    )
    return weighted.withColumn(
        "place",
        F.dense_rank().over(Window.partitionBy("shard").orderBy("item", "version", "number")) - 1,
    ).select("shard", "place", "item", "term", "weight")


@dataclass
class Index:
    """One shard of the index."""

    terms: dict[str, int]
    items: np.ndarray  # item of each segment
    block: int  # segments in a block
    maxima: np.ndarray  # terms x blocks
    keys: np.ndarray  # term * segments + segment, sorted
    weights: np.ndarray
    texts: dict[int, list[tuple[str, str]]]  # question and answer of each item

    @staticmethod
    def build(rows: pd.DataFrame, texts: dict[int, list[tuple[str, str]]]) -> Index:
        terms = {t: i for i, t in enumerate(sorted(rows["term"].unique()))}
        n = int(rows["place"].max()) + 1
        items = np.zeros(n, dtype=np.int64)
        place = rows["place"].to_numpy(np.int64)
        items[place] = rows["item"]
        term = rows["term"].map(terms).to_numpy(np.int64)
        weight = rows["weight"].to_numpy(float)
        block = -(-n // BLOCKS)
        maxima = np.zeros((len(terms), -(-n // block)), dtype=np.float32)
        # Rounded up, so that a bound is never below the weight it stands for.
        np.maximum.at(maxima, (term, place // block), np.nextafter(weight.astype("f4"), np.inf))
        order = np.argsort(term * n + place)
        return Index(
            terms, items, block, maxima, (term * n + place)[order], weight[order], texts
        )

    def retrieve(self, passages: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, ...]:
        """(passage, segment, score) of all pairs at or above the threshold.

        ``passages`` and ``terms`` list the distinct terms of each passage, sorted by passage. A
        passage has at most 2 * SEGMENT of them; about TERMS_AT_ONCE are worked on together.
        """
        starts = np.flatnonzero(np.r_[True, passages[1:] != passages[:-1]])
        cuts = starts[np.r_[True, np.diff(starts // TERMS_AT_ONCE) > 0]].tolist()
        found = [
            self._retrieve(passages[a:b], terms[a:b])
            for a, b in zip(cuts, [*cuts[1:], len(terms)])
        ]
        return tuple(np.concatenate(column) for column in zip(*found))

    def _retrieve(self, passages: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(self.items)
        starts = np.flatnonzero(np.r_[True, passages[1:] != passages[:-1]])
        bounds = np.add.reduceat(self.maxima[terms], starts, axis=0)
        which, blocks = np.nonzero(bounds >= THRESHOLD - 1e-3)
        ends = np.r_[starts[1:], len(terms)]
        pair, at = _ranges(starts[which], ends[which])
        first = terms[at] * n + blocks[pair] * self.block
        last = np.minimum(first + self.block, (terms[at] + 1) * n)
        owner, posting = _ranges(
            np.searchsorted(self.keys, first), np.searchsorted(self.keys, last)
        )
        key = passages[starts[which[pair[owner]]]].astype(np.int64) * n + self.keys[posting] % n
        scored, place = np.unique(key, return_inverse=True)
        scores = np.bincount(place, self.weights[posting], minlength=len(scored))
        good = scores >= THRESHOLD - 1e-9
        return scored[good] // n, scored[good] % n, scores[good]


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, with the number of the range each belongs to."""
    lengths = ends - starts
    owner = np.repeat(np.arange(len(lengths)), lengths)
    before = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - before[owner] + starts[owner]


def overlaps(words: Sequence[str], question: str, answer: str) -> tuple[float, float, float]:
    """Shares of the item's shingles, the question's shingles and the answer's words."""
    have, plain = shingles_of(words), set(words)
    # A short text is found as its run of words.
    joined = f" {' '.join(words)} "

    def share(text: str) -> float:
        wanted = words_of(text)
        if not wanted:
            return 1.0
        if len(wanted) < SHINGLE:
            return float(f" {' '.join(wanted)} " in joined)
        need = shingles_of(wanted)
        return len(need & have) / len(need)

    answered = set(words_of(answer))
    found = len(answered & plain) / len(answered) if answered else 1.0
    return share(f"{question}\n{answer}"), share(question), found


def _passages(frame: pd.DataFrame, index: Index) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Row number, words and term numbers (-1: none) of each document."""
    for row, text in enumerate(frame["_text"]):
        words = words_of(text)
        if words:
            known = map(index.terms.get, words)
            yield row, words, np.array([-1 if t is None else t for t in known], dtype=np.int64)


def _leaks(frame: pd.DataFrame, index: Index) -> Iterator[tuple]:
    """(document, item, score, overlaps) of the verified leaks in a batch of documents."""
    docs, passage_docs, pieces, passage = [], [], [], 0
    for row, words, numbers in _passages(frame, index):
        at = np.flatnonzero(numbers >= 0)
        half = at // SEGMENT  # the half passage a word lies in
        last = max(0, -(-len(words) // SEGMENT) - 2)
        for shift in (0, 1):  # as first half of its own passage, as second half of the one before
            own = half - shift
            keep = (own >= 0) & (own <= last)
            pieces.append(np.stack([passage + own[keep], numbers[at[keep]]]))
        docs.append((row, words))
        passage_docs += [len(docs) - 1] * (last + 1)
        passage += last + 1
    if not pieces:
        return
    joined = np.concatenate(pieces, axis=1)
    width = len(index.terms)
    distinct = np.unique(joined[0] * width + joined[1])
    if not len(distinct):
        return
    found, segments, scores = index.retrieve(distinct // width, distinct % width)
    best: dict[tuple[int, int], float] = {}
    for where, segment, score in zip(found.tolist(), segments.tolist(), scores.tolist()):
        pair = (passage_docs[where], int(index.items[segment]))
        best[pair] = max(score, best.get(pair, 0.0))
    for (doc, item), score in best.items():
        row, words = docs[doc]
        for question, answer in index.texts[item]:
            whole, asked, answered = overlaps(words, question, answer)
            if whole >= OVERLAP or (asked >= OVERLAP and answered >= OVERLAP):
                yield frame["_doc"].iloc[row], item, score, whole, asked, answered


RESULT = (
    "doc_id string, item_id long, score double, item_overlap double, question_overlap double, "
    "answer_overlap double"
)
#: Characters of the documents scored at once, and terms whose block maxima are held at once.
CHARACTERS_AT_ONCE = 1 << 19
TERMS_AT_ONCE = 1 << 15


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    question: str = "text",
    answer: str | None = None,
    id_type: str = "long",
) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    spark = docs.sparkSession
    index_rows = stored(postings(benchmark, item_id, question, answer), "benchmark-index")
    shards = [r[0] for r in index_rows.select("shard").distinct().orderBy("shard").collect()]
    items = benchmark.select(
        F.col(item_id).alias("item"),
        F.col(question).alias("question"),
        (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer"),
    ).distinct()
    parts = []
    for shard in shards:
        rows = index_rows.where(F.col("shard") == shard)
        own = items.join(F.broadcast(rows.select("item").distinct()), "item")
        texts: dict[int, list[tuple[str, str]]] = {}
        for item, asked, answered in own.collect():  # at most one item a segment of the shard
            pair = (
                question_and_answer(asked or "") if answer is None else (asked or "", answered or "")
            )
            texts.setdefault(item, []).append(pair)
        index = Index.build(rows.toPandas(), texts)
        shared = spark.sparkContext.broadcast(vars(index))

        def scan(frames, shared=shared):
            local = Index(**shared.value)
            for frame in frames:
                sizes = frame["_text"].str.len().fillna(0)
                groups = (sizes.cumsum() // CHARACTERS_AT_ONCE).astype(int)
                for _, part in frame.groupby(groups, sort=False):
                    found = list(_leaks(part, local))
                    yield pd.DataFrame(found, columns=[c.split()[0] for c in RESULT.split(", ")])

        parts.append(
            docs.select(
                F.col(doc_id).cast("string").alias("_doc"), F.col(text).alias("_text")
            ).mapInPandas(scan, RESULT)
        )
    if not parts:
        return spark.createDataFrame([], RESULT.replace("doc_id string", f"doc_id {id_type}"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    measures = ["score", "item_overlap", "question_overlap", "answer_overlap"]
    return found.groupBy(F.col("doc_id").cast(id_type).alias("doc_id"), "item_id").agg(
        *[F.max(m).alias(m) for m in measures]
    )
