"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased and every run of characters that are not letters becomes one blank; character
2-grams and 3-grams are hashed into ``BUCKETS`` buckets. Training counts the buckets of a bounded
sample: in each of the ``most_languages`` most frequent languages the ``per_language`` documents
with the smallest hashes. Counts are summed by Spark; the log-probability matrix (buckets x
languages, 128 KB a language) is broadcast. Scoring takes texts in batches of at most ``BLOCK``
code points: their n-gram counts form a sparse matrix (texts x buckets that occur), which is
multiplied with the log-probabilities at once. Longer texts are rows of several batches that add up.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if there was
nothing to learn from; a tie goes to the first language in sorted order. Repeated rows get equal
languages; their scores can differ in the last digits. Other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import per_worker

BUCKETS = 1 << 14
PER_LANGUAGE = 1000
MOST_LANGUAGES = 256
BLOCK = 1 << 19
BLANK = 32


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def normalized(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of other characters as one blank; ends blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = per_worker("letters", _letters)[points]
    # Combining marks of lower-casing (as in a dotted capital I) are not letters and vanish here.
    padded = np.full(len(points) + 2, BLANK, dtype=np.uint32)
    padded[1:-1] = np.where(is_letter, points, BLANK)
    blank = padded == BLANK
    return padded[~(blank & np.r_[False, blank[:-1]])]


def buckets(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 2-grams and 3-grams of normalized code points, in the order of their first points."""
    a = points.astype(np.uint32)
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + a[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1)
    return _bucket(two), _bucket(three)


def _bucket(grams: np.ndarray) -> np.ndarray:
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x2C1B3C6D)
    return (grams >> np.uint32(32 - 14)).astype(np.intp)


@dataclass
class Counts:
    """Rows of a sparse matrix: how often a bucket occurs in a text, by text and bucket."""

    row: np.ndarray
    bucket: np.ndarray
    n: np.ndarray


def _batches(texts: Iterable[str | None]) -> Iterable[tuple[list[int], list[np.ndarray]]]:
    """Numbers of texts and their code points, cut at BLOCK; neighbours share two points."""
    numbers: list[int] = []
    pieces: list[np.ndarray] = []
    size = 0
    for number, text in enumerate(texts):
        points = normalized(text or "")
        for start in range(0, len(points) - 1, BLOCK):
            piece = points[start : start + BLOCK + 2]
            if size and size + len(piece) > BLOCK:
                yield numbers, pieces
                numbers, pieces, size = [], [], 0
            numbers.append(number)
            pieces.append(piece)
            size += len(piece)
    if size:
        yield numbers, pieces


def gram_counts(texts: Iterable[str | None]) -> Iterable[Counts]:
    """The n-grams of all texts, counted by text number and bucket, in batches of bounded size."""
    for numbers, pieces in _batches(texts):
        lengths = np.array([len(piece) for piece in pieces])
        two, three = buckets(np.concatenate(pieces))
        owner = np.repeat(numbers, lengths)
        # No n-gram goes on into the next piece; the last 2-gram of a cut piece is that of its next.
        within = np.ones(len(owner) + 1, dtype=bool)
        last = np.cumsum(lengths) - 1
        within[last] = False
        in_three = within.copy()
        in_three[last - 1] = False
        within[last[lengths == BLOCK + 2] - 1] = False
        in_two, in_three = within[: len(two)], in_three[: len(three)]
        keys = np.concatenate(
            [
                owner[: len(two)][in_two] * BUCKETS + two[in_two],
                owner[: len(three)][in_three] * BUCKETS + three[in_three],
            ]
        )
        found, n = np.unique(keys, return_counts=True)
        yield Counts(found // BUCKETS, found % BUCKETS, n)


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores of a batch of texts."""
        totals = np.zeros((len(texts), len(self.languages)))
        known = np.zeros(len(texts), dtype=bool)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        for counts in gram_counts(texts):
            rows, starts = np.unique(counts.row, return_index=True)
            known[rows] = True
            for i in range(len(self.languages)):
                weighted = self.log_probability[counts.bucket, i] * counts.n
                totals[rows, i] += np.add.reduceat(weighted, starts)
        best = totals.argmax(axis=1)
        # 2-grams and 3-grams state the same text twice.
        away = (totals - totals[np.arange(len(totals)), best][:, None]) / 2
        score = np.where(known, 1.0 / np.exp(away).sum(axis=1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], score


def train(
    docs: DataFrame,
    allowed: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    most_languages: int = MOST_LANGUAGES,
) -> Model:
    """Learn from the rows where ``allowed`` holds and text and language are not null.

    A column with more values than ``most_languages`` teaches the most frequent ones.
    """
    usable = F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = docs.where(usable if allowed is None else usable & F.coalesce(allowed, F.lit(False)))
    rows = rows.select(
        F.col(lang).alias("_lang"),
        F.xxhash64(F.col(doc_id)).alias("_hash"),
        F.col(text).alias("_text"),
    )
    # Of a frequent language, only hashes that can be among the smallest are ranked: twice as many
    # as wanted are expected to pass.
    counted = rows.groupBy("_lang").agg(F.count("*").alias("n"))
    sizes = counted.orderBy(F.desc("n"), "_lang").limit(most_languages).collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)))
    shares = {r["_lang"]: min(1.0, 2 * per_language / r["n"]) for r in sizes}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("_lang")]
    near = F.col("_hash") / 2.0**64 + 0.5 <= share  # null for the other languages
    order = Window.partitionBy("_lang").orderBy("_hash")
    cuts = (
        rows.select("_lang", "_hash")
        .where(near)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= per_language)
        .groupBy("_lang")
        .agg(F.max("_hash").alias("_cut"))
        .collect()  # one row a language, as many as the model has columns
    )
    cut = F.create_map(*[F.lit(x) for row in cuts for x in (row["_lang"], row["_cut"])])
    sample = rows.where(F.col("_hash") <= cut[F.col("_lang")]).select("_lang", "_text")

    def count(frames):
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            for language, texts in frame.groupby("_lang")["_text"]:
                counts = totals.setdefault(language, np.zeros(BUCKETS, dtype=np.int64))
                for found in gram_counts(texts):
                    np.add.at(counts, found.bucket, found.n)
        for language, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": language, "bucket": at, "n": counts[at]})

    counted = (
        sample.mapInPandas(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most languages x buckets rows
    )
    languages = sorted(counted["lang"].unique())
    matrix = np.zeros((BUCKETS, len(languages)))
    column = counted["lang"].map({name: i for i, name in enumerate(languages)})
    matrix[counted["bucket"].to_numpy(), column.to_numpy()] = counted["n"]
    return Model(languages, np.log((matrix + 0.5) / (matrix.sum(axis=0) + 0.5 * BUCKETS)))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (all columns of a document), ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_probability))

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        languages, scores = Model(*shared.value).predict(texts.tolist())
        return pd.DataFrame({"lang_pred": languages, "score": scores})

    return docs.select(F.struct("*").alias("row"), judge(F.col(text)).alias("_judged")).select(
        "row", "_judged.lang_pred", "_judged.score"
    )
