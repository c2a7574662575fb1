"""Approximate nearest neighbours by inner product: multi-index hashing of learned codes.

Codes: a vector gets one more component, sqrt(M^2 - |v|^2) with M the largest norm, which turns the
largest inner product into the smallest angle. An orthogonal rotation learned on a bounded sample
(iterated sign quantization) gives ``BITS`` sign bits. The search radius is calibrated: the largest
inner products of a bounded sample of vectors are found exactly against all rows, and the radius is
the Hamming distance that covers ``COVER`` of them.

Index: every code is split into substrings of about log2(rows) bits, and each substring is indexed:
the vector is stored in the cell of each substring's value. By the pigeonhole principle a code
within the radius differs from the query in at most radius // substrings bits of some substring.
A query is sent to every cell that holds such a value; there it probes the values, checks the
whole code, and reranks the codes within the radius by their floats. A pair that meets in several
substrings is taken in the first one only. Cells are of bounded size: rows of one cell are cut into
blocks by a hash, so a frequent value is spread over tasks. Nothing but the best k of a query and
block leaves a task, so pairs are never emitted.

Equal vectors are one class that keeps its k + 1 smallest ids: no more can be among the k nearest.
Queries that found fewer than k rows are searched again with a larger radius, until it covers all.

Defined results: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part; a null id takes no part; rows with the same id and vector count
once, and an id with several vectors is a row for each; ties go to the smaller id. Other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import smallest, stored

BITS = 64
COVER = 0.97
TRAINING_ROWS = 8192
CALIBRATION_ROWS = 96
ROWS_A_BLOCK = 4096
MOST_CELL_BITS = 10
QUERIES_AT_ONCE = 512


def usable(vector: str) -> Column:
    """Neither null, zero, nor with a null or non-finite component."""
    finite = F.forall(
        vector,
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)),
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def extended(vectors: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0.0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def learn_rotation(sample: np.ndarray, seed: int = 0, rounds: int = 20) -> np.ndarray:
    """(dimensions, BITS): orthogonal blocks that bring the sample close to its signs."""
    rng, parts, width = np.random.default_rng(seed), [], sample.shape[1]
    for _ in range(-(-BITS // width)):
        rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds):
            signs = np.where(sample @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(sample.T @ signs)
            rotation = left @ right
        parts.append(rotation)
    return np.concatenate(parts, axis=1)[:, :BITS]


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Sign bits as one unsigned 64-bit integer each."""
    bits = (vectors @ rotation >= 0).astype(np.uint64)
    return (bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def substrings(n_rows: int) -> list[tuple[int, int]]:
    """(first bit, bits) of substrings of about log2(rows) bits."""
    width = min(max(int(math.log2(max(n_rows, 2))), 8), 32)
    edges = np.linspace(0, BITS, max(1, round(BITS / width)) + 1).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


def _cut(codes: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    return (codes >> np.uint64(part[0])) & np.uint64((1 << part[1]) - 1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products added in a fixed order, whatever the block."""
    return (vectors * query).sum(axis=1)


def _best(
    query: np.ndarray, picked: np.ndarray, rough: np.ndarray, vectors: np.ndarray, limit: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``limit`` best of the picked rows and their exact scores.

    The rough scores of a matrix product may be off in the last digits, so rows that close to the
    last place are scored exactly too.
    """
    if len(picked) > limit:
        last = np.partition(rough[picked], len(picked) - limit)[len(picked) - limit]
        picked = picked[rough[picked] >= last - 1e-9 * max(1.0, abs(last))]
    return picked, exact_scores(query, vectors[picked])


def _plain(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id``, ``vector`` and its hash, of the rows that take part."""
    element = rows.schema[vector].dataType.elementType
    return (
        rows.where(F.col(vec_id).isNotNull() & usable(vector))
        .select(
            F.col(vec_id).cast("long").alias("id"),
            # Adding zero makes one zero of both signed ones.
            F.transform(vector, lambda x: (x + F.lit(0)).cast(element)).alias("vector"),
        )
        .withColumn("hash", F.xxhash64("vector"))
    )


def _classes(plain: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: ``name``, ``hash``, ``vector``, its smallest ``ids``."""
    order = Window.partitionBy("hash", "vector").orderBy("id")
    # Spark keeps the first ranks before it shuffles, so a frequent vector stays small.
    first = plain.withColumn("_rank", F.dense_rank().over(order)).where(F.col("_rank") <= k + 1)
    classes = first.groupBy("hash", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    # The smallest id names a class; the hash tells classes apart if an id has several vectors.
    return classes.select(F.col("ids")[0].alias("name"), "hash", "vector", "ids")


def _sample(classes: DataFrame, limit: int, rows: int) -> np.ndarray:
    """At most ``limit`` vectors, those with the smallest hashes."""
    hashed = classes.select(
        F.xxhash64("hash", F.lit(7)).alias("_order"),
        F.col("vector").cast("array<double>").alias("vector"),
    )
    vectors = smallest(hashed, "_order", limit, rows=rows).toPandas()
    return _matrix(vectors["vector"]) if len(vectors) else np.zeros((0, 1))


def _calibrated(
    classes: DataFrame, sample: np.ndarray, rotation: np.ndarray, largest: float, k: int
) -> int:
    """Radius that covers COVER of the true neighbours of some vectors, found among all rows."""
    queries = sample[:CALIBRATION_ROWS]

    def scan(frames):
        codes = encode(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1), rotation)
        for frame in frames:
            vectors = _matrix(frame["vector"])
            distance = _distance(codes, encode(extended(vectors, largest), rotation))
            scores = queries @ vectors.T
            keep = min(k + 1, len(vectors))
            top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            yield pd.DataFrame(
                {
                    "query": np.repeat(np.arange(len(queries)), keep),
                    "score": np.take_along_axis(scores, top, 1).ravel(),
                    "distance": np.take_along_axis(distance, top, 1).ravel().astype(np.int64),
                }
            )

    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "distance")
    distances = (
        classes.select("vector")
        .mapInPandas(scan, "query int, score double, distance long")
        .withColumn("place", F.row_number().over(nearest))
        .where(F.col("place").between(2, k + 1))  # the first is the vector itself
        .select("distance")
        .toPandas()["distance"]  # k for each calibration vector
    )
    return int(np.ceil(distances.quantile(COVER))) if len(distances) else BITS


def _coded(
    classes: DataFrame, sample: np.ndarray, rotation: np.ndarray, largest: float, k: int
) -> DataFrame:
    """Adds ``code``, ``query_code`` and ``floor``.

    ``floor`` is the score of the k + 1 best of the sample: as the sample is part of the rows, no
    row below it can be among a query's k nearest others.
    """
    shared = classes.sparkSession.sparkContext.broadcast((sample, rotation))

    @F.pandas_udf("code long, query_code long, floor double")
    def code(column: pd.Series) -> pd.DataFrame:
        known, turn = shared.value
        vectors = _matrix(column)
        flat = np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1)
        floor = np.full(len(vectors), -np.inf)
        if len(known) > k:
            for start in range(0, len(vectors), QUERIES_AT_ONCE):
                rough = vectors[start : start + QUERIES_AT_ONCE] @ known.T
                last = np.partition(rough, len(known) - k - 1, axis=1)[:, len(known) - k - 1]
                floor[start : start + QUERIES_AT_ONCE] = last - 1e-9 * np.maximum(1, np.abs(last))
        return pd.DataFrame(
            {
                "code": encode(extended(vectors, largest), turn).view(np.int64),
                "query_code": encode(flat, turn).view(np.int64),
                "floor": floor,
            }
        )

    return classes.withColumn("_coded", code("vector")).select(
        *classes.columns, "_coded.code", "_coded.query_code", "_coded.floor"
    )


def _search(
    coded: DataFrame, queries: DataFrame, parts: list[tuple[int, int]], radius: int, rows: int, k: int
) -> DataFrame:
    """The best of each query and block among the codes within the radius.

    Output: the query's ``query`` and ``query_hash``, ``score`` and the ``ids`` found.
    """
    each = radius // len(parts)
    # A cell is all values of a substring with the same high bits, ROWS_A_BLOCK rows on average.
    bits = min(max(0, math.ceil(math.log2(max(1, rows / ROWS_A_BLOCK)))), MOST_CELL_BITS)

    def cells(code: str) -> Column:
        high = [
            F.shiftrightunsigned(code, first + width - bits).bitwiseAND(
                F.lit((1 << bits) - 1).cast("long")
            )
            for first, width in parts
        ]
        return F.posexplode(F.array(*high)).alias("part", "cell")

    indexed = coded.select("vector", "ids", "code", "hash", cells("code"))
    sizes = indexed.groupBy("part", "cell").agg(
        F.ceil(F.count("*") / ROWS_A_BLOCK).cast("int").alias("blocks")
    )
    sizes = stored(sizes, "nearest-cells")
    stocked = indexed.join(sizes, ["part", "cell"]).withColumn(
        "block", F.pmod("hash", F.col("blocks")).cast("int")
    )
    # Values that differ in at most ``each`` bits lie in cells that differ in no more.
    masks = [m for m in range(1 << bits) if m.bit_count() <= each]
    probes = (
        queries.select("name", "hash", "vector", "query_code", "floor", cells("query_code"))
        .withColumn("_mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        .withColumn("cell", F.col("cell").bitwiseXOR(F.col("_mask")))
        .join(sizes, ["part", "cell"])
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "query_hash", "score", "ids"]
        if left.empty or right.empty:
            return pd.DataFrame([], columns=names)
        part = int(left["part"].iloc[0])
        codes = left["code"].to_numpy(np.int64).view(np.uint64)
        vectors, ids = _matrix(left["vector"]), left["ids"].to_numpy()
        out: list[tuple] = []
        for start in range(0, len(right), QUERIES_AT_ONCE):
            some = right.iloc[start : start + QUERIES_AT_ONCE]
            asked = some["query_code"].to_numpy(np.int64).view(np.uint64)
            wanted = _matrix(some["vector"])
            rough = wanted @ vectors.T
            found = rough >= some["floor"].to_numpy()[:, None]
            found &= _distance(asked, codes) <= radius
            # Met in this substring, and in none before it.
            for i in range(part + 1):
                here = _distance(_cut(asked, parts[i]), _cut(codes, parts[i])) <= each
                found &= here if i == part else ~here
            keys = zip(some["name"], some["hash"], wanted, found, rough)
            for name, query_hash, query, hit, row in keys:
                picked = np.flatnonzero(hit)
                if len(picked):
                    picked, scores = _best(query, picked, row, vectors, k + 1)
                    out += [(name, query_hash, s, ids[p]) for p, s in zip(picked, scores)]
        return pd.DataFrame(out, columns=names)

    key = ["part", "cell", "block"]
    return (
        stocked.select(*key, "vector", "ids", "code")
        .groupBy(*key)
        .cogroup(
            probes.select(*key, "name", "hash", "vector", "query_code", "floor").groupBy(*key)
        )
        .applyInPandas(probe, "query long, query_hash long, score double, ids array<long>")
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """``query``, ``query_hash`` and ``hits``: its k + 1 best rows, nearest first."""
    best = Window.partitionBy("query", "query_hash").orderBy(F.desc("score"), F.col("ids")[0])
    few = found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k + 1)
    row = F.explode("ids").alias("id")
    hits = few.select("query", "query_hash", "score", row).groupBy("query", "query_hash")
    # At most k + 1 classes of k + 1 rows each.
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")))
    return hits.agg(F.slice(listed, 1, k + 1).alias("hits"))


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k best found for each query row.

    ``is_query`` is a condition on the column ``id``.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    plain = _plain(rows, vec_id, vector)
    lengths = plain.groupBy(F.size("vector").alias("n")).count()
    usual = lengths.orderBy(F.desc("count"), "n").first()
    if usual is None:
        return rows.sparkSession.createDataFrame([], schema)
    plain = plain.where(F.size("vector") == usual["n"])
    classes = stored(_classes(plain, k), "nearest-classes")
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    facts = classes.agg(
        F.count("*").alias("rows"), F.sqrt(F.max(square.cast("double"))).alias("largest")
    ).first()
    largest = facts["largest"] * (1 + 1e-12)
    sample = _sample(classes, TRAINING_ROWS, facts["rows"])
    rotation = learn_rotation(extended(sample, largest))
    radius = _calibrated(classes, sample, rotation, largest, k)
    parts = substrings(facts["rows"])
    coded = stored(_coded(classes, sample, rotation, largest, k), "nearest-codes")

    members = plain.where(is_query).select("id", "hash", "vector").distinct()
    asked = members.select("hash", "vector").distinct()
    queries = stored(coded.join(asked, ["hash", "vector"], "left_semi"), "nearest-queries")
    hits = stored(
        _ranked(_search(coded, queries, parts, radius, facts["rows"], k), k), "nearest-hits"
    )
    # A query that found too few rows is searched again among all codes.
    full = hits.where(F.size("hits") > k).select("query", "query_hash")
    lacking = stored(
        queries.join(
            full,
            (F.col("name") == F.col("query")) & (F.col("hash") == F.col("query_hash")),
            "left_anti",
        ),
        "nearest-lacking",
    )
    if radius < BITS and not lacking.isEmpty():
        again = _search(coded, lacking, parts, BITS, facts["rows"], k)
        again = stored(_ranked(again, k), "nearest-hits")
        hits = hits.join(again, ["query", "query_hash"], "left_anti").unionByName(again)

    named = queries.select("name", F.col("hash").alias("_hash"), F.col("vector").alias("_vector"))
    answers = named.join(
        hits, (F.col("name") == F.col("query")) & (F.col("_hash") == F.col("query_hash"))
    ).select("_hash", "_vector", "hits")
    own = members.join(
        answers, (F.col("hash") == F.col("_hash")) & (F.col("vector") == F.col("_vector"))
    )
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, k)
    return own.select(
        F.col("id").alias("query_id"), F.posexplode(others).alias("place", "hit")
    ).select(
        "query_id",
        (F.col("place") + 1).alias("rank"),
        F.col("hit.id").alias("vec_id"),
        (-F.col("hit.minus")).alias("score"),
    )
