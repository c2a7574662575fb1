"""Exact nearest neighbours of a set of query vectors, and the context they make.

A corpus that fits one task is handed to the tasks of the queries. A larger one is stored as an index:

* ``blocks``: a table bucketed by place. The corpus is cut into cells round pivots, and a cell into
  places of bounded size; a row holds a block of vectors of one place.
* ``places``: cell, rows and reach (the largest distance of a vector from the pivot) of each place.
* ``known``: a bounded sample of vectors, the first of which are the pivots.

The k nearest of the sample bound how far a query has to look, and by the triangle inequality it is
sent to those places only that reach so near. Queries are dealt out by place and meet the
bucketed blocks where these lie: a search shuffles queries and hits, never the corpus. A block of queries
meets all blocks of a place in turn and keeps its k nearest, so only these leave the place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martwright.operators.durable import durable, scratch_path
from martwright.sources.commits import CommitLog

# Rows of one block of queries and of one block of the corpus, which bound a task's memory. A pair of
# blocks is worked out in tiles that stay in a core's cache.
QUERY_ROWS = 2048
BLOCK_ROWS = 4096
TILE_QUERIES = 256
TILE_ROWS = 1024
# Pairs whose exact distances are worked out at once.
EXACT_PAIRS = 1 << 15
# Pairs of vectors that one task compares, where the number of tasks is free.
TASK_PAIRS = 1 << 27
# Cells the corpus is cut into, rows of a place, and rows of the sample.
MOST_CELLS = 1024
PLACE_ROWS = 1 << 14
MOST_PLACES = 1 << 16
SAMPLE_ROWS = 2048
# A corpus up to this many bytes is sent to every task.
SHARED_BYTES = 32 << 20
# Queries of a place that are gathered in one task.
GATHERED_QUERIES = 1 << 16
# A bucket is one task of a search. Many queries keep it busy for long, so there are several for each
# place, which seldom share one then, until there are LEAST_BUCKETS.
BUCKET_BYTES = 128 << 20
LEAST_BUCKETS = 96


def _exact(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances worked out pair by pair, so that they do not depend on the block."""
    if metric == "l2":
        gaps = rows - queries
        return np.einsum("ij,ij->i", gaps, gaps)
    scale = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * np.sqrt(np.einsum("ij,ij->i", queries, queries))
    return 1.0 - np.einsum("ij,ij->i", rows, queries) / np.where(scale == 0, 1.0, scale)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms == 0, 1.0, norms)[:, None]


class _Nearest:
    """The k nearest rows of each query among the blocks met so far, ties by id.

    Candidates come from one product in single precision of each tile, with room for its error; exact
    distances decide. A tile is held against the k-th distance found before, so that few
    candidates are left after the first one.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
        self.ids, self.queries, self.k, self.metric = query_ids, queries, k, metric
        self.found = [None] * -(-len(queries) // TILE_QUERIES)
        self.bound = np.full(len(queries), np.inf)

    def meet(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        for at in range(0, len(ids), TILE_ROWS):
            rows = matrix[at : at + TILE_ROWS]
            for tile in range(len(self.found)):
                self._meet_tile(tile, ids[at : at + TILE_ROWS], rows)

    def _rough(self, queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distances but for a shift of each query, how far they may be off, shift and scale.

        Numbers are scaled to at most 1, so no square leaves single precision.
        """
        scale = max(np.abs(queries).max(initial=0.0), np.abs(rows).max(initial=0.0)) or 1.0
        if self.metric == "l2":
            left, right, factor = queries / scale, rows / scale, -2.0
            q_norms, r_norms = (np.einsum("ij,ij->i", m, m) for m in (left, right))
            shift, unit = q_norms, scale
        else:
            left, right, factor = _unit(queries / scale), _unit(rows / scale), -1.0
            q_norms, r_norms = np.ones(len(left)), np.ones(len(right))
            shift, unit = np.zeros(len(left)), 1.0
        left = np.hstack([factor * left, np.ones((len(left), 1))]).astype(np.float32)
        right = np.hstack([right, r_norms[:, None]]).astype(np.float32)
        reach = (np.sqrt(q_norms) + np.sqrt(r_norms.max())) ** 2
        error = (left.shape[1] + 16) * 2.0**-23 * reach + 1e-30
        return left @ right.T, error, shift, unit

    def _meet_tile(self, tile: int, ids: np.ndarray, rows: np.ndarray) -> None:
        own = slice(tile * TILE_QUERIES, (tile + 1) * TILE_QUERIES)
        queries, k = self.queries[own], self.k
        rough, error, shift, unit = self._rough(queries, rows)
        limit = self.bound[own] / unit / unit - shift + error
        if len(ids) > k and np.isinf(limit).any():
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1].astype(np.float64)
            limit = np.minimum(limit, kth + 2 * error)
        # Rounded upwards, so that no candidate is lost by it.
        most = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        at = np.flatnonzero(rough <= most[:, None])
        if not len(at):
            return
        for begin in range(0, len(at), EXACT_PAIRS):
            q, r = np.divmod(at[begin : begin + EXACT_PAIRS], len(ids))
            self._keep(tile, q, ids[r], _exact(queries[q], rows[r], self.metric))
        q, _, distances = self.found[tile]
        last = np.flatnonzero(np.bincount(q, minlength=len(queries)) == k)
        ends = np.searchsorted(q, last, side="right") - 1
        self.bound[own.start + last] = distances[ends]

    def _keep(self, tile: int, q: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> None:
        """The best of those kept and of new ones, sorted by query, distance and id."""
        new = (q, ids, distances)
        if self.found[tile] is not None:
            new = tuple(np.concatenate(both) for both in zip(self.found[tile], new))
        q, ids, distances = new
        order = np.lexsort((ids, distances, q))
        q = q[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.found[tile] = (q[kept], ids[order][kept], distances[order][kept])

    def frame(self) -> pd.DataFrame:
        parts = [(t * TILE_QUERIES + f[0], *f[1:]) for t, f in enumerate(self.found) if f is not None]
        if not parts:
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
        q, ids, distances = (np.concatenate(own) for own in zip(*parts))
        return pd.DataFrame({"query_id": self.ids[q], "doc_id": ids, "distance": distances})


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=np.float64)


def _unpacked(block: bytes, rows: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(block, dtype=kind).reshape(rows, -1).astype(np.float64)


def _placed(matrix: np.ndarray, metric: str, side: int) -> np.ndarray:
    """Points whose Euclidean distances are in the order of the metric.

    For cosine these are unit vectors. A zero vector has distance 1 to everything, so it gets an
    axis of its own, a different one on either ``side``.
    """
    if metric == "l2":
        return matrix
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    axes = np.zeros((len(matrix), 2))
    axes[norms == 0, side] = 1.0
    return np.hstack([matrix / np.where(norms == 0, 1.0, norms)[:, None], axes])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :]
    squares -= 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)


def _usable(df: DataFrame) -> DataFrame:
    """Rows with a vector of numbers.

    One that is NULL or holds a NULL, NaN or infinite value has no distance and is left out.
    """
    # NaN is larger than any number.
    whole = ~F.exists("embedding", lambda x: x.isNull() | (F.abs(x) >= F.lit(float("inf"))))
    return df.where(F.col("embedding").isNotNull() & whole).select("id", "embedding")


def _packed(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Blocks of at most ``rows`` vectors from rows sorted by place."""

    def blocks(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for place, own in frame.groupby("place", sort=False):
            for begin in range(0, len(own), rows):
                part = own.iloc[begin : begin + rows]
                out.append((place, list(part["id"]), _matrix(part["embedding"]).tobytes()))
        return pd.DataFrame(out, columns=["place", "ids", "block"])

    held: pd.DataFrame | None = None
    for frame in frames:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        # The last place may go on, but a full block of it can be given out.
        last = frame["place"].iloc[-1] if len(frame) else None
        tail = int((frame["place"] == last).sum()) % rows
        cut = len(frame) - tail
        held = frame.iloc[cut:] if tail else None
        if cut:
            yield blocks(frame.iloc[:cut])
    if held is not None and len(held):
        yield blocks(held)


@dataclass
class VectorIndex:
    """A stored corpus; see the module. Built by :meth:`build`, or opened again by its path."""

    spark: SparkSession
    path: str
    metric: str
    id_type: str
    cells: int
    buckets: int
    table: str

    @staticmethod
    def build(
        corpus: DataFrame, path: str, metric: str = "l2", buckets: int | None = None
    ) -> VectorIndex:
        """Store ``corpus`` (``id``, ``embedding``) at ``path``, a folder that does not exist yet.

        ``buckets`` follow from the size of the corpus; give more if it is going to grow.
        """
        _check(metric)
        spark = corpus.sparkSession
        usable = _usable(corpus)
        size = usable.agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("values")).first()
        rows = size["n"]
        if not rows:
            raise ValueError("there is no vector to index")
        _sample(usable, rows).select("id", "embedding").write.parquet(f"{path}/known")
        known = spark.read.parquet(f"{path}/known").count()
        cells = min(MOST_CELLS, -(-rows // PLACE_ROWS), known)
        if buckets is None:
            wanted = max(LEAST_BUCKETS, -(-8 * size["values"] // BUCKET_BYTES))
            buckets = max(1, min(-(-4 * rows // PLACE_ROWS), wanted))
        settings = (metric, corpus.schema["id"].dataType.simpleString(), cells, buckets)
        schema = "metric string, id_type string, cells int, buckets int"
        frame = spark.createDataFrame([settings], schema)
        frame.coalesce(1).write.parquet(f"{path}/settings")
        index = VectorIndex.open(spark, path)
        index.add(corpus)
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        """An index stored before; its blocks are registered in this session's catalog."""
        row = spark.read.parquet(f"{path}/settings").first()
        name = f"vector_blocks_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {name} (place int, ids array<{row['id_type']}>, block binary) using parquet "
            f"clustered by (place) sorted by (place) into {row['buckets']} buckets "
            f"location '{path}/blocks'"
        )
        return VectorIndex(spark, path, **row.asDict(), table=name)

    def add(self, corpus: DataFrame) -> None:
        """Put more vectors into the index; those that are stored stay where they are.

        Every new vector is placed once and moved once, to the bucket of its place. The pivots stay,
        and new vectors get places of their own, whose numbers are reserved first. A search looks at
        listed places only, and these are listed last: a writer that fails leaves nothing that
        is seen, and several may add at the same time. Ids are not compared with stored ones.
        Many small additions leave many small places; building anew brings them together.
        """
        corpus, metric, cells = _usable(corpus), self.metric, self.cells
        pivots = _known_points(self.spark, self.path, metric, 1)[:cells]
        shared = self.spark.sparkContext.broadcast(pivots)

        @F.pandas_udf("cell int, away double")
        def nearest_pivot(vectors: pd.Series) -> pd.DataFrame:
            away = _distances(_placed(_matrix(vectors), metric, 1), shared.value)
            return pd.DataFrame({"cell": away.argmin(axis=1), "away": away.min(axis=1)})

        placed = durable(
            corpus.withColumn("_p", nearest_pivot("embedding")).select("id", "embedding", "_p.*")
        )
        # One row a cell. A place's rows grow with the corpus once there are MOST_PLACES.
        counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return
        each = max(PLACE_ROWS, -(-sum(counts.values()) // MOST_PLACES))
        slices = [-(-counts.get(c, 0) // each) for c in range(cells)]
        first = (self._reserved(sum(slices)) + np.r_[0, np.cumsum(slices)]).tolist()
        at = F.col("cell") + 1
        own = F.element_at(F.array(*map(F.lit, slices)), at)
        start = F.element_at(F.array(*map(F.lit, first[:-1])), at)
        placed = placed.withColumn(
            "place", (start + F.pmod(F.xxhash64("id"), F.greatest(own, F.lit(1)))).cast("int")
        )
        packed = (
            placed.select("place", "id", "embedding")
            .repartition(self.buckets, "place")
            .sortWithinPartitions("place")
            .mapInPandas(
                lambda frames: _packed(frames, BLOCK_ROWS),
                f"place int, ids array<{self.id_type}>, block binary",
            )
        )
        packed.write.insertInto(self.table)
        facts = placed.groupBy("place").agg(
            F.first("cell").alias("cell"), F.max("away").alias("reach"), F.count("*").alias("n")
        )
        facts.coalesce(1).write.mode("append").parquet(f"{self.path}/places")

    def _reserved(self, places: int) -> int:
        """The first of so many numbers that no other writer gets."""
        start = 0

        def take(state: dict) -> dict:
            nonlocal start
            start = state.get("next", 0)
            return {"next": start + places}

        CommitLog(self.spark, f"{self.path}/_log").update(take)
        return start

    def dealt(self, queries: DataFrame, k: int) -> DataFrame:
        """Blocks of queries (``place``, ``ids``, ``block``) for every place they can reach.

        A query moves once, to those of its own cell, and a block of them is copied for each place.
        """
        metric, kind = self.metric, _kind(queries)
        facts = self.spark.read.parquet(f"{self.path}/places").orderBy("place").toPandas()
        shared = self.spark.sparkContext.broadcast(
            (
                _known_points(self.spark, self.path, metric, 1),
                facts["place"].to_numpy(np.int32),
                facts["cell"].to_numpy(np.int64),
                facts["reach"].to_numpy(float),
            )
        )
        pivots = self.cells

        @F.pandas_udf("int")
        def nearest_pivot(vectors: pd.Series) -> pd.Series:
            points = _placed(_matrix(vectors), metric, 0)
            return pd.Series(_distances(points, shared.value[0][:pivots]).argmin(axis=1))

        def copied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, places, cells, reach = shared.value
            for frame in frames:
                for begin in range(0, len(frame), QUERY_ROWS):
                    part = frame.iloc[begin : begin + QUERY_ROWS]
                    ids, vectors = part["id"].to_numpy(), _matrix(part["embedding"])
                    away = _distances(_placed(vectors, metric, 0), known)
                    enough = min(k, len(known)) == k
                    bound = np.partition(away, k - 1, axis=1)[:, k - 1] if enough else np.inf
                    limit = bound + 1e-6 * (1.0 + away.max(axis=1))
                    packed = vectors.astype(kind)
                    for place, cell, far in zip(places, cells, reach):
                        own = np.flatnonzero(away[:, cell] - far <= limit)
                        if len(own):
                            row = (place, list(ids[own]), packed[own].tobytes())
                            yield pd.DataFrame([row], columns=["place", "ids", "block"])

        asked = queries.count()
        salt = F.pmod(F.xxhash64("id"), F.lit(-(-asked // GATHERED_QUERIES) or 1))
        id_type = queries.schema["id"].dataType.simpleString()
        return (
            queries.select("id", "embedding", nearest_pivot("embedding").alias("cell"))
            .repartition("cell", salt)
            .sortWithinPartitions("cell")
            .select("id", "embedding")
            .mapInPandas(copied, f"place int, ids array<{id_type}>, block binary")
        )

    def search(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """``query_id``, ``rank`` and ``doc_id`` of the k nearest documents; exact, ties by id."""
        id_type, metric, kind = queries.schema["id"].dataType.simpleString(), self.metric, _kind(queries)
        left = self.dealt(_usable(queries), k).select(
            "place", F.col("ids").alias("asked_ids"), F.col("block").alias("asked")
        )
        # Files that others have added since: all blocks of the places just read are among them.
        self.spark.catalog.refreshTable(self.table)

        def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Rows of one block of queries follow each other.
            last, nearest = None, None
            for frame in frames:
                for asked_ids, asked, ids, block in frame.itertuples(index=False):
                    if last is None or asked != last[1] or not np.array_equal(asked_ids, last[0]):
                        if nearest is not None:
                            yield nearest.frame()
                        last = (asked_ids, asked)
                        points = _unpacked(asked, len(asked_ids), kind)
                        nearest = _Nearest(np.array(asked_ids), points, k, metric)
                    nearest.meet(np.array(ids), _unpacked(block, len(ids)))
            if nearest is not None:
                yield nearest.frame()

        found = (
            left.join(self.spark.table(self.table), "place")
            .select("asked_ids", "asked", "ids", "block")
            .mapInPandas(meet, f"query_id {id_type}, doc_id {self.id_type}, distance double")
        )
        return _best(found, k)


def _kind(queries: DataFrame) -> type:
    """The numbers that blocks of queries are made of: single precision stays that."""
    double = queries.schema["embedding"].dataType.elementType.simpleString() != "float"
    return np.float64 if double else np.float32


def _check(metric: str) -> None:
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")


def _sample(corpus: DataFrame, rows: int) -> DataFrame:
    """The SAMPLE_ROWS vectors with the smallest hashes of their ids.

    Tasks together send about twice the sample: only so many hashes lie below the bound.
    """
    hashed = corpus.withColumn("_hash", F.xxhash64("id"))
    share = min(1.0, 2 * SAMPLE_ROWS / max(rows, 1))
    few = hashed.where(F.col("_hash") / 2.0**64 + 0.5 <= share)
    return few.orderBy("_hash", "id").limit(SAMPLE_ROWS)


def _known_points(spark: SparkSession, path: str, metric: str, side: int) -> np.ndarray:
    known = spark.read.parquet(f"{path}/known").withColumn("_hash", F.xxhash64("id"))
    vectors = known.orderBy("_hash", "id").limit(SAMPLE_ROWS).toPandas()["embedding"]
    return _placed(_matrix(vectors), metric, side)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "doc_id")
    )


def _against_shared(corpus: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """Search in a corpus of at most SHARED_BYTES, which every task gets."""
    rows = corpus.toPandas()
    ids, matrix = rows["id"].to_numpy(), _matrix(rows["embedding"])
    shared = corpus.sparkSession.sparkContext.broadcast((ids, matrix))
    id_type, doc_type = (d.schema["id"].dataType.simpleString() for d in (queries, corpus))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for frame in frames:
            for begin in range(0, len(frame), QUERY_ROWS):
                part = frame.iloc[begin : begin + QUERY_ROWS]
                nearest = _Nearest(part["id"].to_numpy(), _matrix(part["embedding"]), k, metric)
                nearest.meet(ids, matrix)
                yield nearest.frame()

    # A small table lies in one file, but asks for much work.
    parts = -(-queries.count() * len(ids) // TASK_PAIRS)
    schema = f"query_id {id_type}, doc_id {doc_type}, distance double"
    found = queries.repartition(max(1, parts)).mapInPandas(meet, schema)
    return _best(found, k)


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = 3, metric: str = "l2") -> DataFrame:
    """``query_id``, ``rank`` and ``doc_id`` of the k nearest documents; exact, ties by id.

    Both inputs have ``id`` and ``embedding``; rows without a whole vector, or with a
    NaN or infinite value in it, take no part on either side.
    ``metric`` is ``l2`` (squared Euclidean) or ``cosine``.

    A corpus of at most SHARED_BYTES is sent to the queries; a larger one is stored as a
    :class:`VectorIndex` first. Keep the index where the same corpus is asked again.
    """
    _check(metric)
    usable = _usable(corpus)
    size = usable.agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("values")).first()
    if not size["n"]:
        schema = ", ".join(
            f"{name} {d.schema['id'].dataType.simpleString()}"
            for name, d in (("query_id", queries), ("doc_id", corpus))
        )
        empty = corpus.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(1).alias("rank"), "doc_id")
    if 8 * size["values"] + 16 * size["n"] <= SHARED_BYTES:
        return _against_shared(usable, _usable(queries), k, metric)
    path = scratch_path(corpus.sparkSession, "vector-index")
    return VectorIndex.build(corpus, path, metric).search(queries, k)


def context_assemble(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """The texts found for each query, best first, separated by a blank line.

    ``hits`` is the result of :func:`vector_topk`; ``documents`` has ``doc_id``,
    ``model_name`` and ``text``. At most k texts meet per query.
    """
    part = F.concat(F.lit("Model: "), F.col("model_name"), F.lit("\n"), F.col("text"))
    # A window holds the texts of one query at a time; an aggregation would hold those of a whole task,
    # before they are shuffled and after.
    ordered = Window.partitionBy("query_id").orderBy("rank", "part")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        hits.join(documents, "doc_id")
        .select("query_id", "rank", part.alias("part"))
        .withColumn("_parts", F.collect_list("part").over(whole))
        .withColumn("_n", F.row_number().over(ordered))
        .where("_n = 1")
        .select("query_id", F.array_join("_parts", "\n\n").alias("context"))
    )
