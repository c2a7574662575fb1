"""Near-duplicate documents: MinHash signatures joined through a multi-index.

Signature: ``LANES`` MinHash values of the five-word shingles. Two sets with Jaccard similarity s
differ in about (1 - s) * LANES lanes; ``MAX_DIFFERENT`` lanes are allowed, which a pair at the
link threshold of 0.85 exceeds with a probability of 2e-5, and a closer pair more rarely still.

Join: the lanes are split into ``CHUNKS`` chunks. By the pigeonhole principle a pair that differs in
at most MAX_DIFFERENT lanes has a chunk with at most MAX_DIFFERENT // CHUNKS = 1 different lane.
All chunks with one lane masked are enumerated as keys, so every such pair meets in some key: the
candidates hold all pairs under the distance threshold. Eight bit planes of the signature give the
distance of a pair inside the join condition, so pairs above the threshold are never produced.

Skew: documents with equal sets become one class first. Members of a key are then linked with one
hub of the key, confirmed on full sets, so a family of close copies becomes one component at
the price of one comparison a member. Keys that still hold several components are worked off in
blocks of bounded size: a task compares the members of two blocks by sizes, signatures and full
sets, skips pairs of one component, and returns only links that join two components, never
pairs. No link between components is lost.

Defined results: a null or blank text has no shingles and is linked with nothing; fewer words than
a shingle make one shingle; rows with equal sets are one class, whatever their ids; a null id is
never the id of a component unless all ids of the component are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import digest_of, merged, perhaps_in, stored
from martwright.llm.components import components

SHINGLE = 5
LANES = 48
MAX_DIFFERENT = 19
CHUNKS = 10
PLANES = 8
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1 << 20
WORDS_KEPT = 1 << 16
CHARACTERS_AT_ONCE = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hash of each word met so far; lives as long as the task that made it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, known: _WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles.

    Splitting and lower-casing bytes touches ASCII only, which is what words are defined by.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    known = _WordHashes() if known is None else known
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(h))
    # A short text is told apart from a shingle by its length.
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = out * _MIX + _mixed(h[i : len(h) - width + 1 + i])
    return np.unique(_mixed(out))


def _lane_factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 1 << 63, (2, LANES), dtype=np.uint64)
    return factors[0] | np.uint64(1), factors[1]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each lane's minimum, for non-empty sets: (sets, LANES)."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    factors, shifts = _lane_factors()
    out = np.empty((len(sets), LANES), dtype=np.uint16)
    for lane in range(LANES):
        low = np.minimum.reduceat(joined * factors[lane] + shifts[lane], starts)
        out[:, lane] = (_mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def masked_chunks() -> list[list[int]]:
    """The lanes of every key: each chunk with each of its lanes left out once."""
    chunks = np.array_split(np.arange(LANES), CHUNKS)
    return [[int(x) for x in chunk if x != left] for chunk in chunks for left in chunk]


def chunk_keys(lanes: str) -> Column:
    """The keys of a signature, one for every masked chunk."""
    return F.array(
        *[
            F.xxhash64(F.lit(number), *[F.col(lanes)[lane] for lane in picked])
            for number, picked in enumerate(masked_chunks())
        ]
    )


def bit_planes(lanes: np.ndarray) -> np.ndarray:
    """Plane i holds bit i of every lane: (sets, PLANES)."""
    weights = np.uint64(1) << np.arange(LANES, dtype=np.uint64)
    bits = (lanes[:, None, :] >> np.arange(PLANES, dtype=np.uint16)[None, :, None]) & np.uint16(1)
    return (bits.astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)


def different_lanes(a: str, b: str) -> Column:
    """Lanes in which two signatures differ, as far as their kept bits tell."""
    differ = None
    for i in range(PLANES):
        plane = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        differ = plane if differ is None else differ.bitwiseOR(plane)
    return F.bit_count(differ)


def _in_parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    sizes = frame["_text"].str.len().fillna(0)
    for _, part in frame.groupby((sizes.cumsum() // CHARACTERS_AT_ONCE).astype(int), sort=False):
        yield part


def sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id``, ``digest`` (of the text), ``n_shingles``, ``class`` (digest of the set; null: no
    shingles) and signature."""

    def sketch(frames):
        known = _WordHashes()
        for frame in frames:
            for part in _in_parts(frame):
                sets = [shingle_set(whole, known) for whole in part["_text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                lanes: list = [None] * len(sets)
                planes: list = [None] * len(sets)
                classes: list = [None] * len(sets)
                if full:
                    found = signatures([sets[i] for i in full])
                    for i, lane, plane in zip(
                        full, found.view(np.int16), bit_planes(found).view(np.int64)
                    ):
                        lanes[i], planes[i] = lane, plane
                        classes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pd.DataFrame(
                    {
                        "id": part["_id"],
                        "digest": part["_digest"],
                        "n_shingles": [len(s) for s in sets],
                        "class": classes,
                        "lanes": lanes,
                        "planes": planes,
                    }
                )

    rows = docs.select(
        F.col(doc_id).cast("string").alias("_id"),
        F.col(text).alias("_text"),
        digest_of(text).alias("_digest"),
    )
    schema = "id string, digest string, n_shingles long, class binary, lanes array<short>, planes array<long>"
    return (
        rows.mapInPandas(sketch, schema)
        .withColumn("id", F.col("id").cast("long"))
        .withColumn("node", F.when(F.col("class").isNotNull(), F.xxhash64("class")))
    )


def _shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) of the keys that several nodes have; keys of equal members count once."""
    keyed = nodes.select("node", F.explode(chunk_keys("lanes")).alias("key"))
    keys = keyed.groupBy("key").agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64("node", F.lit(2))).alias("mix"),
    )
    chosen = keys.where(F.col("n") > 1).groupBy("n", "sum", "mix").agg(F.min("key").alias("key"))
    return keyed.join(merged(chosen.select("key")), "key")


def _sets_of(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Full shingle sets of the nodes: ``node``, ``set`` (hashes as bytes)."""

    def packed(frames):
        known = _WordHashes()
        for part in (part for frame in frames for part in _in_parts(frame)):
            sets = [shingle_set(whole, known).tobytes() for whole in part["_text"]]
            # An id can stand for several texts; the node's own is the one with its digest.
            own = [
                hashlib.blake2b(s, digest_size=16).digest() == bytes(digest)
                for s, digest in zip(sets, part["class"])
            ]
            yield part.assign(set=sets).loc[own, ["node", "set"]]

    wanted = nodes.select("source", "class", "node")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    # Most texts belong to no such node; they are left out before the shuffle of the join.
    rows = perhaps_in(rows, [F.col("_id").cast("long")], nodes, [F.col("source")])
    found = rows.where("_perhaps").join(merged(wanted), F.col("_id").eqNullSafe(F.col("source")))
    # As an expression, Spark would work the sets out before the join, for all documents.
    return (
        found.select("node", "class", "_text")
        .mapInPandas(packed, "node long, set binary")
        .groupBy("node")
        .agg(F.first("set").alias("set"))
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def confirm(frames):
        for frame in frames:
            keep = np.zeros(len(frame), dtype=bool)
            for i, (left, right) in enumerate(zip(frame["_left"], frame["_right"])):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield frame.loc[keep, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("_left"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("_right"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(confirm, "a long, b long")


def _split_keys(members: DataFrame, seed: int) -> DataFrame:
    """Keys that hold several components: ``key``, ``hub``, ``hub_component``."""
    hub = F.min(F.struct(F.xxhash64("node", F.lit(seed)), F.col("node"), F.col("component")))
    return (
        members.groupBy("key")
        .agg(hub.alias("h"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("key", F.col("h.node").alias("hub"), F.col("h.component").alias("hub_component"))
    )


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) within the signature distance."""
    left = nodes.select(F.col("node").alias("a"), F.col("planes").alias("_pa"))
    right = nodes.select(F.col("node").alias("b"), F.col("planes").alias("_pb"))
    joined = pairs.join(merged(left), "a").join(merged(right), "b")
    return joined.where(different_lanes("_pa", "_pb") <= MAX_DIFFERENT).select("a", "b")


def _hub_pairs(members: DataFrame, seed: int) -> DataFrame:
    away = F.col("component") != F.col("hub_component")
    return (
        members.join(_split_keys(members, seed), "key")
        .where(away)
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        .distinct()
    )


def _block_rows(members: DataFrame) -> DataFrame:
    """The members of every open key, dealt out to the pairs of blocks they are compared in.

    ``members`` has key, node, component and size. The members of a key are cut into blocks of at
    most BLOCK_ROWS nodes and BLOCK_SHINGLES shingles on average; a component that fills a block
    has blocks of its own. All pairs of blocks are formed but those of one such component, whose
    members are linked already. Output: key, pair, node, component, and side (0, 1, or 2 where a
    block meets itself).
    """
    open_keys = _split_keys(members, 0).select("key")
    members = members.join(open_keys, "key")
    sizes = members.groupBy("key", "component").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles")
    )
    own = F.when(F.col("n") >= BLOCK_ROWS, F.col("component"))
    sizes = sizes.withColumn("own", own)
    groups = sizes.groupBy("key", "own").agg(F.sum("n").alias("n"), F.sum("shingles").alias("s"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("s") / BLOCK_SHINGLES))
    groups = groups.withColumn("parts", parts.cast("int"))
    # An array holds the blocks of a key: one for some thousand members.
    block = F.struct("own", "part")
    blocks = (
        groups.select("key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    )
    first = blocks.select("key", "blocks", F.posexplode("blocks").alias("i", "x"))
    second = first.select(
        "key", "i", "x", F.posexplode(F.slice("blocks", F.col("i") + 1, F.size("blocks"))).alias("d", "y")
    )
    same = F.col("d") == 0
    paired = second.where(F.col("x.own").isNull() | ~F.col("x.own").eqNullSafe(F.col("y.own")))
    pair = F.concat_ws("-", "i", F.col("i") + F.col("d")).alias("pair")
    sides = F.when(same, F.array(F.struct(F.lit(2).alias("side"), F.col("x").alias("b")))).otherwise(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("x").alias("b")),
            F.struct(F.lit(1).alias("side"), F.col("y").alias("b")),
        )
    )
    dealt = paired.select("key", pair, F.explode(sides).alias("s")).select(
        F.col("key").alias("_key"),
        "pair",
        "s.side",
        F.col("s.b.own").alias("_own"),
        F.col("s.b.part").alias("_part"),
    )
    placed = (
        members.join(sizes.select("key", "component", "own"), ["key", "component"])
        .join(
            groups.select(F.col("key").alias("_k"), F.col("own").alias("_o"), "parts"),
            (F.col("key") == F.col("_k")) & F.col("own").eqNullSafe(F.col("_o")),
        )
        .withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))
    )
    here = (
        (F.col("key") == F.col("_key"))
        & F.col("own").eqNullSafe(F.col("_own"))
        & (F.col("part") == F.col("_part"))
    )
    return placed.join(merged(dealt), here).select("key", "pair", "node", "component", "side")


def linking_pairs(
    nodes: np.ndarray,
    labels: np.ndarray,
    sides: np.ndarray,
    planes: np.ndarray,
    sets: list[np.ndarray],
    percent: int,
) -> list[tuple[int, int]]:
    """Confirmed links between components; each joins two that were apart.

    Pairs of one component, or above the signature distance, are not looked at. Both kinds of
    sides meet each other only; side 2 meets itself.
    """
    lengths = np.array([len(s) for s in sets])
    _, shingles = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(lengths) - lengths
    _, group = np.unique(labels, return_inverse=True)
    marked = np.zeros(int(shingles.max()) + 1, dtype=bool)
    links = []
    for i in range(len(nodes) - 1):
        apart = group[i + 1 :] != group[i]
        if sides[i] != 2:
            apart &= sides[i + 1 :] != sides[i]
        others = np.flatnonzero(apart) + i + 1
        # A link needs sizes that are not too different, and few different lanes.
        n = lengths[others]
        others = others[100 * np.minimum(n, lengths[i]) >= percent * np.maximum(n, lengths[i])]
        differ = np.bitwise_or.reduce(planes[others] ^ planes[i], axis=1)
        others = others[np.bitwise_count(differ) <= MAX_DIFFERENT]
        if not len(others):
            continue
        own = shingles[starts[i] : starts[i] + lengths[i]]
        marked[own] = True
        n = lengths[others]
        ends = np.cumsum(n)
        at = np.repeat(starts[others] - (ends - n), n) + np.arange(ends[-1])
        both = np.add.reduceat(marked[shingles[at]], ends - n, dtype=np.int64)
        marked[own] = False
        for j in others[100 * both >= percent * (n + lengths[i] - both)].tolist():
            if group[j] != group[i]:
                links.append((int(nodes[i]), int(nodes[j])))
                group[group == group[j]] = group[i]
    return links


def _cross_links(members: DataFrame, sets: DataFrame, few: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a key."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "pair"], ignore_index=True)
        where = frame["key"].to_numpy(), frame["pair"].to_numpy()
        new = np.r_[True, np.logical_or(*(x[1:] != x[:-1] for x in where))]
        columns = [frame[c].to_numpy() for c in ("node", "component", "side")]
        planes = np.stack(frame["planes"].to_numpy()).astype(np.int64).view(np.uint64)
        sets = [np.frombuffer(s, np.uint64) for s in frame["set"]]
        links, edges = [], [*np.flatnonzero(new).tolist(), len(frame)]
        for start, end in zip(edges, edges[1:]):
            part = slice(start, end)
            links += linking_pairs(
                *(c[part] for c in columns), planes[part], sets[part], percent
            )
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    rows = stored(_block_rows(members), "neardup-blocks")
    # Pairs of blocks are put together in groups of about BLOCK_ROWS rows; a large pair adds no more
    # than its own two blocks.
    groups = max(1, -(-rows.count() // BLOCK_ROWS))
    group = F.pmod(F.xxhash64("key", "pair"), F.lit(groups)).alias("group")
    full = rows.join(merged(few.select("node", "planes").join(merged(sets), "node")), "node")
    return (
        full.select(group, "*")
        .groupBy("group")
        .applyInPandas(compare, "a long, b long")
        .distinct()
    )


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Component labels (node, component) after joining the components that edges connect."""
    of = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    ends = (
        edges.join(of, F.col("a") == F.col("_node"))
        .select("b", F.col("_component").alias("_ca"))
        .join(of, F.col("b") == F.col("_node"))
        .select(F.col("_ca").alias("a"), F.col("_component").alias("b"))
    )
    joined = components(ends).select(
        F.col("node").alias("_old"), F.col("component").alias("_new")
    )
    return (
        labels.join(joined, F.col("component") == F.col("_old"), "left")
        .select("node", F.coalesce("_new", "component").alias("component"))
    )


def link(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    ``percent`` must be 85 or more: the signature threshold is chosen for it.
    """
    rows = link_rows(docs, doc_id, text, percent)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def link_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85
) -> DataFrame:
    """The columns of ``link``, ``digest`` of a row's text, and ``least``.

    Of a component of several rows, ``least`` is true for the row with the smallest id (null last)
    and text digest, and for rows equal to it; for rows alone in their component it is null.
    """
    sketch = stored(sketched(docs, doc_id, text), "neardup-sketches")
    nodes = stored(
        sketch.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min("id").alias("source"),
            F.count("*").alias("copies"),
            F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("least"),
            F.first("n_shingles").alias("size"),
            *[F.first(c).alias(c) for c in ("class", "lanes", "planes")],
        ),
        "neardup-nodes",
    )
    members = stored(_shared_keys(nodes), "neardup-members")
    involved = members.select("node").distinct()
    few = stored(
        nodes.join(involved, "node").select("node", "planes", "size", "source", "class"),
        "neardup-planes",
    )
    sets = stored(_sets_of(docs, few, doc_id, text), "neardup-sets")
    labels = stored(involved.select("node", F.col("node").alias("component")), "neardup-labels")

    def join_along(edges: DataFrame) -> DataFrame:
        edges = stored(edges, "neardup-edges")
        return labels if edges.isEmpty() else stored(_merged(labels, edges), "neardup-labels")

    pairs = stored(_close(_hub_pairs(members.join(labels, "node"), 0), few), "neardup-pairs")
    labels = join_along(_confirmed(pairs, sets, percent))
    placed = members.join(labels, "node").join(few.select("node", "size"), "node")
    labels = join_along(_cross_links(placed, sets, few, percent))
    return _resolved(sketch, nodes, labels)


def _resolved(sketch: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Name every component by its smallest id."""
    of = nodes.select("node", "source", "copies", "least").join(labels, "node", "left")
    of = of.withColumn("component", F.coalesce("component", "node"))
    named = of.groupBy("component").agg(
        F.min("source").alias("component_id"),
        F.sum("copies").alias("rows"),
        F.min("least").alias("least"),
    )
    # A row alone in its component is named by its own id.
    several = named.where(F.col("rows") > 1).select("component", "component_id", "least")
    name_of = stored(
        of.drop("least")
        .join(several, "component")
        .select(F.col("node").alias("_node"), "component_id", "least"),
        "neardup-names",
    )
    found = sketch.join(name_of, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("_node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    least = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("digest") == F.col("least.digest"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        "digest",
        F.when(F.col("_node").isNotNull(), least).alias("least"),
    )
