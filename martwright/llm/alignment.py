"""Alignment of two tokenizers: which ids of one end where ids of the other end.

Tokens of a text by A and by B are byte ranges of the same bytes. Where tokens of both end is a cut;
cuts part the tokens into groups, and the tokens that end together are linked. Over the corpus,
the counts of linked id pairs say which A id a B id stands for most often.

Method (Arrow-native): a batch's token lists are flattened, their parent indices name the document,
and segmented cumulative sums of token lengths give byte ends. An Acero hash join on (document, end)
finds the links, and ``binary_join`` writes the groups. Partial pair counts are made by
``Table.group_by`` in each task and merged by Spark.

Scale: pairs are counted before they are shuffled, so frequent ones are no hot keys. To bring
the counts back to the documents, the ``HEAD`` most frequent pairs are broadcast (a fixed number,
whatever the corpus) and joined by Acero in the tasks; the links of the other pairs, each of
which holds at most one in ``HEAD`` of all links, are counted per document and joined by shuffle.
Texts are tokenized once: the links are stored.

Defined results: a text that is null or empty, or whose tokens by either tokenizer do not give its
bytes back (a character that the vocabulary replaces), has no tokens; rows with the same id
are rows of their own; an empty table gives no rows. A very long text is tokenized whole, in one task. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm import tokens
from martwright.llm.common import per_worker, stored

#: Pairs whose counts every task holds: 17 bytes each.
HEAD = 1 << 18
#: Distinct pairs a task holds before it gives their partial counts out.
HELD_PAIRS = 1 << 19
#: Bytes of texts, and links, that are worked on at once; a longer text is worked on alone.
BYTES_AT_ONCE = 1 << 18
LINKS_AT_ONCE = 1 << 17
_SIDE = np.int64(1 << 32)


@dataclass
class Vocabulary:
    """Token lists of texts, and the bytes of each id."""

    encode: object  # list of texts -> list of id sequences
    pieces: pa.LargeBinaryArray
    lengths: np.ndarray

    @staticmethod
    def of(encode: object, pieces: list[bytes]) -> Vocabulary:
        return Vocabulary(
            encode, pa.array(pieces, pa.large_binary()), np.array([len(p) for p in pieces])
        )


def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary; a blank is put before each text. Added tokens are plain text."""

    def load() -> Vocabulary:
        ranks, encode = tokens._ranks(path), tokens.encoder(path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, number in ranks.items():
            pieces[number] = piece
        return Vocabulary.of(lambda texts: [encode(f" {t}") for t in texts], pieces)

    return per_worker(f"align {path}", load)


def sentence_pieces(path: str) -> Vocabulary:
    """A sentencepiece model, which puts a blank before each text itself."""

    def load() -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def piece(number: int) -> bytes:
            text = model.id_to_piece(number)
            if model.is_byte(number):
                return bytes([int(text[1:-1], 16)])
            return text.replace("▁", " ").encode()

        return Vocabulary.of(
            lambda texts: model.encode(texts, num_threads=1),
            [piece(i) for i in range(model.get_piece_size())],
        )

    return per_worker(f"align {path}", load)


@dataclass
class Side:
    """The tokens of a batch by one tokenizer: id, document and end of each."""

    ids: np.ndarray
    docs: np.ndarray
    ends: np.ndarray
    sound: np.ndarray  # documents whose tokens give their bytes back

    @staticmethod
    def read(vocabulary: Vocabulary, texts: list[str], wanted: list[bytes]) -> Side:
        lists = vocabulary.encode(texts)
        bounds = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists])
        nested = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(flat))
        ids = pc.list_flatten(nested).to_numpy()
        docs = pc.list_parent_indices(nested).to_numpy()
        upto = np.r_[0, np.cumsum(vocabulary.lengths[ids])]
        start = upto[bounds[:-1]]
        joined = vocabulary.pieces.take(pa.array(ids)).buffers()[2].to_pybytes()
        spans = zip(start.tolist(), upto[bounds[1:]].tolist(), wanted)
        sound = np.array([joined[a:b] == text for a, b, text in spans])
        return Side(ids, docs, upto[1:] - start[docs], sound)

    def of(self, good: np.ndarray) -> Side:
        keep = good[self.docs]
        return Side(self.ids[keep], self.docs[keep], self.ends[keep], good)

    def keys(self) -> np.ndarray:
        """Document and end in one number; in order."""
        return self.docs * _SIDE + self.ends

    def table(self, name: str) -> pa.Table:
        return pa.table({"doc": self.docs, "end": self.ends, name: self.ids})


def _listed(values: pa.Array, lengths: np.ndarray, between: str) -> pa.Array:
    """Runs of strings, joined."""
    offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int64))
    lists = pa.LargeListArray.from_arrays(offsets, values)
    return pc.binary_join(lists, pa.scalar(between, values.type))


def links_of(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Document and (A id, B id), as one number, of all tokens that end together."""
    found = a.table("a").join(
        b.table("b"), ["doc", "end"], join_type="inner", use_threads=False
    )
    pair = found["a"].to_numpy() * _SIDE + found["b"].to_numpy()
    docs = found["doc"].to_numpy()
    order = np.lexsort((pair, docs))
    return docs[order], pair[order]


def groups_of(a: Side, b: Side, n: int) -> tuple[np.ndarray, pa.Array]:
    """The number of groups of each of ``n`` documents, and their text ``a1,a2|b1;a3|b2``."""
    ours, theirs = a.keys(), np.r_[b.keys(), -1]
    cuts = ours[theirs[np.searchsorted(theirs[:-1], ours)] == ours]
    cuts = cuts[np.diff(cuts, prepend=-1) > 0]
    sides = []
    for side in (a, b):
        group = np.searchsorted(cuts, side.keys())
        texts = pc.cast(pa.array(side.ids), pa.large_string())
        sides.append(_listed(texts, np.bincount(group, minlength=len(cuts)), ","))
    bar = pa.scalar("|", pa.large_string())
    each = pc.binary_join_element_wise(*sides, bar)
    per_doc = np.bincount(cuts // _SIDE, minlength=n)
    return per_doc, _listed(each, per_doc, ";")


COLUMNS = (
    "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>"
)


def align_texts(texts: list[str | None], first: Vocabulary, second: Vocabulary) -> pa.Table:
    """:data:`COLUMNS` of each text."""
    n = len(texts)
    held = [i for i, t in enumerate(texts) if t]
    counts = {c: np.zeros(n, dtype=np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    hashes, pairs = [""] * n, np.empty(0, dtype=np.int64)
    if held:
        own = [texts[i] for i in held]
        wanted = [f" {t}".encode() for t in own]
        a, b = (Side.read(v, own, wanted) for v in (first, second))
        good = a.sound & b.sound
        a, b = a.of(good), b.of(good)
        docs, pairs = links_of(a, b)
        groups, written = groups_of(a, b, len(own))
        for name, values in (
            ("n_a", np.bincount(a.docs, minlength=len(own))),
            ("n_b", np.bincount(b.docs, minlength=len(own))),
            ("n_groups", groups),
            ("n_links", np.bincount(docs, minlength=len(own))),
        ):
            counts[name][held] = values
        for i, sound, text in zip(held, good, written):
            if sound:
                hashes[i] = hashlib.sha256(text.as_buffer()).hexdigest()
    bounds = np.r_[0, np.cumsum(counts["n_links"])]
    # Links lie in the order of their documents.
    lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(pairs))
    return pa.table(
        {**counts, "groups_sha256": hashes, "pairs": lists.cast(pa.list_(pa.int64()))}
    )


def _pieces(batch: pa.RecordBatch, sizes: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` in ``sizes`` each."""
    upto = np.cumsum(pc.fill_null(sizes, 0).to_numpy().astype(np.int64))
    cuts = (np.flatnonzero(np.diff(upto // limit)) + 1).tolist()
    for begin, end in zip([0, *cuts], [*cuts, len(batch)]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _pieces(batch, pc.binary_length(batch.column("_text")), BYTES_AT_ONCE)


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _pieces(batch, pc.list_value_length(batch.column("pairs")), LINKS_AT_ONCE)


def align(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``row_number`` (unique) and :data:`COLUMNS`, stored."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_level(byte_path), sentence_pieces(piece_path)
        for piece in _texts(batches):
            found = align_texts(piece.column("_text").to_pylist(), first, second)
            found = found.add_column(0, "doc_id", piece.column("_doc"))
            yield from found.combine_chunks().to_batches()

    rows = docs.select(F.col(doc_id).alias("_doc"), F.col("text").alias("_text"))
    aligned = rows.mapInArrow(read, f"doc_id {kind}, {COLUMNS}")
    return stored(
        aligned.withColumn("row_number", F.monotonically_increasing_id()), "aligned-links"
    )


def _counted(table: pa.Table) -> pa.Table:
    return table.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(
        ["pair", "n"]
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n`` and ``best`` (is no A id linked with the B id more often?), stored."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        fresh: list[pa.Table] = []
        for batch in _linked(batches):
            pairs = pc.list_flatten(batch.column("pairs"))
            own = pc.value_counts(pairs)
            fresh.append(pa.table({"pair": own.field("values"), "n": own.field("counts")}))
            if sum(map(len, fresh)) > HELD_PAIRS // 4:
                held, fresh = _counted(pa.concat_tables([held, *fresh])), []
            if len(held) > HELD_PAIRS:
                yield from held.combine_chunks().to_batches()
                held = held.slice(0, 0)
        held = _counted(pa.concat_tables([held, *fresh]))
        yield from held.combine_chunks().to_batches()

    merged = (
        aligned.select("pairs")
        .mapInArrow(partial, "pair long, n long")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )
    counts = stored(merged.withColumn("b", F.col("pair") % F.lit(int(_SIDE))), "aligned-counts")
    # One row for each id of B.
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    both = counts.join(F.broadcast(most), "b")
    return stored(
        both.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "aligned-pairs"
    )


SCORES = "n_best long, count_sum long, rest array<long>"


def score(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` without ``pairs``, with ``n_best`` and ``count_sum``."""
    kept = [c for c in aligned.columns if c != "pairs"]
    ranked = counts.orderBy(F.desc("n"), "pair").limit(HEAD)
    head = ranked.toArrow()
    shared = aligned.sparkSession.sparkContext.broadcast(
        {c: head[c].to_numpy() for c in ("pair", "n", "best")}
    )

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.table({**shared.value, "known": np.ones(len(shared.value["pair"]), dtype=bool)})
        for batch in _linked(batches):
            lists = batch.column("pairs")
            links = pa.table(
                {"doc": pc.cast(pc.list_parent_indices(lists), pa.int64()), "pair": pc.list_flatten(lists)}
            )
            found = links.join(known, "pair", join_type="left outer", use_threads=False)
            hit = found.filter(pc.is_valid(found["known"]))
            sums = hit.append_column("b", pc.cast(hit["best"], pa.int64())).group_by(
                "doc", use_threads=False
            ).aggregate([("n", "sum"), ("b", "sum")])
            n_best, count_sum = (np.zeros(len(batch), dtype=np.int64) for _ in range(2))
            n_best[sums["doc"].to_numpy()] = sums["b_sum"].to_numpy()
            count_sum[sums["doc"].to_numpy()] = sums["n_sum"].to_numpy()
            miss = found.filter(pc.is_null(found["known"])).sort_by("doc")
            each = np.bincount(miss["doc"].to_numpy(), minlength=len(batch))
            rest = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(each)], pa.int32()),
                miss["pair"].combine_chunks(),
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(n_best), pa.array(count_sum), rest],
                names=[*kept, "n_best", "count_sum", "rest"],
            )

    fields = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in kept)
    scored = aligned.select(*kept, "pairs").mapInArrow(look_up, f"{fields}, {SCORES}")
    if len(head) < HEAD:
        return scored.drop("rest")
    scored = stored(scored, "aligned-scored")
    rest = (
        scored.select("row_number", F.explode("rest").alias("pair"))
        .groupBy("row_number", "pair")
        .agg(F.count("*").alias("times"))
    )
    more = (
        rest.join(counts, "pair")
        .groupBy("row_number")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times"))).alias("_best"),
            F.sum(F.col("n") * F.col("times")).alias("_sum"),
        )
    )
    return scored.join(more, "row_number", "left").select(
        *kept,
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
    )
