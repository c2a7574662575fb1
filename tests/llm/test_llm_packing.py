import itertools
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from martwright.llm import packing
from martwright.llm.tokens import encoder

SCHEMA = "doc_id long, text string, start string, length string, sequence_id int, _slice int"
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def slow():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_both_vocabulary_files_give_equal_ids_on_every_code_point(slow):
    points = [i for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    fast = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for start in range(0, len(points), 100_000):
        texts = []
        for part in range(start, min(start + 100_000, len(points)), 50):
            some = map(chr, points[part : part + 50])
            texts.append("".join(f"a{c}b {c} {c}{c}1{c}2 .{c}, {c}x  {c}\n{c}'s" for c in some))
        for text, wanted in zip(texts, slow.encode_batch(texts, add_special_tokens=False)):
            assert fast(text).tolist() == wanted.ids
    texts = ["", " ", "\n\n  x", "a" * 5000, "<|endoftext|> it's I'LL we've", "\t\x00\x7f"]
    for text in texts:
        wanted = slow.encode(text, add_special_tokens=False).ids
        assert fast(text).tolist() == encoder(JSON)(text).tolist() == wanted


def check(rows, texts, slow, capacity):
    """Pieces against whole documents; returns the padding."""
    ids = {d: slow.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc])
            piece = np.array(ids[doc][at : at + r["length"]], dtype="<u4")
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
            at += r["length"]
        assert at == len(ids[doc])
    padded = 0
    assert set(by_sequence) == set(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padded += packing.padding(at, capacity)
    return padded


@pytest.mark.parametrize("slice_rows", [7, 50_000])
def test_every_id_lies_in_one_piece(spark, slow, monkeypatch, slice_rows):
    monkeypatch.setattr(packing, "ROWS_A_SLICE", slice_rows)
    rng = random.Random(2)
    words = ["the", "über", "x1", "longer", "\n", "é"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90)))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, "word " * 9000), (-5, "same"), (None, "no id")]
    texts += [(300 + i, "copies of one text") for i in range(60)]
    docs = spark.createDataFrame([(*t, "s", "l", 1, 2) for t in texts], SCHEMA)
    rows = packing.pack(packing.pieces(docs, capacity=64), capacity=64).collect()
    padded = check(rows, texts, slow, 64)
    assert padded < 0.01 * sum(r["length"] for r in rows)


def test_repeated_rows_and_ids(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3 + [(1, "c")], "doc_id long, text string")
    rows = packing.pack(packing.pieces(docs, with_ids=True)).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert all(len(r["ids"]) == r["length"] for r in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs)).count() == 0


def test_fill_equals_enumeration():
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.choice([16, 20, 32])
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        target = rng.randint(0, capacity)
        lengths = sorted(counts, reverse=True)
        total, picked = packing.fill(target, counts, lengths, capacity)
        assert total == sum(k * v for k, v in picked.items()) <= target
        assert all(v <= counts[k] for k, v in picked.items())
        sums = {
            sum(k * n for k, n in zip(lengths, some))
            for some in itertools.product(*(range(counts[k] + 1) for k in lengths))
        }
        used = capacity - target
        least = min(packing.padding(used + s, capacity) for s in sums if s <= target)
        assert packing.padding(used + total, capacity) == least


def test_windows_use_up_all_lengths():
    rng = random.Random(1)
    counts = {rng.randint(1, 2048): rng.randint(1, 1000) for _ in range(1500)}
    counts |= {rng.randint(1, 500): rng.randint(500, 4000) for _ in range(400)}
    windows = packing.plan_windows(counts, 2048)
    used = {}
    for times, picked in windows:
        assert sum(k * v for k, v in picked.items()) <= 2048
        for length, n in picked.items():
            used[length] = used.get(length, 0) + n * times
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    padded = sum(
        t * packing.padding(sum(k * v for k, v in p.items()), 2048) for t, p in windows
    )
    assert padded < 0.001 * total


def test_added_tokens_in_a_text_are_those_of_an_unchanged_tokenizer(spark):
    plain = Tokenizer.from_file(JSON)
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n\n c", " <|endoftext|> it's"]
    texts += ["<|endoftext|", "x  <|endoftext|>  y", "<|fim|> <|endoftext|>é", "no token", ""]
    wanted = [plain.encode(text, add_special_tokens=False).ids for text in texts]
    assert wanted[0] == [50256]
    for path in (JSON, public_tokenizers.path("byte_bpe_50k.tiktoken")):
        assert [encoder(path, special=True)(text).tolist() for text in texts] == wanted
    rows = [(i, text, "s", "l", 1, 2) for i, text in enumerate(texts)]
    found = packing.pieces(spark.createDataFrame(rows, SCHEMA)).collect()
    for row in found:
        ids = np.array([*wanted[row["doc_id"]], 1], dtype="<u4")
        assert row["ids_crc32"] == zlib.crc32(ids.tobytes()) and row["doc_tokens"] == len(ids)
