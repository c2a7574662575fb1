"""Alignment against a brute-force version that compares every token with every other."""

import hashlib
import json
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from martwright.llm import alignment, queries

COLUMNS = (
    "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
)
TEXTS = [
    "The quick brown fox, unaffordable internationalization!",
    "Été à Zürich: naïve façade — 日本語 𝔘𝔫𝔦 🙂🙂",
    "",
    None,
    "text with ▁ in it",
    "<unk> <s> <|endoftext|> </s> plain",
    "  two blanks\n\n\ttab\x00 \r\n",
    "a",
    "The quick brown fox, unaffordable internationalization!",
    "the the the the and and of of " * 50,
    "x" * 3000,
]


@pytest.fixture(scope="module")
def brute():
    """Rows by tokens taken from the plain libraries and ends compared pair by pair."""
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        names = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    # The printable stand-ins of byte-level vocabularies, by their rule.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {chr(c): c for c in plain}
    stands.update({chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)})

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        ids = a.encode(f" {text}", add_special_tokens=False).ids
        one = [(i, bytes(stands[c] for c in names[i])) for i in ids]
        other = [(i, bytes_b(i)) for i in b.encode(text)]
        want = f" {text}".encode()
        whole = all(b"".join(x for _, x in side) == want for side in (one, other))
        return (one, other) if text and whole else ([], [])

    def ends(side):
        at, out = 0, []
        for i, piece in side:
            at += len(piece)
            out.append((i, at))
        return out

    def run(rows):
        read = [(doc, *map(ends, tokens(text or ""))) for doc, text in rows]
        links = [[(x, y) for x, e in one for y, f in other if e == f] for _, one, other in read]
        count = Counter(pair for each in links for pair in each)
        most = Counter()
        for (_, y), n in count.items():
            most[y] = max(most[y], n)
        out = []
        for (doc, one, other), each in zip(read, links):
            cuts = sorted({e for _, e in one} & {e for _, e in other})
            texts, before = [], 0
            for cut in cuts:
                texts.append("|".join(
                    ",".join(str(i) for i, e in side if before < e <= cut) for side in (one, other)
                ))
                before = cut
            sha = hashlib.sha256(";".join(texts).encode()).hexdigest() if one else ""
            out.append((
                doc, len(one), len(other), len(cuts), len(each),
                sum(count[p] == most[p[1]] for p in each), sum(count[p] for p in each), sha,
            ))
        return sorted(out, key=repr)

    return run


def _align(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pairs int")
    found = alignment.align(docs, P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"))
    return alignment.score(found, alignment.pair_counts(found)).select(*COLUMNS)


def test_odd_texts_equal_brute_force(spark, rows, brute):
    data = [(i % 9 if i < 10 else None, t) for i, t in enumerate(TEXTS)]
    assert rows(_align(spark, [(*r, "x", 1) for r in data])) == brute(data)


@pytest.mark.parametrize("head", [1, 40])
def test_pairs_beyond_the_broadcast_ones(spark, rows, brute, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 5)
    monkeypatch.setattr(alignment, "BYTES_AT_ONCE", 60)
    monkeypatch.setattr(alignment, "LINKS_AT_ONCE", 7)
    data = list(enumerate(TEXTS))
    assert rows(_align(spark, [(*r, "x", 1) for r in data])) == brute(data)


def test_empty_table(spark):
    assert _align(spark, []).collect() == []


def test_very_long_text(spark, rows, brute):
    long = " ".join(f"word{i % 977} naïve" for i in range(60_000))
    found = _align(spark, [(1, long, "x", 1), (2, "word1", "x", 1)]).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["n_links"] == by_id[1]["n_groups"] > 60_000
    assert by_id[2]["n_a"] > 0


def test_query_equals_brute_force(spark, rows, brute):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    docs = [d for d in docs if len(d[1] or "") < 3000]
    # The brute force is quadratic in a text, so the query's own steps run over the shorter ones.
    assert rows(_align(spark, [(*d, "x", 1) for d in docs])) == brute(docs)
    assert queries.op13_alignment(spark, folder).count() == 200
