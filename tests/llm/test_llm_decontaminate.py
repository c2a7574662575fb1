import random
from collections import Counter
from math import log1p

import numpy as np
import pytest

from martwright.llm import decontaminate as d

DOCS = "doc_id long, text string, item_id int, score string, _doc int"
ITEMS = "item_id long, text string, shard int, place int"


def plain_leaks(docs, items):
    """Every item against every document, by the overlaps alone."""
    found = set()
    for doc, text in docs:
        words = d.words_of(text)
        for item, body in items:
            if item is None or not d.words_of(body) or not words:
                continue
            whole, asked, answered = d.overlaps(words, *d.question_and_answer(body))
            if whole >= d.OVERLAP or (asked >= d.OVERLAP and answered >= d.OVERLAP):
                found.add((doc, item))
    return found


def leaks(spark, docs, items):
    documents = spark.createDataFrame([(*r, 1, "s", 2) for r in docs], DOCS)
    benchmark = spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS)
    rows = d.find_leaks(documents, benchmark).collect()
    pairs = [(r["doc_id"], r["item_id"]) for r in rows]
    assert len(pairs) == len(set(pairs))
    assert all(r["item_overlap"] >= d.OVERLAP or r["question_overlap"] >= d.OVERLAP for r in rows)
    return set(pairs)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    common = ["the", "of", "and", "in", "that", "is", "to", "was"]
    rare = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmnrst"]

    def sentence(n):
        return " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)) + "."

    items = [(i, f"{sentence(rng.randint(8, 30))} {sentence(rng.randint(5, 12))}") for i in range(40)]
    items += [(100, sentence(300)), (101, "two words"), (102, None), (103, ""), (None, sentence(9))]
    items += [(5, sentence(25)), items[3]]
    docs = []
    for i in range(160):
        parts = [sentence(rng.randint(5, 60)) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            leak = items[rng.randrange(len(items))][1] or ""
            form = rng.randrange(4)
            leak = (leak, leak.upper(), leak.replace(" ", ",\n"), leak[: len(leak) // 2])[form]
            parts.insert(rng.randint(0, len(parts)), leak)
        docs.append((i, " ".join(parts)))
    docs += [(900, None), (901, ""), (902, "!!"), (903, items[0][1]), docs[0], (None, items[1][1])]
    docs += [(904, " ".join(sentence(60) for _ in range(400)) + " " + items[40][1])]
    return docs, items


@pytest.mark.parametrize("shard", [7, 4096])
def test_finds_what_comparing_everything_finds(spark, monkeypatch, corpus, shard):
    monkeypatch.setattr(d, "SHARD", shard)
    docs, items = corpus
    expected = plain_leaks(docs, items)
    assert len(expected) > 25
    assert leaks(spark, docs, items) == expected


def test_batches_of_any_size_give_the_same(spark, monkeypatch, corpus):
    monkeypatch.setattr(d, "CHARACTERS_AT_ONCE", 500)
    docs, items = corpus
    assert leaks(spark, docs, items) == plain_leaks(docs, items)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert leaks(spark, [], items) == set()
    assert leaks(spark, docs, []) == set()
    assert leaks(spark, docs, [(1, None), (2, "")]) == set()


def test_own_question_and_answer_columns(spark):
    docs = spark.createDataFrame(
        [(1, "x y what is the largest town of the north region then it is alba town ok"),
         (2, "x y what is the largest town of the north region then nobody knew it")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame(
        [(1, "what is the largest town of the north region", "alba")],
        "item_id long, q string, a string",
    )
    rows = d.find_leaks(docs, items, question="q", answer="a").collect()
    found = {r["doc_id"]: r["answer_overlap"] for r in rows}
    assert found[1] == 1.0 and found.get(2, 0.0) == 0.0


def test_retrieval_equals_full_scoring(spark, corpus):
    _, items = corpus
    benchmark = spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS)
    rows = d.postings(benchmark).toPandas()
    index = d.Index.build(rows, {})
    weights = {(r.term, r.place): r.weight for r in rows.itertuples()}
    rng = random.Random(2)
    passages, terms, expected = [], [], {}
    vocabulary = sorted(index.terms)
    for p in range(60):
        some = set(rng.sample(vocabulary, 40))
        place = rng.randrange(len(index.items))
        some |= {t for t, at in weights if at == place and rng.random() < 0.8}
        for t in sorted(index.terms[t] for t in some):
            passages.append(p)
            terms.append(t)
        for place in range(len(index.items)):
            total = sum(weights.get((t, place), 0.0) for t in some)
            if total >= d.THRESHOLD:
                expected[p, place] = total
    found = index.retrieve(np.array(passages), np.array(terms))
    got = {(int(p), int(s)): x for p, s, x in zip(*found)}
    assert got.keys() == expected.keys() and len(got) > 30
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_weights_are_bm25(spark):
    items = [(1, "a b b c"), (2, "a d")]
    rows = d.postings(spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS)).collect()
    df, mean = Counter({"a": 2, "b": 1, "c": 1, "d": 1}), 3.0
    for item, text in items:
        words = text.split()
        raw = {}
        for t in set(words):
            n = words.count(t)
            idf = log1p((2 - df[t] + 0.5) / (df[t] + 0.5))
            raw[t] = idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / mean))
        for r in rows:
            if r["item"] == item:
                assert abs(r["weight"] - raw[r["term"]] / sum(raw.values())) < 1e-12
