import uuid
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from martwright.llm import rollup
from martwright.llm.queries import FIRST, SECOND, op1_token_rollup
from martwright.llm.tokens import encoder

SCHEMA = "doc_id long, tokenizer string, source string, lang string, tokens long, docs int, new int"


@pytest.fixture
def kept(spark, tmp_path):
    return rollup.Rollup(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


def batch(spark, rows):
    return spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA)


def totals(kept):
    return {tuple(r)[:3]: tuple(r)[3:] for r in kept.totals().collect()}


def brute_force(batches):
    """Last state of every document and tokenizer, counted again from the start."""
    state = {}
    for rows in batches:
        changes = defaultdict(list)
        for doc, tokenizer, source, lang, tokens in rows:
            if doc is not None and tokenizer is not None:
                changes[doc, tokenizer].append((tokens, source, lang))
        for key, some in changes.items():
            tokens, source, lang = max(
                some, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or "")
            )
            state.pop(key, None)
            if tokens is not None:
                state[key] = (source, lang, tokens)
    sums = defaultdict(lambda: (0, 0))
    for (_, tokenizer), (source, lang, tokens) in state.items():
        n, total = sums[source, lang, tokenizer]
        sums[source, lang, tokenizer] = (n + 1, total + tokens)
    return dict(sums)


BATCHES = [
    [(1, "v1", "a", "en", 10), (2, "v1", "a", "de", 20), (3, "v1", None, None, 0), (4, "v1", "b", "en", 5)],
    [(1, "v1", "a", "en", 12), (2, "v1", "a", "de", None), (9, "v1", "a", "en", None), (None, "v1", "a", "en", 3)],
    [(1, "v2", "a", "en", 7), (4, "v1", "c", "fr", 5), (2, "v1", "a", "de", 21), (5, None, "a", "en", 2)],
    [(3, "v1", None, None, None), (1, "v1", "a", "en", 12), (6, "v1", "a", "en", 1), (6, "v1", "a", "en", 1)],
    [(6, "v1", "a", "en", 4), (6, "v1", "b", "en", None)],
    [],
]


def test_totals_equal_a_fresh_count_after_every_batch(spark, kept):
    assert totals(kept) == {}
    for number, rows in enumerate(BATCHES):
        assert kept.commit(f"b{number}", batch(spark, rows))
        assert totals(kept) == brute_force(BATCHES[: number + 1])


def test_repeated_batches_change_nothing(spark, kept):
    for _ in range(2):
        for number, rows in enumerate(BATCHES[:3]):
            kept.commit(f"b{number}", batch(spark, rows))
    assert not kept.commit("b0", batch(spark, BATCHES[0]))
    again = rollup.Rollup(spark, kept.folder)
    assert totals(again) == brute_force(BATCHES[:3])


def test_a_commit_that_fails_half_way_leaves_no_trace(spark, kept, monkeypatch):
    kept.commit("b0", batch(spark, BATCHES[0]))

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(kept, "_enter", lost)
        with pytest.raises(RuntimeError):
            kept.commit("b1", batch(spark, BATCHES[1]))
    assert totals(kept) == brute_force(BATCHES[:1])
    assert kept.commit("b1", batch(spark, BATCHES[1]))
    assert totals(kept) == brute_force(BATCHES[:2])


def test_a_writer_that_loses_the_version_starts_again(spark, kept, monkeypatch):
    other = rollup.Rollup(spark, kept.folder)
    kept.commit("b0", batch(spark, BATCHES[0]))
    enter, tried = kept._enter, []

    def raced(version, entry):
        if not tried:
            tried.append(version)
            other.commit("between", batch(spark, BATCHES[2]))
        return enter(version, entry)

    monkeypatch.setattr(kept, "_enter", raced)
    assert kept.commit("b1", batch(spark, BATCHES[1]))
    assert totals(kept) == brute_force([BATCHES[0], BATCHES[2], BATCHES[1]])


def test_counts(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (2, None, 4), (3, "", 5)], "doc_id long, text string, counts int")
    paths = {n: public_tokenizers.path(f"{n}.tiktoken") for n in (FIRST, SECOND)}
    rows = rollup.token_counts(docs, paths).select("row.doc_id", "counts").collect()
    assert {r[0]: r[1] for r in rows}[2] == {FIRST: 0, SECOND: 0}
    assert {r[0]: r[1][FIRST] for r in rows}[1] == 2


def test_query_equals_a_fresh_count(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    first = Tokenizer.from_file(public_tokenizers.path(f"{FIRST}.json"))
    second = encoder(public_tokenizers.path(f"{SECOND}.tiktoken"))
    original, expected = {}, defaultdict(lambda: [0, 0])
    for r in rows:
        original[r["text"]] = min(r["doc_id"], original.get(r["text"], r["doc_id"]))
    for r in rows:
        if original[r["text"]] == r["doc_id"]:
            counts = {
                FIRST: len(first.encode(r["text"], add_special_tokens=False).ids),
                SECOND: len(second(r["text"])),
            }
            for name, n in counts.items():
                entry = expected[r["source"], r["lang"], name]
                entry[0], entry[1] = entry[0] + 1, entry[1] + n
    got = {tuple(r)[:3]: list(r)[3:] for r in op1_token_rollup(spark, folder).collect()}
    assert got == dict(expected)
