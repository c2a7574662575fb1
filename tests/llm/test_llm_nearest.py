import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import nearest
from martwright.llm.queries import op4_nearest

SCHEMA = "vec_id long, embedding array<float>, id int, hash string, name int, code int"


def brute_force(rows, k=20, step=20):
    good = {
        (i, tuple(np.float32(x) for x in v))
        for i, v in rows
        if i is not None
        and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
        and any(x != 0 for x in v)
    }
    lengths = [len(v) for _, v in good]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), -n)) if lengths else 0
    good = sorted((i, np.array(v, dtype=float)) for i, v in good if len(v) == usual)
    found = {}
    for i, q in good:
        if i % step == 0:
            scored = sorted((-float((v * q).sum()), j) for j, v in good if j != i)
            found[i] = [(j, -s) for s, j in scored[:k]]
    return found


def answers(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(found[r["query_id"]]) == r["rank"]
    return found


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "h", 2, 3) for i, v in rows], SCHEMA)


def test_small_tables_are_exact(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_A_BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.2, 3)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[40][1]) for i in range(70)]  # equal vectors, ties by id
    rows += [(None, rows[0][1]), (400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7)]
    rows += [(460, [None] + [1.0] * 7), (480, [1.0, 2.0]), (500, [float("inf")] * 8), (520, [])]
    rows += [rows[20], (540, [0.0, -0.0, 1.0] + [0.0] * 5), (541, [-0.0, 0.0, 1.0] + [0.0] * 5)]
    got = answers(nearest.search(table(spark, rows), F.col("id") % 20 == 0).collect())
    expected = brute_force(rows)
    assert set(got) == set(expected)
    for query, hits in expected.items():
        assert [h[0] for h in got[query]] == [h[0] for h in hits], query
        assert [h[1] for h in got[query]] == pytest.approx([h[1] for h in hits], abs=1e-12)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [0.0, 1.0])]
    got = answers(nearest.search(table(spark, rows), F.col("id") % 20 == 0).collect())
    assert got == {20: [(21, 0.5), (22, 0.0)]}
    alone = nearest.search(table(spark, rows[:1]), F.col("id") % 20 == 0)
    assert alone.count() == 0
    assert nearest.search(table(spark, []), F.col("id") % 20 == 0).count() == 0


def test_recall_with_a_calibrated_radius(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TRAINING_ROWS", 512)
    monkeypatch.setattr(nearest, "ROWS_A_BLOCK", 512)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = [
        (i, (centres[i % 40] + 0.4 * rng.normal(size=32)).tolist()) for i in range(4000)
    ]
    got = answers(nearest.search(table(spark, rows), F.col("id") % 20 == 0).collect())
    expected = brute_force(rows)
    hits = sum(len({h[0] for h in got[q]} & {h[0] for h in e}) for q, e in expected.items())
    assert set(got) == set(expected)
    assert hits >= 0.95 * sum(map(len, expected.values()))


def test_masks_and_substrings():
    parts = nearest.substrings(50_000)
    assert parts[0][0] == 0 and sum(w for _, w in parts) == nearest.BITS
    codes = np.array([0b1011, 0xF0F0F0F0F0F0F0F0], dtype=np.uint64)
    joined = np.zeros(2, dtype=np.uint64)
    for first, width in parts:
        joined |= nearest._cut(codes, (first, width)) << np.uint64(first)
    assert (joined == codes).all()


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    expected = brute_force([(r[0], r[1]) for r in table.collect()])
    got = answers(op4_nearest(spark, folder).collect())
    hits = sum(len({h[0] for h in got[q]} & {h[0] for h in e}) for q, e in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))
