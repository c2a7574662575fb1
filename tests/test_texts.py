import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.operators import documents, questions, vectors

TEXTS = [
    "Show me the monthly revenue trend",
    "Which seller is\nbetter than most?",
    "Top 10 products by category",
    "étop and stopwatch",
    "TOTAL sales, share of each segment",
    "hello there",
    "What is the impact of price on count of orders?",
    "which city sells more",
    "",
]


def test_intents_equal_python_patterns(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r.i for r in df.select(questions.classify_intents(F.col("t")).alias("i")).collect()]
    for text, found in zip(TEXTS, got):
        want = [
            intent
            for intent, patterns in questions.INTENT_PATTERNS.items()
            if any(re.search(p, text.lower()) for p in patterns)
        ]
        assert found == (want or ["unknown"]), text
    primary = df.select(questions.primary_intent(questions.classify_intents(F.col("t"))).alias("p"))
    assert [r.p for r in primary.collect()][:3] == ["trend", "ranking", "comparison"]


def test_sql_request(spark):
    df = spark.createDataFrame([("Give me the SQL",), ("data from 2018",), ("hello",)], "t string")
    got = [r.r for r in df.select(questions.classify_sql_request(F.col("t")).alias("r")).collect()]
    assert got == [True, True, False]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Here:\n```sql\nselect 1\n from t\n```\nand ```sql\nselect 2```", "select 1\n from t"),
        ("  select 3 \n", "select 3"),
        ("```\nselect 4\n```", "```\nselect 4\n```"),
        ("```sql\n   ```", ""),
        (None, None),
    ],
)
def test_extract_fenced_sql(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(questions.extract_fenced_sql(F.col("t")).alias("s")).first().s == want


def test_doc_build_and_truncate(spark):
    columns = [("f", "m", "About m", i, f"c{i}", f"d{i}") for i in reversed(range(2500))]
    schema = (
        "file_path string, model_name string, description string, column_pos int, "
        "column_name string, column_description string"
    )
    lines = columns + [("f", "empty", "", 0, None, None), ("g", "m", "Other", 0, "x", None)]
    df = documents.doc_build(spark.createDataFrame(lines, schema).repartition(9))
    got = {(r.file_path, r.model_name): r.text for r in df.collect()}
    want = "Model: m\nDescription: About m\n\nColumns:\n" + "\n".join(f"- c{i}: d{i}" for i in range(2500))
    assert got[("f", "m")] == want
    assert got[("f", "empty")] == "Model: empty\nDescription: \n\nColumns:"
    assert got[("g", "m")] == "Model: m\nDescription: Other\n\nColumns:\n- x:"
    short = df.select(documents.doc_truncate(F.col("text")).alias("t")).where(F.col("t").startswith("Model: m\nDescription: About"))
    cut = short.first().t
    assert cut == want[:1990] + "... [truncated]" and len(cut) == 2005
    exact = spark.createDataFrame([("x" * 2000,)], "t string").select(documents.doc_truncate(F.col("t")).alias("t"))
    assert exact.first().t == "x" * 2000


def test_doc_id(spark):
    row = spark.range(1).select(documents.doc_id_md5(F.lit("a/b.yml"), F.lit("m")).alias("d")).first()
    assert row.d == __import__("hashlib").md5(b"a/b.yml::m").hexdigest()


def test_embed_stats(spark):
    df = spark.createDataFrame(
        [("a", "embedded"), ("a", "error"), ("b", "skipped"), ("b", "embedded")],
        "file_path string, status string",
    )
    assert tuple(documents.embed_stats(df).first()) == (2, 1, 2)


def vector_frame(spark, matrix, start=0):
    rows = [(i + start, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def brute_force(corpus, queries, k, metric):
    corpus, queries = (m.astype(np.float32).astype(np.float64) for m in (corpus, queries))
    out = {}
    for i, q in enumerate(queries):
        if metric == "l2":
            d = ((corpus - q) ** 2).sum(axis=1)
        else:
            d = 1 - corpus @ q / (np.linalg.norm(corpus, axis=1) * np.linalg.norm(q))
        out[i] = sorted(range(len(corpus)), key=lambda j: (round(d[j], 12), j))[:k]
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("rows, shared", [(64, False), (4096, False), (64, True)])
def test_vector_topk_equals_brute_force(spark, monkeypatch, metric, rows, shared):
    rng = np.random.default_rng(11)
    corpus, queries = rng.normal(size=(700, 16)), rng.normal(size=(60, 16))
    # Copies of one vector: ties go to the smallest id, and no copy is dropped.
    corpus[100:300] = queries[7]
    monkeypatch.setattr(vectors, "QUERY_ROWS", rows // 4)
    monkeypatch.setattr(vectors, "PLACE_ROWS", rows)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(vectors, "SHARED_BYTES", 1 << 20 if shared else 0)
    found = vectors.vector_topk(
        vector_frame(spark, corpus).repartition(5),
        vector_frame(spark, queries),
        k=4,
        metric=metric,
    )
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == brute_force(corpus, queries, 4, metric)


def test_vector_topk_with_little_data(spark):
    one = vector_frame(spark, np.ones((2, 3)))
    assert vectors.vector_topk(one, one, k=3).count() == 4
    none = one.limit(0)
    assert vectors.vector_topk(none, one).count() == 0
    assert vectors.vector_topk(one, none).count() == 0
    with pytest.raises(ValueError, match="metric"):
        vectors.vector_topk(one, one, metric="dot")


def test_vectors_that_are_not_whole_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0]), (5, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    for metric in ("l2", "cosine"):
        found = vectors.vector_topk(frame, frame, k=5, metric=metric).collect()
        assert {r.query_id for r in found} == {r.doc_id for r in found} == {1, 4, 5}
        assert len(found) == 9


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("odd", [np.nan, np.inf, -np.inf])
def test_vectors_that_are_not_finite_take_no_part(spark, monkeypatch, metric, odd):
    monkeypatch.setattr(vectors, "PLACE_ROWS", 50)
    monkeypatch.setattr(vectors, "SHARED_BYTES", 0)
    rng = np.random.default_rng(6)
    corpus, queries = rng.normal(size=(300, 6)), rng.normal(size=(20, 6))
    bad = np.ones((1, 6))
    bad[0, 3] = odd
    found = vectors.vector_topk(
        vector_frame(spark, np.concatenate([corpus, bad])),
        vector_frame(spark, np.concatenate([queries, bad])),
        k=3,
        metric=metric,
    )
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == brute_force(corpus, queries, 3, metric)


def _answers(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.doc_id)
    return got


@pytest.fixture
def clustered(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(vectors, "PLACE_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    monkeypatch.setattr(vectors, "BUCKET_BYTES", 4096)
    rng = np.random.default_rng(3)
    centres = 100 * rng.normal(size=(8, 6))
    matrix = np.concatenate([c + rng.normal(size=(100, 6)) for c in centres])
    return matrix, str(tmp_path / "index")


def test_queries_are_dealt_to_places_in_reach_only(spark, clustered):
    matrix, path = clustered
    frame = vector_frame(spark, matrix)
    index = vectors.VectorIndex.build(frame, path)
    asked = frame.where("id < 100")
    places = spark.read.parquet(f"{path}/places")
    assert places.agg({"n": "sum"}).first()[0] == 800 and places.count() >= 16
    dealt = index.dealt(asked, 3).selectExpr("sum(size(ids))").first()[0]
    assert 100 <= dealt < 100 * places.count() / 4
    assert _answers(index.search(asked, 3)) == brute_force(matrix, matrix[:100], 3, "l2")


def test_a_search_leaves_the_stored_corpus_in_place(spark, clustered, monkeypatch):
    matrix, path = clustered
    frame = vector_frame(spark, matrix)
    built = vectors.VectorIndex.build(frame, path, "cosine")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for queries in (frame, frame.where("id % 9 = 0")):
            # Opened by its path, as another session would.
            index = vectors.VectorIndex.open(spark, path)
            found = index.search(queries, 3)
            plan = found._jdf.queryExecution().executedPlan().toString()
            right = plan[plan.index("SortMergeJoin") :].split("vector_blocks")[0]
            # One exchange of query rows to pack them, one of their blocks; none over the corpus.
            assert right.count("Exchange") == 2 and "Bucketed: true" in plan
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
            wanted = brute_force(matrix, matrix, 3, "cosine")
            ids = [r.id for r in queries.collect()]
            assert _answers(found) == {i: wanted[i] for i in ids}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert built.metric == index.metric == "cosine"
    with pytest.raises(ValueError, match="no vector"):
        vectors.VectorIndex.build(frame.limit(0), path + "2")


def test_vectors_are_added_to_a_stored_index(spark, clustered, monkeypatch):
    matrix, path = clustered
    frame = vector_frame(spark, matrix)
    index = vectors.VectorIndex.build(frame.where("id % 3 = 0"), path, buckets=5)
    index.add(frame.where("id % 3 = 1"))
    index.add(frame.limit(0))
    asked = frame.where("id % 7 = 0")

    def wanted(ids):
        # Far off, the vectors that are not stored yet are found by no query.
        known = np.where(np.isin(np.arange(len(matrix)), ids)[:, None], matrix, 1e6)
        answers = brute_force(known, matrix, 3, "l2")
        return {r.id: answers[r.id] for r in asked.collect()}

    two_thirds = [i for i in range(len(matrix)) if i % 3 < 2]
    assert _answers(index.search(asked, 3)) == wanted(two_thirds)
    # A writer that fails before its places are listed leaves nothing that is seen.
    with monkeypatch.context() as patch:
        patch.setattr(vectors.F, "max", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(frame.where("id % 3 = 2"))
    assert _answers(index.search(asked, 3)) == wanted(two_thirds)
    vectors.VectorIndex.open(spark, path).add(frame.where("id % 3 = 2"))
    assert _answers(index.search(asked, 3)) == wanted(range(len(matrix)))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("size", [1e-25, 1.0, 1e25])
def test_nearest_of_many_blocks(metric, size):
    rng = np.random.default_rng(4)
    corpus, queries = rng.normal(size=(5000, 12)), rng.normal(size=(300, 12))
    corpus[::7] = queries[3]
    corpus[5], queries[9] = 0.0, 0.0
    ids = rng.permutation(5000)
    nearest = vectors._Nearest(np.arange(300), queries * size, 4, metric)
    for begin in range(0, 5000, 1300):
        own = slice(begin, begin + 1300)
        nearest.meet(ids[own], corpus[own] * size)
    got = nearest.frame()
    # Only the k nearest of all blocks are left.
    assert len(got) == 1200
    for i in range(300):
        distances = vectors._exact(np.repeat(queries[i : i + 1] * size, 5000, axis=0), corpus * size, metric)
        wanted = ids[np.lexsort((ids, distances))[:4]]
        assert got.doc_id[got.query_id == i].tolist() == wanted.tolist()


def test_a_search_is_dealt_to_many_tasks(spark, clustered, monkeypatch):
    matrix, path = clustered
    frame = vector_frame(spark, matrix).coalesce(1)
    # More buckets than places of full size, though the corpus is small.
    assert vectors.VectorIndex.build(frame, path).buckets == 64
    monkeypatch.setattr(vectors, "TASK_PAIRS", 800 * 100)
    found = vectors.vector_topk(frame, frame, k=2)
    assert "RoundRobinPartitioning(8)" in found._jdf.queryExecution().executedPlan().toString()
    assert _answers(found) == brute_force(matrix, matrix, 2, "l2")


def test_context(spark):
    hits = spark.createDataFrame([(1, 2, 10), (1, 1, 11), (2, 1, 10)], "query_id long, rank int, doc_id long")
    docs = spark.createDataFrame([(10, "m10", "ten"), (11, "m11", "eleven")], "doc_id long, model_name string, text string")
    got = {r.query_id: r.context for r in vectors.context_assemble(hits, docs).collect()}
    assert got == {1: "Model: m11\neleven\n\nModel: m10\nten", 2: "Model: m10\nten"}
