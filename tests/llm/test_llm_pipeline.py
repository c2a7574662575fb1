import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martwright.llm import common, decontaminate, langid, line_dedup, neardup, stages

from .test_llm_lines import key_of
from .test_llm_neardup import brute_force as components_of

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row int, kept int, "
    "_dropped string"
)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    english = "the cat and other thing went there over with that some house".split()
    german = "der hund und die katze gehen dorthin mit einem haus für alle".split()
    item = "whirling orbs narrate quiet lanterns beneath frozen harbours while amber kites drift."

    def text(words, n):
        return " ".join(rng.choice(words) + rng.choice(["", "s", "t", "en"]) for _ in range(n))

    rows = []
    for i in range(120):
        words, lang = (english, "en") if i % 2 else (german, "de")
        body = "\n".join(text(words, rng.randint(8, 30)) for _ in range(rng.randint(1, 4)))
        if i % 6 == 0:
            body += "\n All rights RESERVED."
        if i % 10 == 3:
            body += f" {item} " + text(words, 10)
        rows.append((i, body, lang, "s", len(body)))
    rows += [(200 + i, rows[i][1], rows[i][2], "c", 1) for i in range(10)]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "12 ## 34", "en", "s", 8)]
    rows += [(303, "all rights reserved.\nALL rights reserved.", "en", "s", 41)]
    rows += [(None, "the cat and other thing without an id", None, None, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    benchmark = spark.createDataFrame([(1, item), (2, "unrelated words here")], "item_id long, text string")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def by_id(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_each_stage_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    expected = by_id(docs)
    model = langid.train(docs)

    def known(rows):
        languages, scores = model.predict([r[1] for r in rows])
        return [r for r, x, p in zip(rows, languages, scores) if x != "und" and p >= 0.5]

    def without_lines(rows):
        docs_of = {}
        for doc, text in rows:
            for line in (text or "").split("\n"):
                docs_of.setdefault(key_of(line), set()).add(doc)
        bad = {k for k, v in docs_of.items() if k and len(v) >= 10}
        cut = [
            (d, t, "\n".join(x for x in (t or "").split("\n") if key_of(x) not in bad))
            for d, t in rows
        ]
        return [(d, k) for d, t, k in cut if k == (t or "") or k.strip(line_dedup.BLANKS)]

    def one_each(rows):
        kept = {r[0] for r in components_of(rows) if r[3]}
        return [r for r in rows if r[0] in kept]

    def clean(rows):
        items = spark.read.parquet(f"{corpus}/benchmark.parquet").collect()
        halves = [decontaminate.question_and_answer(r["text"]) for r in items]

        def leaks(text):
            found = [decontaminate.overlaps(decontaminate.words_of(text), *h) for h in halves]
            return any(w >= 0.8 or (q >= 0.8 and a >= 0.8) for w, q, a in found)

        return [r for r in rows if not leaks(r[1])]

    plain = [known, without_lines, one_each, clean]
    counts = [len(expected)]
    for (name, stage), reference in zip(corpus_pipeline.STAGES, plain):
        docs = corpus_pipeline.stored(stage(spark, docs, corpus), "test")
        expected = sorted(reference(expected), key=repr)
        assert docs.columns == columns, name
        assert by_id(docs) == expected, name
        counts.append(len(expected))
    assert all(a > b for a, b in zip(counts, counts[1:]) if (a, b) != (counts[1], counts[2]))
    packed = stages.pack(spark, docs, corpus).select("doc_id").distinct().count()
    assert packed == len({d for d, _ in expected})


def test_run_equals_its_stages(spark, corpus):
    ran = corpus_pipeline.run(spark, corpus)
    assert ran.columns[:2] == ["doc_id", "start"]
    assert ran.agg(F.sum("length")).first()[0] > 1000


def test_empty_documents(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, corpus), "test")
        assert docs.count() == 0, name


@pytest.fixture(scope="module")
def shared_ids(spark, corpus):
    """Rows that share ids, null ones included, and texts."""
    rng = random.Random(8)
    item = spark.read.parquet(f"{corpus}/benchmark.parquet").where("item_id = 1").first()["text"]

    def text():
        return " ".join(f"w{rng.randint(0, 9999)}" for _ in range(40))

    a, b, c, d, e, f, g = (text() for _ in range(7))
    leak = f"{text()} {item} {text()}"
    rows = [
        (1, a), (None, a), (None, b), (None, c), (None, c), (None, c.upper()),
        (2, d), (2, e), (3, d), (4, f), (4, f), (4, f), (5, g), (5, leak), (None, leak),
        (6, None), (6, None), (None, ""), (7, ""),
    ]
    docs = spark.createDataFrame([(*r, "en", "s", i, 1, 2, "x") for i, r in enumerate(rows)], SCHEMA)
    return docs.repartition(4), rows, leak


def test_one_row_of_every_component_stays(spark, corpus, shared_ids):
    docs, rows, leak = shared_ids
    kept = stages.keep_one_of_near_copies(spark, docs, corpus)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()]
    expected = {(1, rows[0][1]), (None, rows[2][1]), (None, rows[3][1]), (2, rows[6][1])}
    expected |= {(2, rows[7][1]), (4, rows[9][1]), (5, rows[12][1]), (5, leak)}
    blank = [(6, ""), (6, ""), (None, ""), (7, "")]
    assert sorted(got, key=repr) == sorted([*((d, t.lower()) for d, t in expected), *blank], key=repr)
    again = stages.keep_one_of_near_copies(spark, docs.repartition(7), corpus)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, kept.collect()))


def test_clean_rows_that_share_an_id_with_a_leak_stay(spark, corpus, shared_ids):
    docs, rows, leak = shared_ids
    kept = by_id(stages.drop_leaks(spark, docs, corpus))
    assert kept == sorted((r for r in rows if r[1] != leak), key=repr)


def unmarked_shuffles(df):
    """The shuffles in a plan that texts go into without a test of the bitmap."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in out.getvalue().splitlines()]
    found = []
    for i, (depth, line) in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            end = next((j for j in range(i + 1, len(lines)) if lines[j][0] <= depth), len(lines))
            below = [x for _, x in lines[i + 1 : end]]
            if any("FileScan" in x and "text#" in x for x in below) and "getbit" not in str(below):
                found.append(line)
    return found


def test_texts_that_cannot_match_are_not_shuffled(spark, corpus, monkeypatch):
    steps = []

    def stored(df, label):
        steps.append(df)
        return common.stored(df, label)

    monkeypatch.setattr(neardup, "stored", stored)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{corpus}/documents.parquet")
        steps.append(stages.keep_one_of_near_copies(spark, docs, corpus))
        steps.append(stages.drop_leaks(spark, docs, corpus))
        assert [x for df in steps for x in unmarked_shuffles(df)] == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [1 << 26, 1 << 10, 7])
def test_rows_with_a_match_are_marked(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    key = "IF(id % 500 = 0, NULL, id) AS id", "IF(id % 7 = 0, NULL, md5(string(id))) AS text"
    rows = spark.range(40_000).selectExpr("id AS n", *key)
    few = spark.range(0, 40_000, 20).selectExpr("id AS n", *key)
    columns = [F.col("id"), F.col("text")]
    marked = common.perhaps_in(rows, columns, few, columns)
    assert marked.columns == ["n", "id", "text", "_perhaps"] and marked.count() == 40_000
    assert marked.where("n % 20 = 0 AND NOT _perhaps").count() == 0
    # 2,000 keys in 32,000 bits; smaller bitmaps fill up.
    others = marked.where("n % 20 > 0 AND _perhaps").count()
    assert others < 0.1 * 38_000 if most > 1 << 20 else others > 0.5 * 38_000
    none = common.perhaps_in(rows, columns, few.where("id < 0"), columns)
    assert none.where("_perhaps").count() == 0
