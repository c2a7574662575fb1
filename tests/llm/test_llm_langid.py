import zlib

import numpy as np
from pyspark.sql import functions as F

from martwright.llm import langid

EN, DE = "the cat and the other thing went there", "der hund und die katze gehen dorthin"
SCHEMA = "doc_id long, text string, lang string, row int, score string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 0, "s") for r in rows], SCHEMA)


def grams(text):
    """Reference: distinct buckets with counts, one n-gram at a time."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    words = " " + " ".join(letters.split()) + " "
    if not words.strip():
        return np.zeros(langid.BUCKETS)
    counts = np.zeros(langid.BUCKETS)
    for n in (2, 3):
        for i in range(len(words) - n + 1):
            piece = np.array([ord(c) for c in words[i : i + n]], dtype=np.uint32)
            found = langid.buckets(piece)
            counts[found[n - 2][0]] += 1
    return counts


def test_buckets_equal_the_slow_way(monkeypatch):
    texts = ["Ab, c!! dé  ÇA 123 zz\nß", None, "", "x", "12 %", "aa aa aa", "İ i"]
    expected = np.array([grams(text or "") for text in texts])
    for block in (2, 3, 5, 13, 1 << 19):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = np.zeros_like(expected)
        for counts in langid.gram_counts(texts):
            np.add.at(got, (counts.row, counts.bucket), counts.n)
        assert (got == expected).all()


def test_query_equals_brute_force(spark):
    from martwright.llm.queries import op7_langid

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r for r in docs.select("doc_id", "text", "lang").collect()}
    learned = {}
    for doc_id, row in texts.items():
        if zlib.crc32(str(doc_id).encode()) % 4 != 2 and None not in (row["text"], row["lang"]):
            learned[row["lang"]] = learned.get(row["lang"], 0) + grams(row["text"]) + 0.0
    names = sorted(learned)
    log = np.log([(learned[x] + 0.5) / (learned[x].sum() + 0.5 * langid.BUCKETS) for x in names])
    judged = op7_langid(spark, "/root/testdata/sf0.001").collect()
    assert len(judged) == docs.count()
    for row in judged:
        text = texts[row["doc_id"]]["text"] or ""
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        total = log @ grams(text)
        assert row["lang_pred"] == names[int(total.argmax())]
        assert np.isclose(row["score"], 1 / np.exp((total - total.max()) / 2).sum())


def test_learns_and_predicts(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 %% ..", "de"), (103, EN * 9000, None)]
    docs = documents(spark, rows + odd + [(None, DE, None), rows[0]])
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    judged = langid.predict(docs, model).select("row.doc_id", "row.row", "lang_pred", "score")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in judged.collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(40))
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "en" and got[None][0] == "de"
    assert all(0 <= score <= 1 for _, score in got.values())
    assert judged.count() == 46


def test_training_leaves_out_what_is_not_allowed(spark):
    rows = [(i, EN, "en") for i in range(5)] + [(i, DE, "de") for i in range(5, 9)]
    model = langid.train(documents(spark, rows), allowed=F.col("doc_id") < 5)
    assert model.languages == ["en"]


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, EN, None)])
    judged = langid.predict(docs, langid.train(docs)).first()
    assert (judged["lang_pred"], judged["score"]) == ("und", 0.0)
    empty = documents(spark, [])
    assert langid.predict(empty, langid.train(empty)).count() == 0


def test_sample_is_bounded_by_language(spark):
    rows = [(i, EN, "en") for i in range(300)] + [(i, DE, "de") for i in range(300, 310)]
    docs = documents(spark, rows).withColumn("text", F.concat_ws(" ", "text", "doc_id"))
    few = langid.train(docs, per_language=20)
    assert few.languages == ["de", "en"]
    assert langid.train(docs, most_languages=1).languages == ["en"]


def test_held_out_accuracy(spark):
    from martwright.llm.queries import op7_langid

    folder = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = op7_langid(spark, folder).where("held_out").join(lang, "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
