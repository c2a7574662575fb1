import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from martwright.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, dropped string, row int, _doc int, n_lines string"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute_force(rows, min_docs=10):
    docs_of = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key_of(line):
                docs_of[key_of(line)].add(doc)
    result = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(docs_of.get(key_of(x), ())) < min_docs]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        result.append((doc, len(lines), len(lines) - len(kept), digest))
    return sorted(result, key=repr)


def applied(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)
    found = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))


def test_equals_brute_force(spark, rows):
    rng = random.Random(1)
    lines = ["All rights reserved.", " all RIGHTS reserved.\t", "É", "é", "", "  ", "x", "\r"]
    lines += [f"line {i}" for i in range(30)]
    texts = [
        (i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(120)
    ]
    texts += [(200, None), (201, ""), (202, "\n"), (None, "x\nx"), (None, "line 3"), texts[0]]
    texts += [(3, "another text under a used id\nx")]
    texts += [(300, "\n".join(["x", "own"] * 20_000))]
    assert rows(applied(spark, texts)) == brute_force(texts)


def test_a_line_of_all_documents(spark, rows):
    texts = [(i, f"shared\nown {i}\nshared") for i in range(400)]
    assert rows(applied(spark, texts)) == brute_force(texts)


def test_a_line_over_many_slices(spark, rows):
    texts = [(i % 390, f"shared\nown {i % 70}\nshared") for i in range(400)]
    texts += [(1000, "\n".join(["shared", "rare"] * 5000)), (1001, "rare"), (None, "shared")]
    option = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(option)
    spark.conf.set(option, "false")
    try:
        assert rows(applied(spark, texts)) == brute_force(texts)
    finally:
        spark.conf.set(option, before)


def test_empty_table_and_nothing_repeated(spark, rows):
    assert rows(applied(spark, [])) == []
    assert rows(applied(spark, [(1, "a\nb")])) == brute_force([(1, "a\nb")])


def test_bitmaps(spark):
    lines = [f"own {i}" for i in range(300)]
    for i in (3, 64, 127, 200):
        lines[i] = "shared"
    rows = [(i, "\n".join(lines) if i == 0 else "shared") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["_doc"]: r for r in line_dedup.keep_bitmaps(docs).collect()}
    keep = [w & (2**64 - 1) for w in found[0]["keep"]]
    lost = [i for i in range(64 * len(keep)) if not keep[i // 64] >> (i % 64) & 1]
    assert lost == [3, 64, 127, 200] and len(keep) == 4 and found[0]["n_dropped"] == 4


def test_no_python_in_the_plan(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "stored", lambda df, _: df)
    found = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "rangepartitioning(_hash" in plan
    # The sorted runs are read as they lie.
    assert not re.search(r"hashpartitioning\(_hash#\d+, _doc", plan)


def test_keys_lower_a_to_z_only(spark):
    points = [(chr(i),) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF and i != 10]
    line = F.concat(F.lit("x aZ"), "c", F.lit("Bc x"))
    plain = F.translate(line, line_dedup.UPPER, line_dedup.LOWER)
    rows = spark.createDataFrame(points, "c string").select(
        line_dedup.line_key(line).alias("key"), plain.alias("plain")
    )
    assert rows.where("key != plain").count() == 0
