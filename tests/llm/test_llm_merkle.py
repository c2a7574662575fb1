"""Merkle manifests against a tree built node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from martwright.llm import merkle

SCHEMA = "id long, source string, body string, root string, path int, subroot string, _pos int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The last node, and of each first node the (left, right) siblings upwards."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, place):
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            path.append((run[: at % 16], run[at % 16 + 1 :]))
        place = [p // 16 for p in place]
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(*row[:3]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    each = {}
    for name in names:
        groups[name].sort(key=lambda e: e[:3])
        each[name] = tree([e[2] for e in groups[name]])
    root, above = tree([each[n][0] for n in names])
    out = []
    for name, top in zip(names, above):
        subroot, paths = each[name]
        for (_, _, own, row), path in zip(groups[name], paths):
            steps = path + top
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = row[2]
                lowered = None if text is None else "".join(
                    c.lower() if "A" <= c <= "Z" else c for c in text
                )
                node = leaf(row[0], row[1], lowered)
            for left, right in steps:
                node = H(*left, node, *right)
            proof = H(*["".join(left + right) for left, right in steps])
            out.append((row[0], own, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def found(spark, data):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 5) for r in data], SCHEMA)
    tampered = F.crc32(F.col("id").cast("string")) % 5 == 0

    def own(text):
        return merkle.leaf_hash(F.col("id"), F.col("source"), text)

    rows = docs.withColumns(
        {
            "leaf": own(F.col("body")),
            "changed": F.when(tampered, own(merkle.lower_ascii(F.col("body")))),
        }
    )
    proven = merkle.manifest(rows, "source", "id")
    folded = merkle.fold(F.coalesce("row.changed", "row.leaf"))
    return proven.select(
        "row.id", "row.leaf", "subroot", "root", merkle.proof_digest().alias("p"), folded.alias("f")
    ).withColumn("ok", F.col("f") == F.col("root"))


@pytest.mark.parametrize("sizes", [[1], [257, 33, 17, 16, 2, 1], [1] * 40])
def test_tree_sizes(spark, rows, sizes):
    data, n = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            data.append((n * 7 % 10_007, f"s{s}", f"Text {n}"))
            n += 1
    assert rows(found(spark, data)) == expected(data)


def test_odd_rows(spark, rows):
    data = [
        (None, None, None),
        (None, None, None),
        (1, None, ""),
        (1, "", "É Ü ÀB🙂C"),
        (4, "", "ABC"),
        (4, "", "ABC"),
        (4, "Z", "lower only"),
        (-5, "a", "X:Y"),
        (9, "\U0001f642", "Q"),
        (9, "￿", "Q"),
    ] + [(i, "hot", None if i % 7 == 0 else "AbC") for i in range(60)]
    assert rows(found(spark, data)) == expected(data)


def test_very_long_text(spark, rows):
    data = [(1, "a", "Ab Ü" * 700_000), (8, "a", "b")]
    assert rows(found(spark, data)) == expected(data)


def test_empty_table(spark):
    result = found(spark, [])
    assert result.collect() == [] and result.columns == "id leaf subroot root p f ok".split()


def test_tampering_is_noticed(spark):
    data = [(i, "s", f"Text {i}") for i in range(40)]
    verified = {r["id"]: r["ok"] for r in found(spark, data).collect()}
    for i, ok in verified.items():
        assert ok == (zlib.crc32(str(i).encode()) % 5 != 0)
