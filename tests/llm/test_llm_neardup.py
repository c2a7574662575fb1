import random
import re

import numpy as np
import pytest

from martwright.llm import neardup
from martwright.llm.common import stored
from martwright.llm.components import components

SCHEMA = "doc_id long, text string, id int, node string, class int, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return set()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_force(rows, percent=85):
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = least.get(root(i))
        least[root(i)] = doc if known is None else known if doc is None else min(known, doc)
    return sorted(
        ((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)),
        key=repr,
    )


def linked(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "n", 2, 3) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in neardup.link(docs).collect()), key=repr)


def varied(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at] = rng.choice(vocabulary)
    return " ".join(words)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(5, 200))
        for _ in range(rng.randint(1, 9)):
            rows.append((doc, varied(rng, base, rng.randint(0, 5), vocabulary)))
            doc += 1
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One  TWO\n")]
    rows += [(905, "one two three"), (None, rows[0][1]), (None, "a null id alone here now")]
    rows += [rows[1], (906, "É é x y z q"), (907, "é é x y z q"), (908, "w " * 30_000)]
    rows += [(rows[2][0], "another text under a used id, long enough to have shingles")]
    assert linked(spark, rows) == brute_force(rows)


def test_a_family_whose_members_are_not_all_linked(spark):
    """Copies of one text with few edits each: many pairs of copies fall below the threshold."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = rng.choices(vocabulary, k=150)
    rows = [(i, varied(rng, base, rng.choice([2, 3, 3, 4, 6]), vocabulary)) for i in range(220)]
    rows += [(300 + i, rows[7][1]) for i in range(100)]
    assert linked(spark, rows) == brute_force(rows)


def test_a_chain_is_one_component(spark):
    words = [f"v{i}" for i in range(300)]
    rows = [(50 - i, " ".join(words[2 * i : 2 * i + 60])) for i in range(50)]
    expected = brute_force(rows)
    assert len({r[2] for r in expected}) == 1
    assert linked(spark, rows) == expected


def test_empty_table(spark):
    assert linked(spark, []) == []
    assert linked(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    masks = neardup.masked_chunks()
    assert len(masks) == neardup.LANES and len({tuple(m) for m in masks}) == len(masks)
    for _ in range(2000):
        n = int(rng.integers(0, neardup.MAX_DIFFERENT + 1))
        different = set(rng.choice(neardup.LANES, n, replace=False).tolist())
        assert any(not different & set(mask) for mask in masks)


def test_signature_threshold_covers_the_link_threshold():
    from math import comb

    n, p = neardup.LANES, 0.15
    missed = sum(
        comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(neardup.MAX_DIFFERENT + 1, n + 1)
    )
    assert missed < 2e-5


def test_lane_differences(spark):
    rng = np.random.default_rng(2)
    lanes = rng.integers(0, 1 << 16, (2, neardup.LANES), dtype=np.uint16)
    lanes[1, :30] = lanes[0, :30]
    lanes[1, 30:] = lanes[0, 30:] ^ np.uint16(3)
    planes = neardup.bit_planes(lanes).view(np.int64).tolist()
    row = spark.createDataFrame([(planes[0], planes[1])], "a array<long>, b array<long>")
    assert row.select(neardup.different_lanes("a", "b")).first()[0] == neardup.LANES - 30


def plan_after(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_not_broadcast_however_small_spark_takes_them(spark):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")[:-1]) > 0
    texts = [" ".join(f"w{i}x{j % (40 + i % 2)}" for j in range(42)) for i in range(30)]
    docs = spark.createDataFrame(
        [(100 * k + i, t + " end" * k) for i, t in enumerate(texts) for k in range(3)], "doc_id long, text string"
    )
    sketch = stored(neardup.sketched(docs, "doc_id", "text"), "test-sketches")
    nodes = stored(sketch.where("node is not null").withColumnRenamed("id", "source"), "test-nodes")
    members = neardup._shared_keys(nodes)
    assert members.count() > 0 and "Broadcast" not in plan_after(members)
    few = nodes.withColumnRenamed("n_shingles", "size")
    pairs = nodes.select(nodes.node.alias("a"), nodes.node.alias("b"))
    assert "Broadcast" not in plan_after(neardup._close(pairs, few))


def test_pairs_of_blocks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 2)
    members = spark.range(40).selectExpr("id % 2 as key", "id as node", "id as component", "3 as size")
    dealt = neardup._block_rows(members)
    plan = plan_after(dealt)
    # Ten blocks a key: a member meets those of all ten.
    assert dealt.count() == 40 * 10
    assert re.search(r"\w+Join", plan).group() == "SortMergeJoin", plan


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(55)]
    edges += [(100 + i, 101 + i) for i in range(30)]
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    own = {x for a, b in edges if a != b for x in (a, b)}
    assert sorted(map(tuple, found)) == sorted((k, v) for k, v in least.items() if k in own)
