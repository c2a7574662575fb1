"""Secret scan: candidate strings, and a random forest that removes false positives.

Candidates are long runs of key characters. Their features are length, character transitions,
share of digits, distinct characters, coverage by the corpus dictionary (words of the candidate
that are frequent in all documents), the path they lie in and the neighbouring words. The forest
is grown from labelled findings by DataFrame aggregations: for all trees at once, one grouped count
over (tree, node, feature, bin) a level; the splits follow from these counts, at most a few
thousand rows. A fitted forest is a column expression. No Python runs on the executors.

Labelled findings are a parameter. ``provider_labels`` labels those whose form decides: issued key
formats and keys assigned next to a credential word are secrets, strings of letters only are not;
all others stay unlabelled and are judged by the forest.

Defined results: a null or empty text has no findings; a document with several findings has a row
for each, repeated rows repeat theirs; without labelled findings of both kinds nothing is removed
(score 1). Ties between splits go to the first feature and bin. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import smallest, stored

CANDIDATE = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}"
RUN = r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"
PART = "[a-z]{4,}"
REACH = 80  # characters on either side in which neighbouring words are looked for
NEIGHBOURS = 5  # candidates, of 16 characters or more, that can lie in them
WORD_COUNT = 20  # occurrences that make a word of the dictionary
# Words that announce a credential, paths of test data, issued key formats.
CREDENTIAL = r"(?i)(password|passwd|pwd|secret|token|api.?key|access.?key|auth|credential|bearer)"
TEST_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"
ISSUED = (
    r"^(A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
)
RANDOM_FORM = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}$"

FEATURES = [
    "length", "transitions", "digits", "distinct", "covered", "slashes", "test_path",
    "credential_before", "assigned", "upper",
]
LABELLED_ROWS = 4000
TREES, DEPTH, BINS, FEATURES_A_SPLIT = 12, 4, 16, 4
KEEP_SCORE = 0.5


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None):
    """``doc_id``, ``path``, ``start`` and ``end`` (code points), ``value``, words around it."""
    where = F.lit("") if path is None else F.coalesce(F.col(path).cast("string"), F.lit(""))
    rows = docs.where(F.col(text).rlike(CANDIDATE)).select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(doc_id).alias("doc_id"),
        where.alias("path"),
        F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)).alias("_values"),
        F.split(F.col(text), CANDIDATE, -1).alias("_between"),
    )
    # Only the text next to a value is carried on, with the length of what was between; words are
    # looked for within REACH characters, as a pattern that ends a long text takes quadratic time.
    reach = F.lit(REACH)
    between = F.transform(
        "_between",
        lambda piece: F.struct(
            F.length(piece).alias("size"),
            F.right(piece, reach).alias("tail"),
            F.left(piece, reach).alias("head"),
        ),
    )
    n = F.size("_values")
    listed = F.arrays_zip(
        F.col("_values").alias("value"),
        F.slice("_pieces", 1, n).alias("gap"),
        F.slice("_pieces", 2, n).alias("next"),
    )
    each = rows.withColumn("_pieces", between).select(
        "_row", "doc_id", "path", F.posexplode(listed).alias("number", "x")
    )
    ordered = Window.partitionBy("_row", "doc_id").orderBy("number")
    end = F.sum(F.col("x.gap.size") + F.length("x.value")).over(ordered)
    # What surrounds a value includes its neighbours: no more than NEIGHBOURS lie within REACH.
    earlier = F.collect_list(F.concat("x.gap.tail", F.right("x.value", reach)))
    later = F.collect_list(F.concat(F.left("x.value", reach), "x.next.head"))
    left = F.array_join(earlier.over(ordered.rowsBetween(-NEIGHBOURS, -1)), "")
    right = F.array_join(later.over(ordered.rowsBetween(1, NEIGHBOURS)), "")
    left = F.right(F.concat(left, "x.gap.tail"), reach)
    right = F.left(F.concat("x.next.head", right), reach)
    return each.select(
        "doc_id",
        "path",
        (end - F.length("x.value")).cast("long").alias("start"),
        end.cast("long").alias("end"),
        F.col("x.value").alias("value"),
        F.regexp_extract(left, r"(\S*\s?\S*\s?\S*)$", 1).alias("before"),
        F.regexp_extract(right, r"^(\S*\s?\S*)", 1).alias("after"),
    )


def covered_letters(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``value`` and ``_covered``: letters of it that are words frequent in all documents."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("word"))
    frequent = (
        words.where(F.length("word") >= 4)
        .groupBy("word")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= WORD_COUNT)
        .select("word")
    )
    parts = found.select("value").distinct().select(
        "value",
        F.explode(F.regexp_extract_all(F.lower("value"), F.lit(PART), F.lit(0))).alias("word"),
    )
    return (
        parts.join(frequent, "word")
        .groupBy("value")
        .agg(F.sum(F.length("word")).alias("_covered"))
    )


def _share_without(value: str, characters: str) -> Column:
    """Share of the characters that are in ``characters``."""
    return 1 - F.length(F.translate(value, characters, "")) / F.length(value)


def with_features(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    covered = covered_letters(found, docs, text).withColumnRenamed("value", "_value")
    n = F.length("value")
    return (
        found.join(covered, F.col("value") == F.col("_value"), "left")
        .withColumns(
            {
                "length": F.least(n, F.lit(200)).cast("double"),
                "transitions": (F.size(F.regexp_extract_all("value", F.lit(RUN), F.lit(0))) - 1) / n,
                "digits": _share_without("value", "0123456789"),
                "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
                "covered": F.coalesce("_covered", F.lit(0)) / n,
                "slashes": (n - F.length(F.translate("value", "/", ""))).cast("double"),
                "test_path": F.col("path").rlike(TEST_PATH).cast("double"),
                "credential_before": F.col("before").rlike(CREDENTIAL).cast("double"),
                "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
                "upper": _share_without("value", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            }
        )
        .drop("_value", "_covered")
    )


def provider_labels() -> Column:
    """True, false, or null for a finding, where its form alone decides."""
    keyed = F.col("before").rlike(CREDENTIAL) & F.col("before").rlike(r"[=:]\s*[\"']?$")
    secret = F.col("value").rlike(ISSUED) | (keyed & F.col("value").rlike(RANDOM_FORM))
    plain = F.col("value").rlike("^([a-z]+|[A-Z]?[a-z]+|[a-z]+(-[a-z]+)+)$")
    return F.when(secret, True).when(plain, False)


@dataclass
class Node:
    """A split (feature, limit: values up to it go left) or a leaf's share of secrets."""

    share: float
    feature: str | None = None
    limit: float = 0.0
    children: list[Node] = field(default_factory=list)

    def number(self) -> Column:
        """Column expression of the share in the leaf that a row falls into."""
        if self.feature is None:
            return F.lit(self.share)
        left, right = self.children
        return F.when(F.col(self.feature) <= self.limit, left.number()).otherwise(right.number())


def _leaf_numbers(node: Node, leaves: list[Node]) -> Column:
    """Column expression of the place in ``leaves`` of a row's leaf; fills ``leaves``."""
    if node.feature is None:
        leaves.append(node)
        return F.lit(len(leaves) - 1)
    left, right = (_leaf_numbers(child, leaves) for child in node.children)
    return F.when(F.col(node.feature) <= node.limit, left).otherwise(right)


def _impurity(secrets: float, total: float) -> float:
    p = secrets / total if total else 0.0
    return 2 * p * (1 - p) * total


def _drawn(tree: int, leaf: int, level: int, features: Sequence[str]) -> list[str]:
    """The features a node may split on, drawn by a fixed rule."""
    key = {f: math.sin((i + 1) * 12.9898 + tree * 78.233 + leaf * 37.719 + level * 4.581) * 43758.5453
           for i, f in enumerate(features)}
    return sorted(features, key=lambda f: key[f] % 1)[:FEATURES_A_SPLIT]


def _copies(tree: int) -> Column:
    """How often a row is drawn for a tree: Poisson with mean 1, from a hash."""
    u = F.pmod(F.xxhash64("_key", F.lit(tree)), F.lit(10_000))
    return (
        F.when(u < 3679, 0).when(u < 7358, 1).when(u < 9197, 2).when(u < 9810, 3).otherwise(4)
    )


def grow(labelled: DataFrame, features: Sequence[str] = FEATURES) -> list[Node] | None:
    """A forest from rows with the features and a boolean ``is_secret``, at most LABELLED_ROWS.

    The rows with the smallest hashes are used.
    """
    key = F.xxhash64("value", "before", *features)
    # Equal findings count once: a frequent one would fill the sample.
    known = (
        labelled.where(F.col("is_secret").isNotNull())
        .select(key.alias("_key"), F.col("is_secret").cast("int").alias("_y"), *features)
        .distinct()
    )
    sample = stored(smallest(known, "_key", LABELLED_ROWS, "_y"), "secrets-labelled")
    if sample.select("_y").distinct().count() < 2:
        return None
    shares = [i / BINS for i in range(1, BINS)]
    cuts = sample.agg(
        *[F.percentile_approx(f, shares, 10_000).alias(f) for f in features]
    ).first()
    limits = {f: sorted(set(cuts[f])) for f in features}
    trees = [Node(0.0) for _ in range(TREES)]
    bins = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                sum((F.col(f) > limit).cast("int") for limit in limits[f]).alias("bin"),
            )
            for f in features
        ]
    )
    for level in range(DEPTH + 1):
        leaves: list[list[Node]] = [[] for _ in trees]
        places = F.array(
            *[
                F.struct(
                    F.lit(t).alias("tree"),
                    _leaf_numbers(tree, leaves[t]).alias("leaf"),
                    _copies(t).alias("copies"),
                )
                for t, tree in enumerate(trees)
            ]
        )
        counted = (
            sample.select("_y", bins.alias("_bins"), F.explode(places).alias("p"))
            .where(F.col("p.copies") > 0)
            .select("_y", "p.*", F.explode("_bins").alias("b"))
            .groupBy("tree", "leaf", "b.feature", "b.bin")
            .agg(
                F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("_y")).alias("secrets")
            )
            .collect()  # trees x leaves x features x bins at most
        )
        counts: dict[tuple, dict[int, tuple[int, int]]] = {}
        for tree, leaf, feature, number, n, secrets in counted:
            counts.setdefault((tree, leaf, feature), {})[number] = (n, secrets)
        for t in range(TREES):
            for number, node in enumerate(leaves[t]):
                _split(node, t, number, level, counts, limits, features)
    return trees


def _split(node, tree, leaf, level, counts, limits, features) -> None:
    """Set a leaf's share, and split it if that makes its parts purer."""
    whole = counts.get((tree, leaf, features[0]))
    if not whole:
        return
    total, secrets = (sum(x) for x in zip(*whole.values()))
    node.share = secrets / total
    best = (_impurity(secrets, total) - 1e-9, None, 0.0)
    for feature in _drawn(tree, leaf, level, features) if level < DEPTH else []:
        binned, n, y = counts[tree, leaf, feature], 0, 0
        for i, limit in enumerate(limits[feature]):
            more, positive = binned.get(i, (0, 0))
            n, y = n + more, y + positive
            if 0 < n < total:
                left = _impurity(y, n) + _impurity(secrets - y, total - n)
                best = min(best, (left, feature, limit), key=lambda x: x[0])
    if best[1] is not None:
        node.feature, node.limit = best[1], best[2]
        node.children = [Node(node.share), Node(node.share)]


def score(forest: list[Node] | None) -> Column:
    if not forest:
        return F.lit(1.0)
    return sum((tree.number() for tree in forest), F.lit(0.0)) / len(forest)


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = None,
    labels: Column | None = None,
) -> DataFrame:
    """All findings with ``score`` and ``is_secret``; ``labels`` labels findings for training."""
    # Stored first, as two features read the findings once more.
    found = stored(findings(docs, doc_id, text, path), "secrets-candidates")
    found = stored(with_features(found, docs, text), "secrets-found")
    labels = provider_labels() if labels is None else labels
    forest = grow(found.withColumn("is_secret", labels))
    return found.withColumn("score", score(forest)).withColumn(
        "is_secret", F.col("score") >= KEEP_SCORE
    )
