import itertools
import random
import re

import numpy as np
import pytest

from martwright.llm import pii
from martwright.llm.tagger import Tagger, _lattice

SCHEMA = "doc_id long, text string, row int, base string, spans string"

PATTERNS = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    """The patterns as stated, one after the other."""
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                0: True,
                1: kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                2: 14 <= len(digits) <= 19 and plain_luhn(digits),
                3: 10 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), m.end(), kind))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


CARDS = ["4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795"]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    signs = "0123456789" * 3 + "@@..++-- ()aZ_%é\n"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    texts += [f"x {c} y" for c in CARDS] + ["a@b@c.d.e@f.g", "1.2.3.4.5.6.7.8.9", "001.2.3.0255"]
    texts += ["+1 (988) 555-2485.", "+12345", "é@b.c ä.b@c.de", "1.2.3.256 1.2.3.4"]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_a_domain_without_local_part_is_left_to_the_next_address():
    texts = ["@a.b@c.d", "@a.b_x@c.de", "@jane.doe@example.com", " @a.b@c.d @e.f@g.h@i.j", "x@@a.b@c.d"]
    rng = random.Random(12)
    texts += ["".join(rng.choices("@@a.b_ ", k=rng.randint(0, 24))) for _ in range(6000)]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans(texts[2]) == [(1, 21, 0)]
    pii.base_spans("@a.b" * 100_000)


def test_long_runs_take_linear_time():
    for sign in "0a.+-@(":
        pii.base_spans(sign * 300_000)
    pii.base_spans("1." * 200_000)
    pii.base_spans("0 " * 200_000)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    tagger = Tagger.new(6, 4, size=3, hidden=4, seed=1)
    tagger.parameters["move"] += rng.normal(0, 0.3, (4, 4))
    ids, tags = rng.integers(0, 6, (3, 7)), rng.integers(0, 4, (3, 7))
    _, found = tagger.gradients(ids, tags)
    for name, values in tagger.parameters.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in values.shape)
            kept, step = values[at], 1e-5
            values[at] = kept + step
            up = tagger.gradients(ids, tags)[0]
            values[at] = kept - step
            down = tagger.gradients(ids, tags)[0]
            values[at] = kept
            assert abs((up - down) / (2 * step) - found[name][at]) < 1e-5, name


def test_decoding_equals_enumeration():
    rng = np.random.default_rng(5)
    tagger = Tagger.new(5, 3, size=3, hidden=3, seed=2)
    tagger.parameters["move"] += rng.normal(0, 1, (3, 3))
    ids = rng.integers(0, 5, (2, 5))
    paths, sure = tagger.decode(ids)
    emissions, _ = tagger._emissions(ids)
    p = tagger.parameters
    for b in range(2):
        scores = {}
        for path in itertools.product(range(3), repeat=5):
            s = p["start"][path[0]] + sum(emissions[t, b, x] for t, x in enumerate(path))
            scores[path] = s + sum(p["move"][x, y] for x, y in zip(path, path[1:]))
        best = max(scores, key=scores.get)
        assert tuple(paths[b]) == best
        weight = {k: np.exp(v) for k, v in scores.items()}
        total = sum(weight.values())
        for t in range(5):
            share = sum(w for k, w in weight.items() if k[t] == best[t]) / total
            assert abs(share - sure[b, t]) < 1e-9
        assert abs(_lattice(emissions, p)[2][b] - np.log(total)) < 1e-9


def test_reconciliation_equals_enumeration():
    rng = random.Random(4)
    for _ in range(300):
        spans = []
        for _ in range(rng.randint(0, 7)):
            start = rng.randint(0, 20)
            spans.append((start, start + rng.randint(1, 8), rng.randint(0, 3), rng.random()))
        base = sorted({(s, s + 2, 0) for s in rng.sample(range(25), 2)})
        got = pii.reconcile(spans, base)
        best = {}
        for s, e, k, w in spans:
            best[s, e, k] = max(w, best.get((s, e, k), 0))
        usable = [x for x in best if all(x[1] <= b[0] or b[1] <= x[0] for b in base)]
        top = 0.0
        for n in range(len(usable) + 1):
            for some in itertools.combinations(usable, n):
                ordered = sorted(some)
                if all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:])):
                    top = max(top, sum(best[x] * (x[1] - x[0]) for x in some))
        assert abs(sum(best[x] * (x[1] - x[0]) for x in got) - top) < 1e-9
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


FILLER = "in the thing that went over and there it was of them "


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(7)
    rows = []
    for i in range(160):
        datum = rng.choice(
            [
                f"bo{i}.x@mail{i % 9}.example.com", f"{rng.randint(1, 255)}.7.{i}.9",
                CARDS[0], f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
            ]
        )
        lead = FILLER[rng.randint(0, 20) :] * rng.randint(0, 3)
        rows.append((i, f"{lead}{datum} {FILLER}{rng.choice(['', '42 '])}"))
    rows += [(500, None), (501, ""), (502, FILLER * 5000 + CARDS[1]), (None, "x@y.zz"), rows[0]]
    return spark.createDataFrame([(*r, 1, "b", "s") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def tagger(documents):
    return pii.train(documents)


def test_rare_data_are_in_the_sample(spark):
    """Twelve documents with an email among 8,000 with a digit are all learned from."""
    rows = [(i, f"{FILLER}{i} {FILLER * (1 + i % 4)}") for i in range(8000)]
    rows += [(9000 + i, f"{FILLER}ann{i}@mail.example.com {FILLER}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sample = pii.sampled_windows(docs, "doc_id", "text", pii.TRAINING_WINDOWS)
    groups = [row["group"] for row in sample]
    assert groups.count(0) == 12 and set(groups) == {0, len(pii.KINDS), len(pii.KINDS) + 1}
    assert 12 < len(sample) <= pii.TRAINING_WINDOWS
    assert max(map(groups.count, groups)) == pii.TRAINING_WINDOWS // pii.GROUPS


def test_query_columns(documents, tagger):
    found = pii.digest_columns(pii.find(documents, tagger))
    for row in found.collect():
        text = row["row"]["text"] or ""
        base = plain_spans(text)
        assert row["base_sha256"] == pii.sha256_of(base)
        for kind, name in enumerate(pii.KINDS):
            assert row[f"n_{name}"] == sum(s[2] == kind for s in base)
        listed = row["spans"].split(",") if row["spans"] else []
        assert set(pii.written(base).split(",")) - {""} <= set(listed)
        assert len(listed) == len(base) + row["n_added"]
        starts = [int(x.split(":")[1]) for x in listed]
        assert starts == sorted(starts)


def test_the_tagger_adds_rewritten_data_only(tagger):
    rng, found, wanted = random.Random(11), 0, 0
    for i in range(60):
        kind = i % 4
        value = (f"ann{i}.b@mail7.example.com", f"9.{i}.77.8", CARDS[0], "+1 (912) 555-2485")[kind]
        hidden = pii._rewritten(value, kind, rng.randrange(4))
        lead = FILLER * 3
        text = f"{lead}{hidden} {FILLER}"
        base = pii.base_spans(text)
        (spans,) = pii.added_spans([text], [base], tagger)
        if not any(k == kind for _, _, k in base):
            wanted += 1
            found += any(k == kind and abs(s - len(lead)) <= 2 for s, _, k in spans)
    assert wanted >= 30 and found >= 0.6 * wanted
    clean = [FILLER * 40, "In 1999 there were 42 of 1000 and 3.5 or 12,50 (see 7) @ home", "1 2 3 4"]
    assert pii.added_spans(clean, [[]] * len(clean), tagger) == [[], [], []]


def test_windows_without_trigger_change_nothing(tagger):
    text = FILLER * 4 + CARDS[0].replace("4974", ".4974.") + " " + FILLER * 6
    (some,) = pii.added_spans([text], [[]], tagger)
    pattern, pii.TRIGGER = pii.TRIGGER, ""
    try:
        (every,) = pii.added_spans([text], [[]], tagger)
    finally:
        pii.TRIGGER = pattern
    assert some == [s for s in every if re.search(pattern, text[s[0] : s[1]])]


NAMES = ["jane", "bo", "carol", "mina", "paul", "rita", "sven", "tom"]
SPELLED = [pii._rewritten(f"{name}@mail.org", 0, i % 3) for i, name in enumerate(NAMES)]


@pytest.fixture(scope="module")
def letters_tagger(spark):
    """Trained on emails without a digit."""
    rng, rows = random.Random(9), []
    for i in range(300):
        name, host = rng.choice(NAMES), rng.choice(["mail", "example", "post"])
        rows.append((i, f"{FILLER[rng.randint(0, 20) :]}{name}@{host}.org {FILLER * 3}"))
    return pii.train(spark.createDataFrame(rows, "doc_id long, text string"))


def test_spelled_out_emails_are_found_as_by_full_decoding(letters_tagger, monkeypatch):
    """Every window is decoded for comparison, and nothing is left out of what that finds."""
    texts = [f"{FILLER}{lead}{value} {FILLER * 3}" for value in SPELLED for lead in ("", "or 7 ")]
    texts += [FILLER * 2 + "she sat at home. that cat dots " + FILLER, "at.", "dot at", "that dot"]
    bases = [pii.base_spans(t) for t in texts]
    some = pii.added_spans(texts, bases, letters_tagger)
    assert sum(any(k == 0 for _, _, k in spans) for spans in some) >= 8
    monkeypatch.setattr(pii, "may_hold", lambda window: True)
    assert some == pii.added_spans(texts, bases, letters_tagger)


def test_windows_left_out_hold_nothing_plausible():
    rng = random.Random(8)
    parts = ["at", "dot", ".", " ", "t", "(", "a", "é", "@", "7", "_", "do"]
    held = 0
    for _ in range(4000):
        whole = "".join(rng.choices(parts, weights=[4, 4, 2, 6, 2, 2, 2, 1, 0.1, 0.1, 1, 1], k=12))
        a, b = sorted((rng.randint(0, len(whole)), rng.randint(0, len(whole))))
        for start in range(a, b):
            for end in range(start + 1, b + 1):
                if any(pii._plausible(whole, start, end, kind) for kind in range(4)):
                    held += 1
                    assert pii.may_hold(whole[a:b]), (whole[a:b], whole[start:end])
    assert held > 1000


def test_texts_with_spelled_out_emails_only_are_searched(spark, letters_tagger):
    rows = [(i, f"{FILLER}{value} {FILLER}") for i, value in enumerate(SPELLED)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.digest_columns(pii.find(docs, letters_tagger)).select("row.doc_id", "n_added").collect()
    direct = pii.added_spans([t for _, t in rows], [[]] * len(rows), letters_tagger)
    assert dict(map(tuple, found)) == {i: len(spans) for i, spans in enumerate(direct)}
    assert sum(n for _, n in found) >= 4


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    assert pii.train(none) is None
    assert pii.find(none, None).count() == 0
    plain = spark.createDataFrame([(1, "no data 12")], "doc_id long, text string")
    row = pii.digest_columns(pii.find(plain, pii.train(plain))).first()
    assert row["spans"] == "" and row["n_card"] == 0


class RunTagger:
    """Tags every run of ``=`` and ``@`` as an email, wherever a window begins."""

    def decode(self, ids):
        wanted = [int(pii.encoded("=")[0]), int(pii.encoded("@")[0])]
        inside = np.isin(ids, wanted)
        first = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
        return np.where(first, 1, np.where(inside, 2, 0)), np.ones(ids.shape)


@pytest.mark.parametrize("length", [1, 10, 47, 48, 49, 84, 96, 97, 150, 400])
@pytest.mark.parametrize("sign", [0, 0.5, 1])
def test_spans_of_any_length_are_found_at_every_offset(monkeypatch, length, sign):
    """Also those longer than the overlap or a window, and where only one window has a sign."""
    monkeypatch.setattr(pii, "may_hold", lambda window: "@" in window)
    monkeypatch.setattr(pii, "_plausible", lambda *_: True)
    at = int(sign * (length - 1))
    span = "=" * at + "@" + "=" * (length - 1 - at)
    for offset in range(0, 2 * pii.WIDTH):
        text = "x" * offset + span + "y" * 130 + "@"
        found = pii.added_spans([text, ""], [[], []], RunTagger())
        assert found == [[(offset, offset + length, 0), (len(text) - 1, len(text), 0)], []]


def test_signs_in_any_case():
    for window in ("JOHN AT EXAMPLE DOT COM", "john At example.com", "a Dot b at c"):
        assert pii.may_hold(window)
        start, end = 0, len(window)
        assert pii._plausible(window, start, end, 0)
    assert not pii.may_hold("what dots")


def test_every_span_of_a_text_can_be_a_training_window():
    text = " ".join(f"mail{i}@host{i}.org and some words" for i in range(40))
    made = pii.labelled_windows(text, 5)
    assert sum(bool(spans) for _, spans in made) > 30
    for window, spans in made:
        assert len(window) <= pii.WIDTH and all(0 <= s < e <= pii.WIDTH for s, e, _ in spans)
