import base64
import gzip
import hashlib
import os

import pytest

from martwright.llm import warc

SCHEMA = "page_id long, url string, html string, kind string, path string, payload string"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.fixture
def written(spark, tmp_path):
    def write(rows, **options):
        path = str(tmp_path / "archive")
        pages = spark.createDataFrame([(*r, "k", "p", "q") for r in rows], SCHEMA)
        warc.write_warc(pages, path, **options)
        return path

    return write


def test_round_trip(spark, written):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n"
    rows = [
        (3, "http://a/ b\r\nX: y", "same"), (1, None, "same"), (2, "http://c", None),
        (5, "http://d", ""), (4, "http://e", tricky + "é\n" * 3), (None, "http://f", "same"),
        (7, "http://g", "long " * 50_000), (8, "u", "rep"), (8, "u", "rep"),
    ]
    read = warc.read_warc(spark, written(rows)).collect()
    assert {r["kind"] for r in read} == {"record"}
    first = {"same": 1, "": 2, None: 2, "rep": 8}
    expected = []
    for page, _, html in rows:
        payload = (html or "").encode()
        response = first.get(html, page)
        expected.append(
            (
                page, len(payload), digest(payload),
                "response" if response == page else "revisit",
                None if response == page else response,
                payload if response == page else None,
            )
        )
    found = [
        (
            r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"],
            r["refers_to"], None if r["payload"] is None else bytes(r["payload"]),
        )
        for r in read
    ]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_small_payloads_are_all_responses(spark, written):
    read = warc.read_warc(spark, written([(1, "u", "ab"), (2, "u", "ab")], min_bytes=3))
    assert {r["record_type"] for r in read.collect()} == {"response"}


def test_empty_table(spark, written):
    assert warc.read_warc(spark, written([])).count() == 0


def archive(written, n=6):
    """The bytes of an archive whose records lie in the order of their ids."""
    path = written([(i, f"http://x/{i}", f"payload {i} " * (i + 1)) for i in range(n)])
    names = sorted(name for name in os.listdir(path) if name.startswith("part-"))
    parts = []
    for name in names:
        with open(f"{path}/{name}", "rb") as file:
            parts.append(file.read())
    return b"".join(parts)


@pytest.mark.parametrize(
    "damage",
    [
        lambda d, at: d[: at + 5] + b"#" + d[at + 6 :],  # version line
        lambda d, at: d.replace(b"payload 2 payload 2 ", b"payload 2 payload X ", 1),  # digest
        lambda d, at: d[: at + 20] + d[at + 90 :],  # bytes lost
        lambda d, at: d[:at] + os.urandom(500).replace(b"WARC/1.", b"") + d[at + 60 :],
    ],
)
def test_records_after_a_damage_are_recovered(written, damage):
    data = archive(written)
    at = data.index(b"WARC/1.1", data.index(b"<urn:page:2>") - 60)
    broken = damage(data, at)
    found = list(warc.salvage(broken))
    good = {r["page_id"] for r in found if r["kind"] == "record"}
    gaps = [r for r in found if r["kind"] == "gap"]
    assert good >= {0, 1, 3, 4, 5} and 2 not in good
    assert len(gaps) == 1 and gaps[0]["reason"]
    covered = sorted((r["start"], r["end"]) for r in found)
    assert covered[0][0] == 0 and covered[-1][1] == len(broken)
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_truncated_and_foreign_files(written):
    data = archive(written)
    found = list(warc.salvage(data[:-30]))
    assert [r["kind"] for r in found][-1] == "gap"
    assert [r["reason"] for r in warc.salvage(b"not an archive")] == ["no version line"]
    assert list(warc.salvage(b"")) == []


def test_gzip_members(written):
    data = archive(written)
    starts = [r["start"] for r in warc.salvage(data)] + [len(data)]
    members = [gzip.compress(data[a:b]) for a, b in zip(starts, starts[1:])]
    whole = list(warc.salvage(b"".join(members)))
    assert [r["page_id"] for r in whole] == [r["page_id"] for r in warc.salvage(data)]
    members[2] = members[2][:15] + b"\xff\xff" + members[2][17:]
    broken = list(warc.salvage(b"".join(members)))
    assert [r["kind"] for r in broken].count("gap") == 1
    assert [r["page_id"] for r in broken if r["kind"] == "record"] == [
        r["page_id"] for i, r in enumerate(whole) if i != 2
    ]


@pytest.mark.parametrize(
    "damage",
    [
        lambda m: [b"\0\0" + m[0][2:], *m[1:]],  # first bytes
        lambda m: [m[0][:30], *m[1:]],  # bytes lost
        lambda m: [m[0][4:], *m[1:]],
        lambda m: [b"junk" * 100, *m],
        lambda m: [b"WARC/1.1 junk", *m],
    ],
)
def test_gzip_members_after_a_damaged_beginning(written, damage):
    data = archive(written)
    starts = [r["start"] for r in warc.salvage(data)] + [len(data)]
    members = [gzip.compress(data[a:b]) for a, b in zip(starts, starts[1:])]
    broken = damage(members)
    found = list(warc.salvage(b"".join(broken)))
    assert [r["kind"] for r in found] == ["gap"] + ["record"] * (len(found) - 1)
    whole = [r["page_id"] for r in warc.salvage(data)]
    assert [r["page_id"] for r in found[1:]] == (whole if len(broken) > len(members) else whole[1:])
    assert found[0]["start"] == 0 and found[-1]["end"] == len(b"".join(broken))
    assert all(a["end"] == b["start"] for a, b in zip(found, found[1:]))


def test_gzip_members_after_plain_records_and_gzip_payloads(written):
    data = archive(written)
    starts = [r["start"] for r in warc.salvage(data)] + [len(data)]
    parts = [data[a:b] for a, b in zip(starts, starts[1:])]
    mixed = [parts[0], parts[1][:-9], gzip.compress(b"a page"), gzip.compress(parts[2]), *parts[3:]]
    found = list(warc.salvage(b"".join(mixed)))
    whole = [r["page_id"] for r in warc.salvage(data)]
    kinds = [r["kind"] for r in found]
    assert kinds == ["record", "gap"] + ["record"] * 4
    assert [r["page_id"] for r in found if r["kind"] == "record"] == whole[:1] + whole[2:]
