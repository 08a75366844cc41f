"""Damage of every kind against a comparison record by record, and WARC files with broken middles."""

from __future__ import annotations

import gzip
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import fixity


def rec(uri: str, body: bytes) -> bytes:
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("segment", [1024, 16])
def test_what_became_of_each_record(spark, monkeypatch, segment):
    monkeypatch.setattr(fixity, "SEGMENT", segment)
    one = [(i, f"r{i}") for i in range(100)] + [(7, "again"), (None, "x"), (None, "y")] + [(9, "many")] * 40
    two = [(i, f"r{i}") for i in range(100) if i != 50] + [(7, "other"), (None, "x"), (None, "z"), (20, "new")] + [(9, "many")] * 41 + [(30, "r30")]
    frames = [spark.createDataFrame(x, "page_id long, record string").repartition(3) for x in (one, two)]
    cut = fixity.layout(*frames)
    found = fixity.compare(*(fixity.leaves(f, cut) for f in frames)).collect()
    digest = {r: F.sha2(F.lit(r), 256) for _, r in one + two}
    names = {v: k for k, v in spark.range(1).select(*(c.alias(r) for r, c in digest.items())).first().asDict().items()}
    a, b = Counter(one), Counter(two)
    got = {(r["page_id"], names[r["digest"]]): r for r in found}
    assert got.keys() == a.keys() | b.keys() and len(found) == len(got)
    for key, r in got.items():
        assert (r["copies_a"] or 0, r["copies_b"] or 0) == (a[key], b[key])
        sides = {k[1] for k in a.keys() - b.keys() if k[0] == key[0]}, {k[1] for k in b.keys() - a.keys() if k[0] == key[0]}
        if a[key] and b[key]:
            want = "copies" if a[key] != b[key] else "moved" if r["offset_a"] != r["offset_b"] else "same"
        elif all(sides) and key[0] is not None:
            want = "changed"
        else:
            want = "missing" if a[key] else "added"
        assert r["status"] == want, (key, r)
    assert {r["status"] for r in found} == {"same", "moved", "copies", "changed", "missing", "added"}
    assert (got[None, "y"]["status"], got[None, "z"]["status"], got[50, "r50"]["status"]) == ("missing", "added", "missing")
    none = fixity.leaves(frames[0].limit(0))
    assert fixity.compare(none, none).count() == 0
    assert {r["status"] for r in fixity.compare(none, fixity.leaves(frames[0])).collect()} == {"added"}


def test_broken_members_and_records(spark, tmp_path):
    records = [rec(f"http://h/{i}", f"body {i} ".encode() * 50) for i in range(4)]
    whole = [gzip.compress(r) for r in records]
    hurt = bytearray(whole[1])
    hurt[len(hurt) // 2] ^= 0xFF
    wrong = whole[1][:-8] + bytes([whole[1][-8] ^ 1]) + whole[1][-7:]
    files = {
        "damaged": whole[0] + bytes(hurt) + whole[2] + whole[3], "checksum": whole[0] + wrong + whole[2] + whole[3], "foreign": whole[0] + b"foreign \x1f\x8b\x08 bytes" + whole[2] + whole[3],
        "first": bytes(hurt) + whole[2], "last": whole[0] + bytes(hurt), "cut": whole[0] + whole[1][:30] + whole[2],
    }
    for name, content in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(content)
    plain = records[0] + b"WARC/1.0\r\nContent-Length: none\r\n\r\nnoise\r\n\r\n" + records[2] + records[3].replace(b"Content-Length: 350", b"Content-Length: 9999") + records[1]
    (tmp_path / "plain.warc").write_bytes(plain)
    found: dict = {}
    for r in fixity.read_warc(spark, str(tmp_path)).collect():
        found.setdefault(r["file"].rsplit("/", 1)[1].split(".")[0], []).append((r["offset"], r["uri"], bytes(r["payload"]), r["error"]))
    good = {i: (f"http://h/{i}", f"body {i} ".encode() * 50, None) for i in range(4)}
    for name in ("damaged", "checksum", "foreign", "cut"):
        rows = found[name]
        assert [x[1:] for x in rows if x[3] is None] == [good[i] for i in ((0, 2) if name == "cut" else (0, 2, 3))], name
        assert [x[3] for x in rows if x[3]] == ["damaged gzip member"] and next(x for x in rows if x[3])[2] in files[name]
        assert rows[2][0] == len(records[0])  # a lost member takes no room
    assert [x[1:] for x in found["first"] if x[3] is None] == [good[2]] and [x[1:] for x in found["last"] if x[3] is None] == [good[0]]
    assert found["first"][0][3] == "damaged gzip member" and found["last"][1][3]
    assert [x[1:] for x in found["plain"] if x[3] is None] == [good[0], good[2], good[1]]
    assert [x[3] for x in found["plain"] if x[3]] == ["no record header", "truncated: 354 of 9999 bytes"]
