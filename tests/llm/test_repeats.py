"""Suffix-array dedup against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import repeats

SMALL = {"length": 8, "grams": (4, 6, 8), "block": 2, "step": 16, "most": 64}


def brute(rows: list, length: int, keep_first: bool) -> list:
    """``(doc_id, n_bytes, n_removed, n_spans, sha256)`` of each row, from a dictionary of all windows."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    starts = defaultdict(list)
    for n, (i, raw) in enumerate(raws):
        for p in range(len(raw) - length + 1):
            starts[raw[p : p + length]].append((i is None, i or 0, raw, p) if keep_first else (n, p))
    out = []
    for n, (i, raw) in enumerate(raws):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            held = starts[raw[p : p + length]]
            here = (i is None, i or 0)
            if len(held) > 1 if not keep_first else any(x[:2] < here or (x[:2] == here and x[2] == raw and x[3] < p) for x in held):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not before for g, before in zip(gone, b"\0" + bytes(gone), strict=False))
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(rnd: random.Random, n: int) -> list:
    passages = ["".join(rnd.choice("abcdé漢") for _ in range(rnd.randrange(6, 30))) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [rnd.choice([rnd.choice(passages), "".join(rnd.choice("abcdefgh \n") for _ in range(rnd.randrange(0, 12)))]) for _ in range(rnd.randrange(0, 5))]
        texts.append("".join(parts))
    texts += [None, "", "a" * 40, "ab" * 30, "a" * 7, texts[0], texts[1], "x" + passages[0], passages[0] + "x"]
    rows = list(enumerate(texts))
    return rows + [rows[2], (None, texts[3]), (None, "z" + texts[4] + "z")]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("keep_first", [False, True])
def test_against_all_windows(spark, seed, keep_first):
    rows = made(random.Random(seed), 60)
    if keep_first:  # the order of texts without an id is that of their digests, which brute force lacks
        rows = rows[:-1]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit(f"clash {c}") for c in ("d", "rank", "place", "h", "spans")})
    found = repeats.removed(docs, keep_first=keep_first, **SMALL).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found), key=str) == brute(rows, 8, keep_first)
    texts = dict(rows)
    for r in found:
        raw, at, kept = (texts[r["doc_id"]] or "").encode(), 0, b""
        if r["doc_id"] is None:
            continue
        for s in r["spans"]:
            assert s["begin"] >= at and s["end"] - s["begin"] >= 8
            kept, at = kept + raw[at : s["begin"]], s["end"]
        assert kept + raw[at:] == r["kept"]
    assert repeats.removed(docs.limit(0)).count() == 0


def test_a_crowded_anchor_over_parts(spark):
    """One passage among other words in every text, and nothing else in common: its anchors are cut to the last level."""
    rnd = random.Random(3)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(14))
    rows = [(i, "".join(rnd.choice("ijklmnop") for _ in range(12)) + passage + "".join(rnd.choice("qrstuvwx") for _ in range(12))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep_first in (False, True):
        found = {r["doc_id"]: [(s["begin"], s["end"]) for s in r["spans"]] for r in repeats.removed(docs, keep_first=keep_first, **SMALL | {"block": 1}).collect()}
        assert all(any(a <= 12 and b >= 26 for a, b in x) for i, x in found.items() if i or not keep_first)
    want = brute(rows, 8, True)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.removed(docs, keep_first=True, **SMALL | {"block": 1}).collect()), key=str) == want


def test_factors_by_definition():
    """Longest previous factors of a text, each window cut at its end, against all pairs."""
    rnd = random.Random(5)
    for alphabet in (b"ab", b"abcd"):
        raw = bytes(rnd.choice(alphabet) for _ in range(90))
        length, n = 12, 90 - 12 + 1
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length)
        order, agree = repeats.suffix_order(windows, np.zeros(n, np.int64))
        assert [bytes(windows[i]) for i in order] == sorted(bytes(w) for w in windows)
        found = np.empty(n, np.int64)
        found[order] = repeats.longest_previous_factors(order, agree)
        common = lambda i, j: next((k for k in range(length) if raw[i + k] != raw[j + k]), length)
        assert found.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(n)]
        found[order] = repeats.longest_previous_factors(-order, agree)
        assert found.tolist() == [max((common(i, j) for j in range(i + 1, n)), default=0) for i in range(n)]


def test_contexts_hold_every_window_once():
    """Windows are named by anchors wherever the text is cut, and equal windows by equal anchors."""
    rnd = random.Random(6)
    raw = bytes(rnd.choice(b"ab") for _ in range(400))
    data = np.frombuffer(raw, np.uint8)
    ends = np.array([0, 100, 100, 107, 250, 400])
    first, size, h, _ = repeats.contexts(data, ends, 8, 4)
    covered = sorted(p for a, n in zip(first.tolist(), size.tolist(), strict=True) for p in range(a, a + n))
    assert covered == [p for b, e in zip([0, *ends[:-1]], ends, strict=True) for p in range(b, e - 7)]
    named = {}
    for a, n, x in zip(first.tolist(), size.tolist(), h.tolist(), strict=True):
        for p in range(a, a + n):
            assert named.setdefault(raw[p : p + 8], x) == x


def test_a_text_longer_than_a_step(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(400)]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    passage = long[200_000:200_700]
    rows = [(1, long), (2, "start#" + passage + "#end"), (3, " " * 500_000), (4, passage[50:249])]
    found = {r["doc_id"]: r for r in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string"), step=1 << 16).collect()}
    assert [(s["begin"], s["end"]) for s in found[1]["spans"]] == [(200_000, 200_700)] and found[2]["kept"] == b"start##end"
    assert found[3]["n_removed"] == 500_000 and found[4]["n_removed"] == 0


def test_the_query_on_the_given_documents(spark):
    """The whole query, windows of 200 bytes, against a dictionary of all of them."""
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = repeats.op13_longest_previous_factors(spark, folder)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == brute(rows, repeats.LENGTH, False) and sum(r[2] for r in got) > 0
