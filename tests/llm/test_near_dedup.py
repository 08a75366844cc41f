"""The pipeline's near-dedup stage against brute-force Jaccard, with planted near copies."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest
from plumbline.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def sets(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted():
    rnd = random.Random(21)
    prose = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    license_ = " ".join(prose(60))
    made = [None, "", " \n", "one", "One", "two words", "two  WORDS", "a b c d e", "a b c d f"]
    for _ in range(40):
        base = prose(rnd.randrange(20, 300))
        made.append(" ".join(base))
        for changes in (1, 2, 3, 5, 8):
            near = list(base)
            for at in rnd.sample(range(len(near)), changes):
                near[at] = "changed"
            made.append(" ".join(near))
        made += [" ".join(base).upper(), " ".join(base[: len(base) * 9 // 10])]
    made += [license_ + " " + " ".join(prose(n)) for n in (5, 8, 12, 15, 20, 40) for _ in range(4)]
    # the limit itself: 40 of 50 shingles
    line = [f"x{i}" for i in range(54)]
    return [*made, " ".join(line), " ".join(line[:44]), " ".join(line[:43])]


def test_stage_finds_what_brute_force_finds(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(planted())]
    random.Random(3).shuffle(rows)
    rows += [rows[0], (None, rows[1][1], "en", "s", 0)]
    held = {r[0]: sets(r[1]) for r in rows if r[0] is not None}
    parent = {i: i for i in held}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in held:
        for j in held:
            a, b = held[i], held[j]
            if j < i and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.where("doc_id is not null").collect()} == {find(i) for i in held}
    assert kept.where("doc_id is null").count() == 1
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("common", [1, 3])
def test_common_shingles_lose_nothing(spark, monkeypatch, common):
    """The order of shingles, sampled or not, decides cost only."""
    monkeypatch.setattr(near_copies, "SAMPLE", common)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(planted())], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(docs).collect()}
    monkeypatch.setattr(near_copies, "COMMON", 0)
    assert found == {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(docs).collect()}
