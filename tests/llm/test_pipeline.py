"""The corpus pipeline, stage by stage, and the queries of the subpackage that have SQL."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
from oracle import connect, rows
from test_near_dedup import sets

import corpus_pipeline
from plumbline.llm import mixing, quality, registry, secrets
from plumbline.staging import table

FOLDER = "/root/testdata/sf0.001"


def jaccard_components(texts: dict) -> dict:
    """Smallest id of each text's group by brute force over all pairs."""
    held, least = {i: sets(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in held.items():
        for j, b in held.items():
            if j < i and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                least[y] = x
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, name):
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), connect(FOLDER).sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = table(spark, FOLDER, "documents")
    columns, held = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], FOLDER).write.parquet(str(tmp_path / str(i)))
        held.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(h.columns == columns for h in held[1:-1])
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: r["text"] for r in held[1].collect()}
    rules = quality.train(docs, table(spark, FOLDER, "labels"))
    _, _, _, verdict = (x := quality.judged(docs, rules))
    assert kept == {r["doc_id"]: r["text"] for r in x[0].where(verdict).select("doc_id", "text").collect()} and len(kept) < len(before)
    groups = {}
    for doc, least in jaccard_components({r["doc_id"]: r["text"] for r in held[1].collect()}).items():
        groups.setdefault(least, set()).add(doc)
    alone = {r["doc_id"]: r["text"] for r in held[2].collect()}
    assert set(alone) == {min(g) for g in groups.values()} == set(groups)
    clean = {r["doc_id"]: r["text"] for r in held[3].collect()}
    assert set(clean) == set(alone) and all(len(clean[d]) == len(alone[d]) for d in clean)
    assert secrets.scan(held[3], secrets.Ledger(spark), secrets.BASE).count() == 0
    mixed = {}
    for r in held[4].collect():
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + 1
        assert r["text"] == clean[r["doc_id"]]
    assert mixed == {r["doc_id"]: r["copies"] for r in mixing.mix(held[3]).collect() if r["copies"]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = held[5].collect()
    assert sum(mixed.values()) == len(last)
    for r in last:
        ids = library.encode(clean[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in last)


