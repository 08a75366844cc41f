"""Queries see whole texts."""

from __future__ import annotations

from plumbline.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_long_arrays_reach_the_flattening(spark):
    found = catalogue.QUERIES["flatten_media"](spark, FOLDER)
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    seen, want = set(), 0
    for i in sorted(texts):
        if texts[i]["lang"] in ("en", "de", "fr"):
            for w in texts[i]["text"].split(" "):
                url = f"http://y/{w}" if len(w) % 3 == 0 else f"http://x/{w}?v=1"
                want += (key := url.split("?")[0]) not in seen
                seen.add(key)
    assert found.count() == want and found.where("idx >= 6").count() > 0
