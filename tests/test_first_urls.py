"""First-seen images of ads: places compared once, whatever the numbers of the ads."""

from __future__ import annotations

import random

import pytest

from plumbline.operators import ingest

IMAGE = "struct<originalImageUrl: string, resizedImageUrl: string>"
SCHEMA = f"pageName string, adArchiveId string, startDate bigint, isActive boolean, ad_pos bigint, snapshot struct<displayFormat: string, images: array<{IMAGE}>, cards: array<{IMAGE}>>"


def ads(spark, numbers, seed=1):
    rng = random.Random(seed)
    image = lambda: rng.choice([None, (None, None), ("", f"u{rng.randrange(30)}"), (f"u{rng.randrange(30)}?{rng.randrange(3)}", "")])
    rows = [("P", str(k), k, k % 2 == 0, n, ("x", rng.choice([None, [], [image(), image()]]), [image() for _ in range(rng.randrange(9))])) for k, n in enumerate(numbers)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def expected(rows):
    """Places and URLs by the first URL of each key, null numbers first."""
    seen = {}
    for _, ad_id, _, _, n, (_, images, cards) in sorted(rows, key=lambda r: -(2**64) if r[4] is None else r[4]):
        urls = [u for i in [*(images or []), *cards] if i and (u := i[0] or i[1])]
        for idx, u in enumerate(urls):
            seen.setdefault(u.split("?")[0], (ad_id, n, idx, u))
    return sorted(seen.values(), key=str)


@pytest.mark.parametrize("numbers", [range(40), [None, *range(-5, 30)], [2**63 - 1, -(2**63), *range(20)], [None, -(2**63), 3]])
def test_first_urls_of_ads(spark, numbers):
    rows, frame = ads(spark, numbers)
    got = ingest.ad_images(frame, {"P": "b"}, ("adArchiveId",)).collect()
    assert sorted(((r["ad_id"], r["ad_pos"], r["idx"], r["url"]) for r in got), key=str) == expected(rows)


def test_ads_of_one_number_keep_one_row_a_key(spark):
    rows, frame = ads(spark, [7, 7, 3, 3, 3, None, None, 9])
    got = ingest.ad_images(frame, {"P": "b"}, ("adArchiveId",)).collect()
    assert sorted(r["url"].split("?")[0] for r in got) == sorted(u[3].split("?")[0] for u in expected(rows))
    for r in got:  # a row is of an ad that holds its URL
        _, images, cards = rows[int(r["ad_id"])][5]
        assert [u for i in [*(images or []), *cards] if i and (u := i[0] or i[1])][r["idx"]] == r["url"]


def test_arrays_are_worked_out_once(spark, capsys):
    """Places go into a hash table by URL; before, all rows were sorted by key, and flattened twice."""
    _, frame = ads(spark, range(5))
    ingest.ad_images(frame, {"P": "b"}, ("adArchiveId",)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Generate ") == 1 and "HashAggregate(keys=[url" in plan
