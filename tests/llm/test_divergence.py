"""The divergence audit against dictionaries and whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows: list, ranks: int, least: int) -> list:
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, terms in (d for d in docs if d[0] == lang):
            counts[source].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        weigh = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        apart = lambda p, q: (p - q) * (p - q) // q
        for s in counts:
            pair = [(-sum(apart(weigh(counts[s], t), weigh(counts[o], t)) for t in kept), o.encode()) for o in counts if o != s]
            term = [(-apart(p, q), t.encode()) for t in kept if counts[s][t] and (p := weigh(counts[s], t)) > (q := weigh(whole, t))]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("ranks, least, groups, terms, held", [(200, 3, 8, 1024, 1 << 20), (3, 2, 2, 4, 5), (200, 1, 1, 1, 1 << 20)])
def test_against_dictionaries(spark, ranks, least, groups, terms, held):
    rnd = random.Random(11)
    words = ["ab", "Ab", "AB", "é", "É", "漢字", "x1y", "naïve", "don't", "zz", "Q"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9))), rnd.choice(["en", "de"]), rnd.choice(["s1", "s2", "S1", "é", "\U0001f600", "￿"])) for i in range(80)]
    rows += [(100, None, "en", None), (101, "ab ab", None, "s1"), (102, "only once", "zz", "a"), (103, "", "zz", "b"), (None, "ab", "en", "s1"), rows[0], rows[0], (104, "1 2 3", "en", "empty")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(f"clash {c}") for c in ("term", "block", "p", "kept")})
    found = divergence.audit(docs, ranks, least, groups, terms, held)
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows, ranks, least)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_long_texts_and_large_counts(spark):
    """A text beyond the length that is looked at at once, and weights whose products pass 64 bits."""
    n = divergence.LONG // 3 + 10
    rows = [(1, "ab " * n, "en", "a"), (2, "ab cd " * 5, "en", "b"), (3, "cd ab", "en", "b")]
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA), least=2)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 200, 2)
    big = spark.sql("select 9000000000000000000L as n, 9000000000000000001L as total, 5L as kept").select(divergence.weight("n", "total", "kept").alias("p"))
    assert big.first()["p"] == 1 + 10**9 * 9000000000000000001 // 9000000000000000006
