"""Source divergence audit: how far the sources of a language lie apart, by cells of a cube.

The cube's axes are sources, sources again, and terms.

1. Terms are counted in tasks by (language, source), then added up.  A language keeps
   the terms that ``LEAST`` of its documents hold.  A source gives each kept term the
   whole-number weight ``1 + floor(UNIT * (count + 1) / (total + kept))``.
2. The sources of a language are dealt to blocks of about ``GROUPS``, its terms to
   blocks of about ``TERMS``.  A slice holds the weights that one block of sources gives one
   block of terms.  It is copied to each cell that pairs its block with another, so a row
   is copied as often as there are blocks of sources in its language.
3. A task owns cells (block, block, terms) and adds up the divergence of each pair of
   sources over the cell's terms, in both directions.  Terms that neither block counts
   have the same weight everywhere in a source and are not in the cell: it says how many
   terms it held.
4. Sums are reduced along the term axis, and the terms that no cell held are added.

Cells are bounded by ``GROUPS`` and ``TERMS``, whatever the input; a hot language has more of
them, and a hot source is one row a term after the counts were added up.  ``audit``'s ``pair`` part
names each pair of sources of a language, so its size is the square of their number.

All arithmetic is in whole numbers and exact: products that may pass 64 bits are decimals, and
squares of weights, which lie below ``UNIT + 2``, and their sums fit.

Defined results: null texts, languages and sources are empty strings.  Each row is a
document of its own, repeated or not.  A source without kept terms counts zero of each; a
language without kept terms has pairs of value 0.  Ties go to the smaller item in UTF-8.  An empty table
gives an empty result.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.simhash import bytes_of
from plumbline.staging import staged, table

#: Letters are those of ASCII and all code points beyond it.
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST = 3
UNIT = 1_000_000_000
RANKS = 200
#: Sources and terms of a block, about.
GROUPS = 8
TERMS = 1024
#: Different terms that a task holds before it hands them on, and bytes of a text that are looked at at once.
HELD = 1 << 20
LONG = 1 << 22
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _counted(held: int):
    terms = re.compile(TERM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, docs) in found.items():
                names = [None, *counts]  # the null term stands for the source itself
                for i in range(0, len(names), 1 << 16):
                    part = names[i : i + (1 << 16)]
                    n = [counts.get(t, 0) for t in part], [docs.get(t, 0) for t in part]
                    columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                counts, docs = found.setdefault(group, (Counter(), Counter()))
                low = data[offsets[i] : offsets[i + 1]].tobytes().translate(_LOWER)
                before = len(counts)
                if len(low) < LONG:
                    words = terms.findall(low)
                    counts.update(words)
                    docs.update(set(words))
                else:
                    own = Counter(m.group() for m in terms.finditer(low))
                    counts.update(own)
                    docs.update(own.keys())
                size += len(counts) - before
                if size > held:
                    yield from rows()
                    found, size = {}, 0
        yield from rows()

    return run


def counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """``docs(lang, source, text)`` -> ``(lang, source, term, n, docs)``; a null term for each source that occurs."""
    clean = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = clean.mapInArrow(_counted(held), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def weight(count: str, total: str, kept: str) -> Column:
    """The whole-number weight of a term."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10, 0)) * cast({count} + 1 as decimal(19, 0))) div cast(greatest({total} + {kept}, 1) as decimal(19, 0))")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_CELL = "lang string, source string, item string, value long, held long, rest long, kept long"


def _cell(rows: pa.Table) -> pa.Table:
    """All pairs of sources of one cell, over the terms that it holds."""
    heads = rows.filter(pc.is_null(rows["term"]))
    names, block, base = heads["source"].to_pylist(), heads["block"].to_numpy(), heads["p"].to_numpy()
    terms = rows.filter(pc.is_valid(rows["term"]))
    coded = terms["term"].combine_chunks().dictionary_encode()
    at = {s: i for i, s in enumerate(names)}
    weights = np.repeat(base[:, None], len(coded.dictionary), axis=1)
    weights[[at[s] for s in terms["source"].to_pylist()], coded.indices.to_numpy()] = terms["p"].to_numpy()
    low, high = rows["lo"][0].as_py(), rows["hi"][0].as_py()
    found: list[tuple] = []
    for i, source in enumerate(names):
        others = np.nonzero(block == (high if block[i] == low else low))[0]
        others = others[others != i]
        value = _apart(weights[i], weights[others]).sum(1)
        rest = _apart(base[i], base[others])
        found += [(source, names[j], v, r) for j, v, r in zip(others.tolist(), value.tolist(), rest.tolist(), strict=True)]
    n = len(found)
    columns = [
        pa.array([rows["lang"][0].as_py()] * n, pa.string()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()),
        pa.array([x[2] for x in found], pa.int64()), pa.array([len(coded.dictionary)] * n, pa.int64()), pa.array([x[3] for x in found], pa.int64()), pa.array([heads["kept"][0].as_py()] * n, pa.int64()),
    ]
    return pa.table(columns, names=[x.split()[0] for x in _CELL.split(", ")])


def pairs(heads: DataFrame, held: DataFrame, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """``(lang, source, item, value)`` of all pairs of sources of a language.

    ``heads(lang, source, total, kept, sources)`` has the sources, with a language's numbers of kept terms and of
    sources; ``held(lang, source, term, p)`` has the weights of the terms that a source counts.
    """
    blocks, cuts = F.ceil(F.col("sources") / groups), F.greatest(F.ceil(F.col("kept") / terms), F.lit(1))
    heads = heads.select("lang", "source", "kept", weight("0", "total", "kept").alias("base"), blocks.alias("blocks"), cuts.alias("cuts"))
    heads = heads.withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    own = held.join(heads, ["lang", "source"]).withColumn("cut", F.pmod(F.xxhash64("term"), "cuts"))
    every = heads.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    fields = ["lang", "source", "block", "blocks", "cut", "kept"]
    slices = own.select(*fields, "term", "p").unionByName(every.select(*fields, F.lit(None).cast("string").alias("term"), F.col("base").alias("p")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    copies = slices.select("*", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    partial = copies.select("lang", "lo", "hi", "cut", "source", "block", "kept", "term", "p").groupBy("lang", "lo", "hi", "cut").applyInArrow(_cell, _CELL)
    sums = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("held").alias("held"), F.max("rest").alias("rest"), F.max("kept").alias("kept"))
    value = F.when(F.col("kept") > 0, F.col("value") + (F.col("kept") - F.col("held")) * F.col("rest")).otherwise(F.lit(0))
    return sums.select("lang", "source", "item", value.cast("long").alias("value"))


def audit(docs: DataFrame, ranks: int = RANKS, least: int = LEAST, groups: int = GROUPS, terms: int = TERMS, held: int = HELD) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs(lang, source, text)``.

    Part ``pair`` ranks the other sources of the language by their divergence from the source, part ``term`` the
    terms that the source uses more than its language does, up to ``ranks``.
    """
    found = staged(counts(docs, held), "term-counts")
    some = found.where("term is not null")
    kept = some.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
    own = staged(some.select("lang", "source", "term", "n").join(kept.select("lang", "term", "lang_n"), ["lang", "term"]), "kept-counts")
    once = own.select("lang", "term", "lang_n").distinct()
    langs = once.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sources = found.where("term is null").select("lang", "source")
    wide = sources.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("kept", "lang_total", "total")}
    heads = staged(sources.join(totals, ["lang", "source"], "left").join(wide, "lang").withColumns(numbers), "sources")
    weighed = own.join(heads, ["lang", "source"]).withColumn("p", weight("n", "total", "kept"))
    pair = pairs(heads.select("lang", "source", "total", "kept", "sources"), weighed.select("lang", "source", "term", "p"), groups, terms)
    more = weighed.withColumn("q", weight("lang_n", "lang_total", "kept")).where("p > q")
    more = more.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    first = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    second = more.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= ranks)
    return first.unionByName(second)


def op11_cube_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang) LEFT JOIN (SELECT lang, source, n FROM c) USING (lang, source) GROUP BY 1, 2),
w AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + g.v)::hugeint AS p, 1 + (1000000000::hugeint * (k.n + 1)) // (l.total + l.v)::hugeint AS q
  FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM w a JOIN w b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::bigint AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
rows AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint FROM w WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::int AS rank FROM rows) WHERE part = 'pair' OR rank <= 200
"""
