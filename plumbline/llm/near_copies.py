"""SimHash near-dedup of texts whose 5-word shingles are similar: wide fingerprints in the Gray index, then an exact check.

Texts whose sets of shingles have a Jaccard similarity of ``SIMILARITY`` or more
are linked, and links are closed transitively.

1. Equal sets collapse before anything is compared, so exact copies of any
   number cost one aggregation.
2. Each set gets a SimHash of ``64 * WORDS`` bits.  Sets at the limit differ in
   about 15 % of them; ``RADIUS`` lies six standard deviations beyond.
3. Two sets that similar share a shingle among the first
   ``n - ceil(SIMILARITY * n) + 1`` of each, in any order that is the same for
   all texts.  So a fingerprint is filed in the Gray index (``simhash.index_links``)
   under these shingles instead of its own bit fields, and no pair is missed by
   the filing.  The order puts shingles that a sample finds in many texts last; the
   sample decides what is cheap, never what is found.  Shingles that one set alone
   holds file nothing.
4. The index, pruned by accumulated differences, joins fingerprints into groups
   that hold every similar pair.  Clean texts are in none, and move no further.
5. The sets of each group go through the index once more, under their group,
   with their shingles: pairs within ``RADIUS`` are checked exactly, nearest first,
   and pairs that links before them connect already need no check.

Defined results: words are runs of anything but ASCII white space, ASCII letters
in lower case; a text of fewer words than a shingle is one shingle, and a null
or wordless text has none (all such texts are copies of each other).  Shingles
and sets are told apart by 64-bit hashes.  Repeated rows and ties collapse to
the smallest doc_id; rows without a doc_id stay and link nothing.  An empty
table gives an empty result.  Other columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.simhash import bytes_of, gray_rank, index_links, shingle_hashes
from plumbline.llm.text import append_columns
from plumbline.operators.components import connected_components
from plumbline.staging import staged

SHINGLE = 5
#: 4 / 5, as integers so that the limit itself counts as similar.
SIMILARITY = (4, 5)
#: Words of a fingerprint, and bits in which similar sets may differ.
WORDS = 4
RADIUS = 72
#: One in so many texts is sampled for shingles that many texts share; at most ``COMMON`` are held.
SAMPLE = 50
COMMON = 1 << 16


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all shingles of one text."""
    return np.unique(shingle_hashes(text, size))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Another hash of each hash (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(grams: np.ndarray, words: int = WORDS) -> np.ndarray:
    """SimHash of a set, one word for each of ``words`` hashes of its shingles."""
    out = np.zeros(words, np.uint64)
    for w in range(words if len(grams) else 0):
        votes = np.zeros(64, np.int64)
        for i in range(0, len(grams), 1 << 16):
            part = np.ascontiguousarray(grams[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[w] = np.packbits(votes * 2 > len(grams), bitorder="little").view("<u8")[0]
        grams = _mixed(grams)
    return out


def _digest(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), 7)


def _sampled(docs: DataFrame) -> np.ndarray:
    """Shingles that more than one sampled text holds, the most frequent last; at most ``COMMON``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x).view(np.int64))], names=["gram"])

    some = docs.where(f"pmod(xxhash64(doc_id, 'sample'), {SAMPLE}) = 0").select("text")
    n = some.mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    held = n.orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()
    return held.column("gram").to_numpy()[::-1].view(np.uint64)


def first_shingles(grams: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of one set under which it must meet all sets that are similar enough."""
    above, below = SIMILARITY
    n = len(grams) - (above * len(grams) + below - 1) // below + 1
    if len(known) and len(grams):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        common = known[at] == grams
        if common.any():
            last = grams[common][np.argsort(rank[at[common]])]
            grams = np.concatenate((grams[~common], last))
    return grams[:n]


def _prints(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, rank, code, keys)`` for each row; ``keys`` are the shingles to file under."""
    common = _sampled(docs)
    order = np.argsort(common)
    held = docs.sparkSession.sparkContext.broadcast((common[order], order))  # at most COMMON

    def make():
        known, rank = held.value

        def work(texts: list) -> list:
            digest, ranks, codes, keys = [], [], [], []
            for text in texts:
                grams = shingles(text)
                code = wide_fingerprint(grams)
                digest.append(_digest(grams))
                ranks.append(code[0])
                codes.append(code.tobytes())
                keys.append(first_shingles(grams, known, rank).tobytes())
            return [np.array(digest, np.uint64).view(np.int64), gray_rank(np.array(ranks, np.uint64)), codes, keys]

        return work

    fields = {"digest": T.LongType(), "rank": T.LongType(), "code": T.BinaryType(), "keys": T.BinaryType()}
    return append_columns(docs.select("doc_id", "text"), "text", fields, make).drop("text")


def _filed(prints: DataFrame) -> DataFrame:
    """``(field, rank, id, code)``: each fingerprint under those of its first shingles that another set has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = bytes_of(batch.column("keys"))
            digests = np.repeat(batch.column("digest").to_numpy(), np.diff(ends) // 8)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(digests)], names=["field", "id"])

    rows = prints.select("digest", "keys").mapInArrow(run, "field long, id long")
    shared = rows.groupBy("field").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("field")
    met = rows.join(shared, "field", "left_semi").distinct()
    codes = prints.select(F.col("digest").alias("id"), "rank", "code").dropDuplicates(["id"])
    return met.join(codes, "id").select("field", "rank", "id", "code")


def similar(loads: list, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs of sets reach ``SIMILARITY``, exactly."""
    above, below = SIMILARITY
    good = np.zeros(len(u), bool)
    for i, (x, y) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        m, n = np.frombuffer(loads[x], np.uint64), np.frombuffer(loads[y], np.uint64)
        if above * max(len(m), len(n)) <= below * min(len(m), len(n)):
            both = np.concatenate((m, n))
            both.sort(kind="stable")  # two sorted runs
            good[i] = (above + below) * int((both[1:] == both[:-1]).sum()) >= above * len(both)
    return good


def _with_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``(field, rank, id, code, load)`` of ``members(doc_id, digest, field)``; ``load`` holds the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                grams = [shingles(t) for t in part.column("text").to_pylist()]
                digests = np.array([_digest(g) for g in grams], np.uint64).view(np.int64)
                codes = np.array([wide_fingerprint(g) for g in grams], np.uint64).reshape(-1, WORDS)
                # a repeated doc_id may bring another text
                keep = pa.array(digests == part.column("digest").to_numpy())
                arrays = [part.column("field"), pa.array(gray_rank(codes[:, 0])), pa.array(digests), pa.array([c.tobytes() for c in codes]), pa.array([g.tobytes() for g in grams])]
                yield pa.RecordBatch.from_arrays(arrays, names=["field", "rank", "id", "code", "load"]).filter(keep)

    texts = docs.select("doc_id", "text").join(members, "doc_id").select("text", "digest", "field")
    return texts.mapInArrow(run, "field long, rank long, id long, code binary, load binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` for each row of ``docs(doc_id, text)`` that has a doc_id."""
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    prints = staged(_prints(docs), "near-prints")
    reps = staged(prints.groupBy("digest").agg(F.min("doc_id").alias("rep")), "near-reps")
    groups = connected_components(index_links(_filed(prints), WORDS, RADIUS))
    members = groups.join(reps, F.col("node") == F.col("digest")).select(F.col("rep").alias("doc_id"), "digest", F.col("component").alias("field"))
    edges = index_links(_with_sets(docs, staged(members, "near-members")), WORDS, RADIUS, similar)
    edges = (
        edges.join(reps.select(F.col("digest").alias("u"), F.col("rep").alias("ru")), "u")
        .join(reps.select(F.col("digest").alias("v"), F.col("rep").alias("rv")), "v")
        .select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    )
    found = connected_components(edges).withColumnRenamed("node", "rep")
    of_set = reps.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", "digest").join(of_set, "digest").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of each near-duplicate group that has the smallest doc_id; rows without an id stay."""
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    nameless = docs.where("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(nameless)
