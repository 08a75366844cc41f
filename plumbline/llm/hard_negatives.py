"""Hard negatives by coordinate pruning over length buckets.

Vectors become integers (floor of 256 times each component).  An anchor's
positives are the ``POSITIVES`` rows of its label that score highest; for each, the
negatives are the ``NEGATIVES`` highest rows of another label whose score lies
between ``LOW`` and ``HIGH`` hundredths of the positive's.

All rows are range-sorted by falling length and packed into buckets of ``BUCKET``
rows; each bucket keeps, for each coordinate, its rows in the order of that
coordinate of the vector divided by its length.  Anchors, a stated set, are packed
into blocks, and each block meets every bucket:

1. An anchor that still needs scores of t or more needs cosines of at least
   t / (its length * the bucket's longest).  If that passes 1 the bucket is skipped.
2. Else it bounds each coordinate of a unit vector that can get there.  For the
   anchor's ``FOCUS`` largest coordinates the bounds are looked up in the sorted
   lists, which gives a range of each list.
3. Rows of the shortest range are the candidates; those outside of any other range go.
4. What is left is scored in exact integers.

Both searches run like this.  The first raises t to the least of the positives that an
anchor holds; the second begins at ``LOW`` hundredths of its worst positive and raises t
as every positive's negatives fill up.  The longest bucket, which is broadcast (at most
``BUCKET`` rows), is met first by all.  Buckets are dealt to stripes, and ranks are taken over
what the stripes found.  Bounds carry a margin for rounding, so nothing that could win is pruned.

Defined results: rows with a null id or label, or whose vector is null or holds a null or a
non-finite component, take no part.  Shorter vectors count as padded with zeros.  Rows
that share an anchor's id count as its own and are no positive of it; of another label they
may be negatives.  Repeated rows each have a rank, repeated anchors ask once for each of their
labels and vectors.  Ties go to the smaller id.  Anchors without positives or negatives return
nothing.  An empty table gives an empty result.  Other columns are not read, so their
names cannot clash.  Sizes of integers as in ``topk``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.topk import _exact, _matrix, integers
from plumbline.staging import staged, table

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
EVERY = 50
BUCKET = 1024
ANCHORS = 256
#: Coordinates whose ranges are intersected.
FOCUS = 4
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Bucket:
    """Rows of like length, with their places sorted by each coordinate of their directions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray):
        self.ids, self.labels, self.ints = ids, labels, ints
        x = ints.astype(float)
        length = np.sqrt((x * x).sum(1))
        self.longest = float(length.max(initial=0))
        unit = x / np.where(length > 0, length, 1)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.order, axis=0)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.arange(len(unit))[:, None].repeat(unit.shape[1], 1), axis=0)


def feasible(cosine: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that a coordinate of a unit vector can be if its cosine with another is ``cosine`` or more, where that one has ``q``."""
    wide, turn = np.arccos(np.clip(cosine, -1, 1)), np.arccos(np.clip(q, -1, 1))
    return np.cos(np.minimum(np.pi, turn + wide)) - 1e-9, np.cos(np.maximum(0, turn - wide)) + 1e-9


class Block:
    """Anchors of a task with the best that they have met, for each of their slots.

    A slot takes scores from ``least`` to ``most`` and keeps the best ``k``; ``same`` says whether it wants the
    anchor's own label or any other.  ``floors`` are scores below which nothing can win.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool, focus: int = FOCUS, floors: np.ndarray | None = None):
        self.ids, self.labels, self.ints, self.least, self.most, self.k, self.same = ids, labels, ints, least, most, k, same
        x = ints.astype(float)
        self.length = np.sqrt((x * x).sum(1))
        self.unit = x / np.where(self.length > 0, self.length, 1)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :focus]
        n, slots = least.shape
        self.scores, self.found = np.full((n, slots, k), _NONE), np.full((n, slots, k), _LAST)
        self.floors = self.least if floors is None else np.maximum(self.least, floors)
        self.skipped = self.listed = self.scored = 0

    def needs(self) -> np.ndarray:
        """The least score that is of use to some slot of each anchor."""
        return np.where(self.most >= self.least, np.maximum(self.scores[:, :, -1], self.floors), _LAST).min(1)

    def candidates(self, bucket: Bucket) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(anchor's place, row's place)`` that the lists leave."""
        needs = self.needs()
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = needs.astype(float) / (self.length * bucket.longest)
        cosine = np.where(needs > 0, cosine - 1e-9, -1.0)  # scores of zero or less say nothing about directions
        live = np.nonzero((cosine <= 1) & (needs < _LAST))[0]
        self.skipped += int(len(live) == 0)
        if not len(live):
            return live, live
        focus = self.focus[live]
        q = np.take_along_axis(self.unit[live], focus, axis=1)
        low, high = feasible(cosine[live, None], q)
        begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            begin[at] = np.searchsorted(bucket.sorted[:, f], low[at], side="left")
            end[at] = np.searchsorted(bucket.sorted[:, f], high[at], side="right")
        size = np.maximum(end - begin, 0)
        short = size.argmin(1)
        each = np.arange(len(live))
        n = size[each, short]
        of = np.repeat(each, n)
        row = bucket.order[np.repeat(begin[each, short], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), focus[of, short[of]]]
        self.listed += len(of)
        fits = (bucket.labels[row] == self.labels[live[of]]) == self.same
        for k in range(focus.shape[1]):
            rank = bucket.rank[row, focus[of, k]]
            fits &= (rank >= begin[of, k]) & (rank < end[of, k])
        of, row = live[of[fits]], row[fits]
        if self.same:
            own = self.ids[of] != bucket.ids[row]
            of, row = of[own], row[own]
        return of, row

    def meet(self, bucket: Bucket) -> None:
        of, row = self.candidates(bucket)
        if not len(of):
            return
        self.scored += len(of)
        anchors, a = np.unique(of, return_inverse=True)
        rows, r = np.unique(row, return_inverse=True)
        if 16 * len(of) > len(anchors) * len(rows):  # one product of matrices where the pairs fill it
            score = _exact(self.ints[anchors], bucket.ints[rows])[a, r]
        else:
            score = np.concatenate([(self.ints[of[i : i + 65536]] * bucket.ints[row[i : i + 65536]]).sum(1) for i in range(0, len(of), 65536)])
        ids = bucket.ids[row]
        for slot in range(self.least.shape[1]):
            last = self.scores[of, slot, -1]
            good = (score >= self.floors[of, slot]) & (score <= self.most[of, slot]) & (score >= last)
            if good.any():
                self._take(slot, of[good], score[good], ids[good])

    def _take(self, slot: int, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Keep the best ``k`` of what the slot holds and the new ones."""
        at = np.unique(of)
        of = np.concatenate((of, np.repeat(at, self.k)))
        score = np.concatenate((score, self.scores[at, slot].ravel()))
        ids = np.concatenate((ids, self.found[at, slot].ravel()))
        order = np.lexsort((ids, -np.where(score == _NONE, _NONE + 1, score), of))
        of, score, ids = of[order], score[order], ids[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        top = place < self.k
        self.scores[of[top], slot, place[top]], self.found[of[top], slot, place[top]] = score[top], ids[top]


_BUCKET = "bucket long, longest double, ids binary, labels binary, ints binary"
_BLOCK = "ids binary, labels binary, ints binary, names binary, least binary, most binary, floors binary, ratio double"


def _packed(width: int, most: int):
    """Buckets of ``(vec_id, label, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, labels = (np.array([r[i] for r in rows], np.int64) for i in range(2))
            ints = _matrix(pa.array([r[2] for r in rows], pa.list_(pa.int64())), width)
            longest = float(np.sqrt((ints.astype(float) ** 2).sum(1)).max())
            values = [[number], [longest], [ids.tobytes()], [labels.tobytes()], [ints.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=[c.split()[0] for c in _BUCKET.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "v")), strict=True):
                held.append(row)
                if len(held) == most:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return run


def _blocks(width: int, slots: int, most: int, k: int, same: bool, focus: int, seed):
    """Blocks of ``(anchor, vec_id, label, v, least, most)`` with their floors, the ``k``-th best in the longest bucket; ``anchor`` numbers the anchors' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, ints = (np.frombuffer(x, np.int64) for x in seed.value)
        longest = Bucket(ids, labels, ints.reshape(-1, width))
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "v", "anchor", "least", "most")), strict=True))
            for i in range(0, len(rows), most):
                part = rows[i : i + most]
                ids, labels, names = (np.array([r[j] for r in part], np.int64) for j in (0, 1, 3))
                ints = _matrix(pa.array([r[2] for r in part], pa.list_(pa.int64())), width)
                least, top = np.ones((len(part), slots), np.int64), np.zeros((len(part), slots), np.int64)  # an empty range
                for j, r in enumerate(part):
                    least[j, : len(r[4])], top[j, : len(r[5])] = r[4], r[5]
                block = Block(ids, labels, ints, least, top, k, same, focus)
                block.meet(longest)
                floors = block.scores[:, :, -1]
                needs = np.maximum(block.needs(), 0).astype(float)
                ratio = float((needs / np.maximum(block.length, 1e-300)).min())  # the length that a bucket must reach
                values = [[x.tobytes()] for x in (ids, labels, ints, names, least, top, floors)]
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in values), pa.array([ratio])], names=[c.split()[0] for c in _BLOCK.split(", ")])

    return run


def _search(width: int, k: int, same: bool, focus: int):
    def read(columns: dict, i: int, prefix: str) -> list[np.ndarray]:
        ids, labels, ints = (np.frombuffer(columns[prefix + c][i].as_py(), np.int64) for c in ("ids", "labels", "ints"))
        return [ids, labels, ints.reshape(-1, width)]

    def rows(block: Block, numbers: np.ndarray) -> pa.RecordBatch:
        of, slot, at = np.nonzero(block.scores > _NONE)
        arrays = [numbers[of], slot, block.found[of, slot, at], block.scores[of, slot, at]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], names=["anchor", "slot", "found_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One block at a time, buckets by falling length; a row for each anchor, slot and place."""
        held, at, numbers = None, None, None
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                if (block := columns["block"][i].as_py()) != at:
                    if held is not None:
                        yield rows(held, numbers)
                    parts = read(columns, i, "")
                    least, most, floors = (np.frombuffer(columns[c][i].as_py(), np.int64).reshape(len(parts[0]), -1) for c in ("least", "most", "floors"))
                    held, at, numbers = Block(*parts, least, most, k, same, focus, floors), block, np.frombuffer(columns["names"][i].as_py(), np.int64)
                held.meet(Bucket(*read(columns, i, "c_")))
        if held is not None:
            yield rows(held, numbers)

    return run


def _best(anchors: DataFrame, buckets: DataFrame, width: int, slots: int, k: int, same: bool, focus: int, block: int) -> DataFrame:
    """``(anchor, slot, found_id, score, rank)`` of ``anchors(anchor, vec_id, label, v, norm2, least, most)``, the last two arrays of up to ``slots`` bounds."""
    spark = anchors.sparkSession
    longest = buckets.orderBy(F.desc("longest"), "bucket").select("ids", "labels", "ints").first()  # at most BUCKET rows
    seed = spark.sparkContext.broadcast(tuple(bytes(x) for x in longest) if longest else (b"", b"", b""))
    dealt = anchors.coalesce(max(1, -(-anchors.count() // block))).sortWithinPartitions(F.desc("norm2"), "vec_id").drop("norm2")
    blocks = staged(dealt.mapInArrow(_blocks(width, slots, block, k, same, focus, seed), _BLOCK).withColumn("block", F.monotonically_increasing_id()), "anchor-blocks")
    stripes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = blocks.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    theirs = buckets.select("longest", F.pmod(F.hash("bucket"), F.lit(stripes)).alias("stripe"), *(F.col(c).alias(f"c_{c}") for c in ("ids", "labels", "ints")))
    # buckets come by falling length: the merge join hands its right side over in the order it was sorted in
    falling = theirs.repartition(stripes, "stripe").sortWithinPartitions("stripe", F.desc("longest"))
    met = spread.join(falling.hint("merge"), "stripe").where(F.col("longest") * (1 + 1e-6) >= F.col("ratio"))
    rows = met.drop("stripe", "longest", "ratio").mapInArrow(_search(width, k, same, focus), "anchor long, slot long, found_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "found_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, focus: int = FOCUS, bucket: int = BUCKET, block: int = ANCHORS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Both frames are ``(vec_id, label, v, norm2)``, ``v`` in integers as ``topk.integers`` makes them.
    """
    rows = staged(rows, "mined")
    width = max(1, rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1)
    ordered = rows.repartitionByRange(F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    buckets = staged(ordered.select("vec_id", "label", "v").mapInArrow(_packed(width, bucket), _BUCKET), "buckets")
    anchors = staged(anchors.select("vec_id", "label", "v", "norm2").withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    every = F.array(F.lit(-(1 << 62))), F.array(F.lit(1 << 62))
    asked = anchors.withColumns(dict(zip(("least", "most"), every, strict=True)))
    fields = ["anchor", "vec_id", "label", "v", "norm2", "least", "most"]
    best = _best(asked.select(fields), buckets, width, 1, positives, True, focus, block)
    found = staged(best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # bounds in hundredths, by parts of the score so that no product passes 64 bits
    rest = F.pmod("positive_score", F.lit(100))
    whole = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
    least, most = whole * low + F.ceil(rest * low / 100), whole * high + F.floor(rest * high / 100)
    bounds = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", least.alias("least"), most.alias("most")))).alias("x"))  # at most POSITIVES
    asked = anchors.join(bounds, "anchor").withColumns({"least": F.col("x.least"), "most": F.col("x.most")})
    last = _best(asked.select(fields), buckets, width, positives, negatives, False, focus, block)
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    out = last.join(found, ["anchor", "slot"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def labelled(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, v, norm2)`` of the rows that take part, every seventh id with the next label."""
    rows = embeddings.where("label is not null").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return integers(rows, keep=("label",)).withColumn("label", moved.cast("long"))


def op12_lemp_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(table(spark, sf_dir, "embeddings"))
    return mine(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.v, c.v)::bigint AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::int AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3
"""
