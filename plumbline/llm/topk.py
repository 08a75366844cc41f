"""Exact top-k inner products by norm order and rotated partial sums.

Vectors become integers (floor of 256 times each component).  An orthogonal
rotation, from the eigenvectors of the Gram matrix (the right singular vectors
of the table), moves most of the length into the first coordinates.  Candidates
are range-sorted by falling length and packed into blocks; queries, a stated
set, are packed into blocks too and meet every candidate block:

1. the longest candidates give each query a floor, its k-th best score there;
2. a pair of blocks does not meet if the longest query times the longest
   candidate reaches no query's floor;
3. candidate blocks come to a query block by falling length, and each raises the
   floors; a block is skipped once no query's length times its longest candidate
   reaches that query's floor;
4. elsewhere the products of the first ``HEAD`` rotated coordinates plus the
   product of the residual lengths bound each score (Cauchy-Schwarz), and only
   pairs at or above the floor are scored, in exact integers;
5. candidate blocks are dealt to stripes by hash; a query block keeps one running
   top k for each stripe, and ranks are taken over those.

Bounds carry a margin for rounding, so nothing that could win is pruned.

Defined results: vectors that are null, or hold a null or a non-finite
component, and rows without an id take no part.  Shorter vectors count as padded
with zeros.  Rows that share a query's id count as its own.  Repeated candidate
rows each have a rank; ties go to the smaller id.  An empty table gives an
empty result.  Other columns are not read, so their names cannot clash.
Components are taken up to 2**20 in size; larger ones are scored in 64-bit
integers, which is exact while scores stay below 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.staging import staged, table

SCALE = 256
TOP = 5
EVERY = 50
BLOCK = 1024
QUERY_BLOCK = 256
#: Rotated coordinates summed before the residual bound.
HEAD = 24
#: No score, and no id.
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integers(embeddings: DataFrame, scale: int = SCALE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(vec_id, v array<long>, norm2)`` of the vectors that take part, and the columns to ``keep``."""
    fine = F.expr("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity'))")
    rows = embeddings.where(fine).select("vec_id", *keep, F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthogonal matrix whose first columns carry most length: ``width`` squared sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "s"])

    cells = vectors.select("v").mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toPandas()
    gram = np.zeros(width * width)
    gram[cells["cell"].to_numpy()] = cells["s"].to_numpy()
    gram = gram.reshape(width, width)
    gram = gram / max(1.0, np.abs(gram).max())
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


_PACKED = "block long, longest double, ids binary, ints binary, turned binary"


def _pack(width: int, turn: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, rows, held = [], [], 0

        def pack(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            y = x.astype(float) @ turn
            number += 1
            longest = float(np.sqrt((x.astype(float) ** 2).sum(1)).max())
            values = [[number], [longest], [ids.tobytes()], [x.tobytes()], [y.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=[c.split()[0] for c in _PACKED.split(", ")])

        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            rows.append(_matrix(batch.column(1), width))
            held += batch.num_rows
            if held >= most:
                all_ids, all_rows = np.concatenate(ids), np.concatenate(rows)
                full = held // most * most
                for i in range(0, full, most):
                    yield pack(all_ids[i : i + most], all_rows[i : i + most])
                ids, rows, held = [all_ids[full:]], [all_rows[full:]], held - full
        if held:
            yield pack(np.concatenate(ids), np.concatenate(rows))

    return run


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: by floats where all sums fit, else by integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2.0**52:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def _floors(width: int, k: int, seeds):
    """The k-th best score of each query in one block of candidates, the broadcast ``(ids, ints)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs, c = np.frombuffer(seeds.value[0], np.int64), np.frombuffer(seeds.value[1], np.int64).reshape(-1, width)
        for batch in batches:
            out, least = [], []
            for q_ids, q_ints in zip(*(batch.column(n).to_pylist() for n in ("ids", "ints")), strict=True):
                q, mine = np.frombuffer(q_ints, np.int64).reshape(-1, width), np.frombuffer(q_ids, np.int64)
                score = _exact(q, c).astype(float)
                score[mine[:, None] == theirs[None, :]] = -np.inf
                floor = np.full(len(q), -np.inf)
                if score.shape[1] >= k:
                    floor = np.partition(score, -k, axis=1)[:, -k]
                out.append(floor.tobytes())
                least.append(float(floor.min()))
            kept = [batch.column(n) for n in ("block", "longest", "ids", "ints", "turned")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary()), pa.array(least, pa.float64())], names=["block", "longest", "ids", "ints", "turned", "floors", "floor"])

    return run


class QueryBlock:
    """Queries of one block and the best k that they have met, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, turned: np.ndarray, floors: np.ndarray, head: int, k: int):
        self.ids, self.ints, self.turned, self.head, self.k = ids, ints, turned, head, k
        self.length, self.rest = np.sqrt((turned * turned).sum(1)), np.sqrt((turned[:, head:] ** 2).sum(1))
        self.floors = floors.copy()
        self.scores, self.found = np.full((len(ids), k), _NONE), np.full((len(ids), k), _LAST)
        self.skipped = self.scored = 0

    def live(self, longest: float) -> np.ndarray:
        """Queries that a candidate of that length may still serve."""
        most = self.length * longest
        return most + 1e-6 * (1 + most) >= self.floors

    def meet(self, longest: float, ids: np.ndarray, ints: np.ndarray, turned: np.ndarray) -> None:
        """Score what the bounds leave of a candidate block, and raise the floors."""
        rows = np.nonzero(self.live(longest))[0]
        if not len(rows):
            self.skipped += 1
            return
        c_len, c_rest = np.sqrt((turned * turned).sum(1)), np.sqrt((turned[:, self.head :] ** 2).sum(1))
        bound = self.turned[rows, : self.head] @ turned[:, : self.head].T + self.rest[rows, None] * c_rest[None, :]
        bound += 1e-6 * (1 + self.length[rows, None] * c_len[None, :])
        may = (bound >= self.floors[rows, None]) & (self.ids[rows, None] != ids[None, :])
        keep, cols = may.any(1), np.nonzero(may.any(0))[0]
        rows, may = rows[keep], may[keep][:, cols]
        if not len(rows):
            return
        self.scored += int(may.sum())
        score = np.where(may, _exact(self.ints[rows], ints[cols]), _NONE)
        score = np.concatenate((self.scores[rows], score), axis=1)
        names = np.concatenate((self.found[rows], np.broadcast_to(ids[cols], may.shape)), axis=1)
        least = np.partition(score, -self.k, axis=1)[:, -self.k]
        of, at = np.nonzero((score >= least[:, None]) & (score > _NONE))
        order = np.lexsort((names[of, at], -score[of, at], of))
        of, at = of[order], at[order]
        begins = np.searchsorted(of, np.arange(len(rows)))
        place = np.arange(len(of)) - begins[of]
        of, at, place = (x[place < self.k] for x in (of, at, place))
        best, who = np.full((len(rows), self.k), _NONE), np.full((len(rows), self.k), _LAST)
        best[of, place], who[of, place] = score[of, at], names[of, at]
        self.scores[rows], self.found[rows] = best, who
        full = best[:, -1] > _NONE
        self.floors[rows[full]] = np.maximum(self.floors[rows[full]], best[full, -1])

    def rows(self) -> pa.RecordBatch:
        of, at = np.nonzero(self.scores > _NONE)
        arrays = [pa.array(x) for x in (self.ids[of], self.found[of, at], self.scores[of, at])]
        return pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])


def _score(width: int, head: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One query block at a time, candidate blocks by falling length; a row per query and place."""
        held, at = None, None
        for batch in batches:
            columns = {n: batch.column(n) for n in ("block", "ids", "ints", "turned", "floors", "c_longest", "c_ids", "c_ints", "c_turned")}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items() if n in ("block", "c_longest")}
                if row["block"] != at:
                    if held is not None:
                        yield held.rows()
                    ids, ints, turned, floors = (np.frombuffer(columns[n][i].as_py(), t) for n, t in (("ids", np.int64), ("ints", np.int64), ("turned", float), ("floors", float)))
                    held, at = QueryBlock(ids, ints.reshape(-1, width), turned.reshape(-1, width), floors, head, k), row["block"]
                ids, ints, turned = (np.frombuffer(columns[n][i].as_py(), t) for n, t in (("c_ids", np.int64), ("c_ints", np.int64), ("c_turned", float)))
                held.meet(row["c_longest"], ids, ints.reshape(-1, width), turned.reshape(-1, width))
        if held is not None:
            yield held.rows()

    return run


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = TOP, head: int = HEAD) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; both frames as ``integers`` returns them."""
    spark = vectors.sparkSession
    vectors = staged(vectors, "vectors")
    shape = vectors.agg(F.max(F.size("v")).alias("w")).first()
    width = max(1, shape["w"] or 1)
    turn = rotation(vectors, width)
    ordered = vectors.repartitionByRange(F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    candidates = staged(ordered.select("vec_id", "v").mapInArrow(_pack(width, turn, BLOCK), _PACKED), "candidates")
    n = queries.count()
    # full blocks of queries of like length, however the table is cut up
    dealt = queries.coalesce(max(1, -(-n // QUERY_BLOCK))).sortWithinPartitions(F.desc("norm2"), "vec_id").select("vec_id", "v")
    asked = dealt.mapInArrow(_pack(width, turn, QUERY_BLOCK), _PACKED)
    c = candidates.select("block", F.col("longest").alias("c_longest"), *(F.col(x).alias(f"c_{x}") for x in ("ids", "ints", "turned")))
    first = c.orderBy(F.desc("c_longest"), "block").select("c_ids", "c_ints").first()  # one block: at most BLOCK vectors
    seeds = spark.sparkContext.broadcast((bytes(first["c_ids"]), bytes(first["c_ints"])) if first else (b"", b""))
    floored = asked.mapInArrow(_floors(width, k, seeds), f"{_PACKED}, floors binary, floor double")
    floored = staged(floored, "queries")
    stripes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = floored.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    # candidate blocks come by falling length: the merge join hands its right side over in the order it was sorted in
    falling = c.withColumn("stripe", F.pmod(F.hash("block"), F.lit(stripes))).drop("block").repartition(stripes, "stripe").sortWithinPartitions("stripe", F.desc("c_longest"))
    # pairs of blocks whose lengths alone rule them out do not meet
    most = F.col("longest") * F.col("c_longest")
    pairs = spread.join(falling.hint("merge"), "stripe").where(most + 1e-6 * (1 + most) >= F.col("floor"))
    rows = pairs.drop("stripe").mapInArrow(_score(width, head, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_inner_products(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s) WHERE rank <= 5
"""
