"""Exact similarity joins of vectors: pairs, or links that span what the pairs connect.

Vectors of one block (a brand) whose inner product reaches a limit are similar.
Rows are sorted by (block, nearest pivot, distance from it) and packed into pages of
like vectors; a page knows its centre and its radius.  For x and y in two pages with
centres c, d and radii r, s

    x . y  <=  c . d + |c| s + r |d| + r s

so pages of one block meet only where that reaches the limit.  Inside two pages the
same bound is taken between leaves of ``LEAF`` rows, and a leaf's rows are bounded by
``|x| s + x . d`` before any product is formed.  What is left are matrix products.

``similar_links`` emits each row with the smallest id that it reaches in its two pages,
never all pairs, and skips leaves that are joined already; ``similar_pairs`` emits all
pairs, as its caller asks.  Pivots are ``PIVOTS`` rows in the order of their MD5; they decide
how well pages are separated, never what is found.

Pages of a hot block are spread over as many tasks as they fill, and so are pairs of pages.

Defined results: rows without a block, an id or a vector, and vectors that are empty or hold a null
or a non-finite component, have no pairs; vectors of unlike length neither.  Repeated ids pair like
any other rows, but no row pairs with one of its own id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.functions.forest import united
from plumbline.staging import staged

PAGE = 4096
LEAF = 128
PIVOTS = 64
#: What rounding may take from a product of doubles, relative to the lengths.
ROUNDING = 1e-12


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of one length as doubles."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _pivots(rows: DataFrame, most: int) -> list[np.ndarray]:
    """At most ``most`` vectors of the table."""
    some = rows.orderBy(F.md5(F.col("item_id").cast("string").cast("binary")), "item_id").limit(most).select("vec")
    return [np.array(r["vec"], float) for r in some.collect()]


def _placed(pivots):
    """Adds each vector's length, its nearest pivot and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            width = np.diff(np.asarray(column.offsets))
            near, off = np.full(len(width), -1), np.zeros(len(width))
            for w in np.unique(width):
                at = np.nonzero(width == w)[0]
                mine = [p for p in pivots.value if len(p) == w]
                if w and mine:
                    x, c = _matrix(column.take(pa.array(at))), np.array(mine)
                    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
                    near[at], off[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width.astype(np.int32)), pa.array(near.astype(np.int32)), pa.array(off)], names=[*batch.schema.names, "width", "near", "off"])

    return run


def spread_of(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre of some rows, and the greatest distance from it."""
    centre = x.mean(0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(1).max(initial=0)))


def _packed(id_type: pa.DataType, block_type: pa.DataType, most: int):
    names = ["page", "block", "width", "ids", "rows", "centre", "radius"]
    kinds = [pa.int64(), block_type, pa.int32(), pa.list_(id_type), pa.binary(), pa.binary(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def page(key: tuple, ids: list, parts: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            x = np.concatenate(parts)
            centre, radius = spread_of(x)
            row = [number, *key, ids, x.tobytes(), centre.tobytes(), radius]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        key, ids, parts = None, [], []
        for batch in batches:
            keys = list(zip(batch.column("block").to_pylist(), batch.column("width").to_pylist(), strict=True))
            begin = 0
            while begin < len(keys):
                if keys[begin] != key or len(ids) >= most:
                    if ids:
                        yield page(key, ids, parts)
                    key, ids, parts = keys[begin], [], []
                end = begin
                while end < len(keys) and keys[end] == key and len(ids) + end - begin < most:
                    end += 1
                ids += batch.column("item_id").slice(begin, end - begin).to_pylist()
                parts.append(_matrix(batch.column("vec").slice(begin, end - begin)))
                begin = end
        if ids:
            yield page(key, ids, parts)

    return run


def _near_pages(least: float):
    """Pairs of pages whose bound reaches the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for c, r, d, s in zip(*(batch.column(x).to_pylist() for x in ("a_centre", "a_radius", "b_centre", "b_radius")), strict=True):
                c, d = np.frombuffer(c, float), np.frombuffer(d, float)
                most = c @ d + np.sqrt(c @ c) * s + r * np.sqrt(d @ d) + r * s
                keep.append(most + ROUNDING * (1 + abs(most)) >= least)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return run


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed left to right."""
    return np.cumsum(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


class Pages:
    """Two pages (or one with itself) and the similar pairs between them."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None, least: float, leaf: int = LEAF):
        self.a, self.b, self.least, self.leaf, self.same = a, a if b is None else b, least, leaf, b is None
        self.met = self.skipped = 0

    def _leaves(self, x: np.ndarray) -> tuple[list[slice], np.ndarray, np.ndarray]:
        cuts = [slice(i, min(i + self.leaf, len(x))) for i in range(0, len(x), self.leaf)]
        found = [spread_of(x[c]) for c in cuts]
        return cuts, np.array([f[0] for f in found]), np.array([f[1] for f in found])

    def hits(self, done=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(places in a, places in b, products)``; ``done(slice, slice)`` says that two leaves need not meet."""
        (cuts_a, c, r), (cuts_b, d, s) = self._leaves(self.a), self._leaves(self.b)
        size_c, size_d = np.sqrt((c * c).sum(1)), np.sqrt((d * d).sum(1))
        most = c @ d.T + size_c[:, None] * s + r[:, None] * size_d + r[:, None] * s
        near = most + ROUNDING * (1 + np.abs(most)) >= self.least
        for i, j in np.argwhere(near if not self.same else np.triu(near)).tolist():
            if done is not None and done(cuts_a[i], cuts_b[j]):
                self.skipped += 1
                continue
            x, y = self.a[cuts_a[i]], self.b[cuts_b[j]]
            length = np.sqrt((x * x).sum(1))
            bound = x @ d[j] + length * s[j]
            rows = np.nonzero(bound + ROUNDING * (1 + np.abs(bound)) >= self.least)[0]
            self.met += 1
            if not len(rows):
                continue
            product = x[rows] @ y.T
            slack = ROUNDING * (1 + length[rows].max() * np.sqrt((y * y).sum(1).max(initial=0)))
            u, v = np.nonzero(product >= self.least - slack)
            value = _in_order(x[rows[u]], y[v])
            good = value >= self.least
            u, v, value = cuts_a[i].start + rows[u[good]], cuts_b[j].start + v[good], value[good]
            if self.same and i == j:
                once = u < v
                u, v, value = u[once], v[once], value[once]
            if len(u):
                yield u, v, value
        every = near.size if not self.same else len(near) * (len(near) + 1) // 2
        self.skipped += every - int((near if not self.same else np.triu(near)).sum())

    def roots(self) -> np.ndarray:
        """The root of each row of ``a``, and then of ``b`` if it is another page, by the pairs between them."""
        shift = 0 if self.same else len(self.a)
        top = np.arange(shift + len(self.b))

        def done(p: slice, q: slice) -> bool:
            root = top[p.start]
            return bool((top[p] == root).all() and (top[q.start + shift : q.stop + shift] == root).all())

        for u, v, _ in self.hits(done):
            top = united(top, u, v + shift)
        return top


def _met(id_type: pa.DataType, least: float, leaf: int, every: bool):
    names = ["u", "v", *(["product"] if every else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(x) for x in ("a", "b", "width", "a_ids", "a_rows", "b_ids", "b_rows")), strict=True):
                a, b, width, a_ids, a_rows, b_ids, b_rows = (x.as_py() for x in row)
                x, y = (np.frombuffer(z, float).reshape(-1, width) for z in (a_rows, b_rows))
                pages = Pages(x, None if a == b else y, least, leaf)
                if every:
                    for u, v, value in pages.hits():
                        pairs = [(min(a_ids[i], b_ids[j]), max(a_ids[i], b_ids[j]), p) for i, j, p in zip(u.tolist(), v.tolist(), value.tolist(), strict=True) if a_ids[i] != b_ids[j]]
                        columns = list(zip(*pairs, strict=True)) if pairs else [[], [], []]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (id_type, id_type, pa.float64()), strict=True)], names=names)
                else:
                    ids = a_ids if a == b else a_ids + b_ids
                    top = pages.roots()
                    least_id: dict = {}
                    for i, root in zip(ids, top.tolist(), strict=True):
                        if root not in least_id or i < least_id[root]:
                            least_id[root] = i
                    links = [(least_id[root], i) for i, root in zip(ids, top.tolist(), strict=True) if least_id[root] != i]
                    columns = list(zip(*links, strict=True)) if links else [[], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, id_type) for c in columns], names=names)

    return run


def _join(items: DataFrame, block: str, least: float, every: bool, page: int, leaf: int) -> DataFrame:
    spark = items.sparkSession
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = items.select(F.col(block).alias("block"), "item_id", F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.where("block is not null and item_id is not null and size(vec) > 0").where(fine)
    pivots = spark.sparkContext.broadcast(_pivots(rows, PIVOTS))  # at most PIVOTS vectors
    schema = T.StructType([*rows.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("near", T.IntegerType()), T.StructField("off", T.DoubleType())])
    order = ["block", "width", "near", "off", "item_id"]
    placed = rows.mapInArrow(_placed(pivots), schema).repartitionByRange(*order).sortWithinPartitions(*order)
    id_type, block_type = (rows.schema[c].dataType for c in ("item_id", "block"))
    packed = T.StructType([T.StructField("page", T.LongType()), T.StructField("block", block_type), T.StructField("width", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("rows", T.BinaryType()), T.StructField("centre", T.BinaryType()), T.StructField("radius", T.DoubleType())])
    pages = staged(placed.drop("near", "off").mapInArrow(_packed(to_arrow_type(id_type), to_arrow_type(block_type), page), packed), "pages")
    slim = pages.select("page", "block", "width", "centre", "radius")
    side = lambda df, s: df.withColumnsRenamed({"page": s} | {c: f"{s}_{c}" for c in ("centre", "radius", "ids", "rows")})
    met = side(slim, "a").join(side(slim, "b"), ["block", "width"]).where("a <= b")
    near = met.select("a", "b", "a_centre", "a_radius", "b_centre", "b_radius").mapInArrow(_near_pages(least), "a long, b long")
    whole = near.join(side(pages.select("page", "width", "ids", "rows"), "a"), "a").join(side(pages.select("page", "ids", "rows"), "b"), "b")
    kind = id_type.simpleString()
    return whole.mapInArrow(_met(to_arrow_type(id_type), least, leaf, every), f"u {kind}, v {kind}" + (", product double" if every else ""))


def similar_pairs(items: DataFrame, block: str, least: float, page: int = PAGE, leaf: int = LEAF) -> DataFrame:
    """``(u, v, product)`` of all similar pairs of ``items(block, item_id, vec)``, ``u < v``."""
    return _join(items, block, least, True, page, leaf)


def similar_links(items: DataFrame, block: str, least: float, page: int = PAGE, leaf: int = LEAF) -> DataFrame:
    """``(u, v)`` that connect exactly what the similar pairs connect, at most one row for each row and pair of pages."""
    return _join(items, block, least, False, page, leaf)
