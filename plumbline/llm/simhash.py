"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints that differ in at most ``MAX_BITS`` bits are linked, and links
are closed transitively.  Exact for any input:

1. A fingerprint comes from all 3-word shingles of the whole text.  Equal
   fingerprints collapse before anything is compared, so exact copies of any
   number cost one aggregation.
2. ``MAX_BITS`` differing bits leave one of ``MAX_BITS + 1`` bit fields equal,
   so each distinct fingerprint is filed once for each field, rotated so that
   this field comes first.  Only fingerprints that share a field meet; this is
   how the index is spread over tasks.
3. Every field is a tree (``Tree``): its codes in the order of their Gray rank,
   ``FAN`` children a node.  A node keeps which bits all codes below it agree
   on, and their values; what its children share is thus held once, above.
4. Node pairs are compared from the root (``descend``).  Differences in the
   bits that both nodes fix are carried down, only bits that are new to a pair
   of children are counted there, and a pair of groups goes as soon as the
   accumulated differences exceed the limit.  What reaches the codes is linked.
5. Files are range partitioned by (field, rank), so a crowded field lies in
   several tasks.  A task cuts such a field into branches of ``BRANCH`` codes at
   most, indexes each, and writes them with their masks; branches of other tasks
   are met by joins, first in groups of ``2 ** UP`` (masks factored upward by
   ``bit_and`` and ``bit_or``), then one by one, differences accumulated alike;
   what is left goes down both trees in one task.
6. A task emits each code with the smallest id that its links reach there, never
   all pairs of a group; fields that hold the same group thus emit the same rows.

A branch's number is its task's number times 2^32 plus its place in the task, so
a table may have up to 2^31 tasks of 2^32 branches.

Defined results: a null or wordless text has fingerprint zero and links like
any other.  Repeated rows and ties collapse to the smallest doc_id; a row
whose doc_id is null links and bridges like any other, and gets the component
of its fingerprint (null if no row in it has an id).  An empty table gives an empty result.  Other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.text import append_columns
from plumbline.operators.components import connected_components
from plumbline.staging import staged, table

MAX_BITS = 2
SHINGLE = 3
#: Children of a node.
FAN = 8
#: Codes in a branch, and bytes of whatever travels with them, at most.
BRANCH = 1 << 14
BRANCH_BYTES = 4 << 20
#: Branches that one node above them spans, as a power of two.
UP = 6
#: Node pairs that are opened at once, and pairs that are checked before the joined ones among the rest go.
STEP = 1 << 13
CHECKED = 256
_FIELDS = {2: (0, 22, 43), 3: (0, 16, 32, 48)}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_byte_words = re.compile(rb"[^\x20\x09-\x0D]+").findall


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of all shingles of one text in order; a shorter text is one shingle, a wordless one has none."""
    words = _byte_words((text or "").encode().translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(flat[a:b], 42) for a, b in spans), np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of one text."""
    hashes = shingle_hashes(text, shingle)
    if len(hashes) < 2:
        return int(hashes.view(np.int64)[0]) if len(hashes) else 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for each row."""
    rows = append_columns(
        docs.select("doc_id", "text"), "text", {"fp": T.LongType()}, lambda: lambda texts: [[fingerprint(x) for x in texts]]
    )
    return rows.select("doc_id", "fp")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence, offset to sort as signed."""
    rank = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return (rank ^ np.uint64(1 << 63)).view(np.int64)


def _rotate(codes: np.ndarray, left: int) -> np.ndarray:
    codes = codes.view(np.uint64)
    if not left:
        return codes
    return (codes << np.uint64(left)) | (codes >> np.uint64(64 - left))


class Tree:
    """Codes sorted by (field, Gray rank), with a root for each field.

    A level holds ``(mask, value, first child)`` of its nodes; ``levels[0]`` are the codes.
    """

    def __init__(self, fields: np.ndarray, codes: np.ndarray):
        begins = np.nonzero(np.concatenate(([True], np.diff(fields) != 0)))[0]
        place = np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))
        self.levels = [(np.full(codes.shape, ~np.uint64(0)), codes, np.arange(len(codes) + 1))]
        owner, every, some = fields, codes, codes
        while place.max() > 0:
            place = place // FAN
            first = np.nonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(place) != 0))))[0]
            below = len(owner)
            every, some = np.bitwise_and.reduceat(every, first, axis=0), np.bitwise_or.reduceat(some, first, axis=0)
            owner, place = owner[first], place[first]
            self.levels.append((~(every ^ some), every, np.append(first, below)))


def descend(one: Tree, other: Tree, radius: int, visits: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of codes at most ``radius`` apart, as arrays ``(place in one, place in other, distance)``.

    With one tree for both, pairs inside each of its fields, each once; else pairs between
    the two trees' only fields.  ``visits`` gets ``(pairs met, pairs dropped)`` of each step.
    """
    same, roots = one is other, np.arange(len(one.levels[-1][1]))
    known = np.zeros((len(roots), one.levels[0][1].shape[1]), np.uint64)
    stack = [(len(one.levels) - 1, len(other.levels) - 1, roots, roots, known, np.zeros(len(roots), np.int64))]
    while stack:
        i, j, a, b, known, apart = stack.pop()
        if len(a) > STEP and (i or j):
            stack += [(i, j, *(x[at : at + STEP] for x in (a, b, known, apart))) for at in range(0, len(a), STEP)]
            continue
        both = one.levels[i][0][a] & other.levels[j][0][b]
        new = (one.levels[i][1][a] ^ other.levels[j][1][b]) & both & ~known
        apart = apart + np.bitwise_count(new).sum(1, dtype=np.int64)
        near = apart <= radius
        if visits is not None:
            visits.append((len(a), int((~near).sum())))
        a, b, both, apart = a[near], b[near], both[near], apart[near]
        if i == 0 and j == 0:
            if same:
                a, b, apart = (x[a != b] for x in (a, b, apart))
            if len(a):
                yield a, b, apart
            continue
        # the higher side opens, both where they stand level
        down_i, down_j = int(i >= j), int(j >= i)
        a_first, b_first = (one.levels[i][2] if down_i else np.arange(len(one.levels[i][1]) + 1)), (other.levels[j][2] if down_j else np.arange(len(other.levels[j][1]) + 1))
        a_n, b_n = np.diff(a_first)[a], np.diff(b_first)[b]
        n = a_n * b_n
        of = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        x, y = a_first[a][of] + at // b_n[of], b_first[b][of] + at % b_n[of]
        if same:
            once = x <= y
            of, x, y = of[once], x[once], y[once]
        if len(x):
            stack.append((i - down_i, j - down_j, x, y, both[of], apart[of]))


def settle(top: np.ndarray) -> np.ndarray:
    """Each place's root, from parents that are never larger."""
    while True:
        above = top[top]
        if (above == top).all():
            return top
        top = above


def span(top: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join ``x`` and ``y`` in ``top`` (changed in place); which pairs did so, and the roots are settled after."""
    took = [np.zeros(0, np.int64)]
    at = np.arange(len(x))
    while True:
        top[:] = settle(top)
        p, q = top[x[at]], top[y[at]]
        at, p, q = (z[p != q] for z in (at, p, q))
        if not len(at):
            took = np.concatenate(took)
            return x[took], y[took]
        high, first = np.unique(np.maximum(p, q), return_index=True)
        top[high] = np.minimum(p, q)[first]
        took.append(at[first])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value begins in them (and the last one's end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


Check = Callable[[list, np.ndarray, np.ndarray], np.ndarray]


def _linked(tree: list, other: list | None, loads: list | None, radius: int, check: Check | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning set of the links in one tree, or between two (the other's places follow the first's)."""
    one = Tree(*tree)
    two = Tree(*other) if other else one
    shift = len(tree[0]) if other else 0
    top = np.arange(len(tree[0]) + (len(other[0]) if other else 0))
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y, apart in descend(one, two, radius):
        y = y + shift
        if check is None:
            x, y = span(top, x, y)
        else:  # nearest first; what is joined by then needs no check
            order, good_x, good_y = np.argsort(apart, kind="stable"), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            x, y = x[order], y[order]
            while len(x):
                head_x, head_y = x[:CHECKED], y[:CHECKED]
                good = check(loads, head_x, head_y)
                for held, z in zip((good_x, good_y), span(top, head_x[good], head_y[good]), strict=True):
                    held.append(z)
                x, y = x[CHECKED:], y[CHECKED:]
                apart_still = top[x] != top[y]
                x, y = x[apart_still], y[apart_still]
            x, y = np.concatenate(good_x), np.concatenate(good_y)
        u.append(x)
        v.append(y)
    return np.concatenate(u), np.concatenate(v)


def _stars(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked id with the smallest id it reaches."""
    top = np.arange(len(ids))
    span(top, u, v)
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, top, ids)
    least = least[top]
    moved = ids != least
    return ids[moved], least[moved]


def _masks(words: int) -> list[str]:
    return [f"{kind}{w}" for kind in ("every", "some") for w in range(words)]


def _indexed_schema(words: int) -> str:
    return ", ".join(["field long", "branch long", *(f"{m} long" for m in _masks(words)), "ids binary", "codes binary", "loads array<binary>", "u long", "v long"])


def _index(words: int, radius: int, check: Check | None):
    names = [x.split()[0] for x in _indexed_schema(words).split(", ")]
    kinds = [pa.int64()] * (2 + 2 * words) + [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def links_of(fields: np.ndarray, ids: np.ndarray, codes: np.ndarray, loads: list | None) -> pa.RecordBatch | None:
            u, v = _linked([fields, codes], None, loads, radius, check)
            if not len(u):
                return None
            u, v = _stars(ids, u, v)
            empty = [pa.nulls(len(u), k) for k in kinds[:-2]]
            return pa.RecordBatch.from_arrays([*empty, pa.array(u), pa.array(v)], names=names)

        def branch(fields: np.ndarray, ids: np.ndarray, codes: np.ndarray, loads: list | None) -> pa.RecordBatch:
            nonlocal number
            number += 1
            masks = np.concatenate((np.bitwise_and.reduce(codes, axis=0), np.bitwise_or.reduce(codes, axis=0))).view(np.int64)
            row = [int(fields[0]), number, *masks.tolist(), ids.tobytes(), codes.tobytes(), loads, None, None]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        def parts(fields: np.ndarray, ids: np.ndarray, codes: np.ndarray, loads: list | None) -> Iterator[slice]:
            """Pieces of one field that are no larger than a branch may be."""
            weigh = np.cumsum([len(x) for x in loads]) // BRANCH_BYTES if loads is not None else np.zeros(len(ids), np.int64)
            begin = 0
            for end in [*(np.nonzero(np.diff(weigh))[0] + 1).tolist(), len(ids)]:
                for at in range(begin, end, BRANCH):
                    yield slice(at, min(end, at + BRANCH))
                begin = end

        def cut(rows: tuple) -> Iterator[pa.RecordBatch]:
            for piece in parts(*rows):
                part = tuple(None if x is None else x[piece] for x in rows)
                yield branch(*part)
                yield links_of(*part)

        def closed(rows: tuple, first: bool) -> Iterator[pa.RecordBatch]:
            """Whole fields; the first of a task may have begun in the task before."""
            fields = rows[0]
            begins = np.nonzero(np.concatenate(([True], np.diff(fields) != 0)))[0]
            if first:
                end = begins[1] if len(begins) > 1 else len(fields)
                yield from cut(tuple(None if x is None else x[:end] for x in rows))
                rows = tuple(None if x is None else x[end:] for x in rows)
                fields, begins = rows[0], begins[1:] - end
            n = np.diff(np.append(begins, len(fields)))
            keep = np.nonzero(np.repeat(n > 1, n))[0]
            if len(keep):
                loads = None if rows[3] is None else [rows[3][i] for i in keep.tolist()]
                yield links_of(fields[keep], rows[1][keep], rows[2][keep], loads)

        held: tuple | None = None
        first, begun = True, False  # whether the held field may go on from the task before, or was cut already
        for batch in batches:
            codes = bytes_of(batch.column("code"))[0].view(np.uint64).reshape(-1, words)
            loads = batch.column("load").to_pylist() if check else None
            rows = (batch.column("field").to_numpy(), batch.column("id").to_numpy(), codes, loads)
            if held is not None:
                rows = tuple(None if y is None else x + y if isinstance(y, list) else np.concatenate((x, y)) for x, y in zip(held, rows, strict=True))
            if not len(rows[0]):
                continue
            changes = np.nonzero(np.diff(rows[0]))[0]
            at = int(changes[-1]) + 1 if len(changes) else 0
            if at:
                ready = tuple(None if x is None else x[:at] for x in rows)
                yield from filter(None, closed(ready, first or begun))
                first = begun = False
            held = tuple(None if x is None else x[at:] for x in rows)
            if len(held[0]) >= BRANCH or (held[3] is not None and sum(map(len, held[3])) >= BRANCH_BYTES):
                yield from filter(None, cut(held))
                held, begun = tuple(None if x is None else x[:0] for x in held), True
        if held is not None and len(held[0]):
            yield from filter(None, cut(held))

    return run


def _across(branches: DataFrame, words: int, radius: int) -> DataFrame:
    """``(a, b)``: pairs of branches of one field that may hold linked codes."""
    some = [F.bit_and(m).alias(m) if m.startswith("every") else F.bit_or(m).alias(m) for m in _masks(words)]
    slim = branches.select("field", "branch", F.expr(f"shiftright(branch, {UP})").alias("up"), *_masks(words))
    uppers = slim.groupBy("field", "up").agg(*some)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{name}_{c}" for c in [*_masks(words), "up", "branch"]})

    def compared(pairs: DataFrame, known: bool) -> DataFrame:
        """Adds the differences in newly fixed bits, and keeps the bits now known."""
        both = [F.expr(f"~(a_every{w} ^ a_some{w}) & ~(b_every{w} ^ b_some{w})" + (f" & ~known{w}" if known else "")) for w in range(words)]
        apart: Column = F.col("apart") if known else F.lit(0)
        for w in range(words):
            apart = apart + F.bit_count(F.col(f"a_every{w}").bitwiseXOR(F.col(f"b_every{w}")).bitwiseAND(both[w]))
        fixed = [both[w].alias(f"known{w}") for w in range(words)]
        return pairs.select("field", *(c for c in pairs.columns if c.endswith(("_up", "_branch"))), apart.alias("apart"), *fixed).where(F.col("apart") <= radius)

    pairs = side(uppers, "a").join(side(uppers, "b"), "field").where("a_up <= b_up")
    pairs = compared(pairs, False)
    pairs = pairs.join(side(slim, "a"), ["field", "a_up"]).join(side(slim, "b"), ["field", "b_up"]).where("a_branch < b_branch")
    return compared(pairs, True).select(F.col("a_branch").alias("a"), F.col("b_branch").alias("b"))


def _compare(words: int, radius: int, check: Check | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("a_ids", "a_codes", "a_loads", "b_ids", "b_codes", "b_loads")
        for batch in batches:
            for row in zip(*(batch.column(k) for k in names), strict=True):
                a, p, s, b, q, t = (x.as_py() for x in row)
                ids = np.concatenate((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))
                trees = [[np.zeros(len(x) // (8 * words), np.int64), np.frombuffer(x, np.uint64).reshape(-1, words)] for x in (p, q)]
                u, v = _linked(*trees, s + t if check else None, radius, check)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(ids, u, v)], names=["u", "v"])

    return run


def index_links(filed: DataFrame, words: int, radius: int, check: Check | None = None) -> DataFrame:
    """Pairs ``(u, v)`` of ids that join what the links of ``filed(field, rank, id, code[, load])`` join.

    Two ids are linked if some field holds both, their codes (``words`` 64-bit words)
    differ in at most ``radius`` bits and, where ``check(loads, places, places)`` is given, it
    says so of what travels with them.  An id may be filed under many fields.
    """
    placed = filed.repartitionByRange("field", "rank").sortWithinPartitions("field", "rank")
    built = staged(placed.mapInArrow(_index(words, radius, check), _indexed_schema(words)), "simhash-index")
    inside = built.where("u is not null").select("u", "v")
    branches = built.where("branch is not null")
    whole = branches.select("branch", "ids", "codes", "loads")
    pairs = _across(branches, words, radius)
    for side in "ab":
        pairs = pairs.join(whole.withColumnsRenamed({"branch": side} | {c: f"{side}_{c}" for c in ("ids", "codes", "loads")}), side)
    return inside.unionByName(pairs.mapInArrow(_compare(words, radius, check), "u long, v long"))


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(u, v)`` that join what the links between the fingerprints in ``distinct(fp)`` join."""
    offsets = _FIELDS[bits]
    widths = [b - a for a, b in zip(offsets, [*offsets[1:], 64], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            for k, (left, width) in enumerate(zip(offsets, widths, strict=True)):
                turned = _rotate(codes, left)
                field = (turned >> np.uint64(64 - width)).astype(np.int64) + (k << 32)
                code = pa.Array.from_buffers(pa.binary(8), len(codes), [None, pa.py_buffer(turned.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(field), pa.array(gray_rank(turned)), pa.array(codes), code], names=["field", "rank", "id", "code"])

    return index_links(distinct.select("fp").mapInArrow(run, "field long, rank long, id long, code binary"), 1, bits)


def near_duplicates(docs: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs(doc_id, text)``."""
    prints = staged(fingerprints(docs), "simhash")
    reps = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    # a fingerprint without an id stands for itself, after all that have one
    node = F.struct(F.col("rep").isNull().alias("nameless"), F.coalesce("rep", "fp").alias("id"))
    nodes = reps.select("fp", node.alias("node"))
    edges = (
        links(reps, bits)
        .distinct()
        .join(nodes.withColumnsRenamed({"fp": "u", "node": "nu"}), "u")
        .join(nodes.withColumnsRenamed({"fp": "v", "node": "nv"}), "v")
        .select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    )
    of_print = nodes.join(connected_components(edges), "node", "left").withColumn("top", F.coalesce("component", "node"))
    of_print = of_print.select("fp", F.when(~F.col("top.nameless"), F.col("top.id")).alias("component_id"))
    return prints.join(of_print, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row of each near-duplicate group that has the smallest doc_id; rows without an id stay."""
    found = near_duplicates(docs)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    nameless = docs.where("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(nameless)


def op1_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
