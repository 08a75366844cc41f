"""Suffix-array dedup: bytes covered by a long string that occurs elsewhere, by longest-previous-factor arrays.

A *window* is a string of ``LENGTH`` bytes.  A window that also starts at another
place, in the same text or another one, is repeated.  Which windows are is found
in suffix order, but no task ever sorts the suffixes of the corpus:

1. Each window names an anchor, the least hash of the strings of ``GRAMS[0]`` bytes in
   it, so equal windows name equal anchors at equal places.  Neighbouring windows
   with the same anchor form a *context*, the bytes that they cover.  Only hashes
   of anchors and contexts leave the tasks (one context in about 65 bytes).
2. Anchors that occur once go.  Equal contexts fall into one class: all windows of
   a class of two or more are repeated, and its first member stands for it.  Copies
   of any number thus cost one aggregation, whatever they are copies of.
3. Members that stand for classes of one anchor are fetched with their bytes, sorted
   in suffix order, and compared with their neighbours there.  For each window the
   nearest smaller positions before and after it in suffix order give its longest
   previous factor, the length of the longest match that begins earlier; the nearest
   larger positions give the longest next factor.  A window is repeated if either
   reaches ``LENGTH``; it is a later copy if the first does.
4. An anchor of more than ``BLOCK`` classes (one passage in a third of all texts) is cut finer:
   its classes name longer anchors, and steps 2 and 3 are repeated with what these hold, up to
   anchors as long as a window, where equal windows are one class and nothing is left to compare.

``removed`` takes either every repeated window out (what the query asks) or, with
``keep_first``, later copies only.  Windows overlap and may cover bytes more than once;
they are judged on the input.  Anchors and contexts are told apart by 128 bits in all.

Defined results: a null text is empty.  Texts shorter than a window lose nothing.
Bytes are those of UTF-8, and a run may begin or end inside a character, so what is
kept is bytes.  Positions are ordered by doc_id (null last), then text, then offset.
Repeated rows occur elsewhere, namely in each other; with ``keep_first`` rows of equal
id and text are one document and keep the same bytes.  Long texts are read in pieces that
overlap by a window, so memory does not grow with them beyond the text itself.
An empty table gives an empty result.  Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.simhash import bytes_of
from plumbline.staging import staged, table

LENGTH = 200
#: Bytes of an anchor, and of those that crowded ones are cut by: longer ones name fewer false partners, shorter ones are fewer.
GRAMS = (64, 128, 192, LENGTH)
#: Classes of one anchor that a task sorts.
BLOCK = 1024
#: Windows whose hashes, and whose suffixes, a task holds at once.
STEP = 1 << 20
SORTED = 1 << 16

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@functools.lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=2)
def _powers(log: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, modulo 2^64."""
    found = []
    for base in _ODD:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full((1 << log) + 1, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        found.append(tuple(both))
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Sums:
    """Prefix sums that give the hash of any string of some bytes."""

    def __init__(self, data: np.ndarray, which: int):
        forth, self.back = _powers(max(1, len(data).bit_length()))[which]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[which][data] * forth[: len(data)], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.back[begin])


def contexts(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(first window, number of windows, anchor's hash, context's hash)`` of the texts that end at ``ends`` in ``data``."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sizes = np.diff(ends, prepend=0)
    left = np.repeat(ends, sizes) - np.arange(len(data))  # bytes up to the text's end
    one = Sums(data, 0)
    n = len(data) - gram + 1
    least = one.hashes(np.arange(n), np.arange(gram, len(data) + 1))
    least[left[:n] < gram] = ~np.uint64(0)
    anchors, place, width, span = least, np.arange(n), 1, length - gram + 1
    while width < span:  # the least hash in ever wider spans, the last of equal ones
        step = min(width, span - width)
        low, high = least[:-step], least[step:]
        later = high <= low
        least, place, width = np.where(later, high, low), np.where(later, place[step:], place[:-step]), width + step
    window = np.nonzero(left[: len(place)] >= length)[0]
    if not len(window):
        return contexts(data[:0], ends[:0], length, gram)
    place = place[window]
    begins = np.nonzero(np.concatenate(([True], (np.diff(place) != 0) | (np.diff(window) != 1))))[0]
    first, last = window[begins], window[np.append(begins[1:], len(window)) - 1]
    size, at = last - first + 1, place[begins]
    whole = Sums(data, 1).hashes(first, last + length)
    whole ^= _mixed((size * (length + 1) + at - first).astype(np.uint64))
    return first, size, anchors[at], whole


def _pieces(offsets: np.ndarray, length: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first text, last text + 1, begin, end)``: whole texts of about ``step`` bytes, or overlapping pieces of a longer one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1)
        for begin in range(int(offsets[i]), int(offsets[j]), step) if offsets[j] - offsets[i] > step else [int(offsets[i])]:
            yield i, j, begin, min(begin + step + length - 1, int(offsets[j])) if j == i + 1 else int(offsets[j])
        i = j


def _keyed(docs: DataFrame, keep_first: bool) -> DataFrame:
    """``(d, rank, doc_id, text)``: rows of equal id and text share the key ``d``; ``rank`` orders documents."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).max)) if keep_first else F.lit(0).cast("long")
    return docs.select(F.unhex(F.md5(name)).alias("d"), rank.alias("rank"), "doc_id", "text")


_SEEN = "d binary, rank long, place long, h long, c long"
#: ``place`` is an offset in the text and a number of windows less one, so windows of one anchor are 256 at most.
_BITS = 8


def _seen(length: int, gram: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            for i, j, begin, end in _pieces(offsets, length, step):
                ends = np.minimum(offsets[i + 1 : j + 1], end) - begin
                first, size, h, c = contexts(data[begin:end], ends, length, gram)
                of = i + np.searchsorted(ends, first, side="right")
                place = ((first + begin - offsets[of]) << _BITS) + size - 1
                rows = [batch.column("d").take(pa.array(of)), batch.column("rank").take(pa.array(of)), pa.array(place), pa.array(h.view(np.int64)), pa.array(c.view(np.int64))]
                yield pa.RecordBatch.from_arrays(rows, names=["d", "rank", "place", "h", "c"])

    return run


_SLICE = "level int, h long, c long, rank long, d binary, place long, bytes binary"


def _slices(level: int, h: list, c: list, rank: pa.Array, d: pa.Array, place: np.ndarray, kept: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array([level] * len(kept), pa.int32()), pa.array(h, pa.int64()), pa.array(c, pa.int64()), rank, d, pa.array(place, pa.int64()), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SLICE.split(", ")])


def _finer(level: int, rank: pa.Array, d: pa.Array, offset: np.ndarray, kept: list[bytes], length: int, gram: int) -> pa.RecordBatch:
    """What some contexts hold, under longer anchors."""
    sizes = np.array([len(x) for x in kept], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(kept), np.uint8)
    first, size, h, c = contexts(data, ends, length, gram)
    of = np.searchsorted(ends, first, side="right")
    place = ((first - (ends - sizes)[of] + offset[of]) << _BITS) + size - 1
    parts = [data[a : a + n].tobytes() for a, n in zip(first.tolist(), (size + length - 1).tolist(), strict=True)]
    return _slices(level, h.view(np.int64), c.view(np.int64), rank.take(pa.array(of)), d.take(pa.array(of)), place, parts)


def _fetched(length: int, gram: int):
    """The bytes of the contexts that a text is asked for; those of crowded anchors are cut by longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            asked = batch.column("asked")
            counts = np.diff(np.asarray(asked.offsets))
            flat = asked.flatten()
            every = np.repeat(np.arange(batch.num_rows), counts)
            crowded = flat.field("crowded").to_numpy(zero_copy_only=False)
            for at in (np.nonzero(~crowded)[0], np.nonzero(crowded)[0]):
                of, rows = pa.array(every[at]), flat.take(pa.array(at))
                place = rows.field("place").to_numpy()
                begin = offsets[every[at]] + (place >> _BITS)
                size = (place & ((1 << _BITS) - 1)) + length
                kept = [data[a : a + n].tobytes() for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
                rank, d = batch.column("rank").take(of), batch.column("d").take(of)
                if len(at) and crowded[at[0]]:
                    yield _finer(2, rank, d, place >> _BITS, kept, length, gram)
                elif len(at):
                    yield _slices(1, rows.field("h"), rows.field("c"), rank, d, place, kept)

    return run


def _cut_finer(level: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            yield _finer(level, batch.column("rank"), batch.column("d"), place >> _BITS, batch.column("bytes").to_pylist(), length, gram)

    return run


def suffix_order(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows inside their groups, equal ones by position, and how far each agrees with the one before."""
    named = np.concatenate((groups.astype(">u4").view(np.uint8).reshape(-1, 4), rows), axis=1)
    order = np.argsort(named.view(f"S{named.shape[1]}").ravel(), kind="stable")
    named = named[order]
    differ = named[1:] != named[:-1]
    agree = np.where(differ.any(1), differ.argmax(1), named.shape[1]) - 4
    return order, np.concatenate(([0], np.maximum(agree, 0)))


def _nearest_smaller(position: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """How far each suffix agrees with the nearest one before it that begins at a smaller position."""
    at, low = np.arange(len(position)) - 1, agree.copy()
    while True:
        past = np.nonzero((at >= 0) & (position[at] > position))[0]
        if not len(past):
            return np.where(at < 0, 0, low)
        over = at[past]
        low[past], at[past] = np.minimum(low[past], low[over]), at[over]


def longest_previous_factors(position: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Longest match of each suffix, in suffix order, with one at a smaller position."""
    after = np.concatenate((agree[1:], [0]))[::-1] if len(agree) else agree
    return np.maximum(_nearest_smaller(position, agree), _nearest_smaller(position[::-1], after)[::-1])


def _factored(length: int, keep_first: bool, most: int):
    """Runs of repeated windows in the contexts of each anchor."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[3:6])  # by position
        number = {x: i for i, x in enumerate(sorted({r[:2] for r in rows}))}
        sizes = np.array([len(r[6]) - length + 1 for r in rows])
        starts = np.cumsum([0, *(len(r[6]) for r in rows[:-1])])
        of = np.repeat(np.arange(len(rows)), sizes)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(flat, length)[starts[of] + inside]
        order, agree = suffix_order(windows, np.array([number[r[:2]] for r in rows])[of])
        repeated = np.empty(len(of), bool)
        factors = longest_previous_factors(order, agree)
        repeated[order] = (factors if keep_first else np.maximum(factors, longest_previous_factors(-order, agree))) >= length
        hit = np.nonzero(repeated)[0]
        first = np.nonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(of[hit]) != 0))))[0] if len(hit) else hit
        a, b = (hit[first], hit[np.append(first[1:], len(hit)) - 1]) if len(hit) else (hit, hit)
        offset = np.array([r[5] >> _BITS for r in rows])[of] + inside
        columns = [pa.array([rows[i][4] for i in of[a].tolist()], pa.binary()), pa.array(offset[a]), pa.array(offset[b] + length)]
        return pa.RecordBatch.from_arrays(columns, names=["d", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] == held[-1][:3]:
                    continue  # the same class, fetched for a repeated row
                if row[:2] != last:
                    if size >= most:
                        yield found(held)
                        held, size = [], 0
                    last = row[:2]
                held.append(row)
                size += len(row[6]) - length + 1
        if held:
            yield found(held)

    return run


def _classes(rows: DataFrame, first: Column) -> tuple[DataFrame, DataFrame]:
    """``(h, c, n, first)`` of the contexts, and ``(h, m)`` of the anchors that hold several kinds; both written."""
    found = staged(rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(first).alias("first")), "classes")
    return found, staged(found.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "crowds")


def spans(docs: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, keep_first: bool = False, block: int = BLOCK, step: int = STEP, most: int = SORTED) -> tuple[DataFrame, DataFrame]:
    """``_keyed(docs)``, and ``(d, spans)`` with what to take out of each, in any order and overlapping."""
    if list(grams) != sorted(grams) or grams[-1] != length or length - grams[0] >= 1 << _BITS:
        raise ValueError("anchors grow up to the length of a window, and the first are at most 255 bytes shorter")
    texts = _keyed(docs, keep_first)
    seen = staged(texts.select("d", "rank", "text").mapInArrow(_seen(length, grams[0], step), _SEEN), "contexts")
    # both sides of the next join are tables, so that a hot anchor can be split
    often = staged(seen.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "anchors")
    met = staged(seen.join(often, "h", "left_semi"), "contexts-met")
    place = F.struct("rank", "d", "place")
    begin, size = F.shiftright("place", _BITS), F.col("place").bitwiseAND(F.lit((1 << _BITS) - 1))

    def whole(rows: DataFrame, classes: DataFrame) -> DataFrame:
        """What the members of classes of two or more cover."""
        named = F.struct("first.rank", "first.d", "first.place").alias("first")
        rows = rows.join(classes.where("n > 1").select("h", "c", named), ["h", "c"])
        rows = rows.where(place > F.col("first")) if keep_first else rows
        return rows.select("d", begin.alias("begin"), (begin + size + length).alias("end"))

    classes, crowds = _classes(met, place)
    every = [whole(met, classes)]
    asked = classes.join(crowds, "h").select("first.d", F.struct("h", "c", "first.place", (F.col("m") > block).alias("crowded")).alias("x"))
    asked = asked.groupBy("d").agg(F.collect_list("x").alias("asked"))  # no more than the text has contexts
    rows = staged(texts.select("d", "rank", "doc_id", "text").join(asked, "d").mapInArrow(_fetched(length, grams[1]), _SLICE), "slices")
    few, fields = rows.where("level = 1"), [x.split()[0] for x in _SLICE.split(", ")]
    rows = rows.where("level = 2")
    for level in range(2, len(grams) + 1):
        if rows.isEmpty():  # no anchor is crowded any more
            break
        rows = rows.dropDuplicates(["h", "c", "d", "place"])
        classes, crowds = _classes(rows, F.struct("rank", "d", "place", "bytes"))
        every.append(whole(rows, classes))
        ones = classes.join(crowds, "h").select(F.lit(level).alias("level"), "h", "c", "first.*", "m")
        few = few.unionByName(ones.where(F.col("m") <= block).select(fields))
        if level < len(grams):
            rows = staged(ones.where(F.col("m") > block).mapInArrow(_cut_finer(level + 1, length, grams[level]), _SLICE), "slices")
    dealt = few.repartition("level", "h").sortWithinPartitions("level", "h", "c")
    every.append(dealt.mapInArrow(_factored(length, keep_first, most), "d binary, begin long, end long"))
    return texts, functools.reduce(DataFrame.unionByName, every).groupBy("d").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def _kept(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OUT]
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans")), strict=True):
                raw = (text.as_py() or "").encode()
                merged: list[list[int]] = []
                for x in sorted((s["begin"], s["end"]) for s in spans.as_py() or []):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                cuts = [0, *(y for x in merged for y in x), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                held = [{"begin": a, "end": b} for a, b in merged]
                rows.append((doc.as_py(), len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), held, kept if keep_bytes else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary())
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 256]], kind) for k, kind in enumerate(kinds)], names=names)

    return run


_OUT = ("doc_id long", "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "spans array<struct<begin: long, end: long>>", "kept binary")


def removed(docs: DataFrame, keep_first: bool = False, keep_bytes: bool = True, **sizes: int) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept)`` for each row of ``docs(doc_id, text)``.

    ``spans`` are the maximal runs of bytes taken out.  ``keep_bytes=False`` leaves ``kept`` null.
    """
    texts, found = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), keep_first=keep_first, **sizes)
    rows = texts.select("d", "rank", "doc_id", "text").join(found, "d", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_kept(keep_bytes), ", ".join(_OUT))


def op13_longest_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed(table(spark, sf_dir, "documents"), keep_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
