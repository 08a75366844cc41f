"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the last 32 bytes hits, so
the same passage is cut alike in every document that holds it.  Chunks that
occur more than once anywhere are encoded once; everything between them is
encoded where it lies.  Parts meet at arbitrary places, so each joint is
re-encoded over a window that grows until the new tokens agree with those
already held on both sides of it.  A joint touches its two edges only, so a text
of many parts is joined in time linear in its length.

Why agreement at anchors is exact: white space after a printable ASCII character
(or an ideographic comma after an ideograph) always ends a pre-token, whatever
stands around it, and scanning from there on does not look back.  Tokens between
two anchors are thus the same in any text that holds them; only tokens between a
joint and its nearest anchors can differ.

How data moves:

* pass 1 reads the texts and counts 128-bit chunk digests (24 bytes a chunk);
* a bitmap of repeated digests of fixed size (``BITMAP_BITS``) is broadcast.  A
  false hit only means that a unique chunk takes the shared path;
* pass 2 encodes documents without repeated chunks on the spot.  The others
  are written as parts to the shared folder;
* repeated chunks are deduplicated, encoded, and joined to the parts by
  digest (a hot chunk meets a skew-splittable join), and each document's parts
  are gathered by its own row key and merged.

Ids are those of the byte-level BPE file under ``path``; special token strings
in a text become their own ids, as the tokenizers library does by default.

Defined results: a null or empty text has no tokens and the digests of the
empty string.  Repeated rows give a row each.  An empty table gives an empty
result.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.staging import staged, table

VOCABULARY = "byte_bpe_50k.json"
#: Chunk sizes in bytes: least, mean (a power of two), most.
CHUNK = (256, 1024, 16384)
#: White space of the pre-token pattern. The pattern keeps a stack entry for each character of a run, so runs from ``LONG_RUN`` on go round it.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 1 << 14
_long_runs = re.compile(rf"{SPACE}(?<!{SPACE}{{2}}){SPACE}{{{LONG_RUN - 1},}}").finditer
BITMAP_BITS = 1 << 27
WINDOW = 16


def _byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def codec(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder for a tokenizers file of a byte-level BPE, and each token's length in bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbol = _byte_symbols()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {k: v for k, v in spec["model"]["vocab"].items() if k not in special}
    ranks = {bytes(symbol[c] for c in k): v for k, v in tokens.items()}
    found = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    sizes = np.zeros(found.n_vocab, np.int64)
    for k, v in ranks.items():
        sizes[v] = len(k)
    for k, v in special.items():
        sizes[v] = len(k.encode())
    return found, sizes


def encode_text(path: str, text: str) -> list[int]:
    """Ids of one text.  A long run of white space is one pre-token but for its last
    character, which begins the next one, unless the text or a special token ends the run."""
    coder = codec(path)[0]
    if len(text) < LONG_RUN:
        return coder.encode(text, allowed_special="all")
    out, begin = [], 0
    for run in _long_runs(text):
        end = run.end()
        if end < len(text) and not text.startswith(tuple(coder.special_tokens_set), end):
            end -= 1
        out += coder.encode(text[begin : run.start()], allowed_special="all")
        out += coder._encode_single_piece(text[run.start() : end])
        begin = end
    return out + coder.encode(text[begin:], allowed_special="all")


_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(raw: bytes, chunk: tuple[int, int, int] = CHUNK) -> list[int]:
    """Ends of the content-defined chunks of ``raw`` (UTF-8), the last one included."""
    least, mean, most = chunk
    if len(raw) <= least:
        return [len(raw)] if raw else []
    data = np.frombuffer(raw, np.uint8)
    rolled = _GEAR[data]
    for step in (1, 2, 4, 8, 16):  # hash of 32 bytes by doubling
        rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint32(step))
    hits = np.nonzero((rolled[:-1] >> np.uint32(32 - mean.bit_length() + 1)) == 0)[0] + 1
    hits = hits[(data[hits] & 0xC0) != 0x80]  # a character stays whole
    found, begin = [], 0
    for hit in [*hits.tolist(), len(raw)]:
        while hit - begin > most:
            end = begin + most
            while (data[end] & 0xC0) == 0x80:
                end -= 1
            found.append(end)
            begin = end
        if hit - begin >= least or hit == len(raw):
            found.append(hit)
            begin = hit
    return found


def _digests(raw: bytes, ends: list[int]) -> np.ndarray:
    """Two signed words a chunk."""
    begin, found = 0, []
    for end in ends:
        found.append(xxhash.xxh3_128_digest(raw[begin:end]))
        begin = end
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def _anchors(raw: bytes) -> np.ndarray:
    """Offsets at which a pre-token ends whatever stands around: white space after a
    printable ASCII character, and an ideographic comma or stop after an ideograph."""
    data = np.frombuffer(raw, np.uint8)
    blank = (data[1:] == 32) | ((data[1:] >= 9) & (data[1:] <= 13))
    found = np.nonzero(blank & (data[:-1] > 32) & (data[:-1] < 127))[0] + 1
    if len(data) > 5 and data.max() >= 0xE3:
        mark = ((data[3:-2] == 0xE3) & (data[4:-1] == 0x80) & ((data[5:] == 0x81) | (data[5:] == 0x82))) | ((data[3:-2] == 0xEF) & (data[4:-1] == 0xBC) & (data[5:] == 0x8C))
        found = np.union1d(found, np.nonzero(mark & (data[:-5] >= 0xE5) & (data[:-5] <= 0xE8))[0] + 3)
    return found


def _edge(path: str, ids: list[int], tail: bool) -> tuple[int, list[int], bytes] | None:
    """Where a part's own tokens begin (or end, for its tail) to hold in any text.

    Returns the place of the second anchor from that edge, the tokens between the two
    anchors next to it, and the bytes from it to the edge.  None: fewer than two anchors.
    """
    coder, sizes = codec(path)
    k = WINDOW
    while True:
        window = ids[-k:] if tail else ids[:k]
        raw = coder.decode_bytes(window)
        found = _anchors(raw)
        if not tail:
            found = found[found < len(raw) - 1]  # the window's last character may go on
        if len(found) > 1:
            ends = np.cumsum(sizes[window])
            far, near = (found[-2], found[-1]) if tail else (found[1], found[0])
            at, guard = (int(np.searchsorted(ends, x)) for x in (far, near))
            if ends[at] != far or ends[guard] != near:
                return None
            at, guard = at + 1, guard + 1
            if tail:
                return len(ids) - len(window) + at, window[at:guard], raw[far:]
            return at, window[guard:at], raw[:far]
        if len(window) == len(ids):
            return None
        k *= 4


def join(path: str, parts: list[list[int]]) -> list[int]:
    """Tokens of the joined text of parts that were encoded alone.

    Around each joint the text between the second anchors on both sides is encoded
    again, once, and has to agree with the tokens that the parts hold between their two
    anchors.  A part with too few anchors belongs to the joints beside it.  Where a
    joint does not agree the whole text is encoded.
    """
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return parts[0] if parts else []
    coder, _ = codec(path)
    out: list[int] = []
    region, guard_left = [], []
    for i, ids in enumerate(parts):
        first, last = i == 0, i == len(parts) - 1
        head = (0, [], b"") if first else _edge(path, ids, False)
        tail = (len(ids), [], b"") if last else _edge(path, ids, True)
        if head is None or tail is None or head[0] > tail[0]:
            region.append(coder.decode_bytes(ids))
            continue
        new = encode_text(path, b"".join([*region, head[2]]).decode())
        if new[: len(guard_left)] != guard_left or (head[1] and new[-len(head[1]) :] != head[1]):
            break
        out += new
        out += ids[head[0] : tail[0]]
        region, guard_left = [tail[2]], tail[1]
    else:
        new = encode_text(path, b"".join(region).decode())
        if new[: len(guard_left)] == guard_left:
            return out + new
    return encode_text(path, b"".join(coder.decode_bytes(p) for p in parts).decode())


def _digest(coder: tiktoken.Encoding, ids: list[int]) -> tuple[int, str, str]:
    named = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return len(ids), named, hashlib.sha256(coder.decode_bytes(ids)).hexdigest()


_DONE = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
_PARTS = "parts array<struct<k1: long, k2: long, text: string, ids: array<int>>>"


def _done_batch(rows: list[tuple], keep_ids: bool) -> list[pa.Array]:
    doc, ids, digests = [r[0] for r in rows], [r[1] if keep_ids else None for r in rows], [r[2] for r in rows]
    kinds = (pa.int64(), pa.string(), pa.string())
    return [pa.array(doc, pa.int64()), *(pa.array([d[i] if d else None for d in digests], k) for i, k in enumerate(kinds)), pa.array(ids, pa.list_(pa.int32()))]


def _repeated(docs: DataFrame, chunk: tuple[int, int, int]) -> DataFrame:
    """Digests of the chunks that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_digests(raw, cuts(raw, chunk)) for text in batch.column(0).to_pylist() if (raw := (text or "").encode())]
            both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["k1", "k2"])

    seen = docs.select("text").mapInArrow(run, "k1 long, k2 long")
    return seen.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")


def _bitmap(repeated: DataFrame, bits: int) -> np.ndarray:
    """A bit for each repeated digest; at most ``bits / 64`` rows reach the driver."""
    slot = F.col("k1").bitwiseAND(F.lit(bits - 1))
    words = repeated.groupBy(F.shiftrightunsigned(slot, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(k1 & 63))")).alias("b")
    )
    found = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def _first_pass(path: str, bitmap, bits: int, chunk: tuple[int, int, int], keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = codec(path)
        marks, key = bitmap.value, TaskContext.get().partitionId() << 36
        parts_type = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32()))]))
        names = ["row_key", *(x.split()[0] for x in _DONE.split(", ")), "parts"]

        def batch_of(rows: list[tuple], keys: list[int], parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *_done_batch(rows, keep_ids), pa.array(parts, parts_type)], names=names)

        for batch in batches:
            rows, keys, parts, held = [], [], [], 0
            for doc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                text = text or ""
                raw = text.encode()
                ends = cuts(raw, chunk)
                names128 = _digests(raw, ends)
                slot = (names128[:, 0] & (bits - 1)).view(np.uint64)
                hit = (marks[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
                key += 1
                keys.append(key)
                held += len(raw)
                if not hit.any():
                    ids = encode_text(path, text)
                    rows.append((doc, ids, _digest(coder, ids)))
                    parts.append(None)
                else:
                    own, begin, found = 0, 0, []
                    for end, shared, (k1, k2) in zip(ends, hit.tolist(), names128.tolist(), strict=True):
                        if shared:
                            if begin > own:
                                found.append({"ids": encode_text(path, raw[own:begin].decode())})
                            found.append({"k1": k1, "k2": k2, "text": raw[begin:end].decode()})
                            own = end
                        begin = end
                    if own < len(raw):
                        found.append({"ids": encode_text(path, raw[own:].decode())})
                    rows.append((doc, None, None))
                    parts.append(found)
                if held > 4 << 20:
                    yield batch_of(rows, keys, parts)
                    rows, keys, parts, held = [], [], [], 0
            yield batch_of(rows, keys, parts)

    return run


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_text(path, x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(ids, pa.list_(pa.int32()))], names=["k1", "k2", "ids"])

    return run


def _merge_parts(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = codec(path)
        names = [x.split()[0] for x in _DONE.split(", ")]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for doc, parts in zip(*(batch.slice(i, 256).column(c).to_pylist() for c in ("doc_id", "parts")), strict=True):
                    ids = join(path, [p["ids"] for p in sorted(parts, key=lambda p: p["seq"])])
                    rows.append((doc, ids, _digest(coder, ids)))
                yield pa.RecordBatch.from_arrays(_done_batch(rows, keep_ids), names=names)

    return run


def encode(docs: DataFrame, path: str | None = None, chunk: tuple[int, int, int] = CHUNK, bits: int = BITMAP_BITS, keep_ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)`` for each row of ``docs(doc_id, text)``.

    ``keep_ids=False`` leaves ``ids`` null for callers that need digests only.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(_repeated(docs, chunk), bits))
    passed = staged(docs.mapInArrow(_first_pass(path, bitmap, bits, chunk, keep_ids), f"row_key long, {_DONE}, {_PARTS}"), "bpe-parts")
    done = passed.where("parts is null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")
    parts = passed.where("parts is not null").select("row_key", "doc_id", F.posexplode("parts").alias("seq", "p")).select("row_key", "doc_id", "seq", "p.*")
    shared = parts.where("k1 is not null")
    once = shared.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    coded = once.mapInArrow(_encode_chunks(path), "k1 long, k2 long, ids array<int>")
    filled = shared.select("row_key", "doc_id", "seq", "k1", "k2").join(coded, ["k1", "k2"]).select("row_key", "doc_id", "seq", "ids")
    whole = parts.where("k1 is null").select("row_key", "doc_id", "seq", "ids").unionByName(filled)
    whole = whole.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("seq", "ids")).alias("parts"))
    merged = whole.select("doc_id", "parts").mapInArrow(_merge_parts(path, keep_ids), _DONE)
    return done.unionByName(merged)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``, special tokens kept."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = codec(path)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op2_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
