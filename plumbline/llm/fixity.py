"""WARC records and Merkle fixity audit of replicas (DataFrame functions only).

A page becomes one WARC response record (header block, blank line, payload,
two line ends).  Records are laid out by id in segments of ``SEGMENT`` ids; a
record's offset is the sum of the lengths before it.  A segment of n records is dealt
by digest to ceil(n / ``SEGMENT``) parts, which is one unless ids are null or repeated; n is
the larger number of the replicas compared.  A lost record thus moves only those
of its own part, and no task orders a hot range alone.  Equal records are counted
and lie in one leaf, so copies of any number are one row.

Each part has a tree in each replica: a leaf hashes the record and its offset
range, an inner node hashes its up to ``FAN_OUT`` children in offset order
together with the range they span, until one node is left.  The audit compares
the roots of two replicas, then only children of nodes that differ, level by
level, until it has the leaves that differ.  ``compare`` tells what became of each: changed, missing,
added, moved, or held another number of times.
Trees are built by grouping on (segment, part, node), so no task holds more than
``FAN_OUT`` hashes of one node, and the payloads are read once and never
shuffled.

Defined results: null columns count as empty strings; a null id lies in segment
-1.  Repeated rows are copies of one leaf.  Of a null id it cannot be said that a record changed: it is
missing in one replica and added in the other.  An
empty table gives an empty result.  Other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.staging import staged, table

SEGMENT = 1024
FAN_OUT = 16
LEVELS = 3  # at least; more where a part has more than FAN_OUT ** LEVELS leaves
KEY = ("segment", "part")
WARC_DATE = "2024-01-01T00:00:00Z"
END = "\r\n"


def record(pages: DataFrame) -> Column:
    """The bytes of a page's WARC record, as text."""
    url, html = (F.coalesce(pages[c], F.lit("")) for c in ("url", "html"))
    page = F.coalesce(pages["page_id"].cast("string"), F.lit(""))
    head = [
        F.lit("WARC/1.0" + END + "WARC-Type: resource" + END + "WARC-Record-ID: <urn:page:"),
        page,
        F.lit(">" + END + "WARC-Date: " + WARC_DATE + END + "WARC-Target-URI: "),
        url,
        F.lit(END + "Content-Type: text/html" + END + "Content-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(END + END),
    ]
    return F.concat(*head, html, F.lit(END + END))


def write_warc(pages: DataFrame, path: str, records_per_file: int = 10000) -> None:
    """WARC files under ``path``, in the order of ids, by Spark's text sink."""
    body = pages.repartitionByRange("page_id").sortWithinPartitions("page_id").select(F.expr("1").alias("one"), record(pages).alias("value"))
    # the sink adds the separator, so the record's own last line ends go
    body = body.select(F.expr("left(value, length(value) - 4)").alias("value"))
    body.write.option("lineSep", END + END).option("maxRecordsPerFile", records_per_file).text(path)


_READ = "file string, offset long, length long, type string, uri string, payload binary, error string"


_MAGIC = b"\x1f\x8b\x08"


def _pieces(raw: bytes) -> Iterator[tuple[bytes, str | None]]:
    """A WARC file's readable runs of bytes, and what lies between them with an error.

    Gzip members are opened one after the other.  Where one is damaged, or foreign bytes
    stand, reading goes on at the next place where a whole member can be opened.
    """
    if not raw.startswith(_MAGIC):
        yield raw, None
        return
    run: list[bytes] = []
    at, lost = 0, 0  # bytes from ``lost`` to ``at`` could not be read
    while at < len(raw):
        member = zlib.decompressobj(31)
        try:
            body = member.decompress(raw[at:])
        except zlib.error:
            body = None
        if body is not None and member.eof:
            if lost < at:
                yield b"".join(run), None
                yield raw[lost:at], "damaged gzip member"
                run = []
            run.append(body)
            at = lost = len(raw) - len(member.unused_data)
            continue
        if body is not None:  # cut short: what there is of it is still read
            after = raw.find(_MAGIC, at + 1)
            if after < 0 and lost == at:
                run.append(body)
                at = lost = len(raw)
                break
        at = raw.find(_MAGIC, at + 1)
        at = len(raw) if at < 0 else at
    yield b"".join(run), None
    if lost < len(raw):
        yield raw[lost:], "damaged gzip member"


def _next_record(raw: bytes, at: int) -> int:
    """Where the next record header stands at or after ``at``; the end if there is none."""
    found = raw.find(b"\r\n\r\nWARC/", at)
    return found + 4 if found >= 0 else len(raw)


def _records(raw: bytes) -> Iterator[tuple]:
    """``(offset, length, type, uri, payload, error)`` in one run of bytes; reading goes on after what is broken."""
    at = 0
    while at < len(raw):
        body = raw.find(b"\r\n\r\n", at) + 4
        lines = raw[at : body - 4].split(b"\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = head.get(b"content-length", b"")
        kind, uri = (v.decode("utf-8", "replace") if (v := head.get(k)) is not None else None for k in (b"warc-type", b"warc-target-uri"))
        if body < 4 or not lines[0].startswith(b"WARC/") or not size.isdigit():
            last = _next_record(raw, at)
            yield at, last - at, None, None, raw[at:last], "no record header"
        elif (end := body + int(size)) > len(raw):
            last = _next_record(raw, body - 4)
            yield at, last - at, kind, uri, raw[body:last], f"truncated: {last - body} of {int(size)} bytes"
        else:
            last = end + 4 if raw[end : end + 4] == b"\r\n\r\n" else end
            yield at, last - at, kind, uri, raw[body:end], None
        at = last


def parse_warc(file: str, raw: bytes) -> Iterator[tuple]:
    """Rows of ``read_warc`` for one file.  What cannot be read is one row with an ``error``; what follows is read."""
    base = 0
    for piece, error in _pieces(raw):
        if error:
            yield file, base, len(piece), None, None, piece, error
            continue
        for offset, *rest in _records(piece):
            yield file, base + offset, *rest
        base += len(piece)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(file, offset, length, type, uri, payload, error)`` of the records in the WARC files under ``path``.

    Payloads are bytes.  Offsets are those in the plain file, also of gzipped ones; a gzip member
    that cannot be opened takes no room there.  A record without a target URI (``warcinfo``) has a null there.
    A cut or broken record, a damaged member and foreign bytes are a row with an error each, with the bytes as
    they are, and the records after them are read.  A file is read by one task, so files should stay near the usual gigabyte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for row in parse_warc(file.as_py(), content.as_py()):
                    rows.append(row)
                    held += len(row[5])
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _READ)


def _slim(records: DataFrame) -> DataFrame:
    raw = records["record"].cast("binary")
    slim = records.select("page_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("length"))
    return slim.withColumn("range", F.coalesce(F.floor(F.col("page_id") / SEGMENT), F.lit(-1)))


def layout(*replicas: DataFrame) -> DataFrame:
    """``(range, parts)`` of the ranges of ids that take more than one part; the others take one.

    At most one row for each ``SEGMENT`` records.  Replicas are compared under one layout, made for all of them.
    """
    counts = [_slim(r).groupBy("range").agg(F.count("*").alias("n")) for r in replicas]
    most = functools.reduce(DataFrame.unionByName, counts).groupBy("range").agg(F.max("n").alias("n"))
    return most.select("range", F.ceil(F.col("n") / SEGMENT).cast("long").alias("parts")).where("parts > 1")


def leaves(records: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """``records(page_id, record)`` -> ``(page_id, digest, segment, part, slot, offset, length, copies, hash)``; ``cut`` is a ``layout``.

    ``length`` is that of all copies.
    """
    slim = _slim(records).groupBy("range", "page_id", "digest", "length").agg(F.count("*").alias("copies"))
    slim = slim.join(cut if cut is not None else layout(records), "range", "left").withColumn("length", F.col("length") * F.col("copies"))
    part = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.coalesce("parts", F.lit(1)))
    slim = slim.withColumnRenamed("range", "segment").withColumn("part", part.cast("long"))
    order = Window.partitionBy(*KEY).orderBy("page_id", "digest")
    slim = slim.withColumn("slot", F.row_number().over(order) - 1)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    named = F.concat_ws(":", "digest", "offset", "length")
    return slim.select("page_id", "digest", *KEY, "slot", "offset", "length", "copies", F.sha2(named.cast("binary"), 256).alias("hash"))


def _level(nodes: DataFrame) -> DataFrame:
    """Parents of ``nodes(segment, part, node, offset, length, hash)``."""
    up = F.floor(F.col("node") / FAN_OUT)
    kids = nodes.groupBy(*KEY, up.cast("long").alias("up")).agg(
        F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("kids"), F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("end")
    )
    named = F.concat_ws(":", F.concat_ws("", F.col("kids.hash")), "offset", "end")
    return kids.select(*KEY, F.col("up").alias("node"), "offset", (F.col("end") - F.col("offset")).alias("length"), F.sha2(named.cast("binary"), 256).alias("hash"))


def height(*replicas: DataFrame) -> int:
    """Levels above the leaves until each tree has one node."""
    last = max(r.agg(F.max("slot").alias("s")).first()["s"] or 0 for r in replicas)
    levels = LEVELS
    while last // FAN_OUT**levels:
        levels += 1
    return levels


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of the trees, leaves first, roots (node 0) last; written as built."""
    found = [leaf.select(*KEY, F.col("slot").cast("long").alias("node"), "offset", "length", "hash")]
    for _ in range(levels):
        found.append(staged(_level(found[-1]), "merkle"))
    return found


def audit(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare two replicas' ``leaves``, made under one layout.

    Returns the slots at which they differ, ``(segment, part, slot)``, and the roots,
    ``(segment, part, root_a, root_b)``.
    """
    levels = height(a, b)
    one, two = tree(a, levels), tree(b, levels)

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = (d.select(*KEY, "node", F.col("hash").alias(n)) for d, n in ((x, "x"), (y, "y")))
        return x.join(y, [*KEY, "node"], "full_outer")

    roots = differing(one[-1], two[-1])
    open_nodes = roots.where(~F.col("x").eqNullSafe(F.col("y"))).select(*KEY, "node")
    for k in range(levels - 1, -1, -1):
        up = F.floor(F.col("node") / FAN_OUT)
        parent = open_nodes.select(*KEY, F.col("node").alias("up"))
        x, y = (d[k].withColumn("up", up).join(parent, [*KEY, "up"], "left_semi") for d in (one, two))
        open_nodes = differing(x, y).where(~F.col("x").eqNullSafe(F.col("y"))).select(*KEY, "node")
    found = open_nodes.select(*KEY, F.col("node").cast("int").alias("slot"))
    return found, roots.select(*KEY, F.col("x").alias("root_a"), F.col("y").alias("root_b"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every leaf of either replica with where it lies in both, its part's roots, and what the audit says of it.

    ``status`` is ``same``, ``moved``, ``copies`` (held another number of times), ``changed`` (the id has
    other bytes in the other replica), ``missing`` (in ``b``) or ``added``.  Both are ``leaves`` under one layout.
    """
    found, roots = audit(a, b)
    seen = found.withColumn("seen", F.lit(True))
    kept = ("page_id", "slot", "offset", "length", "copies", "hash")
    one, two = (x.select(*KEY, "digest", *kept).join(seen, [*KEY, "slot"], "left").withColumnsRenamed({c: f"{c}_{n}" for c in (*kept, "seen")}) for x, n in ((a, "a"), (b, "b")))
    rows = staged(one.join(two, [*KEY, "digest"], "full_outer"), "compared")
    page_id = F.coalesce("page_id_a", "page_id_b")
    lone = rows.where("(seen_a and slot_b is null) or (seen_b and slot_a is null)").select(page_id.alias("page_id"), F.col("slot_a").isNotNull().alias("in_a"))
    both = lone.groupBy("page_id").agg(F.min("in_a").alias("low"), F.max("in_a").alias("high")).where("low <> high").select("page_id", F.lit(True).alias("both"))
    status = (
        F.when(~(F.coalesce("seen_a", F.lit(False)) | F.coalesce("seen_b", F.lit(False))), "same")
        .when((F.col("slot_a").isNull() | F.col("slot_b").isNull()) & F.coalesce("both", F.lit(False)), "changed")
        .when(F.col("slot_b").isNull(), "missing").when(F.col("slot_a").isNull(), "added")
        .when(F.col("copies_a") != F.col("copies_b"), "copies").when(F.col("offset_a") != F.col("offset_b"), "moved").otherwise("same")
    )
    rows = rows.withColumn("page_id", page_id).join(both, "page_id", "left").join(roots, list(KEY), "left")
    names = [f"{c}_{n}" for c in kept[1:] for n in "ab"]
    return rows.select("page_id", "digest", *KEY, *names, status.alias("status"), "root_a", "root_b")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage, so that an audit has something to find.

    By the first two digits of the MD5 of the id: 00 loses its last payload character to
    a blank of the same length, 01 is cut short by one character, 02 is lost, 03 brings another
    record of its id, 04 is there once more.
    """
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    text = F.col("record")
    head = F.expr("left(record, length(record) - 5)")
    turned = F.when(mark == "00", F.concat(head, F.lit("~" + END + END))).when(mark == "01", F.concat(head, F.lit(END + END))).otherwise(text)
    held = F.when(mark == "02", F.array().cast("array<string>")).when(mark == "03", F.array(text, F.concat(text, F.lit("more" + END + END)))).when(mark == "04", F.array(text, text)).otherwise(F.array(turned))
    return records.withColumn("record", F.explode(held))


_PLACES = tuple(f"{c}_{n}" for c in ("slot", "offset", "length", "copies") for n in "ab")


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of either replica with where it lies, its leaves, and what the audit found."""
    pages = table(spark, sf_dir, "pages")
    records = pages.select("page_id", record(pages).alias("record"))
    cut = staged(layout(records, damaged(records)), "layout")
    found = compare(staged(leaves(records, cut), "leaves"), staged(leaves(damaged(records), cut), "leaves"))
    return found.withColumns({c: F.coalesce(c, F.lit(-1)).cast("long") for c in _PLACES})  # -1: not in that replica


_RECORD_SQL = r"""
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id AS varchar), '')
  || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""


def _tree_sql(name: str) -> str:
    return f"""
{name}0 AS (SELECT segment, page_id, digest, len * count(*) AS length, count(*) AS copies, ('0x' || substr(digest, 1, 8))::bigint % any_value(ceil(n / 1024.0)::bigint) AS part FROM {name}r JOIN cut USING (segment) GROUP BY segment, page_id, digest, len),
{name}1 AS (SELECT *, row_number() OVER w - 1 AS slot, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "offset"
  FROM {name}0 WINDOW w AS (PARTITION BY segment, part ORDER BY page_id, digest)),
{name}2 AS (SELECT *, sha256(digest || ':' || "offset" || ':' || length) AS hash FROM {name}1),
{name}3 AS (SELECT segment, part, slot // 16 AS node, min("offset") AS lo, max("offset" + length) AS hi, sha256(string_agg(hash, '' ORDER BY slot) || ':' || min("offset") || ':' || max("offset" + length)) AS hash FROM {name}2 GROUP BY ALL),
{name}4 AS (SELECT segment, part, node // 16 AS node, min(lo) AS lo, max(hi) AS hi, sha256(string_agg(hash, '' ORDER BY node) || ':' || min(lo) || ':' || max(hi)) AS hash FROM {name}3 GROUP BY 1, 2, node // 16),
{name}5 AS (SELECT segment, part, sha256(string_agg(hash, '' ORDER BY node) || ':' || min(lo) || ':' || max(hi)) AS root FROM {name}4 GROUP BY 1, 2)"""


_ENDS = "chr(13) || chr(10) || chr(13) || chr(10)"
_FLIP = "left(r, length(r) - 5)"
_SLIM_SQL = "SELECT coalesce(floor(page_id / 1024.0)::bigint, -1) AS segment, page_id, sha256(r) AS digest, strlen(r) AS len FROM"
#: Three levels, as many as a part of up to 4,096 leaves has.
ORACLE_SQL = (
    f"WITH rec AS (SELECT page_id, {_RECORD_SQL} AS r, substr(md5(coalesce(cast(page_id AS varchar), '')), 1, 2) AS mark FROM pages),"
    f" dam AS (SELECT page_id, CASE mark WHEN '00' THEN {_FLIP} || '~' || {_ENDS} WHEN '01' THEN {_FLIP} || {_ENDS} ELSE r END AS r FROM rec WHERE mark <> '02'"
    f" UNION ALL SELECT page_id, r || 'more' || {_ENDS} FROM rec WHERE mark = '03' UNION ALL SELECT page_id, r FROM rec WHERE mark = '04'),"
    f" ar AS ({_SLIM_SQL} rec), br AS ({_SLIM_SQL} dam),"
    " cut AS (SELECT segment, max(n) AS n FROM (SELECT segment, count(*) AS n FROM ar GROUP BY 1 UNION ALL SELECT segment, count(*) FROM br GROUP BY 1) GROUP BY 1),"
    + _tree_sql("a") + "," + _tree_sql("b")
    + """,
j AS (SELECT coalesce(a2.page_id, b2.page_id) AS page_id, digest, segment, part, a2.slot AS slot_a, b2.slot AS slot_b, a2."offset" AS offset_a, b2."offset" AS offset_b, a2.length AS length_a, b2.length AS length_b,
  a2.copies AS copies_a, b2.copies AS copies_b, a2.hash AS hash_a, b2.hash AS hash_b FROM a2 FULL JOIN b2 USING (segment, part, digest)),
bo AS (SELECT page_id FROM j WHERE slot_a IS NULL OR slot_b IS NULL GROUP BY 1 HAVING min(slot_a IS NULL) <> max(slot_a IS NULL))
SELECT j.* REPLACE (""" + ", ".join(f"coalesce({c}, -1)::bigint AS {c}" for c in _PLACES) + """), CASE WHEN (slot_a IS NULL OR slot_b IS NULL) AND page_id IN (SELECT page_id FROM bo WHERE page_id IS NOT NULL) THEN 'changed' WHEN slot_b IS NULL THEN 'missing' WHEN slot_a IS NULL THEN 'added'
  WHEN copies_a <> copies_b THEN 'copies' WHEN offset_a <> offset_b THEN 'moved' ELSE 'same' END AS status, a5.root AS root_a, b5.root AS root_b
FROM j LEFT JOIN a5 USING (segment, part) LEFT JOIN b5 USING (segment, part)"""
)
