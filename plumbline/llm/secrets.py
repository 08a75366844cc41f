"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every version of a text is addressed by its SHA-256 (a blob).  The ledger holds
which rule versions have scanned a blob, and what they found.  A scan

1. lists the paths and their blobs, without texts;
2. takes from the ledger which rule versions each blob still lacks;
3. fetches the text of one path for each blob that lacks any, and runs only
   the rules it lacks;
4. appends to the ledger and joins the findings of the asked rule versions back
   to all paths.

Copies are thus scanned once, a second scan of the same texts reads no text,
and a changed rule rescans for that rule alone.

Spans come from splitting at the pattern: gaps and matches alternate, and a
running sum of their lengths over the matches of one blob gives offsets in code
points.  Patterns are leftmost, non-overlapping; a match that fails its length
rule is dropped after it was consumed.

Defined results: a null text is the empty blob.  Repeated rows share a blob and
its findings; a path with two texts is two versions.  A null path id is a path
like any other.  An empty table gives an empty result.  Other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.text import fresh
from plumbline.staging import shared_root, staged, table


def either_case(word: str) -> str:
    """A pattern for ``word`` with its ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` must have ``least`` characters or more.

    ``sql`` is the same rule for engines whose patterns cannot look back: its first group is what stands before.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    sql: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules.
_KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
BASE = (
    Rule("assign", 1, rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run that is too short fails from each of its places, so the least lengths of
    # these two can stand in the pattern: the spans are those of the plain runs.
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
#: Further rules, by the published formats of these tokens.
MORE = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}"),
    # The header begins its run of characters, so that a long run without dots costs linear time.
    Rule("jwt", 4, r"eyJ(?<![A-Za-z0-9_-]eyJ)[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 30, r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

#: A key from its first marker to its last, or, where the last is missing, headers and base64 lines as far as they go.
#: Possessive repeats are loops in the regex engine; others recurse once a repeat, and a long key or gap would overflow the stack.
_LINE = r"[A-Za-z0-9+/]{16,}+={0,2}+"
_GAP = r"(?:[\s>]++|\\[nr])*+"
_CUT_KEY = rf"""(?:\s*+[A-Za-z-]++:[^\r\n]*+[\r\n]){{0,4}}+(?:{_GAP}{_LINE})*+(?:{_GAP}[A-Za-z0-9+/]{{1,15}}+={{1,2}}+|\s*[\r\n][A-Za-z0-9+/]{{1,15}}+(?=\s*(?:[\r\n]|$)))?"""
PEM = Rule("pem", 3, rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-[^-]++){{0,8}}+-----END [A-Z ]*PRIVATE KEY-----|{_CUT_KEY})")
#: What redaction hides. The ledger query keeps ``RULES``, from which its SQL is made.
REDACTED = tuple(PEM if r.kind == PEM.kind else r for r in RULES)


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Ledger:
    """Two Parquet tables in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_root(spark)}/ledger-{uuid.uuid4().hex}"

    SEEN = "blob binary, rules array<string>"
    FINDINGS = "blob binary, rule string, first long, last long"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._read("seen", self.SEEN)

    def findings(self) -> DataFrame:
        return self._read("findings", self.FINDINGS)

    def append(self, seen: DataFrame, findings: DataFrame) -> None:
        """Findings first: a scan that dies between the two is repeated, and repeats are dropped on reading."""
        findings.write.mode("append").parquet(f"{self.path}/findings")
        seen.write.mode("append").parquet(f"{self.path}/seen")


def _matches(rule: Rule) -> Column:
    """Gaps and matches of one rule in ``text``, as an array."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
    held = sizes if not rule.group else F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length)
    return F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), F.transform(held, lambda n: n >= rule.least).alias("good"))


def _scan(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``texts(blob, rules, text)`` -> ``(blob, rule, first, last)``."""
    found = [
        F.when(F.array_contains("rules", r.key) & F.col("text").rlike(r.pattern), F.struct(F.lit(r.key).alias("rule"), _matches(r).alias("found"))) for r in rules
    ]
    rows = texts.select("blob", F.explode(F.array_compact(F.array(*found))).alias("x"))
    rows = rows.select("blob", "x.rule", F.posexplode("x.found").alias("at", "m")).where("m.size is not null")
    # one exchange serves the removal of repeats and the running sums
    rows = rows.select("blob", "rule", "at", "m.*").repartition("blob").dropDuplicates(["blob", "rule", "at"])
    so_far = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum(F.col("gap") + F.col("size")).over(so_far)
    rows = rows.select("blob", "rule", "good", (last - F.col("size")).alias("first"), last.alias("last"))
    return rows.where("good").select("blob", "rule", "first", "last")


def paths(docs: DataFrame) -> DataFrame:
    """``(doc_id, blob)`` of each row: which versions there are, without their texts; written as built."""
    return staged(docs.select("doc_id", _blob(docs["text"]).alias("blob")), "paths")


def scan(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, versions: DataFrame | None = None) -> DataFrame:
    """Bring the ledger up to date with ``docs(doc_id, text)``; ``(blob, rule, first, last)`` of the asked rules.

    Offsets are code points, the end exclusive.  ``versions`` are the ``paths`` of
    ``docs``, where the caller has them.
    """
    versions = versions or paths(docs)
    wanted = F.array(*(F.lit(r.key) for r in rules))
    blobs = staged(versions.groupBy("blob").agg(F.min("doc_id").alias("owner")), "blobs")
    seen = ledger.seen().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("had"))
    todo = blobs.join(seen, "blob", "left")
    todo = todo.select("blob", "owner", F.array_except(wanted, F.coalesce("had", F.array().cast("array<string>"))).alias("rules"))
    todo = staged(todo.where(F.size("rules") > 0), "unseen")
    of, blob = F.col("doc_id").eqNullSafe(F.col("owner")), F.col("blob") == F.col("its_blob")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _blob(docs["text"]).alias("its_blob"))
    texts = texts.join(todo, of & blob).select("blob", "rules", "text")
    if not todo.isEmpty():  # else every pair is in the ledger, and no text is read
        ledger.append(todo.select("blob", "rules"), _scan(texts, rules))
    keys = [r.key for r in rules]
    return ledger.findings().where(F.col("rule").isin(keys)).join(blobs, "blob", "left_semi").distinct()


def by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, spans)``: an array of ``(first, place of the rule, last, kind)`` in order."""
    kinds = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    names = F.array(*(F.lit(r.kind) for r in rules))
    rows = findings.withColumn("place", kinds[F.col("rule")])
    span = F.struct("first", "place", "last", F.get(names, F.col("place")).alias("kind"))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> tuple[DataFrame, str]:
    """``docs`` with its spans in one more column, and that column's name."""
    ledger = ledger or Ledger(docs.sparkSession)
    found = by_blob(scan(docs, ledger, rules), rules)
    name, mine, theirs = (fresh(n, docs.columns) for n in ("spans", "blob", "found_blob"))
    found = found.withColumnsRenamed({"spans": name, "blob": theirs})
    joined = docs.withColumn(mine, _blob(docs["text"])).join(found, F.col(mine) == F.col(theirs), "left")
    return joined.select(*docs.columns, name), name


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret's characters replaced by asterisks, so lengths stay."""
    rows, spans = with_spans(docs, REDACTED)
    text = F.col("text")
    # spans in order, each cut to begin where those before it have ended
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["last"]).alias("at"),
            F.concat(
                s["parts"],
                F.array(
                    text.substr(s["at"].cast("int") + 1, F.greatest(x["first"] - s["at"], F.lit(0)).cast("int")),
                    F.repeat(F.lit("*"), F.greatest(x["last"] - F.greatest(s["at"], x["first"]), F.lit(0)).cast("int")),
                ),
            ).alias("parts"),
        ),
        lambda s: F.concat(F.array_join(s["parts"], ""), text.substr(s["at"].cast("int") + 1, F.length(text))),
    )
    clean = F.when(F.col(spans).isNull(), text).otherwise(step)
    return rows.select(*(clean.alias(c) if c == "text" else F.col(c) for c in docs.columns))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")


def op9_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the history, then one of the table as it is now, which meets its blobs in the ledger."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), Ledger(spark)
    versions = paths(docs)
    scan(docs, ledger, versions=versions)
    found = by_blob(scan(docs, ledger, versions=versions))
    base = F.expr(f"filter(spans, s -> s.place < {len(BASE)})")
    found = found.select(
        "blob",
        *(F.expr(f"size(filter(spans, s -> s.place = {i}))").alias(f"n_{r.kind}") for i, r in enumerate(BASE)),
        _listed(base).alias("base"),
        _listed(F.col("spans")).alias("spans"),
    )
    rows = versions.join(found, "blob", "left")
    return rows.select(
        "doc_id",
        *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _sql_spans(place: int, rule: Rule) -> str:
    pattern = (rule.sql or rule.pattern).replace("'", "''")
    lead = f"list_transform(regexp_extract_all(t, '{pattern}', 1), lambda x: length(x))" if rule.sql else "NULL"
    return f"""SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, {lead} AS lead,
      unnest(range(1, len(m) + 1)) AS i, m, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', {rule.group}) AS h, {rule.least} AS least
    FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m FROM documents)"""


ORACLE_SQL = f"""
WITH f AS ({' UNION ALL '.join(_sql_spans(i, r) for i, r in enumerate(RULES))}),
s AS (SELECT doc_id, place, kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + coalesce(lead[i], 0) AS a, length(m[i]) - coalesce(lead[i], 0) AS n
  FROM f WHERE length(h[i]) - coalesce(lead[i], 0) >= least),
p AS (SELECT doc_id, place, a, kind || ':' || a::bigint || ':' || (a + n)::bigint AS span FROM s),
j AS (SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(span, ',' ORDER BY a, place) FILTER (place < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, place) AS spans FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access, coalesce(n_hex, 0)::bigint AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN j USING (doc_id)
"""
