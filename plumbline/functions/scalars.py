"""Scalar expressions that recur in scoring and ingestion.  All return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters trimmed from both ends of a recognised word.
WORD_EDGES = ".,!?:;'\"()"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def platt(x: Column | str, a: Column | float, b: Column | float) -> Column:
    """Calibrated probability of a similarity."""
    a, b = (v if isinstance(v, Column) else F.lit(float(v)) for v in (a, b))
    return sigmoid(a * _c(x) + b)


def p_yes(yes: Column | str, no: Column | str) -> Column:
    """Two-class softmax over logits."""
    return sigmoid(_c(yes) - _c(no))


def linear_score(features: list[str], w: list[float], b: float, mu: list[float], sd: list[float]) -> Column:
    """Standardise, weigh, and squash a row of features."""
    total = F.lit(float(b))
    for name, weight, mean, dev in zip(features, w, mu, sd, strict=True):
        total = total + F.lit(float(weight)) * (F.col(name) - F.lit(float(mean))) / F.lit(float(dev))
    return sigmoid(total)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def hash_from_hex(text: Column | str) -> Column:
    """Signed 64-bit value of 16 hex digits, read as two halves."""
    text = _c(text)
    high, low = (F.conv(F.substring(text, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def first_truthy(*values: Column | str, default: str | None = None) -> Column:
    """First value that is neither null nor empty."""
    kept = [F.nullif(_c(v), F.lit("")) for v in values]
    return F.coalesce(*kept, *([F.lit(default)] if default is not None else []))


def without_query(url: Column | str) -> Column:
    return F.substring_index(_c(url), "?", 1)


def id_source(item: Column | str) -> Column:
    """``src`` of ``src:brand/file``."""
    return F.split_part(_c(item), F.lit(":"), F.lit(1))


def id_brand(item: Column | str) -> Column:
    return F.split_part(F.split_part(_c(item), F.lit(":"), F.lit(2)), F.lit("/"), F.lit(1))


def id_path(item: Column | str) -> Column:
    return F.regexp_replace(_c(item), "^[^:]*:", "")


def cache_key(item: Column | str) -> Column:
    """First 16 hex digits of the SHA-1 of an item id."""
    return F.substring(F.sha1(_c(item).cast("binary")), 1, 16)


def iso_epoch(text: Column | str) -> Column:
    """Epoch seconds of an ISO-8601 time; null where it cannot be read."""
    return F.unix_timestamp(F.try_to_timestamp(_c(text)))


def json_object(text: Column | str) -> Column:
    """The span from the first ``{`` to the last ``}``; null if there is none."""
    return F.nullif(F.regexp_extract(_c(text), r"(?s)\{.*\}", 0), F.lit(""))


def bare_word(text: Column | str) -> Column:
    """Lower case, punctuation trimmed from both ends."""
    return F.btrim(F.lower(_c(text)), F.lit(WORD_EDGES))


def squeezed(text: Column | str) -> Column:
    """Lower case without blanks, punctuation and marks trimmed: for phrase containment."""
    return F.btrim(F.replace(F.lower(_c(text)), F.lit(" "), F.lit("")), F.lit(WORD_EDGES + "™®"))


def spaced_out(text: Column | str) -> Column:
    """Upper case with a blank between letters."""
    return F.array_join(F.filter(F.split(F.upper(_c(text)), ""), lambda c: c != ""), " ")


def slug(item: Column | str) -> Column:
    return F.translate(_c(item), ":/", "__")


def output_name(item: Column | str, generator: Column | str, severity: Column | str) -> Column:
    return F.format_string("%s__%s_s%d.jpg", slug(item), _c(generator), _c(severity))


def item_seed(*parts: Column | str) -> Column:
    """A repeatable seed below 2**31 from strings, by MD5 (portable to other engines)."""
    joined = F.concat_ws("|", *(_c(p).cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(joined.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(1 << 31))


def sample_order(seed: int, item: Column | str) -> Column:
    """Sort key of a seeded shuffle: equal in any engine that has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(item).cast("string")).cast("binary"))


def cost(tokens_in: Column | str, cached: Column | str, out: Column | str, rates: tuple[float, float, float]) -> Column:
    """Dollars for a call: rates per million of fresh input, cached input and output tokens."""
    fresh, held, made = rates
    return ((_c(tokens_in) - _c(cached)) * fresh + _c(cached) * held + _c(out) * made) / 1e6
