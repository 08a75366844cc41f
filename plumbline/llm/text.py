"""What several text operators share: the word rule and Arrow batch plumbing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD).findall


def fresh(name: str, taken: list[str]) -> str:
    """A column name near ``name`` that no column in ``taken`` has."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def append_columns(df: DataFrame, text: str, fields: dict[str, T.DataType], make: Callable[[], Callable]) -> DataFrame:
    """Append columns computed from the text column, one Arrow batch at a time.

    ``make()`` runs once per task and returns ``f(list of texts) -> list of
    sequences``, one for each field.  All other columns pass through untouched.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(k, v) for k, v in fields.items()])
    kinds = [to_arrow_type(v) for v in fields.values()]
    at = df.columns.index(text)
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            found = work(batch.column(at).to_pylist())
            arrays = [pa.array(x, type=k) for x, k in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns + arrays, names=batch.schema.names + names)

    return df.mapInArrow(run, schema)
