"""What the corpus operators share: words, tables, whole documents in Arrow batches.

A document is a row with ``doc_id``, ``text`` and perhaps ``source``.  A null
text is an empty one.  Rows are told apart by (doc_id, hash of the text), so
repeated rows and null ids need no care by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """The runs of other characters than blanks, in order; empty for an empty text.  Splits by one letter, which is quick."""
    spaced = F.regexp_replace(text, r"[\x09-\x0D]|\x20{2,}", " ")
    return F.array_remove(F.split(spaced, " "), "")


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id``, whole ``text`` and ``text_key``, which with the id names a row; nothing else."""
    text = text_of()
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each value starts (one more entry at the end)."""
    column = column.cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), starts


def whole_documents(starts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of values of about ``most`` bytes together; a longer value is alone."""
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last
