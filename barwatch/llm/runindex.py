"""Repeated byte strings, by a run-compressed Burrows-Wheeler transform with sampled run ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barwatch.llm.common import table
from barwatch.llm.repeats import GATE_BYTES, SHARD_BYTES, Kind, Units, covered, repeated_ranges
from barwatch.llm.suffixes import common_prefixes, packed, suffix_order

LENGTH = 400
GRAM = 24
END = 0xFF  # in no UTF-8 text
_BYTE_HASH = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


class RunIndex:
    """The runs of equal letters in the transform, and where the suffixes at their two ends start.

    If two neighbouring suffixes follow the same letter, that letter and they
    are neighbours again, with one more byte in common.  So along the text,
    the length that a position shares with its neighbour in suffix order falls
    by one a byte, except where a run ends.  It is kept at those places only.

    The text is pieces, each up to its place in ``ends``, where a letter of no
    piece stands.  One that stands in several ``places`` is indexed once: its
    copy would be its neighbour in suffix order, with all bytes up to its end in
    common, and that descent is kept at its end.
    """

    def __init__(self, text: np.ndarray, most: int, ends: np.ndarray, places: np.ndarray) -> None:
        keys, many = packed(text, 8)
        order, rank = suffix_order(text, 8, (keys, many))
        self.size = len(text)
        before = np.where(order > 0, text[order - 1].astype(np.int64), -1)
        change = before[1:] != before[:-1]
        self.samples = [(ends, np.where(places > 1, 0, -ends))]
        for run_end, step in ((np.append(True, change), -1), (np.append(change, True), 1)):
            # The position before a run's end starts a new descent; so does the last one.
            sampled = np.zeros(len(text), bool)
            sampled[order[run_end & (order > 0)] - 1] = sampled[-1] = True
            at = np.flatnonzero(sampled)
            other = rank[at] + step
            there = (other >= 0) & (other < len(text))
            shared = np.zeros(len(at), np.int64)
            shared[there] = common_prefixes(keys, many, 8, at[there], order[other[there]], most)
            self.samples.append((at, shared))

    def matching_statistics(self) -> np.ndarray:
        """For each position the length, counted exactly below ``most``, of its longest match elsewhere."""
        best = np.zeros(self.size, np.int64)
        for at, shared in self.samples:
            reach = np.repeat(at + shared, np.diff(np.append(-1, at)))
            np.maximum(best, reach - np.arange(self.size), out=best)
        return best


def byte_units(texts: list[bytes]) -> Units:
    data = b"".join(texts)
    at = np.arange(len(data))
    sizes = np.array([len(t) for t in texts], np.int64)
    return Units(data, at, at + 1, _BYTE_HASH[np.frombuffer(data, np.uint8)], np.cumsum(sizes) - sizes)


def mark_long_matches(pieces: list[bytes], places: np.ndarray, length: int) -> list[np.ndarray]:
    """Starts in each piece of strings of ``length`` bytes that start twice, where each piece stands in so many ``places``."""
    text = np.frombuffer(bytes([END]).join(pieces) + bytes([END]), np.uint8)
    ends = np.cumsum([len(piece) + 1 for piece in pieces]) - 1
    long = RunIndex(text, length, ends, places).matching_statistics() >= length
    return [np.flatnonzero(long[end - len(piece) : end - length + 1]) for piece, end in zip(pieces, ends.tolist())]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, found in zip(batch.column("text").cast(pa.large_binary()), batch.column("found")):
            data = np.frombuffer(text.as_py(), np.uint8)
            gone = covered(found, len(data))
            kept = data[~gone].tobytes()
            for column, value in zip(out, (len(data), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest(), kept)):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(out, kinds))], ["row", *names])


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, gate_bytes: int = GATE_BYTES) -> DataFrame:
    """Per document: ``doc_id``, sizes, ``kept_sha256`` and ``kept``, the bytes outside strings of ``length`` that start twice.

    A null text is empty; texts shorter than ``length`` stay whole; equal rows
    are repeats of each other; null ids, very long texts (cut into pieces) and
    an empty table need no care; other columns are ignored.
    """
    kind = Kind(length, gram, byte_units, partial(mark_long_matches, length=length))
    found = repeated_ranges(docs, kind, shard_bytes, gate_bytes)
    rows = found.selectExpr("struct(doc_id) as row", "text", "found")
    schema = f"row struct<doc_id:{dict(docs.dtypes)['doc_id']}>, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return rows.mapInArrow(_kept, schema).select("row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op1_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that start twice."""
    return drop_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")
