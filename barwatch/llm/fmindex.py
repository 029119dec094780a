"""Repeated word sequences, by backward search in a compressed FM-index of each shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from barwatch.llm.common import table
from barwatch.llm.repeats import GATE_BYTES, SHARD_BYTES, Kind, Units, covered, repeated_ranges
from barwatch.llm.suffixes import suffix_order

WINDOW = 35
GRAM = 6
PROBE = 4


class WaveletTree:
    """Bit vectors of a sequence of codes, one a level from the highest bit down, each sorted by the level above it."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (codes >> level & 1).astype(bool)
            padded = np.zeros((len(ones) // 64 + 1) * 64, bool)
            padded[: len(ones)] = ones
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.zeros.append(len(ones) - int(ones.sum()))
            codes = np.concatenate((codes[~ones], codes[ones]))

    def descend(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` goes if it follows the bits of ``codes`` to the bottom."""
        for level in range(self.bits):
            words, bit = self.words[level], (codes >> (self.bits - 1 - level) & 1).astype(bool)
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][block] + np.bitwise_count(words[block] & below)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Counts of a pattern in a text of codes, one code of the pattern at a time from its end.

    A position of the text counts as often as ``weights`` has it, so copies of a
    text are indexed once.
    """

    def __init__(self, codes: np.ndarray, sigma: int, weights: np.ndarray) -> None:
        bits = max(int(sigma - 1).bit_length(), 1)
        order, _ = suffix_order(codes, bits)
        self.size = len(codes)
        self.tree = WaveletTree(codes[order - 1], bits)
        self.places = np.append(0, np.cumsum(weights[order]))
        every = np.arange(sigma)
        first = np.append(0, np.cumsum(np.bincount(codes, minlength=sigma)))[:-1]
        self.shift = first - self.tree.descend(every, np.zeros(sigma, np.int64))

    def extend(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.tree.descend(np.concatenate((codes, codes)), np.concatenate((low, high)))
        shift = self.shift[codes]
        return both[: len(codes)] + shift, both[len(codes) :] + shift

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.places[high] - self.places[low]


def repeated_windows(index: FMIndex, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Which positions of ``codes`` start a window of a pattern that the index holds twice.

    Patterns are streamed together, each from its right end.  A match is
    extended to the left while it has two places.  Where it ends at word j,
    the windows inside it are marked, and the few words from j on are searched
    alone: if already they have no two places, no window that holds them has,
    and the search goes on left of them.  Else it goes on one window further.
    """
    change = np.zeros(len(codes) + 1, np.int64)
    last = sizes - window  # the rightmost window not decided yet
    live = np.flatnonzero(last >= 0)
    end, at = last + window, last + window
    low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), index.size)
    target = np.full(len(sizes), -1)  # of a probe; -1 for a match
    after = np.zeros(len(sizes), np.int64)  # the window to go on with after a probe

    def restart(who: np.ndarray, window_at: np.ndarray) -> None:
        last[who], end[who], at[who] = window_at, window_at + window, window_at + window
        low[who], high[who], target[who] = 0, index.size, -1

    while len(live):
        l, h = index.extend(codes[begins[live] + at[live] - 1], low[live], high[live])
        twice = index.count(l, h) >= 2
        probe = target[live] >= 0
        good = live[twice]
        low[good], high[good] = l[twice], h[twice]
        at[good] -= 1
        # A probe that reached its word says nothing: one window further.
        through = good[(target[good] >= 0) & (at[good] == target[good])]
        restart(through, after[through])
        whole = good[(target[good] < 0) & (at[good] == 0)]
        np.add.at(change, begins[whole], 1)
        np.add.at(change, begins[whole] + end[whole] - window + 1, -1)
        last[whole] = -1
        failed = live[~twice & probe]
        restart(failed, np.minimum(after[failed], end[failed] - 1 - window))
        ended = live[~twice & ~probe]
        marked = ended[end[ended] - at[ended] >= window]
        np.add.at(change, begins[marked] + at[marked], 1)
        np.add.at(change, begins[marked] + end[marked] - window + 1, -1)
        go_on = np.minimum(at[ended] - 1, last[ended] - 1)
        short = end[ended] - at[ended] < PROBE
        restart(ended[short], go_on[short])
        long = ended[~short]
        after[long], target[long] = go_on[~short], at[long] - 1
        end[long] = at[long] - 1 + PROBE
        at[long], low[long], high[long] = end[long], 0, index.size
        last[long] = go_on[~short]
        live = live[last[live] >= 0]
    return np.cumsum(change[:-1]) > 0


def word_units(texts: list[bytes]) -> Units:
    """Words joined by one blank; both sides of the pieces see them in that form."""
    lists = [t.split() for t in texts]  # at the blanks of ASCII, as the contract has it
    sizes = np.array([len(x) for x in lists], np.int64)
    every = [w for x in lists for w in x]
    lengths = np.array([len(w) for w in every], np.int64)
    at = np.cumsum(lengths + 1) - lengths - 1
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, every), np.uint64, len(every))
    return Units(b" ".join(every), at, at + lengths, hashes, np.cumsum(sizes) - sizes)


def mark_repeated_words(pieces: list[bytes], places: np.ndarray, window: int) -> list[np.ndarray]:
    """Starts in each piece of windows of words that stand twice, where each piece stands in so many ``places``."""
    lists = [p.split(b" ") for p in pieces]
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = [numbers.setdefault(w, len(numbers)) for x in lists for w in x]
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    codes = np.full(len(flat) + len(pieces), len(numbers), np.int64)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = flat
    index = FMIndex(codes, len(numbers) + 1, np.repeat(places, sizes + 1))
    marks = repeated_windows(index, codes, begins, sizes, window)
    return [np.flatnonzero(marks[b : b + n]) for b, n in zip(begins, sizes)]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, kept = [], [], []
        for text, found in zip(batch.column("text").cast(pa.large_binary()), batch.column("found")):
            words = text.as_py().split()
            out = covered(found, len(words))
            counts.append(len(words))
            gone.append(int(out.sum()))
            kept.append(b" ".join(w for w, x in zip(words, out.tolist()) if not x))
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array([k.decode() for k in kept], pa.string())],
            ["row", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, gate_bytes: int = GATE_BYTES) -> DataFrame:
    """Per document: ``doc_id``, counts, ``kept_sha256`` and ``kept``, the words outside windows that stand twice.

    A null text is empty; texts of fewer words than a window stay whole; equal
    rows are repeats of each other; null ids, very long texts (cut into
    pieces) and an empty table need no care; other columns are ignored.
    """
    kind = Kind(window, gram, word_units, partial(mark_repeated_words, window=window))
    found = repeated_ranges(docs, kind, shard_bytes, gate_bytes)
    rows = found.selectExpr("struct(doc_id) as row", "text", "found")
    schema = f"row struct<doc_id:{dict(docs.dtypes)['doc_id']}>, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    return rows.mapInArrow(_kept, schema).select("row.*", "n_words", "n_removed", "kept_sha256", "kept")


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without sequences of 35 words that stand twice."""
    return drop_repeated_words(table(spark, sf_dir, "documents")).drop("kept")


OP5_SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM terms WHERE len(w) >= 35)
), twice AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1
), places AS (
  SELECT r, doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM terms
), marked AS (
  SELECT p.r, p.i, p.word, coalesce(max(t.i) OVER (PARTITION BY p.r ORDER BY p.i), -99) > p.i - 35 AS gone
  FROM places p LEFT JOIN twice t ON p.r = t.r AND p.i = t.i
), kept AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM terms LEFT JOIN kept USING (r)
"""
