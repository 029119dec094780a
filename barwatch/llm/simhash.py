"""SimHash near-duplicates: fingerprints joined through their segments' bit counts.

A fingerprint's 32 segments of two bits have 0, 1 or 2 bits set.  Changing
one bit moves one count by one, so the Manhattan distance of two fingerprints'
counts is at most their number of differing bits.  Counts are written in
unary, two bits each, which makes that distance a number of differing bits too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwatch.llm.common import same_row, table, text_of
from barwatch.llm.components import components
from barwatch.session import materialize, ship_package

BITS = 4  # at most so many differ in a link
WORDS = 4
SEED = 42
SEGMENTS = 32
CELL_LOAD = 32  # fingerprints that meet by chance in a cell, about
SMALL = 256  # up to this size, cells are first searched for any link, all together
CELL_ROWS = 4096  # fingerprints compared in one piece
_ODD = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority of each bit over the hashes of all shingles, repeats included; 0 without words."""
    terms = text.lower().split()  # both know ASCII only
    if not terms:
        return 0
    n = max(len(terms) - words + 1, 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(terms[i : i + words]), SEED) for i in range(n)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for lot in np.split(hashes, range(1 << 16, n, 1 << 16)):
        counts += np.unpackbits(lot.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > n)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch.column("text").cast(pa.large_binary())], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found.view(np.int64))], ["row", "print"])


def unary_counts(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, as 00, 01 or 11."""
    low, high = prints & _ODD, (prints >> _ONE) & _ODD
    return (low | high) | ((low & high) << _ONE)


def band_masks(bands: int, bits: int) -> list[np.uint64]:
    """Masks of all choices of ``bands - bits`` bands of segments.

    Counts at a distance of ``bits`` or less agree wholly on some choice.
    """
    masks = [sum(3 << (2 * int(s)) for s in part) for part in np.array_split(np.arange(SEGMENTS), bands)]
    return [np.uint64(sum(chosen)) for chosen in combinations(masks, bands - bits)]


def bands_for(rows: int, bits: int) -> int:
    """The fewest bands whose cells hold few fingerprints each, at 1.5 bits of choice a segment."""
    bands = bits + 2
    while bands < SEGMENTS and comb(bands + 1, bits) <= 1000 and CELL_LOAD * 2.0 ** (1.5 * SEGMENTS * (bands - bits) / bands) < rows:
        bands += 1
    return bands


def grid_cells(prints: DataFrame, masks: list[np.uint64]) -> DataFrame:
    """(cell, print) for every choice of bands: the cell is the choice and the counts in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray(batch.column("print")).view(np.uint64)
            counts = unary_counts(found)
            for i, mask in enumerate(masks):
                mixed = (counts & mask) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i * 0xC2B2AE3D27D4EB4F % (1 << 64))
                mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                yield pa.RecordBatch.from_arrays([pa.array((mixed ^ (mixed >> np.uint64(29))).view(np.int64)), batch.column("print")], ["cell", "print"])

    return prints.mapInArrow(run, "cell bigint, print bigint")


def forest(prints: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that join what links of ``bits`` bits or less join: one fewer than prints in each component."""
    counts = unary_counts(prints)
    left, tails, heads = np.arange(len(prints)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at = front[0]
            front = front[1:]
            near = np.bitwise_count(counts[left] ^ counts[at]) <= bits
            near[near] = np.bitwise_count(prints[left[near]] ^ prints[at]) <= bits
            new, left = left[near], left[~near]
            tails.append(prints[new])
            heads.append(np.full(len(new), prints[at]))
            front = np.concatenate((front, new))
    return tails, heads


def _linked(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Forests of the cells, whose rows come one after the other; the last cell of a batch may go on in the next."""
    held = [np.empty((0, 4), np.int64)]

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        tails, heads = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        if len(rows):
            cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1
            starts, ends = np.append(0, cut), np.append(cut, len(rows))
            prints = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
            counts = unary_counts(prints)
            cell = np.repeat(np.arange(len(starts)), ends - starts)
            hit = ends - starts > SMALL
            small = ~hit[cell]
            for d in range(1, min(int((ends - starts).max()), SMALL)):
                both = np.flatnonzero((cell[d:] == cell[:-d]) & small[d:])
                if not len(both):
                    break
                both = both[np.bitwise_count(counts[both] ^ counts[both + d]) <= bits]
                hit[cell[both[np.bitwise_count(prints[both] ^ prints[both + d]) <= bits]]] = True
            for i in np.flatnonzero(hit):
                t, h = forest(prints[starts[i] : ends[i]], bits)
                tails += t
                heads += h
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (tails, heads)], ["a", "b"])

    for batch in batches:
        rows = np.column_stack([np.asarray(c) for c in batch.columns])
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole:
            yield edges(np.concatenate([*held, rows[:whole]]))
            held = []
        held.append(rows[whole:])
    yield edges(np.concatenate(held))


def linked_prints(prints: DataFrame, bits: int = BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to join all that are linked.

    ``prints`` has one column ``print`` of distinct values, written already.
    A cell of more than ``cell_rows`` is dealt into blocks by hash and every
    two blocks meet in a task of their own, so no task holds more than two
    blocks, and each gives fewer edges than it has rows.
    """
    cells = grid_cells(prints, band_masks(bands_for(prints.count(), bits), bits))
    full = cells.groupBy("cell").count().filter("count > 1").select("cell", F.ceil(F.col("count") / cell_rows).cast("bigint").alias("blocks"))
    block = F.pmod(F.xxhash64("print"), F.col("blocks"))
    met = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    pieces = cells.join(full, "cell").select("cell", "print", block.alias("block"), met.alias("other"))
    pieces = pieces.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "print")
    pieces = pieces.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "print")
    return pieces.mapInArrow(lambda batches: _linked(batches, bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per document: ``doc_id``, ``text_key``, ``print``, ``component_id`` and ``stays``.

    Fingerprints that differ in ``bits`` bits or less are linked;
    ``component_id`` is the least id reachable, and ``stays`` marks the rows
    with that id and the least text key (equal rows are all marked).  Texts
    are read once; equal fingerprints are one from then on, so copies make
    no pairs.

    Null and empty texts have fingerprint 0 and are linked like others.  Null
    ids come last: the id of a component without any is null.  An empty table
    stays empty; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    text = text_of()
    rows = docs.select(F.struct("doc_id", F.xxhash64(text).alias("text_key")).alias("row"), text.alias("text"))
    found = rows.mapInArrow(_fingerprints, f"row struct<doc_id:{dict(docs.dtypes)['doc_id']},text_key:bigint>, print bigint")
    found = materialize(found.select("row.*", "print"), "prints")
    first: Column = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    classes = materialize(found.groupBy("print").agg(first), "print-classes")
    roots = components(linked_prints(classes.select("print"), bits))
    rooted = classes.join(roots, classes["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root").select("print", "least")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    return found.join(named, "print").select("doc_id", "text_key", "print", F.col("least.doc_id").alias("component_id"), stays.alias("stays"))


def without_near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each component, with all columns: of equal rows, any one."""
    kept = near_duplicates(docs, bits).filter("stays").select("doc_id", "text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text_of()).alias("text_key"))
    return rows.join(kept, same_row(rows, kept), "left_semi").dropDuplicates(["doc_id", "text_key"]).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
