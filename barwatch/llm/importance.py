"""Drawing the documents most like a target: importance weights by hashed features, an exact cut by medians of medians."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwatch.llm.common import identified, table
from barwatch.session import materialize, ship_package

BUCKETS = 10_000
CHUNK = 1 << 18  # keys whose median a task takes at once
FINISH = 1 << 14  # keys left that are sorted instead

# Words are runs of digits, letters and all that is not ASCII; capital letters count as small ones.
_LOWER = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
KEY = ["low", "doc_id", "text_key", "copy"]  # in drawing order; no two rows have one key


def hashed_features(text: bytes, runs: tuple[int, int], buckets: int) -> tuple[int, np.ndarray]:
    """How many words, and the bucket of every run of ``runs`` (least, most) consecutive ones."""
    words = text.translate(_LOWER).split()
    found = []
    for n in range(runs[0], runs[1] + 1):
        named = words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        found.append(np.fromiter(map(zlib.crc32, named), np.int64, len(named)))
    return len(words), np.concatenate(found) % buckets


def bucket_counts(texts: DataFrame, runs: tuple[int, int], buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: one row a bucket and task, summed by Spark; ``buckets`` numbers reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text").cast(pa.large_binary()):
                total += np.bincount(hashed_features(text.as_py(), runs, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def bucket_gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """For each bucket a thousand times the log of how much more often the target has it, each count one higher; floored."""
    s_all, t_all = int(of_docs.sum()) + len(of_docs), int(of_target.sum()) + len(of_docs)
    pairs = zip(of_docs.tolist(), of_target.tolist())
    return np.array([math.floor(1000 * math.log(((t + 1) * s_all) / ((s + 1) * t_all))) for s, t in pairs], np.int64)


def scored(docs: DataFrame, gains: np.ndarray, runs: tuple[int, int], seed: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row.

    The weight is the floored mean gain of the text's features; the score adds
    a thousandfold Gumbel number drawn by the id, so that the highest scores
    are a draw without replacement by the weights.
    """
    ship_package(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    rows = identified(docs).select(F.struct("doc_id", "text_key").alias("row"), "text", drawn.alias("drawn"))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, h in zip(batch.column("text").cast(pa.large_binary()), batch.column("drawn").to_pylist()):
                n_words, at = hashed_features(text.as_py(), runs, len(gains))
                weight = int(gains[at].sum()) // len(at) if len(at) else 0
                gumbel = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
                out.append((n_words, len(at), weight, weight + gumbel))
            columns = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c) for c in columns)], ["row", "n_words", "n_features", "weight", "score"])

    of_row = f"row struct<doc_id:{dict(docs.dtypes)['doc_id']},text_key:bigint>"
    return rows.mapInArrow(weighed, f"{of_row}, n_words bigint, n_features bigint, weight bigint, score bigint").select(
        "row.*", "n_words", "n_features", "weight", "score"
    )


def _literal(keys: DataFrame, values: tuple) -> Column:
    kinds = dict(keys.dtypes)
    return F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(KEY, values)])


def _in_order(values: tuple) -> tuple:
    return tuple((v is not None, v) for v in values)


def _medians(keys: DataFrame, chunk: int) -> list[tuple[int, int, tuple]]:
    """(side, keys, their middle one) of every chunk of a partition's keys."""
    fields = ", ".join(f"{c} {t}" for c, t in keys.dtypes)

    def middle(side: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        order = pc.sort_indices(rows, [(c, "ascending") for c in KEY], null_placement="at_start")
        one = rows.take(order[len(rows) // 2 : len(rows) // 2 + 1]).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*one.columns, pa.array([len(rows)])], [*one.schema.names, "n"])

    def by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            sides = batch.column("side")
            for side in pc.unique(sides).to_pylist():
                mine = held.setdefault(side, [])
                mine.append(batch.filter(pc.equal(sides, side)))
                if sum(len(b) for b in mine) >= chunk:
                    yield middle(side, held.pop(side))
        for side, rest in held.items():
            yield middle(side, rest)

    found = keys.mapInArrow(by_side, f"{fields}, n bigint").collect()
    return [(row["side"], row["n"], tuple(row[c] for c in KEY)) for row in found]


def nth_key(keys: DataFrame, n: int, total: int, chunk: int = CHUNK, finish: int = FINISH) -> tuple:
    """The ``n``-th lowest (from 1) of ``total`` keys, which are a written table.

    Each partition gives the median of what is left of its keys; their median,
    each weighted by the keys it stands for, has at least a quarter of all that is left
    on either side.  One pass counts both sides and takes the medians of
    each, so the side without the ``n``-th key is discarded and the next pivot
    is there.  What is left is written anew when it has shrunk by eight, and
    sorted when few keys are left.  The driver gets one row for every
    ``chunk`` keys or partition.
    """
    every, low, high, left, written = keys, None, None, total, total
    medians = _medians(keys.select(*KEY, F.lit(0).alias("side")), chunk) if left > finish else []
    while left > finish:
        medians.sort(key=lambda m: _in_order(m[2]))
        reach = np.cumsum([size for _, size, _ in medians])
        pivot = medians[int(np.searchsorted(reach, (reach[-1] + 1) // 2))][2]
        key, at = F.struct(*KEY), _literal(every, pivot)
        side = F.when(key < at, 0).when(key > at, 1).otherwise(2)
        found = _medians(_between(keys, low, high).select(*KEY, side.alias("side")), chunk)
        below = sum(size for s, size, _ in found if s == 0)
        if n == below + 1:
            return pivot
        if n <= below:
            high, left = pivot, below
        else:
            low, n, left = pivot, n - below - 1, left - below - 1
        medians = [m for m in found if m[0] == (0 if high is pivot else 1)]
        if left * 8 < written:
            keys, written = materialize(_between(keys, low, high), "sample-left"), left
    row = _between(keys, low, high).orderBy(*[F.col(c).asc_nulls_first() for c in KEY]).limit(n).tail(1)[0]
    return tuple(row[c] for c in KEY)


def _between(keys: DataFrame, low: tuple | None, high: tuple | None) -> DataFrame:
    key = F.struct(*KEY)
    if low is not None:
        keys = keys.where((F.col("low") >= low[0]) & (key > _literal(keys, low)))
    if high is not None:
        keys = keys.where((F.col("low") <= high[0]) & (key < _literal(keys, high)))
    return keys


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, runs: tuple[int, int] = (1, 1),
    buckets: int = BUCKETS, seed: int = 2024, chunk: int = CHUNK, finish: int = FINISH,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_features``, ``weight``, ``score``, and ``rank`` (from 1) where it is drawn.

    Of the documents with ``least_words``, the ``percent`` with the highest
    scores are drawn, equal scores by smaller id (null first), then by hash of
    the text, so the draw is the same in every run; equal rows differ by
    the place at which they were written.  Gains are an array of ``buckets``
    numbers, the only thing sent to all tasks.  The texts are read twice and
    never move; winners alone are sorted, over any number of tasks.

    A null text has no words (weight 0, not drawn); a very long one is read
    whole; equal rows are documents of their own; without target texts all
    gains follow the documents alone; an empty table stays empty; other
    columns are ignored.
    """
    texts = identified(docs)
    gains = bucket_gains(bucket_counts(texts, runs, buckets), bucket_counts(target.select(F.coalesce("text", F.lit("")).alias("text")), runs, buckets))
    rows = scored(docs, gains, runs, seed).withColumn("copy", F.monotonically_increasing_id()).withColumn("low", -F.col("score"))
    rows = materialize(rows, "sample-scores")
    able = rows.where(F.col("n_words") >= least_words)
    total = able.count()
    wanted = percent * total // 100
    result = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*result, F.lit(None).cast("long").alias("rank"))
    cut = nth_key(able.select(*KEY), wanted, total, chunk, finish)
    chosen = (F.col("n_words") >= least_words) & (F.struct(*KEY) <= _literal(rows, cut))
    winners = rows.where(chosen).orderBy(*[F.col(c).asc_nulls_first() for c in KEY]).withColumn("place", F.monotonically_increasing_id())
    winners = materialize(winners.select(*result, "place"), "sample-winners").withColumn("run", F.shiftright("place", 33))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # One row for every task of the sort.
    runs_of = winners.groupBy("run").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    runs_of = runs_of.select("run", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    ranked = winners.join(F.broadcast(runs_of), "run").select(*result, (F.col("place") - F.col("first") + F.col("before") + 1).alias("rank"))
    return ranked.union(rows.where(~chosen).select(*result, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight against the benchmark, and the rank of those drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
