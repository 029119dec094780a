"""Quality classifier: averaged vectors of hashed words and letter n-grams under a softmax.

Training is stochastic gradient descent in numpy on a bounded sample of
labelled documents; scoring reads every document whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwatch.llm.common import table, text_of, utf8, whole_documents
from barwatch.session import ship_package

FOLDS = 5
THRESHOLD = 0.3
GRAMS = (3, 4)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Settings:
    """``sample`` labelled documents at most are learned from, those with the smallest hashed ids."""

    sample: int = 3000
    bits: int = 17
    dim: int = 8
    epochs: int = 10
    rate: float = 4.0
    batch: int = 16
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """One weight per hashed feature: what its vector adds to the difference of the two softmax inputs."""

    weights: np.ndarray
    bias: float
    bits: int


def features(data: np.ndarray, starts: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of hashed features of the documents ``data[starts[i]:starts[i + 1]]``: (ids, document starts in ids).

    Words and the letter n-grams (over bytes) of whole texts; an n-gram
    neither crosses a document's end nor depends on other documents.
    """
    shift = np.uint64(64 - bits)
    origin = starts[:-1] - starts[0]
    bytes_ = data[starts[0] : starts[-1]].astype(np.uint64)
    ends = np.repeat(starts[1:] - starts[0], np.diff(starts))
    for n in GRAMS:
        if len(bytes_) < n:
            continue
        code = np.zeros(len(bytes_) - n + 1, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | bytes_[i : len(code) + i]
        inside = np.flatnonzero(np.arange(len(code)) + n <= ends[: len(code)])
        ids = ((code[inside] + np.uint64(n)) * _MIX) >> shift
        yield ids.astype(np.int64), np.searchsorted(inside, origin)
    if not len(bytes_):
        return
    letter = ~_BLANK[data[starts[0] : starts[-1]]]
    first = np.zeros(len(letter), bool)
    first[origin[origin < len(letter)]] = True
    begins = letter & (first | np.concatenate(([True], ~letter[:-1])))
    at = np.flatnonzero(begins)
    if len(at):
        place = np.arange(len(letter)) - np.repeat(np.append(0, at), np.diff(np.concatenate(([0], at, [len(letter)]))))
        power = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX
        power ^= power >> np.uint64(29)
        sums = np.add.reduceat(np.where(letter, (bytes_ + np.uint64(1)) * power, np.uint64(0)), at)
        ids = ((sums ^ (sums >> np.uint64(31))) * _MIX) >> shift
        yield ids.astype(np.int64), np.searchsorted(at, origin)


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``first``."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[np.append(first[1:], len(values))] - total[first]


def counted_features(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Distinct feature ids of each document, with their share of all its features."""
    for batch in batches:
        data, starts = utf8(batch.column("text"))
        ids, shares = [], []
        for i in range(len(starts) - 1):
            found = [x for x, _ in features(data, starts[i : i + 2], bits)]
            each, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            ids.append(each.astype(np.int32))
            shares.append((n / max(n.sum(), 1)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["key", "ids", "shares"]
        )


def train(ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """Vectors and softmax by gradient descent; one class alone gives its own constant score."""
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-0.5, 0.5, (1 << settings.bits, settings.dim)) / settings.dim
    out, bias = np.zeros((settings.dim, 2)), np.zeros(2)
    n, done = len(labels), 0
    for _ in range(settings.epochs if n else 0):
        order = rng.permutation(n)
        for lot in np.split(order, range(settings.batch, n, settings.batch)):
            rate = settings.rate * (1 - done / (settings.epochs * n))
            sizes = [len(ids[i]) for i in lot]
            which, used, share = np.repeat(np.arange(len(lot)), sizes), np.concatenate([ids[i] for i in lot]), np.concatenate([shares[i] for i in lot])
            hidden = np.zeros((len(lot), settings.dim))
            np.add.at(hidden, which, vectors[used] * share[:, None])
            scores = hidden @ out + bias
            odds = np.exp(scores - scores.max(1, keepdims=True))
            error = odds / odds.sum(1, keepdims=True)
            error[np.arange(len(lot)), labels[lot]] -= 1
            back = error @ out.T
            out -= rate * hidden.T @ error / len(lot)
            bias -= rate * error.mean(0) / 4
            np.subtract.at(vectors, used, rate * share[:, None] * back[which])
            done += len(lot)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), settings.bits)


def scores(data: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """Probability of label 1 of each document; the averaged vectors meet the softmax, so a sum of weights is enough."""
    n = len(starts) - 1
    total, count = np.zeros(n), np.zeros(n)
    for ids, first in features(data, starts, model.bits):
        total += per_document(model.weights[ids], first)
        count += np.diff(np.append(first, len(ids)))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + model.bias, -60, 60)))


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id as text leaves 0 by 5.  A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the labelled documents outside the held-out fold.

    The sample's distinct features, a few thousand numbers a document, come to
    the driver; their count is bounded by ``settings.sample`` documents of at
    most 2^bits features.  Rows without id or with a label other than 0 and 1
    are left out; a document with two labels is learned with both.  Equal rows
    count once, of labels as of documents; rows of one id with other texts are documents
    of their own, and of all of them the first ``settings.sample`` by hash are learned.
    """
    ship_package(docs.sparkSession)
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    picked = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(settings.sample)
    labelled = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    place = ["h", "doc_id", "quality", "text_key"]
    labelled = labelled.withColumns({"h": F.xxhash64("doc_id"), "text_key": F.xxhash64("text")}).dropDuplicates(place)
    texts = labelled.select(F.struct(*place).alias("key"), "text")
    bits, key = settings.bits, texts.schema["key"].dataType.simpleString()
    found = texts.mapInArrow(lambda batches: counted_features(batches, bits), f"key {key}, ids array<int>, shares array<float>")
    first = found.orderBy(*[f"key.{c}" for c in place]).limit(settings.sample)
    found = first.select("key.quality", "ids", "shares").toArrow().combine_chunks()
    ids = [np.asarray(x.values) for x in found.column("ids")] if found.num_rows else []
    shares = [np.asarray(x.values) for x in found.column("shares")] if found.num_rows else []
    # The rows arrive in any order; training should not depend on it.
    order = sorted(range(found.num_rows), key=lambda i: (ids[i].tobytes(), shares[i].tobytes(), found.column("quality")[i].as_py()))
    quality = np.asarray(found.column("quality"), np.int64) if found.num_rows else np.empty(0, np.int64)
    return train([ids[i] for i in order], [shares[i] for i in order], quality[order], settings)


def score_quality(docs: DataFrame, model: Model, with_text: bool = True) -> DataFrame:
    """The columns of ``docs`` (texts only ``with_text``) and ``quality_score``, which is replaced if there.

    A null or empty text gets the bias alone.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^bits numbers, whatever the input
    kept = [c for c in docs.columns if c.lower() not in ("text", "quality_score")]
    rows = docs.select(F.struct(*kept).alias("row"), "text")
    back = ["row", "text"] if with_text else ["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(pc.fill_null(batch.column("text"), ""))
            values = [scores(data, starts[a : b + 1], shared.value) for a, b in whole_documents(starts)]
            found = pa.array(np.concatenate(values) if values else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in back), found], [*back, "quality_score"])

    schema = rows.select(*back).withColumn("quality_score", F.lit(0.0)).schema
    scored = rows.mapInArrow(run, schema)
    order = [c for c in docs.columns if c in kept or c == "text" and with_text]
    return scored.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in order], "quality_score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, with_text=False)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
