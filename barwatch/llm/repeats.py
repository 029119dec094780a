"""Finding windows of text that stand in two places, for any unit of text and any index of a shard.

A window of some units (bytes or words) is routed by its gate, the least hash
of the short grams in it.  Equal windows have equal gates, and neighbouring
windows mostly share one, so a document is cut into pieces of windows with one
gate, about twice as many as it has disjoint windows.  Only gates whose gram stands
twice can hold a repeated window; their distinct pieces, with the number of
their places, are dealt to shards, and an index of each shard says which
windows of its pieces stand in two places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwatch.llm.common import identified, same_row
from barwatch.session import materialize, ship_package

RUN = 4096  # windows of one piece at most
SHARD_BYTES = 4 << 20  # of pieces indexed together
GATE_BYTES = 32 << 20  # of distinct pieces of one gate; beyond, its windows are compared by hash
CHUNK = 1 << 20

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SHIFT = np.uint64(31)


@dataclass(frozen=True)
class Units:
    """Whole documents as units: ``data`` from ``at[i]`` to ``end[i]`` is unit i, ``first[d]`` the first unit of document d."""

    data: bytes
    at: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class Kind:
    """A window's size and its grams', how documents become units, and how a shard is searched.

    ``mark`` gets the distinct pieces of a shard (bytes) and in how many places
    each one stands, and returns for each one the starts of windows, in units,
    that stand in two places or more.
    """

    window: int
    gram: int
    units: Callable[[list[bytes]], Units]
    mark: Callable[[list[bytes], np.ndarray], list[np.ndarray]]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for every ``n`` consecutive unit hashes, by doubling."""
    out, length, level, step = None, 0, hashes, 1
    while step <= n:
        if n & step:
            out = level if out is None else level[: len(level) - length if length else None] * _MIX[0] + out[step:]
            if out is not level:
                out = out[: max(len(hashes) - length - step + 1, 0)]
            length += step
        step *= 2
        if step <= n:
            half = step // 2
            level = level[:-half] * _MIX[1] + (level[half:] ^ (level[half:] >> _SHIFT)) if len(level) > half else level[:0]
    out = (out ^ (out >> _SHIFT)) * _MIX[2]
    return out ^ (out >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    level, step = values, 1
    while step * 2 <= width:
        level = np.minimum(level[:-step], level[step:])
        step *= 2
    return np.minimum(level[: len(values) - width + 1], level[width - step :])


def sliding_most(values: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_least(~values, width)


def gates(units: Units, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the documents: document, first window (a unit of the whole), number of windows, gate, its grams here.

    The last is 2 if the gate's gram stands twice or more in the units given,
    since one piece may hold a window twice, and 1 otherwise.
    """
    n = len(units.hashes)
    counts = np.diff(np.append(units.first, n))
    sound = np.flatnonzero(counts >= window)
    if not len(sound):
        return *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64), np.empty(0, np.int64)
    grams, width = gram_hashes(units.hashes, gram), window - gram + 1
    least = sliding_least(grams, width)
    # A gram is the least of some window if the greatest gate of the windows that hold it is its own hash.
    beside = np.zeros(width - 1, np.uint64)
    chosen = np.sort(grams[sliding_most(np.concatenate((beside, least, beside)), width) == grams])
    double = np.unique(chosen[1:][chosen[1:] == chosen[:-1]])
    many = counts[sound] - window + 1
    begin = np.cumsum(many) - many
    starts = np.arange(many.sum()) + np.repeat(units.first[sound] - begin, many)
    doc = np.repeat(sound, many)
    gate = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (gate[1:] != gate[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(starts)))
    cuts = (sizes - 1) // RUN + 1
    heads = np.repeat(heads, cuts) + RUN * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    return doc[heads], starts[heads], np.diff(np.append(heads, len(starts))), gate[heads], 1 + np.isin(gate[heads], double)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    held, size, begin = [], 0, 0
    for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
        if held and size + len(text.as_buffer()) > CHUNK:
            yield begin, held
            held, size, begin = [], 0, i
        held.append(text.as_py())
        size += len(held[-1])
    if held:
        yield begin, held


def _pieces(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in _chunks(batch):
            units = kind.units(texts)
            doc, start, many, gate, grams = gates(units, kind.window, kind.gram)
            ends = units.end[start + many + kind.window - 2] if len(start) else start
            view = memoryview(units.data)
            digests = b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(units.at[start].tolist() if len(start) else [], ends.tolist()))
            keys = np.frombuffer(digests, np.int64).reshape(-1, 2)
            local = start - units.first[doc] if len(start) else start
            size = ends - units.at[start] if len(start) else start
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(doc + begin, pa.int64())),
                 *(pa.array(x, pa.int64()) for x in (local, many, size, gate.view(np.int64), grams, keys[:, 0], keys[:, 1]))],
                ["row", "start", "windows", "bytes", "gate", "grams", "key_a", "key_b"],
            )


def _cut(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted pieces, and their gates, keys and numbers of places."""
    for batch in batches:
        wanted = batch.column("wanted")
        for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
            units = kind.units([text.as_py()])
            rows = wanted[i].values
            start, many = (np.asarray(rows.field(c)) for c in ("start", "windows"))
            cut = [units.data[a:b] for a, b in zip(units.at[start].tolist(), units.end[start + many + kind.window - 2].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(rows.field(c) for c in ("gate", "key_a", "key_b", "places")), pa.array(cut, pa.binary())], ["gate", "key_a", "key_b", "places", "piece"]
            )


def _search(batches: Iterator[pa.RecordBatch], kind: Kind, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the pieces, which come sorted by gate; all pieces of a gate are indexed together."""
    held: dict[tuple[int, int], tuple[bytes, int]] = {}
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        pieces, places = zip(*held.values())
        keys, begins, ends = [], [], []
        for key, starts in zip(held, kind.mark(list(pieces), np.array(places, np.int64))):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                keys.append(key)
                begins.append(starts[np.append(0, cut + 1)])
                ends.append(starts[np.append(cut, len(starts) - 1)] + kind.window)
        of_key = np.array(keys, np.int64).reshape(-1, 2)
        ranges = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(of_key[:, 0]), pa.array(of_key[:, 1]), pa.array(begins, ranges), pa.array(ends, ranges)], ["key_a", "key_b", "begins", "ends"])

    for batch in batches:
        for gate, a, b, places, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if size > shard_bytes and gate != last:
                yield flush()
                held, size = {}, 0
            if (a, b) not in held:
                held[a, b] = piece, places
                size += len(piece)
            last = gate
    if held:
        yield flush()


def _windows(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """Every window of wanted pieces by its hash."""
    for batch in batches:
        for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
            units = kind.units([text.as_py()])
            rows = batch.column("wanted")[i].values
            start, many = (np.asarray(rows.field(c)) for c in ("start", "windows"))
            starts = np.concatenate([np.arange(a, a + n) for a, n in zip(start, many)])
            digests = b"".join(xxhash.xxh3_128_digest(units.data[a:b]) for a, b in zip(units.at[starts].tolist(), units.end[starts + kind.window - 1].tolist()))
            keys = np.frombuffer(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(np.full(len(starts), i))), pa.array(starts), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["row", "start", "key_a", "key_b"]
            )


def _with_texts(texts: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """Documents that have wanted pieces, with an array of them."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("wanted")).select("row.*", "wanted")
    lists = lists.withColumnsRenamed({"doc_id": "w_id", "text_key": "w_key"})
    met = texts["doc_id"].eqNullSafe(lists["w_id"]) & (texts["text_key"] == lists["w_key"])
    return texts.join(lists, met).select(F.struct("doc_id", "text_key").alias("row"), "text", "wanted")


def repeated_ranges(docs: DataFrame, kind: Kind, shard_bytes: int = SHARD_BYTES, gate_bytes: int = GATE_BYTES) -> DataFrame:
    """Every document's ``doc_id``, ``text_key``, ``text`` (null is empty) and ``found``: ranges covered by repeated windows.

    ``found`` is an array of (begin, end) in units, perhaps overlapping, or null.

    Steps: pieces with gate and content hash, no texts (written); a row per
    distinct piece with its number of places, by map-side sums; those whose
    gate has two places (written); their texts, from one place each; shards by
    gate, indexed and searched; the answer joined to every place.  Texts move
    twice.  Copies of a piece are one row from the second step on.  A gate
    with more than ``gate_bytes`` of distinct pieces does not go to one shard;
    its windows are hashed and counted one by one, which any number of tasks
    can share and which gives the same answer.
    """
    ship_package(docs.sparkSession)
    texts = identified(docs)
    row = F.struct("doc_id", "text_key").alias("row")
    id_type = dict(docs.dtypes)["doc_id"]
    of_row = f"row struct<doc_id:{id_type},text_key:bigint>"
    pieces = texts.select(row, "text").mapInArrow(
        lambda batches: _pieces(batches, kind), f"{of_row}, start bigint, windows bigint, bytes bigint, gate bigint, grams bigint, key_a bigint, key_b bigint")
    pieces = materialize(pieces, "pieces")
    place = F.min(F.struct("row", "start", "windows", "gate", "bytes")).alias("place")
    classes = pieces.groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("places"), place).select("key_a", "key_b", "places", "place.*")
    doubles = pieces.groupBy("gate").agg(F.sum("grams").alias("n")).filter("n > 1").select("gate")
    wanted = materialize(classes.join(doubles, "gate"), "wanted")
    load = wanted.groupBy("gate").agg(F.sum("bytes").alias("load"))
    heavy = load.filter(F.col("load") > gate_bytes).select("gate")
    light = wanted.join(heavy, "gate", "left_anti")
    fields = ["start", "windows", "gate", "key_a", "key_b", "places"]
    cut = _with_texts(texts, light, fields).mapInArrow(lambda batches: _cut(batches, kind), "gate bigint, key_a bigint, key_b bigint, places bigint, piece binary")
    shards = cut.repartition("gate").sortWithinPartitions("gate")
    answers = shards.mapInArrow(lambda batches: _search(batches, kind, shard_bytes), "key_a bigint, key_b bigint, begins array<bigint>, ends array<bigint>")
    ranges = F.arrays_zip(F.transform("begins", lambda x: x + F.col("start")).alias("begin"), F.transform("ends", lambda x: x + F.col("start")).alias("end"))
    placed = pieces.select("row", "start", "key_a", "key_b").join(answers, ["key_a", "key_b"]).select("row", F.explode_outer(ranges).alias("r"))
    found = placed.select("row", F.col("r.begin").alias("begin"), F.col("r.end").alias("end"))
    if heavy.head(1):
        hot = _with_texts(texts, pieces.join(heavy, "gate", "left_semi"), ["start", "windows"])
        windows = hot.mapInArrow(lambda batches: _windows(batches, kind), f"{of_row}, start bigint, key_a bigint, key_b bigint").distinct()
        # Equal rows are one row here, though every window of theirs has two places.
        copies = texts.groupBy("doc_id", "text_key").count().select(row, F.col("count").alias("copies"))
        windows = windows.join(copies, "row")
        twice = windows.groupBy("key_a", "key_b").agg(F.sum("copies").alias("n")).filter("n > 1").select("key_a", "key_b")
        found = found.union(windows.join(twice, ["key_a", "key_b"]).select("row", F.col("start").alias("begin"), (F.col("start") + kind.window).alias("end")))
    lists = found.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("found")).select("row.*", "found")
    return texts.join(lists, same_row(texts, lists), "left").select(texts["doc_id"], texts["text_key"], "text", "found")


def covered(found: pa.Scalar, n: int) -> np.ndarray:
    """Which of ``n`` units the ranges cover."""
    change = np.zeros(n + 1, np.int64)
    if found.is_valid:
        np.add.at(change, np.asarray(found.values.field("begin")), 1)
        np.add.at(change, np.asarray(found.values.field("end")), -1)
    return np.cumsum(change[:n]) > 0
