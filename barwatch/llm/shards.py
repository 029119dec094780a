"""Contiguous shards of nearly equal bytes, from prefix sums over per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwatch.llm.common import table, text_of
from barwatch.session import materialize

ROW_BYTES = 16  # counted for every row besides its text


PARTITION = ["bucket", "sub", "single", "salt"]  # in the global order


def _partitioned(rows: DataFrame, cuts: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds ``sub``, more bits of the hash in a large bucket, and for a hot hash itself as ``single`` and a ``salt`` by id; else 0."""
    met = rows.join(F.broadcast(cuts), "bucket").join(F.broadcast(hot), "h", "left")
    return met.withColumns({
        "sub": F.expr("shiftrightunsigned(shiftrightunsigned(shiftleft(h, bits), 1), 63 - more_bits)"),
        "single": F.when(F.col("parts").isNotNull(), F.col("h")).otherwise(0),
        "salt": F.coalesce(1 + F.pmod(F.xxhash64("id", "size"), "parts"), F.lit(0)),
    })


def _placed(rows: DataFrame, offsets: DataFrame, shards: int) -> DataFrame:
    """Adds the row's global number ``at`` and its ``shard``, by the middle of its bytes in the global order."""
    within = Window.partitionBy(*PARTITION).orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.count(F.lit(1)).over(within))
    return (
        numbered.join(F.broadcast(offsets), PARTITION)
        .withColumn("at", F.col("rows_before") + F.col("nth") - 1)
        .withColumn(
            "shard",
            F.expr(f"cast(least({shards - 1}, ((2 * (bytes_before + upto) - size) * {shards}) div (2 * bytes_all)) as int)"),
        )
    )


def balanced_shards(
    docs: DataFrame, shards: int = 40, bucket_bits: int = 12, partition_rows: int = 1_000_000
) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``shard`` and ``slot``.

    The global order is by hash of the text, then id, so equal texts are
    neighbours.  It is cut into partitions: by the top bits of the hash, and a
    bucket of more than ``partition_rows`` rows by more bits.  There, a hash
    with more than an eighth as many rows (copies of one text) has partitions
    of its own beside its part of the bucket, dealt by id; all others stay in
    their order.  Byte and row totals of the partitions, at most
    2^bucket_bits + 11 * rows / partition_rows of them, are summed in their order;
    with the sums inside a partition they give every row's place, and equal
    targets cut the places into shards.  Shard sizes differ from the mean by
    at most one document.  Texts move once.

    A null text has 16 bytes; null ids come first; equal rows get neighbouring
    slots; an empty table stays empty; columns of the added names are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    text = text_of()
    keyed = docs.select(
        F.struct(*kept).alias("row"),
        F.col("doc_id").alias("id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.xxhash64(text).alias("h"),
    ).withColumn("bucket", F.shiftrightunsigned("h", 64 - bucket_bits).cast("int"))
    narrow = materialize(keyed.drop("row"), "shard-rows")
    more = F.greatest(F.ceil(F.log2(F.col("count") / partition_rows)), F.lit(0)).cast("int")
    cuts = narrow.groupBy("bucket").count().select("bucket", F.lit(bucket_bits).alias("bits"), more.alias("more_bits"))
    large = narrow.join(F.broadcast(cuts.filter("more_bits > 0").select("bucket")), "bucket", "left_semi")
    hot = large.groupBy("h").count().filter(F.col("count") > partition_rows / 8)
    hot = materialize(hot.select("h", F.ceil(F.col("count") / partition_rows).alias("parts")), "shard-hot")
    dealt = _partitioned(narrow, cuts, hot)
    before = Window.orderBy(*PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*PARTITION)
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            *PARTITION,
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("bytes_all"),
        )
    )
    offsets = materialize(offsets, "shard-offsets")
    firsts = _placed(dealt, offsets, shards).groupBy("shard").agg(F.min("at").alias("first"))
    placed = _placed(_partitioned(keyed, cuts, hot), offsets, shards).join(F.broadcast(firsts), "shard")
    return placed.select("row.*", "size", "shard", (F.col("at") - F.col("first")).alias("slot"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of all documents, under the law of equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = balanced_shards(docs)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
