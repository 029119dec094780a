"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwatch.llm.common import WORD, table, text_of
from barwatch.session import materialize

MOST_TIMES = 3
SALTS = 64  # tasks that share the documents of one source and size

_UPTO = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_TIMES) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from rows of ``source`` and ``size``.

    Sources in code point order, null last, take the weights in turn and share
    the whole size by weight.  A target stops at ``most`` times its source's
    size and the excess is reshared.  That is one level L with
    target = min(most * size, weight * L): with the sources ordered by the
    level at which they stop, L is the largest quotient of what is left by the
    weights left that the next source can still hold.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    totals = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", turn)
        .withColumn("stop", F.col("source_size") * most / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum(F.col("source_size") * most).over(stop.rowsBetween(*_BEFORE)), F.lit(0)))
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.col("full"))
        .withColumn("weights", F.sum("weight").over(stop.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.col("left") / F.col("weights"))
    )
    level = F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(Window.partitionBy())
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.coalesce(level, F.lit(0.0)))
    return totals.select("source", "source_size", target.alias("target"))


def offset_of(source: Column, seed: str) -> Column:
    """A fixed number in [0, 1) for each source."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("\u0000"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def systematic_copies(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """All columns of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to 3).

    Every document of a source expects target / source_size copies.  Expected
    copies are summed from the longest document down; one offset drawn
    for the source is added, and a document is emitted once for each integer
    that its part of the sum crosses.  As sizes only fall along the sum, the words
    taken differ from the target by less than the source's longest document.

    A document's place in that order is the number of documents in earlier
    (size, salt) cells, plus its place in its own cell, by id and then by hash of
    the text.  The salt is a remainder of the id (of its hash, where it is no
    number), so the many copies of one text are numbered in up to
    64 tasks.  Texts move once; cells are sums.

    Null sources are one source, the last; a null text has size 0 (it is
    emitted like others and takes no words); repeated rows are documents of
    their own; an empty table stays empty; columns of the added names are
    replaced.
    """
    added = ("size", "source_size", "target", "copies")
    hashed = F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.lit(0))
    salt = F.pmod(F.coalesce(F.col("id").try_cast("long"), hashed), F.lit(SALTS)).cast("int")
    keyed = docs.select(
        F.struct(*[c for c in docs.columns if c.lower() not in added]).alias("row"),
        F.col("doc_id").alias("id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_of()).alias("tie"),
    ).withColumn("salt", salt).withColumn("name", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit(""))))
    counts = materialize(keyed.groupBy("name", "source", "size", "salt").count(), "mix-cells")
    ordered = Window.partitionBy("name").orderBy(F.col("size").desc(), "salt").rowsBetween(*_BEFORE)
    cells = counts.select("name", "size", "salt", F.coalesce(F.sum("count").over(ordered), F.lit(0)).alias("before"))
    targets = source_targets(counts.select("source", (F.col("size") * F.col("count")).alias("size")))
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0)))
    targets = targets.withColumn("offset", offset_of(F.col("source"), seed)).withColumnRenamed("source", "target_source")
    in_cell = Window.partitionBy("name", "size", "salt").orderBy("id", "tie")
    ranked = keyed.withColumn("nth", F.row_number().over(in_cell)).join(cells, ["name", "size", "salt"])
    place = F.col("before") + F.col("nth")
    crossed = F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))
    mixed = ranked.join(targets, ranked["source"].eqNullSafe(targets["target_source"]))
    copies = F.least(F.lit(MOST_TIMES), F.greatest(F.lit(0), crossed)).cast("int")
    return mixed.select("row.*", "size", "source_size", "target", copies.alias("copies"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix by weights 1, 2, 3 takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return systematic_copies(docs).select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"),
    )


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), stops AS (
  SELECT *, source_size * 3 / weight AS stop FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (
      ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM stops
), targets AS (
  SELECT source, source_size,
    least(source_size * 3.0::DOUBLE, weight * coalesce(max(CASE WHEN lvl <= stop THEN lvl END) OVER (), 0)) AS target,
    ('0x' || substr(md5('mix' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM levels
), placed AS (
  SELECT sized.*, row_number() OVER (PARTITION BY source
    ORDER BY size DESC, ((coalesce(doc_id, 0) % 64) + 64) % 64, doc_id NULLS FIRST) AS place
  FROM sized
), rated AS (
  SELECT doc_id, size, source_size, target, place, u,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0::DOUBLE END AS rate
  FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * least(3, greatest(0, floor(place * rate + u) - floor((place - 1) * rate + u))))::BIGINT AS taken
FROM rated
"""
