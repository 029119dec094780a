"""Benchmark decontamination: test items that documents contain, found by MinHash and verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwatch.llm.common import same_row, table, text_of, words
from barwatch.session import join_parameters, materialize

SHINGLE = 5
CONTAINMENT = 0.8
HIT_ROWS = 400_000  # ids of two numbers that may be broadcast, some tens of bytes each


def runs_of(text: Column, lengths: list[int], shortest: bool = False) -> Column:
    """Hashes of the runs of so many words, for each of ``lengths``; a text of fewer words has none of that length.

    With ``shortest`` only the greatest length that the text reaches counts.
    The words stand in an array of one, so that however Spark moves this
    expression it splits a text once and not once a run.
    """
    none = F.array().cast("array<bigint>")

    def of(terms: Column, n: int) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(terms) - n, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(terms, i + k) for k in range(n)]),
        )
        return F.when(F.size(terms) >= n, each)

    def runs(terms: Column) -> Column:
        each = [of(terms, n) for n in sorted(lengths, reverse=True)]
        return F.coalesce(*each, none) if shortest else F.concat(*[F.coalesce(e, none) for e in each])

    return F.get(F.transform(F.array(words(F.lower(text))), runs), F.lit(0))


def item_sketches(items: DataFrame, n: int, containment: float) -> DataFrame:
    """``item``, its number of shingles, and the shingles to look for, one a row.

    Items are partitioned by size, in powers of two.  A document that holds
    the share ``containment`` of an item's s shingles lacks at most
    floor((1 - containment) * s) of them.  So a MinHash sketch of one more
    than that, for the partition's largest size, has a shingle of every such
    document: nothing is missed, and the smallest hashes are a random choice
    that all documents share.
    """
    hashed = items.select("item", F.explode_outer("runs").alias("hash"), F.size("runs").alias("size"))
    largest = F.pow(F.lit(2), F.length(F.bin("size"))) - 1
    order = Window.partitionBy("item").orderBy("hash")
    ranked = hashed.withColumn("nth", F.row_number().over(order))
    return ranked.filter(F.col("nth") <= F.floor(largest * (1 - containment) + 1e-9) + 1).select("item", "hash")


def contained_items(
    docs: DataFrame, items: DataFrame, n: int = SHINGLE, containment: float = CONTAINMENT
) -> DataFrame:
    """Pairs of a document and an item of which it holds the share ``containment`` of shingles or more.

    ``items`` has ``item_id`` and ``text``.  Result: ``doc_id``,
    ``text_key``, ``item_id``, ``shared`` (shingles), ``size`` (the item's)
    and ``contained``.  Words are compared in small letters.

    Arrays are exploded "outer", since Spark filters the input of a plain
    explode by the array's size and computes it twice for that.  A null hash
    joins nothing.  A document's shingles are compared with the sketches of all items by one
    hash join, which names the document and the item of each hit.  The documents that were hit, and no
    others, are read again and their shingles counted against all of the item's.  Items of one text are
    searched once.  The sketches and items are broadcast while they are
    counted small (see ``join_parameters``) and shuffled beyond that; so are the ids of the documents hit.

    An item shorter than ``n`` words is one run of all its words, which is
    looked for among the runs of that length in every document (only lengths that
    items have are hashed); an item without words is never contained.  Null texts are empty; equal rows are
    one document with one row each per item; an empty table gives an empty
    result; other columns are ignored.
    """
    named = items.select("item_id", F.struct(F.lower(text_of()).alias("t")).alias("item"))
    classes = named.select("item").distinct().select(
        F.xxhash64("item.t").alias("item"), F.array_distinct(runs_of(F.col("item.t"), list(range(1, n + 1)), True)).alias("runs"))
    length = F.least(F.size(words(F.lower(text_of()))), F.lit(n)).alias("length")
    lengths = [r["length"] for r in items.select(length).distinct().collect() if r["length"] > 0]  # n at most
    text = text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), runs_of(text, lengths or [n]).alias("runs"))
    hits = materialize(
        join_parameters(rows.select("doc_id", "text_key", F.explode_outer("runs").alias("hash")), item_sketches(classes, n, containment), ["hash"])
        .select("doc_id", "text_key", "item").distinct(), "hits")
    met = hits.select("doc_id", "text_key").distinct()
    if met.count() <= HIT_ROWS:
        met = F.broadcast(met)
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    again = texts.join(met, same_row(texts, met), "left_semi")
    candidates = again.select("doc_id", "text_key", F.explode_outer(runs_of(F.col("text"), lengths or [n])).alias("hash"))
    full = classes.select("item", F.size("runs").alias("size"), F.explode_outer("runs").alias("hash"))
    both = join_parameters(candidates, full, ["hash"])
    shared = (
        both.join(hits, same_row(both, hits) & (both["item"] == hits["item"]), "left_semi")
        .groupBy("doc_id", "text_key", "item", "size")
        .agg(F.countDistinct("hash").alias("shared"))
        .withColumn("contained", F.col("shared") / F.col("size"))
        .filter(F.col("contained") >= containment)
    )
    ids = named.select("item_id", F.xxhash64("item.t").alias("item"))
    return join_parameters(shared, ids, ["item"]).select("doc_id", "text_key", "item_id", "shared", F.col("size").cast("long").alias("size"), "contained")


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` less those that contain an item; all columns, repeated rows kept or dropped together."""
    found = contained_items(docs, items, n, containment).select("doc_id", "text_key").distinct()
    kept = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text_of()).alias("text_key"))
    return kept.join(found, same_row(kept, found), "left_anti").select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that contain a benchmark item, with the share of its shingles."""
    docs = table(spark, sf_dir, "documents")
    found = contained_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "size", F.round("contained", 6).alias("contained"))


OP7_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), lengths AS (
  SELECT DISTINCT least(len(w), 5) AS n FROM item WHERE len(w) > 0
), doc_runs AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc JOIN lengths ON len(w) >= n)
), item_runs AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 5) AS n, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), sizes AS (
  SELECT item_id, count(*) AS size FROM item_runs GROUP BY item_id
)
SELECT doc_id, item_id, count(*) AS shared, any_value(size) AS size, round(count(*) / any_value(size), 6) AS contained
FROM doc_runs JOIN item_runs USING (n, g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / any_value(size) >= 0.8
"""
