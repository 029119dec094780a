"""Quality rules: what a document repeats, and lines that many documents of a host share.

Everything is expressions on the row, but for the count of documents per line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwatch.llm.common import table, text_of, words

SYMBOLS = "[#*$%&|<>]"
BLANK = " \t\n\x0b\f\r"


def with_repeated_window_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: of the array ``terms``, those in three-word windows found twice or more.

    Windows are hashed, and each one's number is packed into the low bits of
    its hash; one sort of longs brings equal hashes together, so the work is
    n log n whatever the text repeats.  Where windows of one hash differ in
    their words, the windows themselves are compared.
    """
    windows = "sequence(0, size(terms) - 3)"
    same = "terms[{a}] = terms[{b}] and terms[{a} + 1] = terms[{b} + 1] and terms[{a} + 2] = terms[{b} + 2]"
    bits = lambda p: f"shiftright({p}, low)"
    at = lambda p: f"cast({p} & (shiftleft(1L, low) - 1) as int)"
    steps = {
        "low": "length(bin(size(terms)))",
        "packed": "if(size(terms) < 4, cast(array() as array<bigint>), sort_array(transform("
        f"{windows}, i -> shiftleft(shiftright(xxhash64(terms[i], terms[i + 1], terms[i + 2]), low), low) | i)))",
        "again": f"filter(packed, (p, j) -> {bits('get(packed, j - 1)')} <=> {bits('p')})",
        "hits": "if(size(again) = 0, again, filter(packed, (p, j) ->"
        f" {bits('get(packed, j - 1)')} <=> {bits('p')} or {bits('get(packed, j + 1)')} <=> {bits('p')}))",
        "clash": "size(hits) > 0 and exists(sequence(1, size(hits) - 1), j -> shiftright(hits[j - 1], low) = shiftright(hits[j], low)"
        f" and not ({same.format(a=at('hits[j - 1]'), b=at('hits[j]'))}))",
        "starts": f"sort_array(if(clash, filter({windows}, i -> exists({windows}, j -> i <> j and {same.format(a='i', b='j')})),"
        f" transform(hits, p -> {at('p')})))",
        "n_repeat_words": "aggregate(transform(starts, (s, j) -> least(3, coalesce(get(starts, j + 1), s + 3) - s)),"
        " 0L, (total, x) -> total + x)",
    }
    for name, step in steps.items():
        rows = rows.withColumn(name, F.expr(step))
    return rows.drop("low", "packed", "again", "hits", "clash", "starts")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != "")


def normalised(text: Column) -> Column:
    """The text without regard to letter case and which numbers it has."""
    return F.lower(F.regexp_replace(text, "[0-9]+", "0"))


def line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def base_rules(docs: DataFrame) -> DataFrame:
    """Per row of ``doc_id`` and ``text``: the counts of the document itself and ``base_failed``."""
    rows = docs.withColumn("terms", words(F.col("text"))).withColumn("lines", lines_of(F.col("text")))
    rows = with_repeated_window_words(rows)
    counted = rows.select(
        *docs.columns,
        F.size("terms").cast("long").alias("n_words"),
        F.length(F.array_join("terms", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def shared_lines(lines: DataFrame, documents: int) -> DataFrame:
    """Keys of lines that more than ``documents`` documents of one host hold; ``lines`` has each line of a document once."""
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("holders"))
    return counted.filter(F.col("holders") > documents)


def line_frequency_rules(docs: DataFrame, documents: int = 10, depleted: float = 0.5) -> DataFrame:
    """Per document: its own counts, the verdict ``kept``, and ``kept_text``, its text less the shared lines.

    A line (its letters made small, its numbers made 0, trimmed and hashed) that more than ``documents`` documents of
    the same ``source`` hold is removed from all of them; ``kept_text`` has
    the other lines as they were, blank ones too, and a text without shared
    lines is unchanged.  A document that loses more than the share
    ``depleted`` of its lines' characters is rejected, as is one that fails
    the base rules; ``kept_text`` is there for rejected ones as well.  Lines
    are counted with map-side sums, so a line that all documents hold is one
    row per task.  Texts are shuffled only if ``kept_text`` is used.

    A null text is empty and fails the base rules; a null source is a host of
    its own; every repeated row counts as a document; an empty table stays
    empty; other columns are ignored.
    """
    text = text_of()
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-")).alias("host"),
                       text.alias("text"), F.xxhash64(text).alias("text_key"))
    named = rows.withColumn("lines", lines_of(normalised(F.col("text"))))
    keys = named.select("host", F.explode(F.array_distinct(F.transform("lines", line_key))).alias("line"))
    shared = shared_lines(keys, documents)
    each = rows.select("doc_id", "text_key", "host", F.posexplode(F.split(normalised(F.col("text")), "\n")).alias("place", "content"))
    each = each.filter(F.btrim("content", F.lit(BLANK)) != "").select(
        "doc_id", "text_key", "host", line_key(F.col("content")).alias("line"), F.struct("place", F.length("content").alias("chars")).alias("lost"))
    # Equal rows fall into one group here, with one and the same set of places.
    lost = (
        each.join(shared.select("host", "line"), ["host", "line"], "left_semi")
        .groupBy("doc_id", "text_key", "host")
        .agg(F.collect_set("lost").alias("lost"))
        .withColumnsRenamed({"doc_id": "l_id", "text_key": "l_key", "host": "l_host"})
    )
    chars = F.aggregate(lines_of(normalised(F.col("text"))), F.lit(0).cast("long"), lambda n, line: n + F.length(line))
    base = base_rules(rows.select("doc_id", "text_key", "host", "text", chars.alias("line_chars")))
    joined = base.join(lost, base["doc_id"].eqNullSafe(lost["l_id"]) & (base["text_key"] == lost["l_key"]) & (base["host"] == lost["l_host"]), "left")
    lost_chars = F.aggregate("lost", F.lit(0).cast("long"), lambda n, line: n + line["chars"])
    share = F.coalesce(lost_chars, F.lit(0)) / F.greatest(F.col("line_chars"), F.lit(1))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (share <= depleted)).alias("kept"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_shared_lines"), F.round(share, 6).alias("shared_share"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("lost.place"))).alias("kept_text"),
    )


def without_lines(text: Column, places: Column) -> Column:
    """The text without its lines at these places; time is linear in the lines."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return F.get(F.transform(F.array(F.struct(lines.alias("all"), left.alias("left"))), lambda x: F.array_join(
        F.transform(x["left"], lambda i: F.get(x["all"], i)), "\n")), F.lit(0))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return line_frequency_rules(table(spark, sf_dir, "documents")).drop("kept_text")


OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce('+' || source, '-') AS host, row_number() OVER () AS r FROM documents
), terms AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM terms)
), hits AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, sum(least(3, coalesce(next - i, 3)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM hits) GROUP BY r
), lines AS (
  SELECT r, host, line, lower(regexp_replace(line, '[0-9]+', '0', 'g')) AS low,
    trim(low, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS norm
  FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), shared AS (
  SELECT host, norm FROM lines GROUP BY host, norm HAVING count(DISTINCT r) > 10
), counted AS (
  SELECT r, sum(length(low)) AS chars, count(*) - count(DISTINCT line) AS dups,
    coalesce(sum(length(low)) FILTER (WHERE shared.norm IS NOT NULL), 0) AS lost,
    count(*) FILTER (WHERE shared.norm IS NOT NULL) AS lost_lines
  FROM lines LEFT JOIN shared USING (host, norm) GROUP BY r
), base AS (
  SELECT docs.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    coalesce(lost_lines, 0) AS n_shared_lines, coalesce(lost, 0) / greatest(coalesce(chars, 1), 1) AS share
  FROM docs JOIN terms USING (r) LEFT JOIN repeats USING (r) LEFT JOIN counted USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND share <= 0.5 AS kept, n_shared_lines, round(share, 6) AS shared_share
FROM judged
"""
