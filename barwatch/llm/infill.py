"""Fill-in-the-middle: a text's lines in another order, cut through a learned index of where they end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwatch.llm.common import table, text_of, utf8, whole_documents
from barwatch.session import ship_package

ERROR = 255  # bytes by which a segment may miss an offset
BLOCK = 256  # boundaries of a segment at most
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class RankIndex:
    """From the rank of a boundary to its offset: straight segments, and by how much each boundary lies beside its own.

    ``offsets`` never fall.  Blocks of boundaries are halved until the line
    through a segment's two ends misses none of its boundaries by more than
    ``error``, so a residual fits two bytes however long the text is; two
    neighbours always lie on their line.
    """

    def __init__(self, offsets: np.ndarray, error: int = ERROR) -> None:
        last = np.append(np.arange(BLOCK, len(offsets), BLOCK), len(offsets)) - 1
        first = np.append(0, last[:-1] + 1)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        residuals = np.zeros(len(offsets), np.int64)
        while len(first):
            sizes = last - first + 1
            segment = np.repeat(np.arange(len(first)), sizes)
            rank = np.arange(len(segment)) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
            slope = (offsets[last] - offsets[first]) / np.maximum(sizes - 1, 1)
            missed = offsets[rank] - self._on_line(offsets[first][segment], slope[segment], rank - first[segment])
            residuals[rank] = missed
            wide = np.maximum.reduceat(np.abs(missed), np.cumsum(sizes) - sizes) > error
            done.append((first[~wide], slope[~wide]))
            middle = (first[wide] + last[wide]) // 2
            first, last = np.concatenate((first[wide], middle + 1)), np.concatenate((middle, last[wide]))
        first, slope = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(first)
        self.first, self.slope = first[order], slope[order]
        self.base = offsets[self.first]
        self.residuals = residuals.astype(np.int16 if error < 1 << 15 else np.int64)

    @staticmethod
    def _on_line(base: np.ndarray, slope: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return base + np.rint(slope * steps).astype(np.int64)

    def predict(self, rank: np.ndarray) -> np.ndarray:
        """Offsets within the error."""
        segment = np.searchsorted(self.first, rank, "right") - 1
        return self._on_line(self.base[segment], self.slope[segment], rank - self.first[segment])

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets."""
        return self.predict(rank) + self.residuals[rank]


def line_boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and the offsets of all boundaries in order: one more than a text has lines, its two ends included."""
    ends = np.flatnonzero(data[starts[0] : starts[-1]] == ord("\n")) + 1 + starts[0]
    filled = starts[1:] > starts[:-1]
    open_end = filled.copy()
    open_end[filled] = data[starts[1:][filled] - 1] != ord("\n")
    lines = np.searchsorted(ends, starts[1:], "right") - np.searchsorted(ends, starts[:-1], "right") + open_end
    return lines, np.sort(np.concatenate((starts[:-1], ends, starts[1:][open_end])))


def _reordered(batches: Iterator[pa.RecordBatch], error: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = utf8(batch.column("text"))
        form = batch.column("form").to_pylist()
        draws = [batch.column(c).to_numpy() for c in ("draw_a", "draw_b")]
        for begin, stop in whole_documents(starts):
            here = starts[begin : stop + 1]
            lines, offsets = line_boundaries(data, here)
            index = RankIndex(offsets, error)
            base = np.cumsum(lines + 1) - lines - 1
            cuts = np.sort([draw[begin:stop] % (lines + 1) for draw in draws], axis=0)
            one, two = (index.offset(base + cut) for cut in cuts)
            chars = np.append(0, np.cumsum((data[here[0] : here[-1]] & 0xC0) != 0x80))
            counts = [chars[b - here[0]] - chars[a - here[0]] for a, b in ((here[:-1], one), (one, two))]
            view, out = memoryview(data), []
            for kind, a, b, c, d in zip(form[begin:stop], here[:-1].tolist(), one.tolist(), two.tolist(), here[1:].tolist()):
                first, middle, rest = (PREFIX.encode(), view[a:b]), (MIDDLE.encode(), view[b:c]), (SUFFIX.encode(), view[c:d])
                parts = {"plain": (view[a:d],), "psm": first + rest + middle, "spm": rest + first + middle}[kind]
                out.append(b"".join(parts))
            plain = np.array([kind == "plain" for kind in form[begin:stop]], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(begin, stop - begin), pa.array(lines, pa.int64()), batch.column("form").slice(begin, stop - begin),
                 *(pa.array(c, pa.int64(), mask=plain) for c in counts), pa.array(out, pa.binary()).view(pa.string())],
                ["row", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, seed: int = 7, share: int = 100, suffix_first: int = 50, error: int = ERROR) -> DataFrame:
    """Per document: ``doc_id``, ``n`` lines, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    A text's lines (each with its newline) are cut at two drawn boundaries
    into prefix, middle and suffix.  ``share`` per cent of the texts are
    rearranged, ``suffix_first`` per cent of those as suffix, prefix, middle
    (``spm``), the others as prefix, suffix, middle (``psm``), each part after its mark.
    All draws are parts of the SHA-256 of the seed and the id, so they
    are the same in every run.  The boundaries of about a megabyte of whole
    texts share one index; a longer text has its own.

    A null text is empty; an empty text, or one that holds a mark, stays as it
    is (``plain``, counts null); a null id is drawn for like an empty one;
    equal rows have equal results; an empty table stays empty; other columns
    are ignored.
    """
    ship_package(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draw = [F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(mark)
    form = (
        F.when((F.col("text") == "") | marked | (draw[2] % 100 >= share), "plain").when(draw[3] % 100 < suffix_first, "spm").otherwise("psm")
    )
    rows = docs.select("doc_id", text_of().alias("text"), digest.alias("digest"))
    rows = rows.select(F.struct("doc_id").alias("row"), "text", form.alias("form"), draw[0].alias("draw_a"), draw[1].alias("draw_b"))
    schema = f"row struct<doc_id:{dict(docs.dtypes)['doc_id']}>, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(lambda batches: _reordered(batches, error), schema).select("row.*", "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output of :func:`fill_in_middle` and its form alone."""

    def between(mark: str, next_mark: str | None) -> Column:
        after = F.substring(output, F.instr(output, mark) + len(mark), F.char_length(output))
        return F.substring_index(after, next_mark, 1) if next_mark else after

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for filling in its middle, and rebuilt from that."""
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines FROM documents
), draws AS (
  SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM texts
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws
), parts AS (
  SELECT *, array_to_string(list_slice(lines, 1, a), '') AS pre, array_to_string(list_slice(lines, a + 1, b), '') AS mid,
    array_to_string(list_slice(lines, b + 1, n), '') AS suf FROM cuts
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
