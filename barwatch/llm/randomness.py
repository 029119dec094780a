"""Secrets by their form and by how random they look.

The base patterns find assignments, access keys and hexadecimal runs.  The
method takes every long token, also those inside base spans, infers its
encoding, and asks a battery of tests whether its symbols could be drawn at
random from that alphabet.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwatch.llm.common import table, text_of
from barwatch.session import materialize, ship_package

KINDS = ("assign", "access", "hex", "random")  # in the order in which spans of one start are listed
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs end where letters end, so a shorter run hides no longer one
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")  # no '=', which pads a token or stands before it
WIDEST = (re.compile(r"[A-Za-z0-9+/]{20,}"), re.compile(r"[A-Za-z0-9_-]{20,}"))  # base64 and base64url
# Alphabets from the narrowest to the widest; a token has the first one that holds all its symbols.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
BINS = 200  # of p-values from 0 to 1
LENGTHS = (24, 32, 40, 64, 128)  # upper ends of the length classes but the last
RATE = 0.05


def even_chi2_tail(x: float, half: int) -> float:
    """P(chi-squared with 2 * half degrees of freedom > x)."""
    term = total = 1.0
    for k in range(1, half):
        term *= x / 2 / k
        total += term
    return min(1.0, total * math.exp(-x / 2))


def encoding_of(token: str) -> str | None:
    """The narrowest alphabet that holds the token; digits alone are a number and have none."""
    if token.isdigit():
        return None
    symbols = set(token)
    return next((name for name, alphabet in ALPHABETS.items() if symbols <= set(alphabet)), None)


def randomness(token: str, encoding: str) -> float:
    """Combined p-value of the token being drawn evenly from its alphabet.

    Chi-squared over five classes of symbols of known sizes (common small
    letters, other small letters, the two halves of the capitals, digits and
    signs, or as many equal parts of a hexadecimal alphabet), the runs above
    and below the alphabet's middle, and the correlation of neighbours, joined
    by Fisher's sum of logarithms.
    """
    alphabet = ALPHABETS[encoding]
    size, n = len(alphabet), len(token)
    place = {c: i for i, c in enumerate(alphabet)}
    at = np.array([place[c] for c in token])
    if size <= 32:
        cell_of = np.arange(size) * 5 // size
    else:
        cell_of = np.array([0 if c in "etaoinsrhld" else 1 if c.islower() else 2 if "A" <= c <= "M" else 3 if c.isupper() else 4 for c in alphabet])
    expected = np.bincount(cell_of, minlength=5) * n / size
    seen = np.bincount(cell_of[at], minlength=5)
    p_even = even_chi2_tail(float(((seen - expected) ** 2 / expected).sum()), 2)
    high = at >= size / 2
    changes, share = int((high[1:] != high[:-1]).sum()), 0.5
    p_runs = math.erfc(abs(changes - (n - 1) * share) / math.sqrt((n - 1) * share * (1 - share)) / math.sqrt(2))
    centred = at - (size - 1) / 2
    serial = float((centred[1:] * centred[:-1]).sum()) / ((size * size - 1) / 12) / math.sqrt(n - 1)
    p_serial = math.erfc(abs(serial) / math.sqrt(2))
    logs = sum(math.log(max(p, 1e-300)) for p in (p_even, p_runs, p_serial))
    return even_chi2_tail(-2 * logs, 3)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of long runs of symbols of one alphabet, without padding.

    A run that mixes base64's own signs with those of base64url, such as a
    value glued to a name or a path, fits neither; then its longest parts in
    each are taken, which may overlap.
    """
    for m in RUN.finditer(text):
        if any(w.fullmatch(m.group()) for w in WIDEST):
            yield m.span()
        else:
            yield from sorted(p.span() for w in WIDEST for p in w.finditer(text, *m.span()))


def candidates(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, length class, p-value bin) of every token that has an encoding."""
    for start, end in tokens(text):
        token = text[start:end]
        if encoding := encoding_of(token):
            p = randomness(token, encoding)
            yield start, end, sum(end - start > x for x in LENGTHS), min(int(p * BINS), BINS - 1)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("size", pa.int32()), ("bin", pa.int32())])
_FOUND = ("row struct<doc_id:{id}>, base array<struct<start:bigint,kind:int,end:bigint>>, "
          "candidates array<struct<start:bigint,end:bigint,size:int,bin:int>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, more = [], []
        for text in batch.column("text"):
            text = text.as_py()
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            more.append([{"start": a, "end": b, "size": n, "bin": p} for a, b, n, p in candidates(text)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(base, pa.list_(_SPAN)), pa.array(more, pa.list_(_CANDIDATE))], ["row", "base", "candidates"]
        )


def cut_points(counts: np.ndarray, rate: float = RATE) -> np.ndarray:
    """For each length class the first bin that counts as random; BINS if none does.

    ``counts[size, bin]`` counts p-values.  Random tokens spread evenly over
    all bins and others gather near 0, so the upper half shows how many random
    ones a bin has.  A cut holds if at most ``rate`` of the tokens above it
    are more than that and one standard deviation.
    """
    cuts = np.full(len(counts), BINS)
    for i, row in enumerate(counts):
        even = row[BINS // 2 :].sum() / (BINS - BINS // 2)
        above = np.cumsum(row[::-1])[::-1]
        false = np.maximum(above - even * (BINS - np.arange(BINS)), 0)
        chance = np.sqrt(even * (BINS - np.arange(BINS)))  # of the number of random ones; it fades as tokens grow many
        holds = np.flatnonzero((above > 0) & (false <= rate * above + chance))
        if len(holds):
            cuts[i] = holds[0]
    return cuts


def scan_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document: ``doc_id``, ``base`` and ``spans``, arrays of (start, kind, end) in code points.

    Texts are read once.  What that finds, a few numbers a token, is written;
    its p-values are counted per length class and bin (a table of fixed size
    that goes to the driver), which gives the least p-value of each class at
    which at most ``rate`` of the tokens called random would be ordinary ones.

    A text of any length is read whole, in time in proportion to it.  A null text is empty and has no spans; null ids, repeated rows and an
    empty table need no care; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.struct("doc_id").alias("row"), text_of().alias("text"))
    found = rows.mapInArrow(_scan, _FOUND.format(id=dict(docs.dtypes)["doc_id"]))
    found = materialize(found, "secret-tokens")
    counts = np.zeros((len(LENGTHS) + 1, BINS))
    for size, at, n in found.select(F.explode("candidates").alias("c")).groupBy("c.size", "c.bin").count().collect():
        counts[size, at] = n
    cuts = F.array(*[F.lit(int(x)) for x in cut_points(counts, rate)])
    random = F.filter("candidates", lambda c: c["bin"] >= F.get(cuts, c["size"]))
    as_spans = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return found.select("row.doc_id", "base", F.array_sort(F.concat("base", as_spans)).alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
