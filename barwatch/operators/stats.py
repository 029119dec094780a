"""Feature statistics: correlation, pruning of collinear columns, scaling.

One aggregate pass yields means and deviations per symbol, a second one the
correlation of each feature pair.  Both combine on the map side, so a hot
symbol costs no more than any other.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwatch.schema import FEATURES, SYMBOL
from barwatch.session import join_parameters, materialize

# Fixed value: pairs at or above this absolute correlation are collinear.
CORRELATION_CUT = 0.95


def moments(df: DataFrame, by: list[str], features: list[str] = FEATURES) -> DataFrame:
    """``n, mean[], std[]`` per group, with the sample deviation."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(c) for c in features]).alias("mean"),
        F.array(*[F.stddev_samp(c) for c in features]).alias("std"),
    )


def with_z(df: DataFrame, by: list[str], features: list[str] = FEATURES) -> DataFrame:
    """Add the standardised features ``_z0, _z1, ...``, null where a column is constant."""
    own = materialize(moments(df, by, features), "moments")
    if by:
        df = join_parameters(df, own, by, written=True)
    else:
        df = df.withColumns({c: own.select(c).scalar() for c in ("n", "mean", "std")})
    return _scaled(df, features).drop("n", "mean", "std")


def correlations(df: DataFrame, by: list[str], features: list[str] = FEATURES) -> DataFrame:
    """``n`` and ``corr[]`` per group, in pair order; null if a side is constant.

    ``df`` comes from :func:`with_z`: with both sides centred, plain sums of
    products are as exact as a covariance aggregate and far cheaper.
    """
    pairs = list(combinations(range(len(features)), 2))
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    )
    degrees = F.nullif(F.col("n") - 1, F.lit(0))
    return sums.select(*by, "n", F.array(*[F.col(f"p{i}_{j}") / degrees for i, j in pairs]).alias("corr"))


def pooled_correlation(stats: DataFrame) -> DataFrame:
    """Correlation of the per-symbol standardised features over all symbols.

    A symbol's standardised products sum to ``(n-1) * corr``, so the pooled
    value is a weighted mean.  With one symbol it is that symbol's matrix.
    """
    exploded = stats.select((F.col("n") - 1).alias("weight"), F.posexplode("corr").alias("pair", "r"))
    pooled = exploded.groupBy("pair").agg(
        (F.sum(F.col("r") * F.col("weight")) / F.nullif(F.sum(F.when(F.col("r").isNotNull(), F.col("weight"))), F.lit(0))).alias("r")
    )
    return pooled.agg(F.transform(F.array_sort(F.collect_list(F.struct("pair", "r"))), lambda p: p["r"]).alias("corr"))


def correlation_matrix(df: DataFrame, by: list[str], features: list[str] = FEATURES) -> DataFrame:
    """Long form: one row per group and feature pair."""
    names = [F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j")) for a, b in combinations(features, 2)]
    own = correlations(with_z(df, by, features), by, features)
    return own.select(*by, F.inline(F.arrays_zip(F.array(*names).alias("pair"), F.col("corr")))).select(
        *by, "pair.col_i", "pair.col_j", "corr"
    )


def keep_mask(corr: Column, cut: float = CORRELATION_CUT, features: list[str] = FEATURES) -> Column:
    """Which features stay: none that is collinear with any earlier one.

    An earlier feature counts even if it is dropped itself, and an undefined
    correlation drops nothing.
    """
    place = {pair: k for k, pair in enumerate(combinations(range(len(features)), 2))}

    def kept(j: int) -> Column:
        clashes = [F.coalesce(F.abs(corr[place[i, j]]) >= cut, F.lit(False)) for i in range(j)]
        return ~reduce(lambda a, b: a | b, clashes, F.lit(False))

    return F.array(*[kept(j) for j in range(len(features))])


def selected_names(mask: Column, features: list[str] = FEATURES) -> Column:
    named = F.array(*[F.lit(c) for c in features])
    return F.filter(named, lambda name, i: F.get(mask, i))


def select_features(df: DataFrame, cut: float = CORRELATION_CUT) -> list[str]:
    """The columns a single model over ``df`` uses."""
    own = correlations(with_z(df, [SYMBOL]), [SYMBOL])
    return pooled_correlation(own).select(selected_names(keep_mask(F.col("corr"), cut)).alias("f")).first()["f"]


def assemble(columns: list[str]) -> Column:
    """Columns as one array; a null anywhere is an error, as with VectorAssembler."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns])
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return F.when(complete, values).otherwise(F.raise_error(F.lit("null or NaN among the features")))


def standardise(df: DataFrame, columns: list[str], by: list[str] | None = None, ddof: int = 1) -> DataFrame:
    """Replace columns by ``(x - mean) / std``; a constant column becomes 0."""
    by = by or [SYMBOL]
    deviation = F.stddev_samp if ddof else F.stddev_pop
    stats = df.groupBy(*by).agg(
        F.struct(*[F.avg(c).alias(c) for c in columns]).alias("_mean"),
        F.struct(*[deviation(c).alias(c) for c in columns]).alias("_std"),
    )
    joined = join_parameters(df, stats, by)
    scaled = {
        c: F.coalesce((F.col(c) - F.col(f"_mean.{c}")) / F.nullif(F.col(f"_std.{c}"), F.lit(0.0)), F.lit(0.0))
        for c in columns
    }
    return joined.withColumns(scaled).drop("_mean", "_std")


def feature_space(featured: DataFrame, by: str | None, ddof: int = 1, cut: float = CORRELATION_CUT) -> DataFrame:
    """Per symbol, what turns its rows into model input: ``mean``, ``std``, ``keep`` (a flag per feature) and ``group_rows``.

    With ``by`` each symbol selects its own columns; without it one selection
    holds for all, taken from the pooled correlations.  ``ddof`` 0 divides by
    the population deviation.  ``group_rows`` counts the rows of the model that the symbol belongs to.
    """
    own = materialize(moments(featured, [SYMBOL]), "moments")
    corr = correlations(_centred(featured, own), [SYMBOL])
    if by:
        kept = own.join(corr.select(SYMBOL, keep_mask(F.col("corr"), cut).alias("keep")), SYMBOL).withColumn("group_rows", F.col("n"))
    else:
        keep = pooled_correlation(corr).select(keep_mask(F.col("corr"), cut).alias("keep"))
        kept = own.withColumns({"keep": keep.scalar(), "group_rows": own.agg(F.sum("n")).scalar()})
    narrow = F.lit(1.0) if ddof else F.sqrt((F.col("n") - 1) / F.col("n"))
    std = F.transform("std", lambda x: x * narrow)
    return materialize(kept.select(SYMBOL, "n", "mean", std.alias("std"), "keep", "group_rows"), "space")


def _centred(df: DataFrame, own: DataFrame) -> DataFrame:
    return _scaled(join_parameters(df, own, [SYMBOL], written=True)).drop("n", "mean", "std")


def _scaled(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    return df.withColumns(
        {f"_z{i}": (F.col(c) - F.col("mean")[i]) / F.nullif(F.col("std")[i], F.lit(0.0)) for i, c in enumerate(features)}
    )


def in_space(featured: DataFrame, space: DataFrame) -> DataFrame:
    """Add ``features``, the selected columns standardised within each symbol, and ``group_rows``.

    ``space`` comes from :func:`feature_space`, perhaps of an earlier run;
    rows of symbols that it does not have go.  A null or NaN feature is an error; a constant column is 0.
    """
    rows = _scaled(join_parameters(featured, space, [SYMBOL], written=True))
    z = [f"_z{i}" for i in range(len(FEATURES))]
    holes = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in FEATURES])
    every = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in z])
    chosen = F.filter(every, lambda x, i: F.get("keep", i))
    checked = F.when(holes, F.raise_error(F.lit("null or NaN among the features"))).otherwise(chosen)
    return rows.withColumn("features", checked).drop("n", "mean", "std", "keep", *z)


def model_input(featured: DataFrame, by: str | None, ddof: int = 1, cut: float = CORRELATION_CUT) -> DataFrame:
    """Rows with ``features`` and ``group_rows``, in the space of these rows themselves."""
    return in_space(featured, feature_space(featured, by, ddof, cut))
