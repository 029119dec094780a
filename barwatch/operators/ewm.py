"""Exponentially weighted means as window expressions.

The recursion ``y = a*y' + share*x`` is solved in blocks of rows.  Inside a
block, each term is scaled by the inverse of the decay since the block began,
summed, and scaled back; the block before adds one carry term.  Blocks are
long enough that anything older weighs less than 1e-19, and short enough that
the scales stay far inside the range of a double.

A decay too slow for such blocks is solved exactly: a block is an affine map
of the mean before it, the maps are composed over all blocks of a series, and
every block takes over its own carry.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barwatch.operators.series import HALO_ROWS, Series
from barwatch.schema import SYMBOL
from barwatch.session import join_parameters, materialize

_NEGLIGIBLE = 44.0  # nats of decay after which older rows no longer show
_LARGEST = 500.0  # nats by which a term may be scaled
_LONG_GAP = 60.0  # a gap that decays more than this forgets its past


def alpha_from(span: float | None = None, com: float | None = None) -> float:
    return 2.0 / (span + 1.0) if span is not None else 1.0 / (1.0 + com)


def slowest_decay(alpha: float) -> float:
    """Nats per row that a series forgets at least, however its nulls lie."""
    q = 1.0 - alpha
    horizon = int(60 / -math.log(q)) + 1
    return min(math.log1p(alpha * q**-k) / k for k in range(1, horizon + 1))


def block_rows(alpha: float) -> int:
    """Rows after which the past is negligible, within the range of a double."""
    rows = 1024
    while rows * slowest_decay(alpha) < _NEGLIGIBLE:
        rows *= 2
    while rows * -math.log(1.0 - alpha) > _LARGEST:
        rows //= 2
    return rows


def slow(alpha: float) -> bool:
    """Whether what lies before the block before, or before a chunk's halo, may still show."""
    return block_rows(alpha) > HALO_ROWS or block_rows(alpha) * slowest_decay(alpha) < _NEGLIGIBLE


def levels_for(alphas: list[float]) -> list[int]:
    """The blocks that these decays need; slow ones have their own."""
    return sorted({block_rows(a) for a in alphas if not slow(a)}, reverse=True)


def _level(rows: int) -> str:
    return f"_b{rows}"


def with_blocks(series: Series, levels: list[int]) -> Series:
    """Number the blocks and order the series by them.

    Block numbers nest and rise with the position, so a sort by all of them
    serves windows over a block and windows over the whole series alike.
    """
    rows = series.rows.withColumns({_level(n): F.floor(F.col("_pos") / n) for n in levels})
    return replace(series, rows=rows, order=(*[_level(n) for n in levels], "_pos"))


def ewm_means(series: Series, specs: dict[str, tuple[str, float]], first_rows: int = 0) -> Series:
    """Add one smoothed column per spec ``{name: (column, alpha)}``.

    Leading nulls stay null, a null repeats the mean before it, and its place
    still counts as one step of decay.  ``series`` comes from
    :func:`with_blocks` with the levels these decays need.

    In a gapless series only the ``first_rows`` rows of a column may be null;
    each step then decays alike and the scale follows from the position.
    """
    for name, (column, alpha) in specs.items():
        if slow(alpha):
            series = _composed_mean(series, name, column, alpha)
    specs = {name: spec for name, spec in specs.items() if not slow(spec[1])}
    if not specs:
        return series
    if series.gapless:
        return _gapless_means(series, specs, first_rows)
    pos = F.col("_pos")
    rows = series.rows
    before = series.window().rowsBetween(Window.unboundedPreceding, -1)

    def gap(column: str) -> Column:
        return F.col(f"_gap_{column}")

    inputs = sorted({c for c, _ in specs.values()})
    rows = rows.withColumns(
        {
            f"_gap_{c}": pos - F.last(F.when(F.col(c).isNotNull(), pos), ignorenulls=True).over(before)
            for c in inputs
        }
    )

    def scale(column: str, alpha: float) -> Column:
        # Ordinary steps are counted and raised to a power, which is more
        # exact than a sum of logarithms; only steps over nulls are summed.
        q = 1.0 - alpha
        seen = F.col(column).isNotNull()
        one = F.when(seen & (gap(column) == 1), F.lit(1)).otherwise(F.lit(0))
        over_nulls = F.least(F.lit(_LONG_GAP), F.log1p(alpha * F.pow(F.lit(q), -gap(column))))
        nats = F.when(seen & (gap(column) > 1), over_nulls).otherwise(F.lit(0.0))
        block = _block(series, alpha)
        return F.pow(F.lit(1.0 / q), F.sum(one).over(block)) * F.exp(F.sum(nats).over(block))

    def share(column: str, alpha: float) -> Column:
        return (
            F.when(gap(column).isNull(), F.lit(1.0))
            .when(gap(column) == 1, F.lit(alpha))
            .otherwise(alpha / (F.pow(F.lit(1.0 - alpha), gap(column)) + alpha))
        )

    rows = rows.withColumns({f"_scale_{o}": scale(c, a) for o, (c, a) in specs.items()})
    rows = rows.withColumns(
        {
            f"_local_{o}": F.sum(F.coalesce(share(c, a) * F.col(c), F.lit(0.0)) * F.col(f"_scale_{o}"))
            .over(_block(series, a))
            / F.col(f"_scale_{o}")
            for o, (c, a) in specs.items()
        }
    )
    rows = rows.withColumns(
        {
            f"_mean_{o}": F.when(
                F.col(c).isNotNull(),
                F.col(f"_local_{o}") + _carry(series, f"_local_{o}", a) / F.col(f"_scale_{o}"),
            )
            for o, (c, a) in specs.items()
        }
    )
    upto = series.window().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({o: F.last(f"_mean_{o}", ignorenulls=True).over(upto) for o in specs})
    helpers = [f"_{kind}_{o}" for o in specs for kind in ("scale", "local", "mean")]
    return series.with_rows(rows.drop(*helpers, *[f"_gap_{c}" for c in inputs]))


def _gapless_means(series: Series, specs: dict[str, tuple[str, float]], first_rows: int) -> Series:
    pos = F.col("_pos")

    def scale(alpha: float) -> Column:
        # Counted from 1: the step into the block decays the carry as well.
        return F.pow(F.lit(1.0 / (1.0 - alpha)), F.pmod(pos, F.lit(block_rows(alpha))) + 1)

    def term(column: str, alpha: float) -> Column:
        # The frame starts before the column does, so rows without a value yet add nothing.
        return F.coalesce(F.when(pos == first_rows, F.col(column)).otherwise(alpha * F.col(column)), F.lit(0.0))

    rows = series.rows.withColumns(
        {
            f"_local_{o}": F.sum(term(c, a) * scale(a)).over(_block(series, a)) / scale(a)
            for o, (c, a) in specs.items()
        }
    )
    means = {
        o: F.when(pos >= first_rows, F.col(f"_local_{o}") + _carry(series, f"_local_{o}", a) / scale(a))
        for o, (_, a) in specs.items()
    }
    return series.with_rows(rows.withColumns(means).drop(*[f"_local_{o}" for o in specs]))


def _block(series: Series, alpha: float) -> WindowSpec:
    depth = series.order.index(_level(block_rows(alpha))) + 1
    parts = Window.partitionBy(*series.keys, *series.order[:depth]).orderBy(*series.order[depth:])
    return parts.rowsBetween(Window.unboundedPreceding, 0)


def _carry(series: Series, local: str, alpha: float) -> Column:
    """The mean the block before ended with."""
    last_row = F.pmod("_pos", F.lit(block_rows(alpha))) == block_rows(alpha) - 1
    before = series.window().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(F.when(last_row, F.col(local)), ignorenulls=True).over(before), F.lit(0.0))


def _decay(alpha: float, gap: Column) -> Column:
    """The weight that the mean before keeps when a value follows ``gap`` steps after the last one."""
    kept = F.pow(F.lit(1.0 - alpha), gap)
    return kept / (kept + alpha)


def _after(state: Column, block: Column, alpha: float) -> Column:
    """Two blocks as one.  A block without values changes nothing.

    A block knows its ``first`` value and the place of it, the place of its
    ``last`` value, and the mean at its end as ``rate * m + rest``, where m is
    the mean at its first value.
    """
    before = state["rate"] * state["x"] + state["rest"]
    keep = _decay(alpha, block["first"] - state["last"])
    # The mean at the second block's first value is ``keep`` of the first block's end, which is affine in its own m.
    joined = F.struct(
        state["first"].alias("first"),
        state["x"].alias("x"),
        block["last"].alias("last"),
        (block["rate"] * keep * state["rate"]).alias("rate"),
        (block["rate"] * (keep * state["rest"] + (1 - keep) * block["x"]) + block["rest"]).alias("rest"),
        (block["rate"] * (keep * before + (1 - keep) * block["x"]) + block["rest"]).alias("mean"),
    )
    return F.when(state.isNull() | state["first"].isNull(), block).when(block["first"].isNull(), state).otherwise(joined)


def _carries(rows: DataFrame, alpha: float, partials: list[Column]) -> DataFrame:
    """``before``, what the blocks before it left, for each ``symbol`` and ``_blk``.

    The maps of blocks are composed in doubling strides: after n rounds a block
    holds the composition of the 2^n blocks that end with it.  The table has one row a
    block, and one window order serves all rounds.
    """
    own = F.struct("first", "x", "last", "rate", "rest", (F.col("rate") * F.col("x") + F.col("rest")).alias("mean"))
    blocks = rows.groupBy(SYMBOL, "_blk").agg(*partials).select(SYMBOL, "_blk", own.alias("s"))
    blocks = materialize(blocks, "blocks")
    most = blocks.groupBy(SYMBOL).count().agg(F.max("count")).first()[0] or 1
    w = Window.partitionBy(SYMBOL).orderBy("_blk")
    stride = 1
    while stride < most:
        blocks = blocks.withColumn("e", F.lag("s", stride).over(w)).withColumn("s", _after(F.col("e"), F.col("s"), alpha)).drop("e")
        stride *= 2
    return blocks.select(SYMBOL, "_blk", F.lag("s", 1).over(w).alias("before"))


def _composed_mean(series: Series, name: str, column: str, alpha: float) -> Series:
    """One smoothed mean of any decay, exact over any distance and over nulls, in every layout.

    Halo rows lie in the same blocks as their originals, so they get the same means.
    """
    size = HALO_ROWS
    while size * -math.log(1.0 - alpha) > _LARGEST:
        size //= 2
    x, pos = F.col(column), F.col("_pos")
    rows = series.rows.withColumn("_blk", F.floor(pos / size))
    block = Window.partitionBy(*series.keys, "_blk").orderBy("_pos")
    upto, every = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = x.isNotNull()
    rows = rows.withColumn("_gap", pos - F.last(F.when(seen, pos), ignorenulls=True).over(block.rowsBetween(Window.unboundedPreceding, -1)))
    later = seen & F.col("_gap").isNotNull()
    ones = F.when(later & (F.col("_gap") == 1), F.lit(1)).otherwise(F.lit(0))
    nats = F.when(later & (F.col("_gap") > 1), -F.log(_decay(alpha, F.col("_gap")))).otherwise(F.lit(0.0))
    rows = rows.withColumn("_scale", F.pow(F.lit(1.0 / (1.0 - alpha)), F.sum(ones).over(upto)) * F.exp(F.sum(nats).over(upto)))
    term = F.when(later, (1 - _decay(alpha, F.col("_gap"))) * x * F.col("_scale")).otherwise(F.lit(0.0))
    rows = rows.withColumns({
        "_rest": F.sum(term).over(upto) / F.col("_scale"),
        "_first": F.first(F.when(seen, pos), ignorenulls=True).over(every),
        "_x": F.first(x, ignorenulls=True).over(every),
    })
    rows = materialize(rows, "blocked")
    own = rows.where(~F.col("_halo")) if series.chunked else rows
    at_value = F.when(seen, pos)
    carries = _carries(own, alpha, [
        F.max("_first").alias("first"), F.max("_x").alias("x"), F.max(at_value).alias("last"),
        F.max_by(1 / F.col("_scale"), at_value).alias("rate"), F.max_by("_rest", at_value).alias("rest"),
    ])
    rows = join_parameters(rows, carries, [SYMBOL, "_blk"])
    before = F.col("before.mean")
    keep = _decay(alpha, F.col("_first") - F.col("before.last"))
    started = F.when(before.isNull(), F.col("_x")).otherwise(keep * before + (1 - keep) * F.col("_x"))
    # Before the block's first value the mean is still the one before the block.
    mean = F.when(pos >= F.col("_first"), started / F.col("_scale") + F.col("_rest")).otherwise(before)
    rows = rows.withColumn(name, F.coalesce(mean, before))
    return series.with_rows(rows.drop("_blk", "_gap", "_scale", "_rest", "_first", "_x", "before"))
