"""Fitting many models at once, one per group of rows.

A fit is a row of passes.  In each pass the rows of a group add up to a total
under the group's state, and the total moves the state on.  A group that one
task can hold goes through all its passes there.  A larger one is dealt over
tasks once and its rows stay where they were dealt: each pass brings the
state to them, totals are merged in a tree, and the new states are written.
Only the number of groups still moving reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barwatch.session import materialize, ship_package

# Rows of one group that one task fits or scores.
ROWS_PER_TASK = 200_000
# Totals that one task merges.
FAN_IN = 256


class State(NamedTuple):
    """Where a group's fit stands: the pass it is at, and numbers that its fit can read."""

    phase: int
    values: np.ndarray
    done: bool = False


class Fit:
    """One model's passes.  ``fields`` is the schema of its result."""

    fields: str
    rows_per_task = ROWS_PER_TASK

    def start(self, width: int) -> State:
        """The state of a group whose rows have ``width`` features."""
        raise NotImplementedError

    def partial(self, state: State, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        """What these rows add; ``u`` is a number in [0, 1) for each row, the same in every run."""
        raise NotImplementedError

    def merge(self, phase: int, parts: list[np.ndarray]) -> np.ndarray:
        return np.sum(parts, axis=0)

    def update(self, state: State, total: np.ndarray) -> State:
        raise NotImplementedError

    def result(self, state: State) -> dict[str, object]:
        raise NotImplementedError


def to_matrix(lists: pa.ListArray) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(lists), -1)


def unit_hash(*columns, seed: int):
    """A number in [0, 1) that depends on the values alone, not on partitioning."""
    span = 1 << 52
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(span)) / span


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features and hashes in the order of the hashes, so that sums agree to the last bit."""
    u = table.column("_u").to_numpy()
    order = np.argsort(u, kind="stable")
    return to_matrix(table.column("features").combine_chunks())[order], u[order]


def _arrow(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def fit_groups(points: DataFrame, group: str, fit: Fit, seed: int, rows_per_task: int | None = None) -> DataFrame:
    """One row per ``group`` with the fields of ``fit``, written by the executors.

    ``points`` has ``symbol`` and ``_pos``, which name a row, ``features``, and ``group_rows``.
    """
    ship_package(points.sparkSession)
    rows_per_task = rows_per_task or fit.rows_per_task
    schema = f"{group} string, {fit.fields}"
    fields = _arrow(schema)
    rows = points.select(
        group, "group_rows", unit_hash("symbol", "_pos", seed=seed).alias("_u"), "features",
        F.pmod(F.xxhash64("symbol", "_pos"), F.ceil(F.col("group_rows") / rows_per_task)).alias("_deal"),
    )

    def whole(table: pa.Table) -> pa.Table:
        x, u = _rows_of(table)
        state = fit.start(x.shape[1])
        while not state.done:
            state = fit.update(state, fit.partial(state, x, u))
        return pa.Table.from_pylist([{group: table.column(group)[0].as_py(), **fit.result(state)}], fields)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{group: row[group], **fit.result(State(row["phase"], np.array(row["values"]), True))} for row in batch.to_pylist()]
            yield from pa.Table.from_pylist(found, fields).to_batches()

    small = rows.where(F.col("group_rows") <= rows_per_task)
    fitted = small.groupBy(group).applyInArrow(whole, schema)
    large = rows.where(F.col("group_rows") > rows_per_task)
    if large.isEmpty():
        return materialize(fitted, "models")
    states = _passes(large, group, fit, rows_per_task)
    return materialize(fitted.union(states.mapInArrow(finished, schema)), "models")


def _passes(rows: DataFrame, group: str, fit: Fit, rows_per_task: int) -> DataFrame:
    """The final states of groups whose rows are dealt over many tasks."""
    spark = rows.sparkSession
    state_fields = f"{group} string, deals bigint, phase int, values array<double>, done boolean"
    part_fields = f"{group} string, _deal bigint, phase int, total array<double>"
    state_arrow, part_arrow = _arrow(state_fields), _arrow(part_fields)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                state = fit.start(row["width"])
                found.append({group: row[group], "deals": row["deals"], "phase": state.phase, "values": state.values, "done": state.done})
            yield from pa.Table.from_pylist(found, state_arrow).to_batches()

    def add_up(key: tuple, mine: pa.Table, own: pa.Table) -> pa.Table:
        if not len(mine) or not len(own):
            return part_arrow.empty_table()
        state = State(own.column("phase")[0].as_py(), np.array(own.column("values")[0].as_py()))
        total = fit.partial(state, *_rows_of(mine))
        return pa.Table.from_pylist([{group: key[0].as_py(), "_deal": key[1].as_py(), "phase": state.phase, "total": total}], part_arrow)

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("_part")
        phase = parts.column("phase")[0].as_py()
        total = fit.merge(phase, [np.array(t.as_py()) for t in parts.column("total")])
        return pa.Table.from_pylist([{group: key[0].as_py(), "_deal": key[1].as_py(), "phase": phase, "total": total}], part_arrow)

    def move_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                state = fit.update(State(row["phase"], np.array(row["values"])), np.array(row["total"]))
                found.append({group: row[group], "deals": row["deals"], "phase": state.phase, "values": state.values, "done": state.done})
            yield from pa.Table.from_pylist(found, state_arrow).to_batches()

    groups = rows.groupBy(group).agg(
        F.ceil(F.first("group_rows") / rows_per_task).alias("deals"), F.first(F.size("features")).alias("width")
    )
    states = materialize(groups.mapInArrow(begun, state_fields), "fit-states")
    all_deals, most = states.agg(F.sum("deals"), F.max("deals")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(all_deals, 20_000))
    dealt = rows.select(group, "_deal", "_u", "features").repartition(tasks, group, "_deal").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while not states.where("not done").isEmpty():
            moving = states.where("not done")
            copies = moving.select(group, "phase", "values", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("_deal"))
            parts = dealt.groupBy(group, "_deal").cogroup(copies.groupBy(group, "_deal")).applyInArrow(add_up, part_fields)
            left = most
            while left > 1:
                parts = parts.withColumnRenamed("_deal", "_part").withColumn("_deal", F.expr(f"_part div {FAN_IN}"))
                parts = parts.groupBy(group, "_deal").applyInArrow(merge, part_fields)
                left = -(-left // FAN_IN)
            totals = parts.select(group, "total").join(moving, group)
            states = materialize(totals.mapInArrow(move_on, state_fields).union(states.where("done")), "fit-states")
    finally:
        dealt.unpersist()
    return states


def score_groups(
    rows: DataFrame, params: DataFrame, group: str, score: Callable[[np.ndarray, list[dict]], dict], fields: str
) -> DataFrame:
    """Append the columns ``score(matrix, params)`` yields, with each group's own parameters.

    Groups are dealt over as many tasks as their ``group_rows`` ask for, and
    the parameters are copied to each, so a hot group does not meet in one.
    """
    ship_package(rows.sparkSession)
    share = F.ceil(F.col("group_rows") / ROWS_PER_TASK)
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(group, "_pos"), share))
    counts = rows.groupBy(group).agg(F.first("group_rows").alias("group_rows"))
    copies = params.join(counts, group).withColumn("_deal", F.explode(F.sequence(F.lit(0), share - 1)))
    names = [f.split()[0] for f in fields.split(", ")]

    def apply(points: pa.Table, own: pa.Table) -> pa.Table:
        points = points.drop_columns(["_deal"])
        if len(points) == 0:
            found = {name: [] for name in names}
        else:
            found = score(to_matrix(points.column("features").combine_chunks()), own.to_pylist())
        for name in names:
            points = points.append_column(name, pa.array(found[name]))
        return points.cast(arrow_schema)

    schema = rows.limit(0).selectExpr("*", *[f"cast(null as {f.split()[1]}) as {f.split()[0]}" for f in fields.split(", ")]).schema
    arrow_schema = to_arrow_schema(schema)
    return dealt.groupBy(group, "_deal").cogroup(copies.groupBy(group, "_deal")).applyInArrow(apply, schema)
