"""Running values over groups of any size: a segmented prefix scan.

`ranged` sorts rows into ranges of (group, order) and stores them, so a huge group lies in many ranges. `running` computes
a running value within each range by a window, folds every range's part of a group to one state, carries the states of
earlier ranges along, and applies what is carried to the rows. Only a group that started in an earlier range is carried
into a range, so there is at most one carried state a range: that table is broadcast, bounded by the number of ranges.

Running values are sums, exclusive ors, and last values that aren't null. A state that can be forgotten is a last value
of structs: a row that sets it gives `struct(value)`, a row that resets it gives a struct of null (see `state`).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordmill.session import materialize

#: Columns that ranged adds: a range, and a row's place in it.
RANGE, PLACE = "_range", "_at"
_PLACES = (1 << 33) - 1


@dataclasses.dataclass(frozen=True)
class Running:
    """A running value: how is sum, xor or last; own: the row itself counts."""

    value: Column
    how: str = "last"
    own: bool = True


def ranged(rows: DataFrame, by: list[str], order: list[Column | str], then: list[Column | str] | None = None, keep: list[Column | str] | None = None, ranges: int | None = None, what: str = "ranges") -> DataFrame:
    """rows sorted by (by, order, then) in ranges of (by, order), with RANGE and PLACE, stored. then: wide columns such as
    texts, which sort rows but don't bound ranges, since bounds pass through the driver. keep: the columns to store. The
    whole order must be total but for equal rows; nulls come first."""
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    cut = (rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys, *(then or []))
    return materialize(cut.select(*(keep or rows.columns), F.spark_partition_id().alias(RANGE), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACES)).alias(PLACE)), what)


def _within(r: Running, window: Window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if r.own else -1)
    if r.how == "last":
        return F.last(r.value, ignorenulls=True).over(frame)
    return (F.sum(r.value) if r.how == "sum" else F.bit_xor(r.value)).over(frame)


def _folded(r: Running) -> Column:
    if r.how == "last":
        return F.max_by(r.value, F.when(r.value.isNotNull(), F.col(PLACE)))
    return F.sum(r.value) if r.how == "sum" else F.bit_xor(r.value)


def _over_ranges(how: str, c: str, window: Window) -> Column:
    return F.last(c, ignorenulls=True).over(window) if how == "last" else (F.sum(c) if how == "sum" else F.bit_xor(c)).over(window)


def _met(how: str, carried: Column, local: Column) -> Column:
    if how == "last":
        return F.coalesce(local, carried)
    zero = F.lit(0)
    return F.coalesce(local, zero) + F.coalesce(carried, zero) if how == "sum" else F.coalesce(local, zero).bitwiseXOR(F.coalesce(carried, zero))


def running(cut: DataFrame, by: list[str], **values: Running) -> DataFrame:
    """cut, a table of `ranged` (perhaps filtered), with a column for each running value in the order of its rows. by must
    be (a start of) the columns that the ranges were cut by; its nulls are a group."""
    window = Window.partitionBy(RANGE, *by).orderBy(PLACE)
    local = cut.withColumns({f"_l_{n}": _within(r, window) for n, r in values.items()})
    states = cut.groupBy(RANGE, *by).agg(*[_folded(r).alias(f"_s_{n}") for n, r in values.items()])
    ahead = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = states.select(F.col(RANGE).alias("_to"), *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *[_over_ranges(r.how, f"_s_{n}", ahead).alias(f"_c_{n}") for n, r in values.items()], F.count(F.lit(1)).over(ahead).alias("_n")).where("_n > 0")
    same = F.col(RANGE) == F.col("_to")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    met = local.join(F.broadcast(carried), same, "left")  # no more than one row a range
    return met.select(*cut.columns, *[_met(r.how, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, r in values.items()])


def state(value: Column, reset: Column | None = None) -> Column:
    """For a last value: value where it isn't null, forgotten where reset is true. Read the result's field v."""
    own = F.when(value.isNotNull(), F.struct(value.alias("v")))
    return own if reset is None else own.when(reset, F.struct(F.nullif(value, value).alias("v")))
