"""Interval joins as a sweep: windows and events ranged by key and time, one ordered pass, no event copied.

A window is two points in time, its start and its end, and so costs the same whether it lasts an hour or ten years.
Events of one key and instant are one point with their sums. Points are cut into ranges of time; inside a range of a
key one ordered pass keeps running sums and the events before and after each point, and what the other ranges of the
key add is one small row per key and range. The events inside a window are then the sums at its end less those at its
start. A key with a third of the rows is spread over the ranges, whatever the length of its windows.

The event times and both ends of the windows must have one type, of dates or timestamps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, IntegralType, TimestampNTZType, TimestampType

from .joins import lookup_join, null_columns
from .ranking import value_bounds, with_range

_OPEN, _EVENT, _CLOSE = 0, 1, 2
_BLOCK = 1024


def _time_type(windows: DataFrame, events: DataFrame, ts: str, start: str, end: str) -> DataType:
    kinds = {events.schema[ts].dataType, windows.schema[start].dataType, windows.schema[end].dataType}
    if len(kinds) > 1 or not isinstance(next(iter(kinds)), (DateType, TimestampNTZType, TimestampType)):
        raise ValueError("events and windows must have one type of date or timestamp")
    return kinds.pop()


def _instant(value: Column, kind: DataType) -> Column:
    """Microseconds that rise with the value in every time zone."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(value)
    wall = value.cast("timestamp_ntz")
    minutes = (F.unix_date(wall.cast("date")).cast("bigint") * 24 + F.hour(wall)) * 60 + F.minute(wall)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("bigint")


def _swept(
    windows: DataFrame, events: DataFrame, on: Sequence[str], ts: str, start: str, end: str, sums: Sequence[Column]
) -> DataFrame:
    """Every point with what comes before it: _k0.., _t, _side, _from, _to, _own, _n, _s0.., _last, _next.

    _n counts the events of the key up to the point, the point included, _s0.. are the sums over them; _own is the
    number of events at the point itself. _last is the latest event not after the point, _next the earliest not before.
    """
    kind = _time_type(windows, events, ts, start, end)
    keys = [f"_k{i}" for i in range(len(on))]
    named = [F.col(name).alias(key) for name, key in zip(on, keys)]
    totals = {"_n": F.lit(1), **{f"_s{i}": column for i, column in enumerate(sums)}}
    present = reduce(and_, [F.col(key).isNotNull() for key in keys])

    marks = events.select(
        *named, _instant(F.col(ts), kind).alias("_t"), F.col(ts).alias("_at"), *[c.alias(n) for n, c in totals.items()]
    )
    if not all(isinstance(marks.schema[name].dataType, (IntegralType, DecimalType)) for name in totals):
        raise ValueError("a sweep takes differences of running sums, which are exact for integers and decimals only")
    # Events at one moment of one key are summed before the shuffle and stay one row.
    marks = marks.filter(present & F.col("_t").isNotNull()).groupBy(*keys, "_t", "_at")
    marks = marks.agg(*[F.sum(name).alias(name) for name in totals])
    spans = windows.select(
        *named, _instant(F.col(start), kind).alias("_from"), _instant(F.col(end), kind).alias("_to")
    )
    spans = spans.filter(present & (F.col("_from") <= F.col("_to"))).distinct()

    def absent(*names: str) -> list[Column]:
        return [F.lit(None).cast(marks.schema[name].dataType).alias(name) for name in names]

    ends = [F.struct(F.col(at).alias("_t"), F.lit(side).alias("_side")) for at, side in (("_from", _OPEN), ("_to", _CLOSE))]
    points = spans.select(*keys, "_from", "_to", F.explode(F.array(*ends)).alias("_end"))
    points = points.select(*keys, "_end.*", "_from", "_to", *absent("_at", *totals))
    unset = [F.lit(None).cast("bigint").alias(name) for name in ("_from", "_to")]
    rows = marks.select(*keys, "_t", F.lit(_EVENT).alias("_side"), *unset, "_at", *totals).unionByName(points)
    ranged = with_range(rows, "_t", value_bounds(marks, "_t"))

    inside = W.partitionBy(*keys, "_range")
    forward = inside.orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    backward = inside.orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.withColumns(
        {
            **{f"_in{name}": F.sum(name).over(forward) for name in totals},
            "_before": F.max("_at").over(forward),
            "_after": F.min("_at").over(backward),
        }
    )
    of_range = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(name).alias(name) for name in totals], F.min("_at").alias("_least"), F.max("_at").alias("_most")
    )
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    carried = of_range.select(
        *keys,
        "_range",
        *[F.sum(name).over(earlier).alias(f"_out{name}") for name in totals],
        F.max("_most").over(earlier).alias("_earlier"),
        F.min("_least").over(later).alias("_later"),
    )

    def whole(name: str) -> Column:
        return F.coalesce(F.col(f"_in{name}"), F.lit(0)) + F.coalesce(F.col(f"_out{name}"), F.lit(0))

    return lookup_join(local, carried, [*keys, "_range"]).select(
        *keys,
        *["_t", "_side", "_from", "_to", F.col("_n").alias("_own")],
        *[whole(name).alias(name) for name in totals],
        F.coalesce("_before", "_earlier").alias("_last"),
        F.coalesce("_after", "_later").alias("_next"),
    )


def _met_windows(swept: DataFrame, n_keys: int, n_sums: int) -> DataFrame:
    """The windows with events: _k0.., _from, _to, _n, _s0.., _first, _last, and _ahead, the events before the start."""
    opened = F.col("_side") == _OPEN
    totals = ["_n", *[f"_s{i}" for i in range(n_sums)]]
    spans = swept.filter((F.col("_side") != _EVENT) & F.col("_own").isNull())
    found = spans.groupBy(*[f"_k{i}" for i in range(n_keys)], "_from", "_to").agg(
        *[F.sum(F.when(opened, -F.col(name)).otherwise(F.col(name))).alias(name) for name in totals],
        F.max(F.when(opened, F.col("_next"))).alias("_first"),
        F.max(F.when(~opened, F.col("_last"))).alias("_last"),
        F.max(F.when(opened, F.col("_n"))).alias("_ahead"),
    )
    return found.filter("_n > 0")


def _with_instants(df: DataFrame, on: Sequence[str], kind: DataType, **columns: str) -> DataFrame:
    added = {f"_k{i}": F.col(name) for i, name in enumerate(on)}
    return df.withColumns(added | {out: _instant(F.col(name), kind) for out, name in columns.items()})


def sweep_summary(
    windows: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    ts: str,
    start: str,
    end: str,
    count: str = "n_events",
    first: str | None = None,
    last: str | None = None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Every window row with the number of events in it, start <= ts <= end, and what else is asked for.

    ``first`` and ``last`` name columns for the earliest and the latest event time; ``sums`` are integer or decimal
    expressions over the events. A window without events (a missing key or end, an end before the start) has the count
    0 and NULL elsewhere; the sum of events whose values are all NULL is 0. Floats are refused, since differences of their
    running sums are not exact: ``interval_summary`` takes them.
    """
    kind, sums = _time_type(windows, events, ts, start, end), dict(sums or {})
    met = _met_windows(_swept(windows, events, on, ts, start, end, list(sums.values())), len(on), len(sums))
    named = [F.col(name).alias(out) for name, out in (("_first", first), ("_last", last)) if out]
    keys = [*[f"_k{i}" for i in range(len(on))], "_from", "_to"]
    found = met.select(
        *keys, F.col("_n").alias(count), *[F.col(f"_s{i}").alias(name) for i, name in enumerate(sums)], *named
    )
    left = _with_instants(windows, on, kind, _from=start, _to=end)
    joined = lookup_join(left, found, keys, "left")
    extra = [name for name in found.columns if name not in (*keys, count)]
    return joined.select(*windows.columns, F.coalesce(count, F.lit(0)).alias(count), *extra)


def sweep_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], ts: str, start: str, end: str, how: str = "left"
) -> DataFrame:
    """left JOIN right ON equal keys AND right.ts BETWEEN left.start AND left.end, the same rows as ``interval_join``.

    The sweep tells the ordinals of the first and last event of a window among those of its key. Events stand in
    blocks of neighbouring ordinals, one block each; a window meets the blocks that hold its events, so it is copied
    once per ``_BLOCK`` of its own matches, however long it is, and windows without events never reach the join.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    kind, keys = _time_type(left, right, ts, start, end), [f"_k{i}" for i in range(len(on))]
    extra = [name for name in right.columns if name not in on]
    swept = _swept(left, right, on, ts, start, end, [])
    met = _met_windows(swept, len(on), 0).select(
        *[*keys, "_from", "_to"],
        F.floor(F.col("_ahead") / _BLOCK).alias("_low"),
        F.floor((F.col("_ahead") + F.col("_n") - 1) / _BLOCK).alias("_high"),
    )
    # The condition on _from keeps the columns of both uses alike, so that they read the same shuffled points.
    placed = swept.filter((F.col("_side") == _EVENT) & F.coalesce("_from", "_to").isNull())
    placed = placed.select(*keys, "_t", F.floor((F.col("_n") - F.col("_own")) / _BLOCK).alias("_block"))

    windows = _with_instants(left, on, kind, _from=start, _to=end)
    spans = lookup_join(windows, met, [*keys, "_from", "_to"])
    spans = spans.withColumn("_block", F.explode(F.sequence("_low", "_high")))
    spans = spans.select(*left.columns, *keys, "_from", "_to", "_block")
    events = lookup_join(_with_instants(right, on, kind, _t=ts), placed, [*keys, "_t"])
    events = events.select(*[F.col(name).alias(f"_right_{i}") for i, name in enumerate(extra)], *keys, "_t", "_block")
    pairs = events.join(spans, [*keys, "_block"])
    pairs = pairs.filter(F.col("_t").between(F.col("_from"), F.col("_to")))
    matched = pairs.select(*left.columns, *[F.col(f"_right_{i}").alias(name) for i, name in enumerate(extra)])
    if how == "inner":
        return matched
    same = [F.col(a) == F.col(b) for a, b in zip([*keys, "_from", "_to"], [f"_m{i}" for i in range(len(keys) + 2)])]
    found = met.select(*[F.col(name).alias(f"_m{i}") for i, name in enumerate([*keys, "_from", "_to"])])
    missing = windows.join(found, reduce(and_, same), "left_anti")
    return matched.unionByName(missing.select(*left.columns, *null_columns(right, extra)))
