"""Joins that stay balanced when one key holds a large share of the rows.

Adaptive execution splits a hot join key under two conditions, and the joins here are written to meet both.

* The hot side may be either side of an inner join, but only the left of a left outer or semi join. Where the many
  rows stand on the right, an outer join is written as an inner join plus the left rows that meet no key.
* Both sides must reach the join straight from a shuffle. An aggregated side is already partitioned by the key and
  would not be shuffled again, so it is grouped by the key and a hash of the key: the same groups, another
  partitioning. The extra shuffle moves one small row per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F


_SPREAD = "_spread"


def group_for_join(df: DataFrame, keys: Sequence[str]) -> GroupedData:
    """Group by the keys so that a later join on them gets its own shuffle; drop ``_spread`` after aggregating."""
    return df.groupBy(*keys, F.xxhash64(*keys).alias(_SPREAD))


def _with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    present = df.select(*keys)
    for key in keys:
        present = present.filter(F.col(key).isNotNull())
    return present


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct non-null keys (NULL never joins), for a join on them."""
    return group_for_join(_with_keys(df, keys), keys).agg(F.lit(1).alias("_one")).select(*keys)


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many rows to a lookup with few rows per key, whatever plan the lookup comes from.

    The hash of the key joins along with the key, so both sides are shuffled for this join alone.
    """
    left = df.withColumn(_SPREAD, F.xxhash64(*on))
    right = lookup.withColumn(_SPREAD, F.xxhash64(*on))
    return left.join(right, [*on, _SPREAD], how).drop(_SPREAD)


def null_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.lit(None).cast(df.schema[name].dataType).alias(name) for name in names]


def without_partner(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left rows whose key is not on the right, with NULLs for the right columns."""
    unmatched = left.join(distinct_keys(right, on), list(on), "left_anti")
    return unmatched.select(*left.columns, *null_columns(right, columns))


def left_join_many(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left LEFT JOIN right USING (on) for a right side with many rows per key, perhaps a third of them on one key.

    Columns: those of ``left``, then the other columns of ``right``. One form for all keys: an inner join, whose sides
    adaptive execution can both split, and the left rows whose key is not on the right.
    """
    on = list(on)
    extra = [name for name in right.columns if name not in on]
    matched = right.join(left, on, "inner").select(*left.columns, *extra)
    return matched.unionByName(without_partner(left, right, on, extra))


def keep_matching(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is among ``ids`` (repeated ids do not multiply rows)."""
    return df.join(distinct_keys(ids, on), list(on), "left_semi")


def existence_flags(df: DataFrame, other: DataFrame, on: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """0/1 columns on ``df``: does any row of ``other`` with the same key satisfy the predicate?

    All flags share one scan and one aggregation of ``other``; rows of ``df`` are never multiplied. A NULL key or a
    predicate that is NULL counts as no match.
    """
    marked = other.select(*on, *[predicate.alias(name) for name, predicate in flags.items()])
    marked = marked.filter(reduce(or_, [F.col(name) for name in flags]))
    found = group_for_join(marked, on).agg(
        *[F.max(F.when(F.col(name), 1).otherwise(0)).alias(name) for name in flags]
    )
    joined = df.join(found.drop(_SPREAD), list(on), "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in flags])


def flag_exists(df: DataFrame, other: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """0/1 column ``out``: 1 where ``other`` (already filtered) holds the key. A column of that name is replaced."""
    base = df.drop(out)
    return existence_flags(base, other, keys, {out: F.lit(True)})


def classify_last_wins(
    df: DataFrame,
    codes: DataFrame,
    keys: Sequence[str],
    code_col: str,
    classes: Mapping[str, Sequence],
    out: str,
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Label each row of ``df`` with the class of its codes; of several classes the last listed one wins.

    One pass: the class number is an integer, so its maximum per key is combined before the shuffle and the label is
    looked up afterwards. No code of any class gives NULL. ``flags`` are 0/1 columns of ``existence_flags`` to be
    found in the same pass.
    """
    flags = flags or {}
    labels = list(classes)
    number = F.lit(None).cast("int")
    for i, label in enumerate(labels):
        # Later classes are tested first: a code listed in two classes belongs to the later one.
        number = F.when(F.col(code_col).isin(list(classes[label])), i + 1).otherwise(number)
    marked = codes.select(
        *keys,
        number.alias("_class"),
        *[F.when(predicate, 1).otherwise(0).alias(name) for name, predicate in flags.items()],
    )
    relevant = reduce(or_, [F.col(name) == 1 for name in flags], F.col("_class").isNotNull())
    best = group_for_join(marked.filter(relevant), keys).agg(
        *[F.max(name).alias(name) for name in ["_class", *flags]]
    )
    label = F.get(F.array(*[F.lit(name) for name in labels]), F.col("_class") - 1)
    base = df.drop(out, *flags)
    joined = base.join(best.drop(_SPREAD), list(keys), "left")
    return joined.select(
        *base.columns, *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in flags], label.alias(out)
    )


# Bucket widths of an interval join, in days. A window uses the narrowest that covers it with about 16 buckets.
_WIDTHS = (1, 16, 256, 4096)


def _bucket(ts: Column, width: Column) -> Column:
    """First day of the bucket that holds the timestamp."""
    day = F.unix_date(ts.cast("date"))
    return day - F.pmod(day, width)


def _bucketed_matches(
    windows: DataFrame, events: DataFrame, on: Sequence[str], ts: str, start: str, end: str
) -> DataFrame:
    """All (window, event) rows with equal keys and start <= ts <= end.

    Both sides also join on a time bucket. A window is placed in every bucket it touches, of a width that suits its
    length; an event has one bucket of each width in use. A pair therefore appears exactly once, a hot key is spread
    over its days, long windows do not multiply, and rows far apart in time are never compared.
    """
    days = F.unix_date(F.col(end).cast("date")) - F.unix_date(F.col(start).cast("date"))
    width = F.lit(_WIDTHS[-1])
    for narrower, wider in reversed(list(zip(_WIDTHS, _WIDTHS[1:]))):
        width = F.when(days <= wider, narrower).otherwise(width)
    sized = windows.filter(F.col(start) <= F.col(end)).withColumn("_width", width)
    spans = sized.withColumn(
        "_bucket",
        F.explode(
            F.sequence(_bucket(F.col(start), F.col("_width")), _bucket(F.col(end), F.col("_width")), F.col("_width"))
        ),
    )
    # At most one row per width, so this side is always tiny; unused widths never reach the shuffle.
    in_use = F.broadcast(sized.select("_width").distinct())
    placed = (
        events.filter(F.col(ts).isNotNull())
        .withColumn("_width", F.explode(F.array(*[F.lit(days) for days in _WIDTHS])))
        .join(in_use, "_width", "left_semi")
        .withColumn("_bucket", _bucket(F.col(ts), F.col("_width")))
    )
    pairs = placed.join(spans, [*on, "_width", "_bucket"], "inner")
    return pairs.filter(F.col(ts).between(F.col(start), F.col(end)))


def interval_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], ts: str, start: str, end: str, how: str = "left"
) -> DataFrame:
    """left JOIN right ON equal keys AND right.ts BETWEEN left.start AND left.end (both ends closed)."""
    extra = [name for name in right.columns if name not in on]
    matched = _bucketed_matches(left, right, on, ts, start, end).select(*left.columns, *extra)
    if how == "inner":
        return matched
    if how != "left":
        raise ValueError("how must be 'left' or 'inner'")
    # Whether a left row matches depends on these columns alone, so equal rows stay or go together. The rows that
    # matched are asked for with all their columns here too: both uses then read the same shuffled rows.
    window = [*on, start, end]
    rest = [name for name in [*left.columns, *extra] if name not in window]
    names = [f"_window_{i}" for i in range(len(window))]
    found = matched.groupBy(*window, F.xxhash64(*window).alias(_SPREAD)).agg(F.any_value(F.struct(*rest)).alias("_row"))
    found = found.select(*[F.col(name).alias(other) for name, other in zip(window, names)], "_row")
    same = reduce(and_, [F.col(name) == F.col(other) for name, other in zip(window, names)]) & F.col("_row").isNotNull()
    missing = left.join(found, same, "left_anti")
    return matched.unionByName(missing.select(*left.columns, *null_columns(right, extra)))


def interval_summary(
    windows: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    ts: str,
    start: str,
    end: str,
    aggregates: Mapping[str, Column],
    defaults: Mapping[str, Column] | None = None,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Aggregates of the events inside each window, one output row per window row.

    Equal to a left interval join followed by a group-by, but the events are aggregated before they meet the wide
    window rows. A window without events gets NULL, or the value in ``defaults``. ``key`` names columns that identify
    a window; without it windows are told apart by ``on``, ``start`` and ``end``, which costs a distinct.
    """
    window = list(key or [*on, start, end])
    spans = windows.select(*dict.fromkeys([*window, *on, start, end]))
    spans = spans if key else distinct_keys(spans, window)
    summary = (
        _bucketed_matches(spans, events, on, ts, start, end)
        .groupBy(*window)
        .agg(*[column.alias(name) for name, column in aggregates.items()])
    )
    defaults = defaults or {}
    filled = [
        (F.coalesce(F.col(name), defaults[name]) if name in defaults else F.col(name)).alias(name)
        for name in aggregates
    ]
    return windows.join(summary, window, "left").select(*windows.columns, *filled)
