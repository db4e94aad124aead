"""Interval joins as a sweep: against the range join, with windows of hours beside windows of decades and a hot key."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import sweep
from cohortloom.operators.sweep import sweep_join, sweep_summary


def tables(spark, seed, n_events=400, kind="TIMESTAMP_NTZ"):
    draw, start = random.Random(seed), datetime(2001, 3, 1)

    def moment():
        return start + timedelta(seconds=draw.randint(0, 400 * 86400), microseconds=draw.choice([0, 1, 999_999]))

    windows = []
    for i in range(120):
        begin = moment()
        length = draw.choice([0, 3600, 5 * 86400, 700 * 86400, 9000 * 86400, -86400])
        windows.append((i, 0 if draw.random() < 0.4 else draw.randint(1, 5), begin, begin + timedelta(seconds=length)))
    windows += [(500, None, start, moment()), (501, 0, None, moment()), (502, 0, start, None), (503, 9, start, moment())]
    windows += [windows[0], windows[1]]
    events = [(0 if draw.random() < 0.4 else draw.randint(1, 5), moment(), i) for i in range(n_events)]
    events += [(k, end, 1000 + i) for i, (_, k, _, end) in enumerate(windows) if end is not None]
    events += [(k, begin, 2000 + i) for i, (_, k, begin, _) in enumerate(windows) if begin is not None]
    events += [(0, None, 5000), (None, start, 5001), events[0], events[0], (2, events[5][1], None)]
    left = spark.createDataFrame(windows, f"id INT, k INT, s {kind}, e {kind}")
    return left, spark.createDataFrame(events, f"k INT, ts {kind}, n INT")


def rows(df):
    return sorted(map(str, df.collect()))


def range_join(left, right, how="left"):
    condition = (F.col("l.k") == F.col("r.k")) & F.col("r.ts").between(F.col("l.s"), F.col("l.e"))
    return left.alias("l").join(right.alias("r"), condition, how)


@pytest.mark.parametrize("kind", ["TIMESTAMP_NTZ", "TIMESTAMP"])
@pytest.mark.parametrize("block", [3, 1024])
def test_sweep_join_equals_range_join(spark, monkeypatch, kind, block):
    monkeypatch.setattr(sweep, "_BLOCK", block)
    left, right = tables(spark, 1, kind=kind)
    for how in ("left", "inner"):
        want = range_join(left, right, how).select("id", "l.k", "s", "e", "ts", "n")
        assert rows(sweep_join(left, right, ["k"], "ts", "s", "e", how)) == rows(want)


def test_sweep_summary_equals_a_grouped_range_join(spark):
    left, right = tables(spark, 2)
    got = sweep_summary(left, right, ["k"], "ts", "s", "e", "c", "first", "last", {"total": F.col("n")})
    by_id = left.distinct()
    want = range_join(by_id, right).groupBy("id", "l.k", "s", "e").agg(
        F.count("ts").alias("c"),
        F.when(F.count("ts") > 0, F.coalesce(F.sum("n"), F.lit(0))).alias("total"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    assert got.columns == ["id", "k", "s", "e", "c", "total", "first", "last"]
    assert got.count() == left.count()
    assert rows(got.distinct()) == rows(want)


def test_dates_and_empty_tables(spark):
    left, right = tables(spark, 3)
    days = left.withColumns({"s": F.col("s").cast("date"), "e": F.col("e").cast("date")})
    dated = right.withColumn("ts", F.col("ts").cast("date"))
    want = range_join(days, dated).select("id", "l.k", "s", "e", "ts", "n")
    assert rows(sweep_join(days, dated, ["k"], "ts", "s", "e")) == rows(want)
    none = right.limit(0)
    assert sweep_summary(left, none, ["k"], "ts", "s", "e").agg(F.sum("n_events")).first()[0] == 0
    assert rows(sweep_join(left, none, ["k"], "ts", "s", "e")) == rows(range_join(left, none).select("id", "l.k", "s", "e", "ts", "n"))
    assert sweep_join(left.limit(0), right, ["k"], "ts", "s", "e").count() == 0


def test_mixed_types_and_floats_are_refused(spark):
    left, right = tables(spark, 4)
    with pytest.raises(ValueError, match="one type"):
        sweep_summary(left, right.withColumn("ts", F.col("ts").cast("date")), ["k"], "ts", "s", "e")
    with pytest.raises(ValueError, match="exact"):
        sweep_summary(left, right, ["k"], "ts", "s", "e", sums={"x": F.col("n").cast("double")})


def test_a_hot_key_is_spread_and_no_event_is_copied(spark):
    begin = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    i = F.col("id")
    events = spark.range(30_000).select(
        F.when(i % 3 == 0, 0).otherwise(i).cast("int").alias("k"), (begin + F.make_dt_interval(mins=i.cast("int"))).alias("ts")
    )
    long = spark.range(300).select(
        i, F.lit(0).alias("k"), (begin + F.make_dt_interval(mins=i.cast("int"))).alias("s"),
        (begin + F.make_dt_interval(days=F.when(i % 2 == 0, 9000).otherwise(0).cast("int"), hours=F.lit(1))).alias("e"),
    )
    points = sweep._swept(long, events, ["k"], "ts", "s", "e", [])
    assert points.filter("_side = 1").agg(F.sum("_own")).first()[0] == 30_000
    assert points.filter("_side <> 1").count() == 2 * long.filter("s <= e").count()
    # The window function sees a range of the hot key, never the whole of it.
    bounds = sweep.value_bounds(events.withColumn("_t", sweep._instant(F.col("ts"), events.schema["ts"].dataType)), "_t")
    timed = events.withColumn("_t", sweep._instant(F.col("ts"), events.schema["ts"].dataType))
    largest = sweep.with_range(timed, "_t", bounds).groupBy("k", "_range").count().agg(F.max("count")).first()[0]
    assert largest < 10_000 / 20
    want = range_join(long, events).groupBy("id").agg(F.count("ts").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    got = sweep_summary(long, events, ["k"], "ts", "s", "e", "n", "a", "z").select("id", "n", "a", "z")
    assert rows(got) == rows(want)
