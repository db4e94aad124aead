"""A third of the rows on one key: the joins must be of a form adaptive execution can split, and stay right."""

from __future__ import annotations

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.operators.encounters import build_cohort, encounter_index, first_encounters
from cohortloom.operators.joins import (
    classify_last_wins,
    existence_flags,
    interval_summary,
    keep_matching,
    left_join_many,
)
from cohortloom.operators.ranking import (
    ranked,
    repeat_rows,
    top_k,
    value_bounds,
    with_dense_rank,
    with_ordinal,
    with_range,
)
from cohortloom.session import FIRST_PARTITIONS, PARTITION_INPUT, sized, tuned

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2.0",
}


@pytest.fixture
def low_limits(spark):
    """Limits so low that these few rows count as skewed."""
    tuned(spark)
    for name, value in LOW.items():
        spark.conf.set(name, value)
    yield spark
    for name in LOW:
        spark.conf.unset(name)


def hot(spark, n=240_000, keys=4000):
    """(k, v): every third row has key 0."""
    row = F.col("id")
    key = F.when(row % 3 == 0, 0).otherwise(F.pmod(F.xxhash64(row), F.lit(keys))).cast("int")
    return spark.range(0, n, 1, 16).select(key.alias("k"), F.pmod(F.xxhash64(row + 7), F.lit(50_000)).alias("v"), row.alias("n"))


def split(df):
    """Run the query; is some join in its final plan split by skew?"""
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    names = a.columns
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64(*names).cast("decimal(38,0)"))]
    return a.agg(*digest).first() == b.select(*names).agg(*digest).first()


def test_left_join(low_limits):
    left = low_limits.range(5000).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("x"))
    right = hot(low_limits)
    got = left_join_many(left, right, ["k"])
    assert split(got)
    assert same(got, left.join(right, "k", "left"))


@pytest.mark.parametrize("copies", [False, True])
def test_encounter_index(low_limits, copies):
    parents = low_limits.range(3000).select(F.col("id").cast("int").alias("s"))
    visits = hot(low_limits, 30_000, 2500).select(F.col("k").alias("s"), F.col("n").cast("int").alias("k"))
    # Different stays of the hot admission are spread by their ranges, copies of one stay are counted.
    stay = F.when(F.col("k") == 0, 17).otherwise(F.col("v")) if copies else F.col("v")
    stays = hot(low_limits).select("k", stay.cast("bigint").alias("stay"))
    got = encounter_index(parents, visits, stays, "s", "k", "stay", stay_keys=["k"])
    joined = parents.join(visits, "s", "left").join(stays, "k", "left")
    window = W.partitionBy("s", "k").orderBy(F.col("stay").asc_nulls_last())
    want = joined.select("s", "k", "stay", F.dense_rank().over(window).cast("bigint").alias("ind"))
    assert same(got, want)


def test_repeated_rows_are_chunked(low_limits):
    df = low_limits.createDataFrame([(1, 3), (2, 25), (3, 10), (4, 11)], "k INT, n BIGINT")
    got = repeat_rows(df, "n", ["k"], chunk=10).groupBy("k").count()
    assert {row.k: row["count"] for row in got.collect()} == {1: 3, 2: 25, 3: 10, 4: 11}


def test_flags(low_limits):
    base, other = hot(low_limits), hot(low_limits, 60_000)
    flagged = existence_flags(base, other, ["k"], {"big": F.col("v") > 49_000})
    assert split(flagged)
    assert flagged.count() == base.count()
    keys = {row.k for row in other.filter("v > 49000").select("k").distinct().collect()}
    assert {row.k for row in flagged.filter("big = 1").select("k").distinct().collect()} == keys


def test_classes(low_limits):
    base, codes = hot(low_limits), hot(low_limits, 60_000).withColumn("code", F.col("v") % 7)
    got = classify_last_wins(base, codes, ["k"], "code", {"low": [1, 2], "high": [2, 3]}, "label")
    assert split(got)
    assert got.count() == base.count()


def test_semi_join(low_limits):
    base, other = hot(low_limits), hot(low_limits, 60_000).filter("v > 25000")
    got = keep_matching(base, other, ["k"])
    assert split(got)
    assert same(got, base.join(other.select("k").distinct(), "k"))


def test_cohort(low_limits):
    index = hot(low_limits).withColumn("ind", F.lit(1))
    flags = existence_flags(index.select("k").distinct(), index, ["k"], {"big": F.col("v") > 49_000})
    admissions = index.groupBy("k").agg(F.max("n").alias("last"))
    got = build_cohort(index, flags, admissions, ["k"], F.lit(True))
    assert split(got)
    assert same(got, index.join(flags, "k").join(admissions, "k"))


def test_dense_rank_of_copies(low_limits):
    rows = hot(low_limits).withColumn("v", F.when(F.col("k") == 0, 5).otherwise(F.col("v")).cast("bigint"))
    got = with_dense_rank(rows, ["k"], "v", "r")
    assert split(got)
    window = W.partitionBy("k").orderBy("v")
    assert same(got, rows.withColumn("r", F.dense_rank().over(window).cast("bigint")))


def test_interval_summary_spreads_a_hot_key(low_limits):
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    minutes = F.make_dt_interval(mins=F.col("v").cast("int"))
    events = hot(low_limits).select("k", (start + minutes).alias("ts"))
    windows = low_limits.range(200).select(
        F.col("id"),
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("int").alias("k"),
        (start + F.make_dt_interval(mins=(F.col("id") * 200).cast("int"))).alias("s"),
        (start + F.make_dt_interval(mins=(F.col("id") * 200 + 1500).cast("int"))).alias("e"),
    )
    got = interval_summary(windows, events, ["k"], "ts", "s", "e", {"n": F.count("ts")}, {"n": F.lit(0)}, ["id"])
    joined = windows.alias("w").join(
        events.alias("x"), (F.col("w.k") == F.col("x.k")) & F.col("ts").between(F.col("s"), F.col("e")), "left"
    )
    want = joined.groupBy("id", "w.k", "s", "e").agg(F.count("ts").alias("n"))
    assert same(got, want)


def many_just_under(spark, keys=2000, each=120):
    """Every key holds just under a thousandth of the rows."""
    row = F.col("id")
    return spark.range(0, keys * each, 1, 12).select(
        (row % keys).cast("int").alias("k"), F.xxhash64(row).alias("v"), row.alias("n")
    )


@pytest.mark.parametrize("layout", [1, 7, 16])
def test_forms_do_not_depend_on_the_layout(low_limits, layout):
    low_limits.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = many_just_under(low_limits, 300, 40).repartition(layout)
        left = low_limits.range(400).select(F.col("id").cast("int").alias("k"))
        assert same(left_join_many(left, rows, ["k"]), left.join(rows, "k", "left"))
        parents = low_limits.range(50).select(F.col("id").cast("int").alias("s"))
        visits = low_limits.range(320).select((F.col("id") % 45).cast("int").alias("s"), F.col("id").cast("int").alias("k"))
        stays = rows.select("k", F.col("v").alias("stay"))
        got = encounter_index(parents, visits, stays, "s", "k", "stay", stay_keys=["k"])
        joined = parents.join(visits, "s", "left").join(stays, "k", "left")
        window = W.partitionBy("s", "k").orderBy(F.col("stay").asc_nulls_last())
        assert same(got, joined.select("s", "k", "stay", F.dense_rank().over(window).cast("bigint").alias("ind")))
    finally:
        low_limits.conf.unset("spark.sql.exchange.reuse")


def test_many_keys_just_under_a_share(low_limits):
    rows = many_just_under(low_limits)
    left = low_limits.range(2500).select(F.col("id").cast("int").alias("k"))
    assert same(left_join_many(left, rows, ["k"]), left.join(rows, "k", "left"))


def test_first_encounters_are_the_first_of_the_index(low_limits):
    parents = low_limits.range(3000).select(F.col("id").cast("int").alias("s"))
    visits = hot(low_limits, 30_000, 2500).select(F.col("k").alias("s"), F.col("n").cast("int").alias("k")).distinct()
    stays = hot(low_limits).select("k", F.when(F.col("v") % 9 > 0, F.col("v") % 50).alias("stay"))
    arguments = (parents, visits, stays, "s", "k", "stay", ["k"])
    index = encounter_index(*arguments).filter("ind = 1 AND k IS NOT NULL")
    assert same(first_encounters(*arguments), index)


def test_ordinal_windows_stay_small(low_limits):
    rows = many_just_under(low_limits).select("v", "n")
    bounds = value_bounds(rows, "v")
    largest = with_range(rows, "v", bounds).groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest < rows.count() / 20
    got = with_ordinal(rows, "v")
    assert same(got, rows.withColumn("ordinal", (F.row_number().over(W.orderBy("v")) - 1).cast("bigint")))


def test_top_k_of_one_group_with_most_rows(low_limits):
    rows = hot(low_limits).select(F.when(F.col("k") % 5 > 0, 1).otherwise(0).alias("g"), "v", "n")
    order = [F.col("v").desc(), F.col("n").asc()]
    got = top_k(rows, ["g"], order, 3000, "n", parts=16)
    want = rows.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(*order))).filter("rank <= 3000")
    assert same(got, want)


def test_ranked_rows_of_a_large_group(low_limits):
    rows = hot(low_limits).select(F.lit("p").alias("phrase"), (F.col("v") % 7).cast("double").alias("score"), "n")
    got = ranked(rows, ["phrase"], "score", "n")
    order = W.partitionBy("phrase").orderBy(F.col("score").desc(), "n")
    want = rows.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn("n_rows", F.lit(rows.count()).cast("bigint"))
    assert same(got, want)


def test_what_a_task_gets_is_bounded_however_many_cores_there_are(spark):
    """Merged shuffle partitions stop at the advisory size; without one a task gets the total over the cores."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        session = tuned(spark)
        rows = session.range(0, 12_000_000, 1, 8).select(F.xxhash64("id").alias("key"), F.xxhash64("id", F.lit(1)).alias("value"))
        parts = rows.repartition("key").select(F.spark_partition_id().alias("part")).distinct().count()
        assert parts >= 16  # about 200 MB of shuffled rows: 8 tasks of 25 MB without the setting
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_what_a_task_reads_of_a_file_is_bounded(spark, tmp_path):
    """A scan sorts and groups the rows of its part of a file before the shuffle."""
    wide = spark.range(0, 700_000, 1, 1).select(*[F.xxhash64("id", F.lit(i)).alias(f"c{i}") for i in range(10)])
    wide.write.parquet(f"{tmp_path}/t")  # one file of 56 MB
    name = "spark.sql.files.minPartitionNum"
    spark.conf.set(name, "1")  # as many bytes to a task as if the files were large
    try:
        assert tuned(spark).read.parquet(f"{tmp_path}/t").rdd.getNumPartitions() >= 2
    finally:
        spark.conf.unset(name)


def test_partitions_follow_the_bytes_of_the_tables(spark, tmp_path):
    """With a number of partitions that stays, a task would grow with the tables; merging cannot cut a partition."""
    (tmp_path / "t.parquet").write_bytes(bytes(30 * PARTITION_INPUT))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(0, 12_000_000, 1, 8).select(F.xxhash64("id").alias("key"), F.xxhash64("id", F.lit(1)).alias("value"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        sized(tuned(spark), str(tmp_path))
        assert spark.conf.get(FIRST_PARTITIONS) == "30"
        # About 200 MB of shuffled rows: 4 tasks of 50 MB without.
        parts = rows.groupBy("key").agg(F.max("value")).select(F.spark_partition_id().alias("part")).distinct().count()
        assert parts >= 16
        sized(spark, None)
        assert spark.conf.get(FIRST_PARTITIONS, None) is None
        spark.conf.set(FIRST_PARTITIONS, "7")
        sized(spark, str(tmp_path))
        assert spark.conf.get(FIRST_PARTITIONS) == "7"
    finally:
        spark.conf.unset(FIRST_PARTITIONS)
        spark.conf.set("spark.sql.shuffle.partitions", before)
