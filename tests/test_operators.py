"""Operators against plain windows, joins and brute force, on skewed and random rows."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.codes import cascade
from cohortloom.functions.text import alternation, contains_keyword, phrase_tokens, tokens_of
from cohortloom.operators.dosing import union_of_sums
from cohortloom.operators.encounters import encounter_index
from cohortloom.operators.joins import (
    classify_last_wins,
    existence_flags,
    flag_exists,
    interval_join,
    interval_summary,
    keep_matching,
    left_join_many,
)
from cohortloom.operators.phrases import (
    catalogue_frame,
    peek_hits,
    phrase_json,
    phrase_search,
    phrase_stats,
    severity_ids,
    top_hits,
)
from cohortloom.operators.ranking import seeded_sample, seeded_samples, top_k, value_bounds, with_dense_rank, with_ordinal
from cohortloom.operators.sets import attrition, overlap
from cohortloom.operators.status import first_last_status


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def hot_rows(n, seed=1, keys=40):
    """(key, value): a third of the rows on key 0, NULLs and repeated values among them."""
    draw = random.Random(seed)
    return [
        (
            0 if draw.random() < 0.33 else draw.choice([None, *range(1, keys)]),
            None if draw.random() < 0.05 else draw.randint(-3000, 3000) * draw.choice([1, 1, 5]),
        )
        for _ in range(n)
    ]


def test_dense_rank_over_many_blocks(spark):
    df = spark.createDataFrame([r for r in hot_rows(4000) if None not in r], "k INT, v INT").repartition(7)
    window = W.partitionBy("k").orderBy("v")
    want = df.select("k", "v", F.dense_rank().over(window).cast("bigint").alias("r"))
    assert rows(with_dense_rank(df, ["k"], "v", "r")) == rows(want)


def test_dense_rank_keeps_missing_keys_and_values(spark):
    df = spark.createDataFrame(hot_rows(600) + [(None, None), (3, None)], "k INT, v INT").repartition(5)
    window = W.partitionBy("k").orderBy(F.col("v").asc_nulls_last())
    want = df.select("k", "v", F.dense_rank().over(window).cast("bigint").alias("r"))
    assert rows(with_dense_rank(df, ["k"], "v", "r")) == rows(want)


def test_dense_rank_of_big_integers(spark):
    values = [(1, v) for v in (-(1 << 62), -1, 0, 1023, 1024, 1 << 40, (1 << 63) - 1)]
    df = spark.createDataFrame(values, "k INT, v BIGINT")
    assert [row.r for row in with_dense_rank(df, ["k"], "v", "r").orderBy("v").collect()] == list(range(1, 8))


def test_index_equals_outer_joins_with_hot_keys(spark):
    draw = random.Random(3)
    parents = spark.createDataFrame([(k,) for k in range(50)], "s INT")
    visits = [(0 if draw.random() < 0.4 else draw.randint(0, 60), h) for h in range(300)]
    visits += [(None, 900), (7, None)]
    stays = [(7 if draw.random() < 0.4 else draw.randint(0, 350), draw.randint(1, 4000)) for _ in range(1500)]
    a = spark.createDataFrame(visits, "s INT, h INT")
    i = spark.createDataFrame(stays + [(None, 5)], "h INT, stay INT")
    joined = parents.join(a, "s", "left").join(i, "h", "left")
    ind = F.dense_rank().over(W.partitionBy("s", "h").orderBy(F.col("stay").asc_nulls_last())).cast("bigint")
    want = joined.select("s", "h", "stay", ind.alias("ind"))
    assert rows(encounter_index(parents, a, i, "s", "h", "stay", stay_keys=["h"])) == rows(want)


def test_ordinal(spark):
    df = spark.createDataFrame([(v * 37, v) for v in range(3000)], "id BIGINT, v INT").repartition(5)
    got = with_ordinal(df, "id").orderBy("id").collect()
    assert [row.ordinal for row in got] == list(range(3000))


def test_ordinal_without_a_key_comes_last(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (5, "c"), (None, "d"), (None, "d")], "id BIGINT, x STRING")
    got = {(row.id, row.ordinal) for row in with_ordinal(df, "id").collect()}
    assert got == {(1, 0), (5, 1), (None, 2), (None, 3), (None, 4)}


def test_left_join_many(spark):
    left = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (None, "c"), (99, "d")], "k INT, x STRING")
    right = spark.createDataFrame(hot_rows(300), "k INT, v INT")
    assert rows(left_join_many(left, right, ["k"])) == rows(left.join(right, "k", "left"))


def test_missing_keys(spark):
    left = spark.createDataFrame([(None, 1), (1, 2), (2, 3)], "k INT, x INT")
    right = spark.createDataFrame([(None, i) for i in range(500)] + [(1, i) for i in range(5)], "k INT, v INT")
    assert rows(left_join_many(left, right, ["k"])) == rows(left.join(right, "k", "left"))
    parents = spark.createDataFrame([(1,), (2,)], "s INT")
    visits = spark.createDataFrame([(1, None), (1, 1), (2, 7)], "s INT, k INT")
    got = encounter_index(parents, visits, right, "s", "k", "v", stay_keys=["k"])
    assert (1, None, None, 1) in rows(got) and got.count() == 7


def test_flags_never_multiply(spark):
    base = spark.createDataFrame([(0, 7), (0, 7), (1, 5), (None, 5), (77, 5)], "k INT, flag INT")
    other = spark.createDataFrame(hot_rows(500), "k INT, v INT")
    got = existence_flags(base, other, ["k"], {"big": F.col("v") > 2900, "any": F.lit(True), "none": F.col("v") > 1e9})
    assert got.count() == 5 and {row.none for row in got.collect()} == {0}
    assert [row["any"] for row in got.orderBy("k").collect()] == [0, 1, 1, 1, 0]
    # An existing column of that name is replaced, rows stay.
    assert rows(flag_exists(base, other, ["k"], "flag")) == sorted([(None, 0), (0, 1), (0, 1), (1, 1), (77, 0)], key=repr)


def test_last_wins_equals_updates(spark):
    draw = random.Random(5)
    classes = {"one": ["a", "b"], "two": ["b", "c"], "three": ["d"]}
    data = [(draw.randint(0, 30), draw.choice("abcdefg")) for _ in range(60)]
    want = {k: None for k in range(35)}
    for label, codes in classes.items():  # one update after the other
        for k, code in data:
            if code in codes:
                want[k] = label
    df = spark.createDataFrame([(k,) for k in want], "k INT")
    codes = spark.createDataFrame(data, "k INT, code STRING")
    got = classify_last_wins(df, codes, ["k"], "code", classes, "label", {"e": F.col("code") == "e"})
    assert {row.k: row.label for row in got.collect()} == want
    assert {row.k for row in got.collect() if row.e == 1} == {k for k, code in data if code == "e"}


def test_cascade_first_true(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, None), (None, 0)], "a INT, b INT")
    rule = cascade([(F.col("a") == 1, 5), (F.col("b") == 1, 6)])
    assert [row[0] for row in df.select(rule).collect()] == [5, 6, 0, 0]


def _intervals(seed):
    draw = random.Random(seed)
    start = datetime(1969, 12, 20)

    def moment(days=6000):
        return start + timedelta(seconds=draw.randint(0, days * 86400))

    windows = []
    for i in range(120):
        begin = moment()
        length = draw.choice([0, 3600, 5 * 86400, 40 * 86400, 700 * 86400, 9000 * 86400, -86400])
        windows.append((i, 0 if draw.random() < 0.4 else draw.randint(1, 5), begin, begin + timedelta(seconds=length)))
    windows += [(500, None, start, moment()), (501, 0, None, moment()), (502, 0, start, None), (503, 9, start, moment())]
    events = [(0 if draw.random() < 0.4 else draw.randint(1, 5), moment(), i) for i in range(400)]
    events += [(k, end, 1000 + i) for i, (_, k, _, end) in enumerate(windows) if end is not None]  # on the closed end
    events += [(0, None, 5000), (None, start, 5001)]
    return windows, events


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_join_equals_range_join(spark, seed):
    windows, events = _intervals(seed)
    left = spark.createDataFrame(windows, "id INT, k INT, s TIMESTAMP_NTZ, e TIMESTAMP_NTZ")
    right = spark.createDataFrame(events, "k INT, ts TIMESTAMP_NTZ, n INT")
    condition = (F.col("l.k") == F.col("r.k")) & F.col("ts").between(F.col("s"), F.col("e"))
    joined = left.alias("l").join(right.alias("r"), condition, "left")
    assert rows(interval_join(left, right, ["k"], "ts", "s", "e")) == rows(
        joined.select("id", "l.k", "s", "e", "ts", "n")
    )
    want = joined.groupBy("id").agg(F.count("ts").alias("c"), F.min("ts").alias("first"))
    aggregates = {"c": F.count(F.lit(1)), "first": F.min("ts")}
    for key in (None, ["id"]):
        got = interval_summary(left, right, ["k"], "ts", "s", "e", aggregates, {"c": F.lit(0)}, key)
        assert rows(got.select("id", "c", "first")) == rows(want)


def test_first_last_equals_row_numbers(spark):
    draw = random.Random(9)
    data = [
        (0 if draw.random() < 0.33 else draw.randint(1, 9), draw.choice([None, *range(30)]), i, draw.choice("xyz"))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "k INT, ts INT, n INT, v STRING")
    flags = {name: F.when(F.col("v") == name, 1).otherwise(0) for name in "xy"}
    got = first_last_status(df, ["k"], "ts", ["n"], flags, {"x": "x_time"})
    first = F.row_number().over(W.partitionBy("k").orderBy(F.asc_nulls_last("ts"), F.asc("n")))
    last = F.row_number().over(W.partitionBy("k").orderBy(F.desc_nulls_first("ts"), F.desc("n")))
    ranked = df.select("*", first.alias("f"), last.alias("l"), *[c.alias(f"is_{n}") for n, c in flags.items()])
    want = ranked.groupBy("k").agg(
        *[F.max(F.when(F.col("f") == 1, F.col(f"is_{n}"))) for n in "xy"],
        *[F.max(F.when(F.col("l") == 1, F.col(f"is_{n}"))) for n in "xy"],
        *[F.max(f"is_{n}") for n in "xy"],
        F.min(F.when(F.col("is_x") == 1, F.col("ts"))),
    )
    assert rows(got) == rows(want)


def test_union_of_sums(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0), (None, 4.0)], "k INT, x DOUBLE")
    b = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, None)], "k INT, x DOUBLE")
    want = a.groupBy("k").agg(F.sum("x")).union(b.groupBy("k").agg(F.sum("x"))).distinct()
    assert rows(union_of_sums([a, b], ["k"], "x", "total")) == rows(want)


def test_overlap_and_attrition(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id INT")
    b = spark.createDataFrame([(2,), (3,)], "x INT")
    assert tuple(overlap({"a": a, "b": b}).first()) == (2, 2, 1, 3)
    df = spark.createDataFrame([(1, 1), (1, 5), (2, 5), (None, 9)], "k INT, v INT")
    criteria = [("all", F.lit(True)), ("big", F.col("v") >= 5), ("huge", F.col("v") > 100)]
    assert [tuple(r)[2:] for r in attrition(df, "k", criteria).collect()] == [(4, 2), (3, 2), (0, 0)]
    separate = attrition(df, "k", [("small", F.col("v") < 5), ("big", F.col("v") >= 5)], cumulative=False)
    assert [tuple(r) for r in separate.collect()] == [(1, "small", 1, 1), (2, "big", 3, 2)]
    empty = attrition(df.filter("false"), "k", criteria)
    assert [tuple(r)[2:] for r in empty.collect()] == [(0, 0)] * 3


def test_top_k_with_a_hot_group(spark):
    data = [(0 if i % 3 else i % 7, i * 7919 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(data, "g INT, s INT, id INT")
    order = [F.col("s").desc(), F.col("id").asc()]
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(*order))).filter("rank <= 5")
    assert rows(top_k(df, ["g"], order, 5, "id", parts=8)) == rows(want)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    for sample in (
        lambda d: seeded_sample(d, "id", 5, 10),
        lambda d: seeded_sample(d, "id", 5, 10, by=["g"]),
        lambda d: seeded_samples(d, "id", 5, [10, 20]),
    ):
        assert rows(sample(df.repartition(2))) == rows(sample(df.repartition(9)))
    assert rows(seeded_sample(df, "id", 5, 10)) != rows(seeded_sample(df, "id", 5, 20))


def test_keep_matching(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id INT, x STRING")
    ids = spark.createDataFrame([(1,), (1,), (None,)], "id INT")
    assert rows(keep_matching(df, ids, ["id"])) == [(1, "a")]


def test_keywords(spark):
    assert alternation([" a.b ", "c"]) == r"a\.b|c"
    df = spark.createDataFrame([("A.B",), ("axb",), (None,)], "t STRING")
    assert [r[0] for r in df.select(contains_keyword(F.col("t"), ["a.b"])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(contains_keyword(F.col("t"), ["a.b"], literal=False)).collect()] == [
        True, True, False,
    ]


# --- phrases ----------------------------------------------------------------------------------------------------


def test_same_tokens_in_text_and_phrase(spark):
    texts = ["LVEF (>55%)", "LVEF >55%", "lvef 55", "TASPE depressed (<1.6cm)", "30-39% a1.5.2b"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [row[0] for row in df.select(tokens_of(F.col("t"))).collect()]
    assert got == [phrase_tokens(t) for t in texts]
    assert got[0] == got[1] == got[2] == ["lvef", "55"]
    assert got[3][-1] == "1.6cm"


def search(spark, docs, phrases, slop=4):
    df = spark.createDataFrame(list(enumerate(docs)), "id BIGINT, text STRING")
    return phrase_search(df, "id", "text", phrases, slop)


def test_slop_limits(spark):
    phrase = "mild global left ventricular hypokinesis"
    docs = [
        "there is Mild global, left ventricular hypokinesis.",
        "global mild left ventricular hypokinesis",
        "mild a b c d global left ventricular hypokinesis",
        "mild a b c d e global left ventricular hypokinesis",
        "mild global left hypokinesis",
        None,
        "",
    ]
    got = {row.doc_id: row.spread for row in search(spark, docs, [phrase]).collect()}
    assert got == {0: 0, 1: 2, 2: 4}


def test_repeated_token_needs_two_places(spark):
    docs = ["the by the", "the by", "by the", "the the by", "the by a the"]
    assert {row.doc_id for row in search(spark, docs, ["the by the"]).collect()} == {0, 3, 4}


def assignments(terms, positions, used, low, high, slop):
    """Brute force: can the remaining terms get places of their own within the slop?"""
    if not terms:
        return True
    (q, tok), *rest = terms
    for p in positions.get(tok, []):
        if p in used:
            continue
        d = p - q
        lo, hi = (d, d) if low is None else (min(low, d), max(high, d))
        if hi - lo <= slop and assignments(rest, positions, used | {p}, lo, hi, slop):
            return True
    return False


@pytest.mark.parametrize("slop", [0, 2, 4])
def test_search_equals_brute_force(spark, slop):
    draw = random.Random(slop)
    phrases = ["a b", "a b a", "a a", "c a b c", "a b a a", "d c b a", "a a b b", "e"]
    docs = [" ".join(draw.choice("abcdexyz") for _ in range(draw.randint(0, 14))) for _ in range(600)]
    want = set()
    for i, doc in enumerate(docs):
        positions = {}
        for p, tok in enumerate(doc.split()):
            positions.setdefault(tok, []).append(p)
        for phrase in phrases:
            if assignments(list(enumerate(phrase.split())), positions, frozenset(), None, None, slop):
                want.add((phrase, i))
    got = search(spark, docs, phrases, slop).select("phrase", "doc_id").collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == want


def test_statistics_keep_phrases_without_hits(spark):
    rows_ = [("A", "normal", "a b"), ("B", "normal", "a b"), ("A", "severely", "q q")]
    catalogue = catalogue_frame(spark, rows_)
    hits = search(spark, ["a b", "a x b", "b a", "z"], ["a b", "q q"])
    got = {(r.category, r.phrase): (r.n_docs, r.first_doc, r.last_doc) for r in phrase_stats(hits, catalogue, 1).collect()}
    assert got == {("A", "a b"): (3, 0, 2), ("B", "a b"): (3, 0, 2), ("A", "q q"): (0, 0, 0)}
    assert [r.doc_id for r in top_hits(hits, 2).orderBy("rank").collect()] == [0, 1]
    assert {(r.rank, r.doc_id) for r in peek_hits(hits, 2).collect()} == {(2, 1), (3, 2)}


def test_no_hit_is_lost_and_no_list_grows(spark):
    n = 50_200
    hits = spark.range(n).select(
        F.lit("a b").alias("phrase"), F.col("id").alias("doc_id"), (F.col("id") % 3).cast("double").alias("score")
    )
    catalogue = catalogue_frame(spark, [("A", "normal", "a b"), ("A", "normal", "q")])
    got = phrase_json(hits, catalogue, 1000, value_bounds(hits, "doc_id")).collect()
    lists = {(row.phrase, row.part): json.loads(row.ids) for row in got}
    assert lists.pop(("q", 0)) == []
    assert len(lists) == 51 and max(map(len, lists.values())) == 1000
    every = [doc for part in range(51) for doc in lists["a b", part]]
    assert every == sorted(range(n), key=lambda doc: (-(doc % 3), doc))


def test_peeks_of_a_large_phrase(spark):
    hits = spark.range(3000).select(
        F.lit("p").alias("phrase"), F.col("id").alias("doc_id"), (F.col("id") % 7).cast("double").alias("score")
    )
    order = sorted(range(3000), key=lambda doc: (-(doc % 7), doc))
    assert {(r.rank, r.doc_id) for r in peek_hits(hits, 11).collect()} == {(11, order[10]), (3000, order[-1])}
    assert {(r.rank, r.doc_id) for r in peek_hits(hits.limit(5), 11).collect()} == {(5, 0)}


def test_accented_words_stay_whole(spark):
    got = search(spark, ["la fonction est dépressée", "d press e", "1.6cm d'été 2½"], ["d press e", "fonction est dépressée", "1.6cm d été"])
    assert {(row.phrase, row.doc_id) for row in got.collect()} == {
        ("d press e", 1), ("fonction est dépressée", 0), ("1.6cm d été", 2),
    }


def test_the_literal_is_built_at_once(spark):
    phrases = [f"word{i} of the {i}" for i in range(105)]
    docs = spark.createDataFrame([(1, "word7 of the 7")], "doc_id BIGINT, text STRING")
    phrase_search(docs, "doc_id", "text", phrases).collect()
    start = time.perf_counter()
    phrase_search(docs, "doc_id", "text", phrases)._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - start < 3  # under 1 s on an idle machine


def test_left_interval_join_reads_each_side_once(spark):
    day = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    path = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/reads"
    spark.range(400).select(
        (F.col("id") % 20).alias("k"), (day + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), "id"
    ).write.mode("overwrite").parquet(path)
    events = spark.read.parquet(path)
    start = day + F.make_dt_interval(hours=(F.col("id") % 5).cast("int"))
    windows = spark.range(30).select(F.col("id").alias("k"), start.alias("s"), (start + F.expr("INTERVAL 3 DAYS")).alias("e"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # large sides: both joins are shuffled
    try:
        joined = interval_join(windows, events, ["k"], "ts", "s", "e")
        assert joined.filter("id IS NULL").count() == 10
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_document_can_be_in_several_severities(spark):
    catalogue = catalogue_frame(spark, [("A", "severely", "severe x"), ("A", "mild", "x")])
    hits = search(spark, ["severe x", "x"], ["severe x", "x"])
    cohorts = {"severely": ["severely"], "mild": ["mild"], "either": ["severely", "mild"]}
    assert rows(severity_ids(hits, catalogue, cohorts)) == [
        ("either", 0), ("either", 1), ("mild", 0), ("mild", 1), ("severely", 0),
    ]


def test_long_document(spark):
    # Frequent tokens in one long text: the work must stay linear in their number.
    words = ["of", "the", "a", "b", "c"]
    draw = random.Random(4)
    doc = " ".join(draw.choice(words) for _ in range(60_000))
    got = search(spark, [doc], ["of the", "the of the", "zz"]).collect()
    assert {row.phrase for row in got} == {"of the", "the of the"}
