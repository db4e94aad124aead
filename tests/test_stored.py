"""What the library stores and answers from: positions, bitmaps, keyed updates, versions, layouts, inferred types."""

from __future__ import annotations

import glob
import math
import os
import random
import re
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortloom.operators import bitmaps
from cohortloom.operators.automaton import KeywordAutomaton, automaton_cohort, clued_patterns
from cohortloom.operators.phrases import phrase_search
from cohortloom.operators.positions import BUCKETS, add_batch, read_blocks, stored_phrase_search, token_blocks
from cohortloom.operators.relevance import corpus_statistics, relevance
from cohortloom.operators.sets import attrition, overlap
from cohortloom.plans import stored_queries
from cohortloom.plans import table_queries as t
from cohortloom.sources.inferred import infer_types, read_inferred_csv
from cohortloom.sources.layout import SearchPath, point_read, write_clustered
from cohortloom.sources.tables import save_table
from cohortloom.sources.updates import read_keyed, update_keyed, write_keyed
from cohortloom.sources.versions import VersionedTables
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"
ORACLES = stored_queries.oracles()


def test_every_query_has_sql():
    assert set(ORACLES) == set(stored_queries.QUERIES)


@pytest.mark.parametrize("name", list(stored_queries.QUERIES))
def test_matches_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    allowed = r"CartesianProduct" if "automaton" in name else r"CartesianProduct|Python|ArrowEval"
    assert not re.search(allowed, df._jdf.queryExecution().executedPlan().toString())
    assert compare(df, connect(SMALL), ORACLES[name]) is None


def files(path):
    return {name: os.stat(name).st_mtime_ns for name in glob.glob(f"{path}/**/*.parquet", recursive=True)}


# --- positions --------------------------------------------------------------------------------------------------


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_positions_equal_the_search_of_texts(spark, tmp_path):
    draw = random.Random(2)
    words = ["the"] * 6 + ["heart", "failure", "left", "right", "of", "no", "1.6cm", "é"]
    texts = [(i * 37 - 3000, " ".join(draw.choice(words) for _ in range(draw.randint(0, 30)))) for i in range(600)]
    texts += [(10**12, "heart failure"), (10**12 + 1, None), (10**12 + 2, ""), (77777, "the " * 3000 + "heart the failure")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    path = str(tmp_path / "positions")
    phrases = ["heart failure", "the the of", "left heart failure", "of", "1.6cm é the", "missing heart", "failure failure heart"]
    add_batch(docs.filter("doc_id < 5000"), path, "a", block_ids=512)
    before = files(path)
    add_batch(docs.filter("doc_id >= 5000"), path, "b", block_ids=512)
    after = files(path)
    assert {name: after[name] for name in before} == before and len(after) > len(before)
    found = stored_phrase_search(spark, path, phrases)
    assert rows_of(found) == rows_of(phrase_search(docs, "doc_id", "text", phrases))
    assert rows_of(stored_phrase_search(spark, path, ["missing"])) == []


def test_positions_are_shuffled_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for partitions in ("8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        blocks = token_blocks(docs, "doc_id", "text").sortWithinPartitions("bucket", "token", "block")
        plan = blocks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert len(re.findall(r"\bExchange ", plan)) == 1
        spread = blocks.filter("token = 'the'").agg(F.count_distinct("bucket"), F.count_distinct("block"), F.count("*")).first()
        assert spread[0] == 1 and spread[1] == spread[2]
        assert blocks.filter(F.pmod(F.xxhash64("token"), F.lit(BUCKETS)) != F.col("bucket")).isEmpty()


def test_only_the_buckets_of_the_tokens_are_read(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "positions")
    add_batch(docs, path, "1")
    blocks = read_blocks(spark, path, ["the", "of"])
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*token", plan)
    buckets = {row["bucket"] for row in blocks.select("bucket").distinct().collect()}
    assert 1 <= len(buckets) <= 2 < len(glob.glob(f"{path}/batch=1/bucket=*"))
    row = blocks.filter("token = 'the'").first()
    ids = [p["doc_id"] for p in row["postings"]]
    assert ids == sorted(ids) and (ids[0], ids[-1], len(ids)) == (row["first_doc"], row["last_doc"], row["n_docs"])


# --- bitmaps ----------------------------------------------------------------------------------------------------


def test_bitmaps_equal_id_sets(spark):
    draw = random.Random(1)
    pool = [*range(-50, 200), 32767, 32768, 32769, 65536, 65537, -32768, -32769, 10**12, 10**12 + 1]
    sets = {name: [draw.choice(pool) for _ in range(300)] + [None] for name in ("a", "b", "c")} | {"d": [5], "e": []}
    frames = {name: spark.createDataFrame([(i,) for i in ids], "id bigint") for name, ids in sets.items()}
    stored = bitmaps.cohort_bitmaps(frames)
    plain = {name: {i for i in ids if i is not None} for name, ids in sets.items()}

    def ids(bits):
        return sorted(row.id for row in bitmaps.members(bits).collect())

    assert ids(bitmaps.union_bits(stored, ["a", "b"])) == sorted(plain["a"] | plain["b"])
    both = bitmaps.intersection_bits(stored, ["a", "b", "c"])
    assert ids(both) == sorted(plain["a"] & plain["b"] & plain["c"])
    assert bitmaps.count_bits(both).first().n == len(ids(both))
    assert ids(bitmaps.intersection_bits(stored, ["a", "e"])) == [] and bitmaps.count_bits(bitmaps.union_bits(stored, ["e"])).first().n == 0
    assert bitmaps.overlap_of_bitmaps(stored, list(sets)).first().asDict() == overlap(frames).first().asDict()
    assert bitmaps.overlap_of_bitmaps(stored, ["a"]).first().n_a == len(plain["a"])


@pytest.mark.parametrize("cumulative", [True, False])
def test_bitmap_attrition(spark, cumulative):
    rows = [(i % 700 if i % 11 else None, i % 5, i % 3 if i % 7 else None) for i in range(5000)]
    df = spark.createDataFrame(rows, "k bigint, x int, y int").repartition(4)
    criteria = [("x", F.col("x") > 1), ("y", F.col("y") == 2), ("none", F.col("x") > 9)]
    assert rows_of(bitmaps.bitmap_attrition(df, "k", criteria, cumulative)) == rows_of(attrition(df, "k", criteria, cumulative))
    assert rows_of(bitmaps.bitmap_attrition(df.filter("x > 9"), "k", criteria)) == rows_of(attrition(df.filter("x > 9"), "k", criteria))


# --- keyed updates ----------------------------------------------------------------------------------------------


def test_update_rewrites_only_the_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "keyed")
    rows = [(i, i % 4, f"n{i}", None) for i in range(400)] + [(None, 1, "no key", None), (7, 3, "again", None)]
    df = spark.createDataFrame(rows, "id int, part int, name string, flag int")
    write_keyed(df, path, ["id"], buckets=16)
    before = files(path)
    changes = spark.createDataFrame(
        [(7, 1, 1, "early"), (7, 1, 9, "late"), (7, 1, 3, "middle"), (8, None, 1, None), (None, 1, 1, "x"), (9999, 1, 1, "nobody")],
        "id int, flag int, at int, name string",
    )
    numbers = update_keyed(spark, path, changes, ["id"], buckets=16, order=["at"])
    assert 1 <= len(numbers) <= 2
    after = files(path)
    untouched = {name: when for name, when in before.items() if int(re.search(r"_bucket=(\d+)", name)[1]) not in numbers}
    assert {name: after.get(name) for name in untouched} == untouched and len(untouched) < len(before)
    want = {(i, part, "late" if i == 7 else None if i == 8 else name, 1 if i == 7 else None) for i, part, name, _ in rows}
    got = read_keyed(spark, path).select("id", "part", "name", "flag").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    assert update_keyed(spark, path, changes.filter("id = 9999 OR id IS NULL"), ["id"], buckets=16, order=["at"]) == []
    assert files(path) == after


def test_update_by_two_keys(spark, tmp_path):
    path = str(tmp_path / "keyed")
    df = spark.createDataFrame([(i, j, 0) for i in range(20) for j in range(3)], "a int, b int, v int")
    write_keyed(df, path, ["a", "b"], buckets=8)
    update_keyed(spark, path, spark.createDataFrame([(3, 1, 5), (3, 1, 7), (4, 2, 6)], "a int, b int, v bigint"), ["a", "b"], buckets=8)
    assert {tuple(r) for r in read_keyed(spark, path).filter("v > 0").collect()} == {(3, 1, 7), (4, 2, 6)}
    assert read_keyed(spark, path).count() == 60


# --- versions ---------------------------------------------------------------------------------------------------


def test_versions_and_dependants(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "versions"))
    tables.write("base", spark.range(10))
    tables.define("even", lambda at: at.read("base").filter("id % 2 = 0"), uses=["base"])
    tables.define("sum", lambda at: at.read("even").agg(F.sum("id").alias("s")), uses=["even"])
    tables.define("both", lambda at: at.read("base").join(at.read("even"), "id"), uses=["base", "even"])
    assert tables.rebuild("even") in (["even", "both", "sum"], ["even", "sum", "both"]) and tables.read("sum").first().s == 20
    # A table rebuilt from itself; the others follow, each after what it is built from.
    tables.define("base", lambda at: at.read("base").filter("id < 5"), uses=["base"])
    done = tables.rebuild("base")
    assert done[0] == "base" and done.index("even") < min(done.index("sum"), done.index("both"))
    assert tables.read("sum").first().s == 6 and tables.read("base", 1).count() == 10
    # One that fails keeps its old version, and so do those behind it.
    held = tables.read("sum")
    tables.define("even", lambda at: at.read("base").select(F.assert_true(F.col("id") < 2), "id"), uses=["base"])
    with pytest.raises(Exception):
        tables.rebuild("base")
    assert tables.read("even").count() == 3 and held.first().s == 6 and tables.versions("base") == [1, 2, 3]
    tables.keep("base", 1)
    assert tables.versions("base") == [3] and tables.read("base").count() == 5
    with pytest.raises(ValueError):
        tables.drop("even")
    assert set(tables.drop("even", cascade=True)) == {"even", "sum", "both"}
    for name in ("even", "sum", "both"):
        with pytest.raises(KeyError):
            tables.read(name)
    assert tables.read("base").count() == 5


def test_circles_and_unknown_tables(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "versions"))
    with pytest.raises(KeyError):
        tables.define("a", lambda at: None, uses=["nothing"])
    tables.write("a", spark.range(1))
    tables.define("b", lambda at: at.read("a"), uses=["a"])
    with pytest.raises(ValueError):
        tables.define("a", lambda at: at.read("b"), uses=["b"])


# --- inferred types, layouts, search path -----------------------------------------------------------------------


def test_types_hold_for_all_rows(spark, tmp_path):
    path = tmp_path / "in.csv"
    lines = ["'id','gap','price','when','day','text','late','none','lead'"]
    lines += [f"{i},{i}.0,{i}.5,2020-01-0{1 + i % 9} 10:00:00,2020-02-01,a{i},{i},,+0{i}" for i in range(3000)]
    lines += ["-5,,1e3,,,\"x, y\",word,,7", "18,3.,.5,2020-01-01T00:00,,,1,,"]
    path.write_text("\n".join(lines))
    got = read_inferred_csv(spark, str(path))
    assert dict(got.dtypes) == {
        "id": "bigint", "gap": "bigint", "price": "double", "when": "timestamp_ntz", "day": "timestamp_ntz",
        "text": "string", "late": "string", "none": "string", "lead": "bigint",
    }
    assert got.agg(F.sum("id"), F.sum("gap"), F.sum("price")).first()[:] == (4498500 + 13, 4498503, 4500000.0 + 1000.5)
    assert got.filter("id = -5").select("gap", "when", "text").first()[:] == (None, None, "x, y")
    strings = spark.createDataFrame([("2020-13-45", "12345678901234567890", "NaN")], "a string, b string, c string")
    assert infer_types(strings) == {"a": "text", "b": "float", "c": "text"}
    assert infer_types(strings.limit(0)) == {"a": "text", "b": "text", "c": "text"}


def scanned_rows(df):
    """Rows that the scan gave to the plan, after whole row groups were ruled out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_point_reads_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "clustered")
    n = 200_000
    # Both ids are scattered over the whole range; one orders the files, the other only has Bloom filters.
    df = spark.range(n).select(
        ((F.col("id") * 7919) % n).alias("id"), (F.xxhash64("id") % (1 << 40)).alias("other"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("pad")
    )
    write_clustered(df, path, ["id"], bloom=["other"], row_group_bytes=256 << 10, distinct=20_000)
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    try:
        one = point_read(spark, path, "id", [777])
        assert scanned_rows(one) <= n / 8 and len(one.collect()) == 1
        value = spark.read.parquet(path).filter("id = 4242").first().other
        found = point_read(spark, path, "other", [value])
        assert scanned_rows(found) <= n / 4 and [r.id for r in found.collect()] == [4242]
    finally:
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")
    assert point_read(spark, path, "id", []).count() == point_read(spark, path, "id", [None, n + 5]).count() == 0


def test_search_path_both_ways(spark):
    for name in ("front", "back"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
        save_table(spark.range(3).withColumn("db", F.lit(name)), f"{name}.shared")
    save_table(spark.range(7), "back.only")
    assert SearchPath(spark, ["front", "back"]).table("shared").first().db == "front"
    assert SearchPath(spark, ["back", "front"]).table("shared").first().db == "back"
    path = SearchPath(spark, ["front", "back"])
    assert path.resolve("only") == "back.only" and path.resolve("front.shared") == "front.shared"
    path.views("shared", "only")
    assert spark.sql("SELECT count(*) AS n FROM shared JOIN only USING (id)").first().n == 3
    with pytest.raises(KeyError):
        path.table("nowhere")


# --- keywords and relevance -------------------------------------------------------------------------------------


def test_automaton_finds_what_a_plain_search_finds():
    draw = random.Random(9)
    keywords = ["he", "she", "his", "hers", "é", " Heart Failure ", "aaa", "aa", "日本", "x" * 40, "ab" * 30]
    automaton = KeywordAutomaton(keywords)
    alphabet = ["h", "e", "s", "H", "i", "r", "é", "É", "a", "A", "日本", " ", "heart failure", "x" * 13, "ab" * 9, "\x00", "😀"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 120))) for _ in range(300)]
    texts += ["ab" * 4000, "q" * 2040 + "x" * 40 + "q" * 3000, "", "q" * 2047 + "hers", "A" * 5000]
    want = []
    for text in texts:
        low = text.encode().lower()
        want.append([i for i, word in enumerate(keywords) if word.strip().encode().lower() in low])
    assert automaton.search([text.encode() for text in texts]) == want
    assert automaton.search([]) == [] and automaton.search([b""]) == [[]]
    with pytest.raises(ValueError):
        KeywordAutomaton(["a", " "])


def test_time_does_not_grow_with_the_keywords():
    draw = random.Random(3)

    def word():
        return "".join(draw.choice("abcdefghijklmnop") for _ in range(10))

    many = [word() for _ in range(5000)]
    texts = [" ".join(word() for _ in range(400)).encode() for _ in range(600)]
    seconds = []
    for keywords in (many[:8], many):
        automaton = KeywordAutomaton(keywords)
        start = time.perf_counter()
        for _ in range(3):
            automaton.search(texts)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 3 * seconds[0]


def test_patterns_are_tried_where_their_clue_stands(spark):
    rows = [(1, "A Licence."), (2, "license"), (3, "licentious"), (4, None), (5, "Copyright"), (6, "nothing"), (7, "")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("_clues", F.lit(5))
    found = clued_patterns(df, "text", {"licen[cs]e": ["licen"], "copyright": ["copyright"]})
    assert found.columns == df.columns and sorted((r.id, r._clues) for r in found.collect()) == [(1, 5), (2, 5), (5, 5)]
    assert sorted(r.id for r in automaton_cohort(df, "text", ["LICEN", "right"]).collect()) == [1, 2, 3, 5]


def test_relevance_of_few_documents(spark):
    docs = spark.createDataFrame([(1, "heart failure"), (2, "heart failure " + "word " * 50), (3, "heart and more"), (4, None), (5, "x")], "doc_id bigint, text string")
    phrases = ["heart failure", "missing"]
    n, mean, counts = corpus_statistics(docs, "text", phrases)
    assert (n, counts) == (5, {"heart": 3, "failure": 2}) and mean == (2 + 52 + 3 + 0 + 1) / 5
    hits = phrase_search(docs, "doc_id", "text", phrases)
    got = {r.doc_id: r.score for r in relevance(hits, docs, "doc_id", "text", phrases).collect()}
    idf = sum(math.log(1 + (5 - df + 0.5) / (df + 0.5)) for df in (3, 2))
    assert got == {i: pytest.approx(idf / (1 + 1.2 * (0.25 + 0.75 * length / mean)), abs=1e-9) for i, length in ((1, 2), (2, 52))}
    assert corpus_statistics(docs.limit(0), "text", phrases) == (0, 0.0, {})


# --- the training-data part may be missing ----------------------------------------------------------------------


@pytest.mark.parametrize("missing", ["cohortloom.llm", "corpus_pipeline", "tokenizers", "public_tokenizers"])
def test_queries_without_the_training_part(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=120)
    own = len(t.QUERIES) + len(stored_queries.QUERIES) + len(entry.clinic_queries.QUERIES)
    assert out.stdout.split() == [str(own), str(own)], out.stderr
