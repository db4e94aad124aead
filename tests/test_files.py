"""Readers and writers."""

from __future__ import annotations

import json
import os
from collections import Counter

from pyspark.sql import functions as F

from cohortloom.plans.echo import echo_severity
from cohortloom.plans.note_cohorts import note_exports, write_exports
from cohortloom.session import remove_folder, scratch_folder
from cohortloom.sources.files import (
    export_documents,
    id_from_path,
    read_exported_texts,
    read_quoted_csv,
    write_csv,
    write_json,
    write_lines,
)
from cohortloom.sources.tables import load, materialise, register_views, save_table

SMALL = "/root/testdata/sf0.001"


def test_quoted_header_and_dirty_ids(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("'hadm_id','angus'\n180367.0,1\n,1\n125506,0\nx,1\n")
    got = read_quoted_csv(spark, str(path), "hadm_id INT, angus INT")
    assert got.columns == ["hadm_id", "angus"]
    assert [tuple(row) for row in got.collect()] == [(180367, 1), (None, 1), (125506, 0), (None, 1)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "id INT, name STRING, other STRING")
    write_csv(df, str(tmp_path / "out"), ["id", "name"])
    back = read_quoted_csv(spark, str(tmp_path / "out"), "id INT, name STRING")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]


def test_one_file_per_document(spark, tmp_path):
    texts = {1: "one\nline two\n", 2: "", 30: "ä ß"}
    df = spark.createDataFrame(list(texts.items()), "row_id BIGINT, text STRING")
    export_documents(df, str(tmp_path / "notes"), "row_id", "text", one_file_each=True)
    back = read_exported_texts(spark, str(tmp_path / "notes"), "row_id")
    assert {row.row_id: row.text for row in back.collect()} == texts


def test_id_from_path(spark):
    df = spark.createDataFrame([("/a/b/123.txt",), ("x/7.csv",), ("n/9007199254740993.txt",)], "p STRING")
    assert [row[0] for row in df.select(id_from_path(F.col("p"))).collect()] == [123, None, 9007199254740993]


def test_ids_with_a_point(spark, tmp_path):
    path = str(tmp_path / "ids")
    values = ["125506", "125506.0", "125506.", "125506.7", "9007199254740993.0", "-3", "x", "1e5", "99999999999999999999"]
    spark.createDataFrame([(v,) for v in values], "`'hadm_id'` STRING").coalesce(1).write.option("header", True).csv(path)
    got = [row.hadm_id for row in read_quoted_csv(spark, path, "hadm_id BIGINT").collect()]
    assert got == [125506, 125506, 125506, None, 9007199254740993, -3, None, None, None]


def test_exports_round_trip(spark, tmp_path):
    notes = spark.createDataFrame(
        [
            (5, 1, 10, "Physician Resident Admission Note", "known CHF"),
            (7, 2, 20, "Physician Resident Admission Note", "nothing"),
            (9, 3, 30, "Report", "CHF"),
        ],
        "row_id BIGINT, subject_id INT, hadm_id INT, description STRING, text STRING",
    )
    external = spark.createDataFrame([(10, 1), (20, 0)], "hadm_id INT, angus INT")
    write_exports(note_exports(notes, external), str(tmp_path))
    back = {
        name: sorted(tuple(row) for row in spark.read.option("header", True).csv(str(tmp_path / name)).collect())
        for name in ["admission", "heart_failure", "sepsis", "heart_failure_sepsis"]
    }
    assert back["admission"] == [("5", "1", "10"), ("7", "2", "20")]
    assert back["heart_failure"] == [("0", "1", "10")]  # the ordinal in all notes
    assert back["sepsis"] == back["heart_failure_sepsis"] == [("5", "1", "10")]


def test_load_pushes_filter_and_columns(spark):
    df = load(spark, SMALL, "orders", ["o_orderkey"], F.col("o_orderstatus") == "F")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_views_and_tables(spark, tmp_path):
    df = spark.range(10)
    register_views({"ten": df})
    assert spark.sql("SELECT count(*) FROM ten").first()[0] == 10
    assert materialise(df, str(tmp_path / "t")).count() == 10
    assert materialise(df.limit(3), str(tmp_path / "t")).count() == 3  # replaced


def test_saved_table_is_replaced(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS files_test LOCATION '{tmp_path / 'db'}'")
    try:
        save_table(spark.range(10), "files_test.numbers", bucket_by="id", buckets=2)
        assert save_table(spark.range(4), "files_test.numbers").count() == 4
    finally:
        spark.sql("DROP DATABASE files_test CASCADE")


def test_scratch_folder_follows_the_setting(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    first, second = scratch_folder(spark, "x"), scratch_folder(spark, "x")
    assert first.startswith(f"{shared}/x-") and first != second
    spark.range(3).write.parquet(first)
    remove_folder(spark, first)
    assert not os.path.exists(first)


def test_echo_plan_and_sinks(spark, tmp_path):
    notes = spark.createDataFrame(
        [
            (1, 10, 100, "Echo", "There is Severely depressed LVEF (<30%). Dilated LV cavity."),
            (2, 20, None, "Echo", "Overall normal LVEF (>55%)"),
            (3, 30, 300, "Echo", "Mildly dilated RV cavity"),
            (4, 40, 400, "Nursing", "Severely depressed LVEF"),
            (5, 50, 500, "Echo", None),
        ],
        "row_id BIGINT, subject_id INT, hadm_id INT, category STRING, text STRING",
    )
    result = echo_severity(notes, str(tmp_path / "hits"))
    cohorts = {}
    for row in result.cohorts.collect():
        cohorts.setdefault(row.cohort, set()).add((row.row_id, row.subject_id, row.hadm_id))
    # 'Depressed LVEF' and 'Dilated LV cavity' are mild or moderate terms, so note 1 is in every cohort.
    assert cohorts["severely"] == {(1, 10, 100)}
    assert cohorts["mild_moderate"] == cohorts["either"] == {(1, 10, 100), (3, 30, 300)}
    assert result.stats.count() == 121 and result.stats.filter("n_docs = 0").count() > 100
    write_lines(result.report, str(tmp_path / "report"), "ord", "line")
    lines = [row.value for row in spark.read.text(str(tmp_path / "report")).collect()]
    assert len(lines) == 790 and lines[3] == "NORMAL" and lines[-1] == "*" * 100
    assert lines[6:11] == ["Overall normal LVEF (>55%)", "Number of Documents 1", "First 2", "Random 2", "Last 2"]
    listed = result.json()
    write_json(listed.select(F.to_json(F.struct(*listed.columns)).alias("json")), str(tmp_path / "json"), "json")
    parsed = [json.loads(row.value) for row in spark.read.text(str(tmp_path / "json")).collect()]
    assert sorted(Counter((row["category"], row["level"]) for row in parsed).values()) == sorted(
        [22, 16, 7, 23, 6, 2, 11, 17, 2, 7, 4, 4]
    )
    first = next(row for row in parsed if row["phrase"] == "Overall normal LVEF (>55%)")
    assert (first["level"], first["part"], first["ids"]) == ("normal", 0, "[2]")
