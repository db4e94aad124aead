"""The operators run on the supplied order, event and document tables.

Roles: customer = patient, orders = admission, lineitem = stay, diagnosis or infusion row, part = coded item,
events = charted event, documents = note, labels = external id list. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import as_flag, cascade, exact_flag, prefix_flag
from ..functions.dosing import dose_predicate, DoseRule, in_band, normalise_unit, whole_units
from ..functions.temporal import age_flag, whole_hours, whole_years
from ..functions.text import contains_ignore_case, contains_keyword, labelled, occurs
from ..operators.dosing import union_of_sums
from ..operators.encounters import build_cohort, encounter_index
from ..operators.joins import (
    classify_last_wins,
    existence_flags,
    flag_exists,
    interval_join,
    interval_summary,
    keep_matching,
    left_join_many,
)
from ..operators.notes import frequency, frequency_lines, frequency_total, keyword_cohort, text_evidence
from ..operators.phrases import (
    catalogue_frame,
    hit_summary,
    peek_hits,
    phrase_json,
    phrase_search,
    phrase_stats,
    report_lines,
    severity_cohorts,
    severity_ids,
    tokenise,
    top_hits,
)
from ..operators.ranking import first_match, seeded_sample, seeded_samples, value_bounds, with_ordinal
from ..operators.sets import attrition, id_set, intersect_ids, overlap, shape, union_ids
from ..operators.status import first_last_status
from ..operators.sweep import sweep_join, sweep_summary
from ..session import remove_folder, scratch_folder
from ..sources.files import export_documents, id_from_path, read_exported_texts, read_quoted_csv, write_csv
from ..sources.tables import load, materialise

BRANDS = {7: ["Brand#1"], 8: ["Brand#23", "Brand#24"]}
LINE_CLASSES = {"ACCEPTED": ["A"], "NONE": ["N"], "RETURNED": ["R"]}
LICENCE = ["licen[cs]e", "copyright"]
SLOP = 4
PART = 100
SEED = 10
SEEDS = [10, 20, 30, 40, 50]
PHRASES = ["of the", "by the and", "on the it is", "the by the", "this is the", "zzqx of the"]
CATALOGUE = [
    ("A", "normal", "of the"),
    ("A", "normal", "by the and"),
    ("A", "mild_moderate", "on the it is"),
    ("A", "severely", "the by the"),
    ("B", "normal", "of the"),
    ("B", "mild_moderate", "this is the"),
    ("B", "severely", "zzqx of the"),
]
TITLES = {"A": "First heading", "B": "Second heading"}
COHORTS = {
    "normal": ["normal"],
    "mild_moderate": ["mild_moderate"],
    "severely": ["severely"],
    "either": ["severely", "mild_moderate"],
}


# --- encounters, flags and durations ----------------------------------------------------------------------------


def _index(spark: SparkSession, sf: str, orders: DataFrame) -> DataFrame:
    return encounter_index(
        load(spark, sf, "customer", ["c_custkey"]),
        orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"),
        load(spark, sf, "lineitem", [F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"]),
        "c_custkey",
        "o_orderkey",
        "l_linenumber",
        stay_keys=["o_orderkey"],
    )


def encounter_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, load(spark, sf, "orders", where=F.col("o_orderstatus") == "F"))


def ages(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    lines = load(spark, sf, "lineitem", [F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate"])
    age = whole_years(F.col("o_orderdate"), F.col("l_shipdate"))
    return left_join_many(orders, lines, ["o_orderkey"]).select(
        "*", age.alias("age"), age_flag(age, 2).alias("age_flag")
    )


def prefix_flags(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part", ["p_partkey", "p_brand", "p_type"])
    flagged = prefix_flag(part, "p_brand", BRANDS, "brand_flag")
    return exact_flag(flagged, "p_type", ["ECONOMY", "PROMO"], "type_flag")


def _lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return load(spark, sf, "lineitem", [F.col("l_orderkey").alias("o_orderkey"), *columns])


def _order_flags(spark: SparkSession, sf: str) -> DataFrame:
    return existence_flags(
        load(spark, sf, "orders", ["o_orderkey", "o_custkey"]),
        _lines(spark, sf, "l_returnflag", "l_quantity", "l_discount"),
        ["o_orderkey"],
        {
            "returned": F.col("l_returnflag") == "R",
            "bulky": F.col("l_quantity") >= 45,
            "discounted": F.col("l_discount") >= 0.09,
        },
    )


def existence(spark: SparkSession, sf: str) -> DataFrame:
    return _order_flags(spark, sf).drop("discounted")


def rule_cascade(spark: SparkSession, sf: str) -> DataFrame:
    returned = F.col("returned") == 1
    rule = cascade(
        [
            (F.col("bulky") == 1, 1),
            (returned & (F.col("discounted") == 1), 2),
            (returned, 3),
        ]
    )
    return _order_flags(spark, sf).withColumn("rule", rule)


def update_from(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumn("flagged", F.lit(0))
    lines = _lines(spark, sf, "l_returnflag", "l_quantity")
    return flag_exists(
        orders, lines.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)), ["o_orderkey"], "flagged"
    )


def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return classify_last_wins(
        load(spark, sf, "orders", ["o_orderkey"]),
        _lines(spark, sf, "l_returnflag"),
        ["o_orderkey"],
        "l_returnflag",
        LINE_CLASSES,
        "line_class",
    )


def elapsed_hours(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    joined = _lines(spark, sf, "l_linenumber", "l_shipdate").join(orders, "o_orderkey")
    hours = whole_hours(F.col("o_orderdate"), F.col("l_shipdate"))
    return joined.select("o_orderkey", "l_linenumber", "o_orderdate", "l_shipdate", hours.alias("hours"))


def hours_profile(spark: SparkSession, sf: str) -> DataFrame:
    return elapsed_hours(spark, sf).groupBy("hours").agg(F.count(F.lit(1)).alias("n"))


def _cohort(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice"])
    return build_cohort(
        _index(spark, sf, orders),
        existence(spark, sf).drop("o_custkey"),
        orders.drop("o_custkey"),
        ["o_orderkey"],
        F.col("returned") == 1,
    )


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    return _cohort(spark, sf)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Index, flags, coded items, rule and cohort in one plan, ending in the attrition table."""
    coded = prefix_flag(load(spark, sf, "part", ["p_partkey", "p_brand"]), "p_brand", BRANDS, "coded")
    coded_lines = _lines(spark, sf, F.col("l_partkey").alias("p_partkey")).join(
        coded.filter(F.col("coded") == 1), "p_partkey", "left_semi"
    )
    chosen = flag_exists(_cohort(spark, sf), coded_lines, ["o_orderkey"], "coded")
    rule = cascade([(F.col("bulky") == 1, 1), (F.col("coded") == 1, 1)])
    return attrition(
        chosen.withColumn("rule", rule),
        "c_custkey",
        [
            ("returned", F.col("returned") == 1),
            ("rule", F.col("rule") == 1),
            ("finished", F.col("o_orderstatus") == "F"),
            ("large", F.col("o_totalprice") > 100000),
        ],
    )


# --- status and intervals ---------------------------------------------------------------------------------------


def _event_flags() -> dict:
    return {
        "error": as_flag(F.col("event_type") == "error"),
        "purchase": as_flag(F.col("event_type").isin("purchase", "signup")),
    }


def _status(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events", ["user_id", "ts", "event_id", "event_type"])
    return first_last_status(
        events, ["user_id"], "ts", ["event_id"], _event_flags(), {"error": "first_error", "purchase": "first_purchase"}
    )


def first_last(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf)


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    start = load(spark, sf, "events", ["user_id", "ts"]).groupBy("user_id").agg(F.min("ts").alias("start_ts"))
    return start.withColumn("end_ts", F.col("start_ts") + F.expr("INTERVAL 7 DAYS"))


def _of_type(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return load(spark, sf, "events", ["user_id", "event_id", "ts"], where=F.col("event_type") == kind)


def interval_counts(spark: SparkSession, sf: str) -> DataFrame:
    return interval_summary(
        _windows(spark, sf),
        _of_type(spark, sf, "error"),
        ["user_id"],
        "ts",
        "start_ts",
        "end_ts",
        {"n_errors": F.count(F.lit(1)), "first_error": F.min("ts")},
        {"n_errors": F.lit(0)},
        key=["user_id"],
    )


def interval_rows(spark: SparkSession, sf: str) -> DataFrame:
    windows = _windows(spark, sf).withColumn("start_ts", F.col("end_ts") - F.expr("INTERVAL 12 HOURS"))
    return interval_join(windows, _of_type(spark, sf, "error"), ["user_id"], "ts", "start_ts", "end_ts")


def swept_counts(spark: SparkSession, sf: str) -> DataFrame:
    errors = _of_type(spark, sf, "error")
    return sweep_summary(
        _windows(spark, sf), errors, ["user_id"], "ts", "start_ts", "end_ts", "n_errors", "first_error"
    )


def swept_rows(spark: SparkSession, sf: str) -> DataFrame:
    windows = _windows(spark, sf).withColumn("start_ts", F.col("end_ts") - F.expr("INTERVAL 12 HOURS"))
    return sweep_join(windows, _of_type(spark, sf, "error"), ["user_id"], "ts", "start_ts", "end_ts")


def swept_sums(spark: SparkSession, sf: str) -> DataFrame:
    """For every order the parts shipped in the year and the century after it, over all orders of its status."""
    lines = load(spark, sf, "lineitem", ["l_linestatus", "l_shipdate", "l_quantity"])
    lines = lines.select("l_linestatus", "l_shipdate", F.floor("l_quantity").alias("quantity"))
    orders = load(spark, sf, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"])
    orders = orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("l_linestatus"),
        F.col("o_orderdate").alias("start_ts"),
        F.explode(F.array(F.lit(1), F.lit(100))).alias("years"),
    )
    windows = orders.withColumn("end_ts", F.expr("start_ts + make_ym_interval(years, 0)"))
    times, found = ("l_shipdate", "start_ts", "end_ts"), ("n_lines", "first_ship", "last_ship")
    swept = sweep_summary(windows, lines, ["l_linestatus"], *times, *found, {"quantity": F.col("quantity")})
    return swept.select("o_orderkey", "years", "n_lines", "quantity", "first_ship", "last_ship")


def combined_status(spark: SparkSession, sf: str) -> DataFrame:
    """First, last and ever status, the first purchase inside the window and a flag from the notes, per user."""
    status = _status(spark, sf).drop("first_purchase")
    purchase = interval_summary(
        _windows(spark, sf),
        _of_type(spark, sf, "purchase"),
        ["user_id"],
        "ts",
        "start_ts",
        "end_ts",
        {"window_purchase": F.min("ts")},
        key=["user_id"],
    )
    docs = load(spark, sf, "documents", [F.pmod("doc_id", F.lit(150)).alias("user_id"), "text"])
    noted = text_evidence(docs, ["user_id"], {"noted": occurs(F.col("text"), "[Ll]icen[cs]e")})
    joined = purchase.join(status, "user_id", "left").join(noted, "user_id", "left")
    return joined.select(
        "user_id",
        "error_first",
        "error_last",
        "error",
        "first_error",
        F.coalesce("noted", F.lit(0)).alias("noted"),
        F.when(F.col("error") == 1, F.col("window_purchase")).alias("window_purchase"),
    )


# --- doses ------------------------------------------------------------------------------------------------------


def dose_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem")
    status = F.col("l_linestatus")
    rules = [
        DoseRule(F.col("l_quantity"), status, "O", 24.8),
        DoseRule(F.col("l_discount"), status, "F", 0.05),
    ]
    amount = whole_units(normalise_unit(F.col("l_quantity"), F.col("l_returnflag"), {"A": 1000.0, "N": 1.0}))
    return (
        lines.filter(dose_predicate(rules))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", amount.alias("amount"))
        .filter(F.col("amount") > 0)
    )


def _dose_sources(spark: SparkSession, sf: str) -> list[DataFrame]:
    lines = load(spark, sf, "lineitem")
    price = whole_units(F.col("l_extendedprice")).alias("amount")
    kept = [
        (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 24.8),
        (F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "N") & (F.col("l_discount") > 0.05),
        in_band(F.col("l_extendedprice"), 1000.0, 20000.0, closed=False) & (F.col("l_tax") > 0.04),
    ]
    return [lines.filter(test).select("l_suppkey", "l_shipdate", price) for test in kept]


def two_source_sums(spark: SparkSession, sf: str) -> DataFrame:
    return union_of_sums(_dose_sources(spark, sf)[:2], ["l_suppkey", "l_shipdate"], "amount", "total")


def three_source_sums(spark: SparkSession, sf: str) -> DataFrame:
    return union_of_sums(_dose_sources(spark, sf), ["l_suppkey", "l_shipdate"], "amount", "total")


# --- id sets, counts and samples --------------------------------------------------------------------------------

def _criteria() -> list:
    return [
        ("finished", F.col("o_orderstatus") == "F"),
        ("large", F.col("o_totalprice") > 100000),
        ("urgent", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
        ("from 1997", F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")),
    ]


def attrition_table(spark: SparkSession, sf: str) -> DataFrame:
    return attrition(load(spark, sf, "orders"), "o_custkey", _criteria())


def separate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return attrition(load(spark, sf, "orders"), "o_custkey", _criteria(), cumulative=False)


def keyword_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return keyword_cohort(docs, "text", LICENCE, literal=False).select("doc_id", "lang", "source")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return text_evidence(
        load(spark, sf, "documents"),
        ["source", "lang"],
        {"has_rea": occurs(text, "[^E]rea"), "has_of_the": occurs(F.lower(text), "of.the")},
        F.lower(text).contains("the"),
    )


def _labels_frequency(spark: SparkSession, sf: str, ordered: bool) -> DataFrame:
    label = labelled(F.col("lang"), F.col("source"))
    docs = load(spark, sf, "documents", ["lang", "source"])
    return frequency(docs.filter(contains_ignore_case(label, "SRC1")), label, ordered=ordered)


def label_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _labels_frequency(spark, sf, ordered=True)


def label_report(spark: SparkSession, sf: str) -> DataFrame:
    return frequency_lines(_labels_frequency(spark, sf, ordered=False))


def label_total(spark: SparkSession, sf: str) -> DataFrame:
    return frequency_total(_labels_frequency(spark, sf, ordered=False))


def _good_ids(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "labels", ["doc_id"], where=F.col("quality") == 1)


def set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    hits = phrase_search(load(spark, sf, "documents"), "doc_id", "text", ["of the"], SLOP)
    licence = load(spark, sf, "documents").filter(contains_keyword(F.col("text"), LICENCE, literal=False))
    return overlap(
        {"quality": _good_ids(spark, sf), "phrase": hits.select("doc_id"), "licence": licence.select("doc_id")}
    )


def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return union_ids(id_set(_good_ids(spark, sf), "doc_id"), id_set(keyword_rows(spark, sf), "doc_id"))


def set_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return intersect_ids(id_set(_good_ids(spark, sf), "doc_id"), id_set(keyword_rows(spark, sf), "doc_id"))


def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    toxic = load(spark, sf, "labels", ["doc_id"], where=F.col("toxic") == 1)
    docs = load(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars"])
    return keep_matching(docs, toxic, ["doc_id"])


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return seeded_samples(load(spark, sf, "documents", ["doc_id", "lang"]), "doc_id", 5, SEEDS)


def sample_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return seeded_sample(load(spark, sf, "documents", ["doc_id", "lang"]), "doc_id", 3, SEED, by=["lang"])


def one_sample(spark: SparkSession, sf: str) -> DataFrame:
    return seeded_sample(load(spark, sf, "orders", ["o_orderkey", "o_custkey"]), "o_orderkey", 20, SEED)


def lookup(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    return first_match(orders, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()], F.col("o_custkey") == 7)


def ordinals(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders", ["o_orderkey", "o_orderstatus"])
    return with_ordinal(orders, "o_orderkey").filter(F.col("o_orderstatus") == "F")


def table_shape(spark: SparkSession, sf: str) -> DataFrame:
    return shape(load(spark, sf, "documents"))


# --- phrases ----------------------------------------------------------------------------------------------------


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_search(load(spark, sf, "documents"), "doc_id", "text", PHRASES, SLOP)


def _id_bounds(spark: SparkSession, sf: str) -> list[int]:
    return value_bounds(load(spark, sf, "documents", ["doc_id"]), "doc_id")


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    toks = tokenise(load(spark, sf, "documents"), "doc_id", "text", ["lang"])
    return toks.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.max("p").alias("last_position"), F.max("tok").alias("last_token")
    )


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf)


def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    member = severity_ids(_hits(spark, sf), catalogue_frame(spark, CATALOGUE), COHORTS)
    return member.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_docs"))


def severity_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return severity_cohorts(
        _hits(spark, sf), catalogue_frame(spark, CATALOGUE), docs, "doc_id", COHORTS, ["doc_id", "lang", "source"]
    )


def best_hits(spark: SparkSession, sf: str) -> DataFrame:
    return top_hits(_hits(spark, sf), 10).select("phrase", "rank", "doc_id", "score")


def peeks(spark: SparkSession, sf: str) -> DataFrame:
    return peek_hits(_hits(spark, sf), 11)


def hit_totals(spark: SparkSession, sf: str) -> DataFrame:
    return hit_summary(_hits(spark, sf), SEED)


def statistics(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_stats(_hits(spark, sf), catalogue_frame(spark, CATALOGUE), SEED)


def statistics_report(spark: SparkSession, sf: str) -> DataFrame:
    catalogue = catalogue_frame(spark, CATALOGUE)
    return report_lines(phrase_stats(_hits(spark, sf), catalogue, SEED), catalogue, TITLES)


def hits_json(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_json(_hits(spark, sf), catalogue_frame(spark, CATALOGUE), PART, _id_bounds(spark, sf))


# --- sinks ------------------------------------------------------------------------------------------------------


def sink_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Write ids as CSV, documents as parquet and a table, read each back and describe what came back.

    The folder is below the shared one and goes when the descriptions, one row per sink, are read.
    """
    docs = load(spark, sf, "documents", ["doc_id", "lang", "text"])
    base = scratch_folder(spark, "sinks")
    write_csv(docs, f"{base}/ids", ["doc_id", "lang"])
    export_documents(docs, f"{base}/documents", "doc_id", "text")
    back = {
        "csv": read_quoted_csv(spark, f"{base}/ids", "doc_id BIGINT, lang STRING").select("doc_id", F.length("lang")),
        "documents": spark.read.parquet(f"{base}/documents").select("doc_id", F.length("text")),
        "table": materialise(docs, f"{base}/table").select("doc_id", F.length("text")),
    }
    rows = None
    for name, df in back.items():
        described = df.toDF("doc_id", "size").agg(
            F.lit(name).alias("sink"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("doc_id").alias("n_ids"),
            F.max("doc_id").alias("last_id"),
            F.sum("size").alias("n_chars"),
        )
        rows = described if rows is None else rows.unionByName(described)
    return _read_and_removed(rows, base)


def _read_and_removed(described: DataFrame, folder: str) -> DataFrame:
    """The few rows of a description, read now; the folder they came from is removed."""
    spark = described.sparkSession
    result = spark.createDataFrame(described.collect(), described.schema)
    remove_folder(spark, folder)
    return result


def exported_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark items as one text file each, and the parquet form of the same, read back and described."""
    items = load(spark, sf, "benchmark", ["item_id", "text"])
    base = scratch_folder(spark, "texts")
    export_documents(items, f"{base}/files", "item_id", "text", one_file_each=True)
    export_documents(items, f"{base}/parquet", "item_id", "text")
    back = {
        "files": read_exported_texts(spark, f"{base}/files", "item_id"),
        "parquet": spark.read.parquet(f"{base}/parquet"),
    }
    described = [
        df.agg(
            F.lit(name).alias("sink"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("item_id").alias("n_ids"),
            F.sum(F.length("text")).alias("n_chars"),
        )
        for name, df in back.items()
    ]
    return _read_and_removed(described[0].unionByName(described[1]), base)


def path_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids read back from the paths that documents would be exported under."""
    docs = load(spark, sf, "documents", ["doc_id"])
    path = F.concat(F.lit("notes/of.2024/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", id_from_path(path).alias("path_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_encounter_index": encounter_rank,
    "q01_point_lookup": lookup,
    "q01_table_shape": table_shape,
    "q02_age_flag": ages,
    "q03_prefix_flags": prefix_flags,
    "q04_existence_flags": existence,
    "q05_flag_cascade": rule_cascade,
    "q06_update_from": update_from,
    "q07_last_wins_class": last_wins,
    "q08_elapsed_hours": elapsed_hours,
    "q08_group_counts": hours_profile,
    "q09_cohort_build": cohort,
    "q10_first_last_status": first_last,
    "q11_interval_join": interval_counts,
    "q11_interval_rows": interval_rows,
    "q66_sweep_counts": swept_counts,
    "q66_sweep_rows": swept_rows,
    "q66_sweep_sums": swept_sums,
    "q12_text_evidence": evidence,
    "q13_code_status": combined_status,
    "q14_dose_normalise": dose_rows,
    "q15_bolus_union": two_source_sums,
    "q15_bolus_union_three": three_source_sums,
    "q16_attrition": attrition_table,
    "q16_separate_counts": separate_counts,
    "q17_keyword_cohort": keyword_rows,
    "q18_frequency": label_frequency,
    "q18_frequency_lines": label_report,
    "q18_frequency_total": label_total,
    "q19_flagship": flagship,
    "q20_overlap": set_overlap,
    "q20_union": set_union,
    "q20_intersection": set_intersection,
    "q21_semi_join": semi_join,
    "q22_seeded_sample": samples,
    "q22_sample_per_group": sample_per_group,
    "q22_one_sample": one_sample,
    "q23_tokens": token_counts,
    "q24_phrase_search": hits,
    "q25_severity_cohorts": severity_counts,
    "q25_severity_rows": severity_rows,
    "q26_topk_hits": best_hits,
    "q26_peek_hits": peeks,
    "q27_hit_summary": hit_totals,
    "q27_phrase_stats": statistics,
    "q27_report_lines": statistics_report,
    "q28_phrase_json": hits_json,
    "q29_sink_round_trip": sink_round_trip,
    "q29_row_ordinal": ordinals,
    "q29_exported_texts": exported_texts,
    "q29_path_ids": path_ids,
}
