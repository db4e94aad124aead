"""Queries on tables that the library stores first: positions, bitmaps, keyed updates, versions.

Each stores what it derives from the whole supplied tables in the shared folder and answers from there. Their SQL is
that of the plain form wherever there is one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import contains_keyword
from ..operators.automaton import automaton_cohort, clued_patterns
from ..operators.bitmaps import (
    bitmap_attrition,
    cohort_bitmaps,
    intersection_bits,
    members,
    overlap_of_bitmaps,
    store_cohorts,
    union_bits,
)
from ..operators.phrases import phrase_search, ranked_hits
from ..operators.positions import add_batch, stored_phrase_search
from ..operators.ranking import value_bounds
from ..operators.relevance import relevance
from ..operators.sets import id_set, union_ids
from ..session import scratch_folder
from ..sources.inferred import read_inferred_csv
from ..sources.layout import SearchPath, point_read, write_clustered
from ..sources.tables import load, save_table
from ..sources.updates import read_keyed, update_keyed, write_keyed
from ..sources.versions import VersionedTables
from . import clinic_oracles, note_cohorts, sepsis, table_oracles
from . import table_queries as t
from .clinic_queries import _cohort, _tables, people


def stored_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches that make up the whole table, the later ids added to the earlier ones' positions."""
    docs = load(spark, sf, "documents", ["doc_id", "text"])
    path = scratch_folder(spark, "positions")
    middle = docs.agg(F.floor((F.min("doc_id") + F.max("doc_id")) / 2)).first()[0] or 0
    add_batch(docs.filter(F.col("doc_id") <= middle), path, "1")
    add_batch(docs.filter(F.col("doc_id") > middle), path, "2")
    return stored_phrase_search(spark, path, t.PHRASES, t.SLOP)


def _cohorts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    docs = load(spark, sf, "documents", ["doc_id", "text"])
    return {
        "quality": load(spark, sf, "labels", ["doc_id"], where=F.col("quality") == 1),
        "phrase": phrase_search(docs, "doc_id", "text", ["of the"], t.SLOP).select("doc_id"),
        "licence": docs.filter(contains_keyword(F.col("text"), t.LICENCE, literal=False)).select("doc_id"),
    }


def bitmap_overlap(spark: SparkSession, sf: str) -> DataFrame:
    stored = store_cohorts(_cohorts(spark, sf), scratch_folder(spark, "cohort-bitmaps"))
    return overlap_of_bitmaps(stored, ["quality", "phrase", "licence"])


def _two(spark: SparkSession, sf: str) -> DataFrame:
    cohorts = _cohorts(spark, sf)
    return cohort_bitmaps({name: cohorts[name] for name in ("quality", "licence")})


def bitmap_union(spark: SparkSession, sf: str) -> DataFrame:
    return members(union_bits(_two(spark, sf), ["quality", "licence"]))


def bitmap_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return members(intersection_bits(_two(spark, sf), ["quality", "licence"]))


def bitmap_table(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap_attrition(load(spark, sf, "orders"), "o_custkey", t._criteria())


def bitmap_separate(spark: SparkSession, sf: str) -> DataFrame:
    return bitmap_attrition(load(spark, sf, "orders"), "o_custkey", t._criteria(), cumulative=False)


def bitmap_agreement(spark: SparkSession, sf: str) -> DataFrame:
    sets = note_cohorts.agreement_sets(*_tables(spark, sf, "noteevents", "admissions", "external_list"))
    return overlap_of_bitmaps(store_cohorts(sets, scratch_folder(spark, "agreement-bitmaps")), list(sets))


def bitmap_clinic_attrition(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.adult_counts(_cohort(spark, sf), people(spark, sf), count=bitmap_attrition)


def stored_update(spark: SparkSession, sf: str) -> DataFrame:
    """The orders are stored unflagged; the lines then set the flag of theirs."""
    path = scratch_folder(spark, "keyed-orders")
    write_keyed(load(spark, sf, "orders").withColumn("flagged", F.lit(0)), path, ["o_orderkey"])
    lines = load(spark, sf, "lineitem", ["l_orderkey"], where=(F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))
    update_keyed(spark, path, lines.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("flagged")), ["o_orderkey"])
    return read_keyed(spark, path)


def stored_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Every line sets the class of its order; of several the one with the highest class number is the last."""
    path = scratch_folder(spark, "keyed-classes")
    orders = load(spark, sf, "orders", ["o_orderkey"]).withColumn("line_class", F.lit(None).cast("string"))
    write_keyed(orders, path, ["o_orderkey"])
    labels = list(t.LINE_CLASSES)
    number = F.lit(None).cast("int")
    for i, codes in enumerate(t.LINE_CLASSES.values()):
        number = F.when(F.col("l_returnflag").isin(codes), i).otherwise(number)
    lines = load(spark, sf, "lineitem", ["l_orderkey", "l_returnflag"]).select(F.col("l_orderkey").alias("o_orderkey"), number.alias("place"))
    label = F.get(F.array(*[F.lit(name) for name in labels]), "place")
    changes = lines.filter("place IS NOT NULL").withColumn("line_class", label)
    update_keyed(spark, path, changes, ["o_orderkey"], order=["place"])
    return read_keyed(spark, path)


def rebuilt_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table, a table of it and a table of that; the first is then rebuilt from itself and the others follow."""
    tables = VersionedTables(spark, scratch_folder(spark, "versions"))
    tables.write("orders", load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]))
    tables.define(
        "large", lambda at: at.read("orders").filter("o_totalprice > 100000"), uses=["orders"]
    )
    tables.define(
        "per_status",
        lambda at: at.read("large").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers")),
        uses=["large"],
    )
    tables.rebuild("large")
    tables.define("orders", lambda at: at.read("orders").filter("o_custkey % 3 <> 0"), uses=["orders"])
    tables.rebuild("orders")
    return tables.read("per_status")


def inferred_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The orders as CSV text with gaps and whole numbers spelled as floats, read back without naming a type."""
    path = scratch_folder(spark, "inferred-csv")
    orders = load(spark, sf, "orders")
    gap = F.col("o_orderkey") % 5 == 0
    text = orders.select(
        F.col("o_orderkey").cast("string").alias("order_key"),
        F.when(~gap, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("customer"),
        F.when(~gap, F.col("o_totalprice").cast("string")).alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ordered"),
        F.concat(F.col("o_orderstatus"), F.lit(", status")).alias("status"),
        F.when(gap, F.lit("7")).otherwise(F.lit("x")).alias("mixed"),
    )
    text.write.option("header", "true").csv(path)
    back = read_inferred_csv(spark, path)
    kinds = [F.lit(f"{name}:{kind}") for name, kind in back.dtypes]
    return back.withColumn("kinds", F.concat_ws(" ", *kinds))


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of one order in a hundred thousand, read from a layout clustered by order."""
    path = scratch_folder(spark, "clustered-lines")
    lines = load(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    write_clustered(lines, path, ["l_orderkey", "l_linenumber"], bloom=["l_partkey"])
    return point_read(spark, path, "l_orderkey", [1, 2, 3, 1000])


def searched_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two databases that share a name: the first of the path that has it answers."""
    mark = uuid.uuid4().hex[:12]
    first, second = f"derived_{mark}", f"base_{mark}"
    for name in (first, second):
        spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_folder(spark, name)}'")
    orders = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    save_table(orders, f"{second}.orders")
    save_table(load(spark, sf, "customer", ["c_custkey", "c_nationkey"]), f"{second}.customer")
    save_table(orders.filter("o_orderstatus = 'F'"), f"{first}.orders")
    path = SearchPath(spark, [first, second])
    joined = path.table("orders").join(path.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_orders"))


def automaton_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", ["doc_id", "lang", "source", "text"])
    return clued_patterns(docs, "text", {"licen[cs]e": ["licen"], "copyright": ["copyright"]}).drop("text")


def automaton_heart_failure(spark: SparkSession, sf: str) -> DataFrame:
    notes, admissions = _tables(spark, sf, "noteevents", "admissions")
    by_note = automaton_cohort(note_cohorts.admission_notes(notes), "text", fixed.HEART_FAILURE_KEYWORDS)
    by_diagnosis = automaton_cohort(admissions, "diagnosis", fixed.HEART_FAILURE_DIAGNOSIS)
    return union_ids(id_set(by_note, "hadm_id"), id_set(by_diagnosis, "hadm_id"))


def relevant_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Every hit with its weight from the corpus and its place in the phrase's order."""
    docs = load(spark, sf, "documents", ["doc_id", "text"])
    hits = phrase_search(docs, "doc_id", "text", t.PHRASES, t.SLOP)
    weighed = relevance(hits, docs, "doc_id", "text", t.PHRASES)
    return ranked_hits(weighed, value_bounds(docs, "doc_id")).select("phrase", "doc_id", "score", "rank", "n_docs")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q57_stored_hits": stored_hits,
    "q58_bitmap_overlap": bitmap_overlap,
    "q58_bitmap_union": bitmap_union,
    "q58_bitmap_intersection": bitmap_intersection,
    "q58_bitmap_attrition": bitmap_table,
    "q58_bitmap_counts": bitmap_separate,
    "q58_bitmap_agreement": bitmap_agreement,
    "q58_bitmap_clinic_attrition": bitmap_clinic_attrition,
    "q59_stored_update": stored_update,
    "q59_stored_last_wins": stored_last_wins,
    "q60_rebuilt_tables": rebuilt_tables,
    "q61_inferred_csv": inferred_csv,
    "q62_searched_tables": searched_tables,
    "q63_point_lookup": point_lookup,
    "q64_automaton_cohort": automaton_rows,
    "q64_automaton_heart_failure": automaton_heart_failure,
    "q65_relevant_hits": relevant_hits,
}


def oracles() -> dict[str, str]:
    plain = table_oracles.oracles() | clinic_oracles.oracles()
    return {
        "q57_stored_hits": plain["q24_phrase_search"],
        "q58_bitmap_overlap": plain["q20_overlap"],
        "q58_bitmap_union": plain["q20_union"],
        "q58_bitmap_intersection": plain["q20_intersection"],
        "q58_bitmap_attrition": plain["q16_attrition"],
        "q58_bitmap_counts": plain["q16_separate_counts"],
        "q58_bitmap_agreement": plain["q41_clinic_agreement"],
        "q58_bitmap_clinic_attrition": plain["q36_clinic_attrition"],
        "q59_stored_update": plain["q06_update_from"],
        "q59_stored_last_wins": plain["q07_last_wins_class"],
        "q60_rebuilt_tables": """
            SELECT o_orderstatus, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
            FROM orders WHERE o_totalprice > 100000 AND o_custkey % 3 <> 0 GROUP BY o_orderstatus""",
        "q61_inferred_csv": """
            SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS customer,
                   CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, date_trunc('second', o_orderdate)::TIMESTAMP AS ordered,
                   o_orderstatus || ', status' AS status, CASE WHEN o_orderkey % 5 = 0 THEN '7' ELSE 'x' END AS mixed,
                   'order_key:bigint customer:bigint price:double ordered:timestamp_ntz status:string mixed:string' AS kinds
            FROM orders""",
        "q62_searched_tables": """
            SELECT c_nationkey, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey
            WHERE o_orderstatus = 'F' GROUP BY c_nationkey""",
        "q63_point_lookup": """
            SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (1, 2, 3, 1000)""",
        "q64_automaton_cohort": plain["q17_keyword_cohort"],
        "q64_automaton_heart_failure": plain["q42_clinic_heart_failure_ids"],
        "q65_relevant_hits": f"""
            WITH {table_oracles.hits_ctes("SELECT doc_id, text FROM documents", t.PHRASES, t.SLOP)},
            sizes AS (SELECT doc_id, coalesce(len(toks), 0) AS length FROM doc_toks),
            corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM sizes),
            found AS (SELECT tok, count(DISTINCT doc_id) AS df FROM places GROUP BY tok),
            rarity AS (
                SELECT phrase, sum(ln(1 + (corpus.n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) AS weight
                FROM needed CROSS JOIN corpus LEFT JOIN found USING (tok) GROUP BY phrase),
            weighed AS (
                SELECT phrase, doc_id,
                  round(weight * score / (score + 1.2 * (0.25 + 0.75 * length / mean)), 9) AS score
                FROM hits JOIN rarity USING (phrase) JOIN sizes USING (doc_id) CROSS JOIN corpus)
            SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, doc_id) AS rank,
              count(*) OVER (PARTITION BY phrase) AS n_docs FROM weighed""",
    }
