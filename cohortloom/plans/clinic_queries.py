"""The clinical plans run on the derived clinic tables (see ``clinic_tables``)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators.sets import id_set
from ..session import remove_folder, scratch_folder
from ..sources.files import read_quoted_csv, write_csv
from . import echo, note_cohorts, sepsis
from .clinic_tables import clinic


def _tables(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [clinic(spark, sf, name) for name in names]


def index(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.admissions_index(*_tables(spark, sf, "patients", "admissions", "icustays"))


def first_index(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.first_stays(*_tables(spark, sf, "patients", "admissions", "icustays"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.demographics(*_tables(spark, sf, "admissions", "patients"))


def flags(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.admission_flags(*_tables(spark, sf, "admissions", "diagnoses_icd", "procedures_icd"))


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        flags(spark, sf)
        .groupBy("chd", "chd_class")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("subject_id").alias("n_subjects"))
    )


def times(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.discharge_times(flags(spark, sf), first_index(spark, sf), clinic(spark, sf, "admissions"))


def _cohort(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.sepsis_cohort(flags(spark, sf), first_index(spark, sf), clinic(spark, sf, "admissions"))


def status(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.code_status(*_tables(spark, sf, "icustays", "chartevents", "noteevents"))


def status_by_note(spark: SparkSession, sf: str) -> DataFrame:
    tables = _tables(spark, sf, "icustays", "chartevents", "noteevents")
    return sepsis.code_status(*tables, use_note_flag=True)


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.with_exclusion_flags(_cohort(spark, sf), status(spark, sf), clinic(spark, sf, "diagnoses_icd"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.adult_counts(_cohort(spark, sf), people(spark, sf))


def crystalloids(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.crystalloid_bolus(*_tables(spark, sf, "inputevents_mv", "inputevents_cv"))


def colloids(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.colloid_bolus(*_tables(spark, sf, "inputevents_mv", "inputevents_cv", "chartevents"))


def note_types(spark: SparkSession, sf: str) -> DataFrame:
    return note_cohorts.admission_note_types(clinic(spark, sf, "noteevents"))


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    return note_cohorts.agreement(*_tables(spark, sf, "noteevents", "admissions", "external_list"))


def heart_failure_ids(spark: SparkSession, sf: str) -> DataFrame:
    return note_cohorts.heart_failure_ids(*_tables(spark, sf, "noteevents", "admissions"))


def diagnosis_ids(spark: SparkSession, sf: str) -> DataFrame:
    found = note_cohorts.heart_failure_admissions(clinic(spark, sf, "admissions"), fixed.HEART_FAILURE_KEYWORDS)
    return id_set(found, "hadm_id")


def sepsis_notes(spark: SparkSession, sf: str) -> DataFrame:
    notes, external = _tables(spark, sf, "noteevents", "external_list")
    return note_cohorts.sepsis_admission_notes(notes, external).select("row_id", "subject_id", "hadm_id")


def heart_failure_sepsis_notes(spark: SparkSession, sf: str) -> DataFrame:
    notes, external = _tables(spark, sf, "noteevents", "external_list")
    return note_cohorts.heart_failure_sepsis_notes(notes, external).select("row_id", "subject_id", "hadm_id")


def _echo(spark: SparkSession, sf: str) -> echo.EchoResult:
    return echo.echo_severity(clinic(spark, sf, "noteevents"))


def echo_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _echo(spark, sf).hits


def echo_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _echo(spark, sf).stats


def echo_report(spark: SparkSession, sf: str) -> DataFrame:
    return _echo(spark, sf).report


def echo_json(spark: SparkSession, sf: str) -> DataFrame:
    return _echo(spark, sf).json()


def echo_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return _echo(spark, sf).cohorts


def adult_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.adult_rows(index(spark, sf), people(spark, sf))


def sepsis_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.sepsis_counts(flags(spark, sf))


def sepsis_rows_per_subject(spark: SparkSession, sf: str) -> DataFrame:
    return sepsis.sepsis_rows_per_subject(flags(spark, sf))


def note_exports(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the four exports under common names; ``number`` is the id or the ordinal."""
    exports = note_cohorts.note_exports(*_tables(spark, sf, "noteevents", "external_list"))
    parts = [df.toDF("number", "subject_id", "hadm_id").withColumn("cohort", F.lit(name)) for name, df in exports.items()]
    return reduce(DataFrame.unionByName, parts)


def echo_exports(spark: SparkSession, sf: str) -> DataFrame:
    return echo.cohort_exports(_echo(spark, sf), clinic(spark, sf, "noteevents"))


def external_list(spark: SparkSession, sf: str) -> DataFrame:
    """The external list written as CSV with quoted names, read back and counted; the file goes afterwards."""
    path = scratch_folder(spark, "external-list")
    quoted = clinic(spark, sf, "external_list").toDF("'hadm_id'", "'angus'")
    write_csv(quoted, path, [f"`{name}`" for name in quoted.columns])
    counted = note_cohorts.external_counts(read_quoted_csv(spark, path, "hadm_id BIGINT, angus INT"))
    rows = counted.collect()  # one row
    remove_folder(spark, path)
    return spark.createDataFrame(rows, counted.schema)


def admission_note_counts(spark: SparkSession, sf: str) -> DataFrame:
    return note_cohorts.admission_note_counts(*_tables(spark, sf, "noteevents", "external_list"))


def note_samples(spark: SparkSession, sf: str) -> DataFrame:
    return note_cohorts.heart_failure_samples(clinic(spark, sf, "noteevents"))


PROBE = "The left ventricular cavity is severely dilated"


def phrase_probe(spark: SparkSession, sf: str) -> DataFrame:
    return echo.probe_phrase(clinic(spark, sf, "noteevents"), PROBE)


def renal_rows(spark: SparkSession, sf: str) -> DataFrame:
    return cohort(spark, sf).filter(F.col("flag_esrt") == 1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q30_clinic_index": index,
    "q31_clinic_ages": people,
    "q32_clinic_flags": flags,
    "q33_clinic_class_counts": class_counts,
    "q34_clinic_discharge_times": times,
    "q35_clinic_cohort": cohort,
    "q36_clinic_attrition": counts,
    "q37_clinic_code_status": status,
    "q37_clinic_code_status_by_note": status_by_note,
    "q38_clinic_crystalloids": crystalloids,
    "q39_clinic_colloids": colloids,
    "q40_clinic_note_types": note_types,
    "q41_clinic_agreement": agreement,
    "q42_clinic_heart_failure_ids": heart_failure_ids,
    "q42_clinic_diagnosis_ids": diagnosis_ids,
    "q43_clinic_sepsis_notes": sepsis_notes,
    "q43_clinic_heart_failure_sepsis_notes": heart_failure_sepsis_notes,
    "q44_clinic_echo_hits": echo_hits,
    "q45_clinic_echo_stats": echo_stats,
    "q46_clinic_echo_report": echo_report,
    "q47_clinic_echo_json": echo_json,
    "q48_clinic_echo_cohorts": echo_cohorts,
    "q49_clinic_adult_rows": adult_rows,
    "q50_clinic_sepsis_counts": sepsis_counts,
    "q50_clinic_sepsis_per_subject": sepsis_rows_per_subject,
    "q51_clinic_note_exports": note_exports,
    "q51_clinic_echo_exports": echo_exports,
    "q52_clinic_external_list": external_list,
    "q53_clinic_admission_notes": admission_note_counts,
    "q54_clinic_note_samples": note_samples,
    "q55_clinic_phrase_probe": phrase_probe,
    "q56_clinic_renal_rows": renal_rows,
}
