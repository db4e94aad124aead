"""Cohorts from admission notes: keyword search, id sets and their overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import contains_ignore_case, contains_keyword, labelled
from ..operators.joins import flag_exists, keep_matching
from ..operators.notes import frequency, keyword_cohort
from ..operators.ranking import seeded_samples, with_ordinal
from ..operators.sets import id_set, overlap, union_ids
from ..sources.files import write_csv


def admission_note_types(noteevents: DataFrame) -> DataFrame:
    """(label, n): category and description of notes that look like admission notes."""
    label = labelled(F.col("category"), F.col("description"))
    return frequency(noteevents.filter(contains_ignore_case(label, "admission")), label)


def admission_notes(noteevents: DataFrame) -> DataFrame:
    return noteevents.filter(F.col("description") == fixed.ADMISSION_NOTE_DESCRIPTION)


def heart_failure_notes(noteevents: DataFrame) -> DataFrame:
    return keyword_cohort(admission_notes(noteevents), "text", fixed.HEART_FAILURE_KEYWORDS)


def heart_failure_admissions(admissions: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Admissions whose free-text diagnosis holds a keyword; by default the single leading phrase."""
    return admissions.filter(contains_keyword(F.col("diagnosis"), keywords or fixed.HEART_FAILURE_DIAGNOSIS))


def heart_failure_ids(noteevents: DataFrame, admissions: DataFrame) -> DataFrame:
    """Admission ids found by notes or by diagnosis."""
    return union_ids(
        id_set(heart_failure_notes(noteevents), "hadm_id"), id_set(heart_failure_admissions(admissions), "hadm_id")
    )


def sepsis_ids(external: DataFrame) -> DataFrame:
    """Admission ids an external list marks as severe sepsis."""
    return id_set(external.filter(F.col("angus") == 1), "hadm_id", "hadm_id")


def agreement_sets(noteevents: DataFrame, admissions: DataFrame, external: DataFrame) -> dict[str, DataFrame]:
    """The admissions found by notes, diagnosis and the external list."""
    return {
        "note_hf": heart_failure_notes(noteevents).select("hadm_id"),
        "diagnosis_hf": heart_failure_admissions(admissions).select("hadm_id"),
        "sepsis": external.filter(F.col("angus") == 1).select("hadm_id"),
        "admission_note": admission_notes(noteevents).select("hadm_id"),
    }


def agreement(noteevents: DataFrame, admissions: DataFrame, external: DataFrame) -> DataFrame:
    """Sizes of the id sets found by notes, diagnosis and the external list, and of their pairs."""
    return overlap(agreement_sets(noteevents, admissions, external))


def sepsis_admission_notes(noteevents: DataFrame, external: DataFrame) -> DataFrame:
    return keep_matching(admission_notes(noteevents), sepsis_ids(external), ["hadm_id"])


def heart_failure_sepsis_notes(noteevents: DataFrame, external: DataFrame) -> DataFrame:
    return keep_matching(heart_failure_notes(noteevents), sepsis_ids(external), ["hadm_id"])


def admission_note_counts(noteevents: DataFrame, external: DataFrame) -> DataFrame:
    """(n_notes, n_admissions, n_subjects, n_sepsis_admissions) of the admission notes."""
    notes = admission_notes(noteevents).select("subject_id", "hadm_id")
    flagged = flag_exists(notes, sepsis_ids(external), ["hadm_id"], "_sepsis")
    sepsis = F.when(F.col("_sepsis") == 1, F.col("hadm_id"))
    return flagged.agg(
        F.count(F.lit(1)).alias("n_notes"),
        F.count_distinct("hadm_id").alias("n_admissions"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count_distinct(sepsis).alias("n_sepsis_admissions"),
    )


def external_counts(external: DataFrame) -> DataFrame:
    """(n_ids, n_flagged): distinct admissions of the external list, and of its rows marked as severe sepsis."""
    flagged = F.when(F.col("angus") == 1, F.col("hadm_id"))
    return external.agg(F.count_distinct("hadm_id").alias("n_ids"), F.count_distinct(flagged).alias("n_flagged"))


def heart_failure_samples(noteevents: DataFrame) -> DataFrame:
    """(seed, row_id, hadm_id): one heart-failure note for each published seed, to be read by a person."""
    notes = heart_failure_notes(noteevents).select("row_id", "hadm_id")
    return seeded_samples(notes, "row_id", 1, fixed.SAMPLE_SEEDS).select("seed", "row_id", "hadm_id")


def numbered(noteevents: DataFrame) -> DataFrame:
    """(row_id, subject_id, hadm_id, ordinal): the place of every note in the whole table, from 0."""
    return with_ordinal(noteevents.select(*EXPORTED), "row_id")


EXPORTED = ["row_id", "subject_id", "hadm_id"]


def note_exports(noteevents: DataFrame, external: DataFrame) -> dict[str, DataFrame]:
    """The four note cohorts as they are exported; the heart-failure notes carry their ordinal instead of their id."""
    found = heart_failure_notes(noteevents).select("row_id")
    return {
        "admission": admission_notes(noteevents).select(*EXPORTED),
        "heart_failure": keep_matching(numbered(noteevents), found, ["row_id"]).select("ordinal", "subject_id", "hadm_id"),
        "sepsis": sepsis_admission_notes(noteevents, external).select(*EXPORTED),
        "heart_failure_sepsis": heart_failure_sepsis_notes(noteevents, external).select(*EXPORTED),
    }


def write_exports(exports: dict[str, DataFrame], path: str) -> None:
    """Each cohort as CSV below its name."""
    for name, df in exports.items():
        write_csv(df, f"{path}/{name}", df.columns)
