"""Sepsis and heart-failure cohort: index, flags, cohort, code status, renal flag and fluid boluses.

Input frames carry the columns named in the functions; all timestamps are without a zone. Every function returns a
lazy frame; only ``sepsis_cohort`` is worth materialising, because the enrichment and the counts read it again.
"""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.codes import cascade, has_prefix, value_flags
from ..functions.dosing import DoseRule, dose_predicate, in_band, normalise_unit, whole_units
from ..functions.temporal import whole_hours
from ..functions.text import occurs
from ..operators.dosing import union_of_sums
from ..operators.encounters import age_flags, build_cohort, encounter_index, first_encounters
from ..operators.joins import (
    classify_last_wins,
    existence_flags,
    flag_exists,
    group_for_join,
    interval_summary,
    lookup_join,
)
from ..operators.notes import text_evidence
from ..operators.sets import attrition
from ..operators.status import first_last_status

ADMISSION = ["subject_id", "hadm_id"]
SHORT_STAY_HOURS = 24 * 60  # thresholds as published: hours compared with 1440 and 2880
LONG_STAY_HOURS = 48 * 60


def admissions_index(patients: DataFrame, admissions: DataFrame, icustays: DataFrame) -> DataFrame:
    return encounter_index(patients, admissions, icustays, "subject_id", "hadm_id", "icustay_id")


def first_stays(patients: DataFrame, admissions: DataFrame, icustays: DataFrame) -> DataFrame:
    """The rows of the index with number 1 that belong to an admission."""
    return first_encounters(patients, admissions, icustays, "subject_id", "hadm_id", "icustay_id")


def adult_rows(index: DataFrame, people: DataFrame) -> DataFrame:
    """(n_rows): rows of the admissions index whose admission is of an adult."""
    adults = people.filter(F.col("age_flag") == 1).select(*ADMISSION)
    return lookup_join(index, adults, ADMISSION).agg(F.count(F.lit(1)).alias("n_rows"))


def sepsis_counts(flags: DataFrame) -> DataFrame:
    """(n_rows, n_subjects) of the admissions with severe sepsis."""
    rows = flags.filter(F.col("angus") == 1)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("subject_id").alias("n_subjects"))


def sepsis_rows_per_subject(flags: DataFrame) -> DataFrame:
    """(subject_id, n) of the admissions with severe sepsis."""
    return flags.filter(F.col("angus") == 1).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


def demographics(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    return age_flags(
        admissions.select("subject_id", "hadm_id", "admittime"),
        patients,
        "subject_id",
        "dob",
        "admittime",
        keep=["dod", "dod_hosp", "dod_ssn", "expire_flag"],
    )


def sepsis_flags(admissions: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """Component flags per admission (matched on the admission id alone) and the severe-sepsis flag ``angus``."""
    code = F.col("icd9_code")
    flagged = existence_flags(
        admissions.select(*ADMISSION),
        diagnoses,
        ["hadm_id"],
        {
            "infection": has_prefix(code, fixed.INFECTION),
            "explicit_sepsis": has_prefix(code, fixed.EXPLICIT_SEPSIS),
            "organ_dysfunction": has_prefix(code, fixed.ORGAN_DYSFUNCTION),
        },
    )
    flagged = existence_flags(
        flagged, procedures, ["hadm_id"], {"mech_vent": has_prefix(code, fixed.MECHANICAL_VENTILATION)}
    )
    return flagged.withColumn("angus", _angus())


def _angus() -> Column:
    """Severe sepsis: named as such, or an infection with organ dysfunction or mechanical ventilation."""
    infection = F.col("infection") == 1
    return cascade(
        [
            (F.col("explicit_sepsis") == 1, 1),
            (infection & (F.col("organ_dysfunction") == 1), 1),
            (infection & (F.col("mech_vent") == 1), 1),
        ]
    )


def with_heart_failure(flags: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Add ``chd`` and ``chd_class``, matched on subject and admission."""
    return classify_last_wins(
        flags,
        diagnoses,
        ADMISSION,
        "icd9_code",
        fixed.HEART_FAILURE_CLASSES,
        "chd_class",
        flags={"chd": F.col("icd9_code").isin(fixed.HEART_FAILURE)},
    )


def admission_flags(admissions: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """``with_heart_failure(sepsis_flags(...))`` from one read of the diagnoses.

    All tests of a code become bits of one number, which is combined per subject and admission. The heart-failure bits
    are looked up by both, the sepsis bits by the admission alone; both lookups read the same shuffled rows.
    """
    code = F.col("icd9_code")
    classes = list(fixed.HEART_FAILURE_CLASSES.items())
    tests = [
        has_prefix(code, fixed.INFECTION),
        has_prefix(code, fixed.EXPLICIT_SEPSIS),
        has_prefix(code, fixed.ORGAN_DYSFUNCTION),
        code.isin(fixed.HEART_FAILURE),
        *[code.isin(list(codes)) for _, codes in classes],
    ]
    marks = reduce(add, [F.when(test, 1 << bit).otherwise(0) for bit, test in enumerate(tests)])
    rows = diagnoses.select(*ADMISSION, marks.alias("_marks")).filter(F.col("_marks") > 0)
    pairs = group_for_join(rows, ADMISSION).agg(F.bit_or("_marks").alias("_marks")).drop("_spread")
    own = pairs.withColumnRenamed("_marks", "_own")
    shared = group_for_join(pairs, ["hadm_id"]).agg(F.bit_or("_marks").alias("_shared")).drop("_spread")

    base = existence_flags(
        admissions.select(*ADMISSION),
        procedures,
        ["hadm_id"],
        {"mech_vent": has_prefix(code, fixed.MECHANICAL_VENTILATION)},
    )
    joined = base.join(own, ADMISSION, "left").join(shared, "hadm_id", "left")

    def bit(name: str, number: int) -> Column:
        return F.when(F.getbit(F.col(name), F.lit(number)) == 1, 1).otherwise(0)

    label = F.lit(None).cast("string")
    for i, (name, _) in enumerate(classes):
        label = F.when(bit("_own", 4 + i) == 1, F.lit(name)).otherwise(label)
    flagged = joined.select(
        *ADMISSION,
        bit("_shared", 0).alias("infection"),
        bit("_shared", 1).alias("explicit_sepsis"),
        bit("_shared", 2).alias("organ_dysfunction"),
        "mech_vent",
        bit("_own", 3).alias("chd"),
        label.alias("chd_class"),
    )
    return flagged.select(
        *ADMISSION, "infection", "explicit_sepsis", "organ_dysfunction", "mech_vent", _angus().alias("angus"), "chd",
        "chd_class",
    )


def _durations(df: DataFrame) -> DataFrame:
    return df.withColumn("timeadtodischarge", whole_hours(F.col("admittime"), F.col("dischtime"))).withColumn(
        "timeadtodeath", whole_hours(F.col("admittime"), F.col("deathtime"))
    )


def discharge_times(flags: DataFrame, index: DataFrame, admissions: DataFrame) -> DataFrame:
    """First encounters with the heart-failure columns and whole hours to discharge and death."""
    joined = build_cohort(
        index,
        flags.select(*ADMISSION, "chd", "chd_class"),
        admissions.select(*ADMISSION, "admittime", "dischtime", "deathtime"),
        ADMISSION,
        F.lit(True),
    )
    return _durations(joined).select(
        *ADMISSION, "icustay_id", "ind", "admittime", "dischtime", "chd", "chd_class", "timeadtodischarge",
        "timeadtodeath",
    )


def sepsis_cohort(flags: DataFrame, index: DataFrame, admissions: DataFrame) -> DataFrame:
    """First encounters of admissions with severe sepsis, with the flags, the admission and the durations."""
    return _durations(build_cohort(index, flags, admissions, ADMISSION, F.col("angus") == 1))


def _status_rows(chartevents: DataFrame) -> DataFrame:
    kept = (
        F.col("itemid").isin(fixed.CODE_STATUS_ITEMS)
        & F.col("value").isNotNull()
        & (F.col("value") != fixed.CODE_STATUS_IGNORED_VALUE)
        & ~F.col("error").eqNullSafe(1)
    )
    return chartevents.filter(kept)


def code_status(
    icustays: DataFrame, chartevents: DataFrame, noteevents: DataFrame, use_note_flag: bool = False
) -> DataFrame:
    """First, last and ever code status per stay, with note evidence and first times.

    Charts, nursing notes and discharge summaries are each reduced to one row per stay or admission before they are
    joined, so no chart row ever meets a note row. By default any nursing note that mentions comfort measures gives
    the note time; with ``use_note_flag`` only notes that meet a pattern do.
    """
    flags = value_flags(F.col("value"), fixed.CODE_STATUS_VALUES)
    charts = first_last_status(
        _status_rows(chartevents),
        ["icustay_id"],
        "charttime",
        ["value"],
        flags,
        {"dnr": "timednr_chart", "cmo": "timecmo_chart"},
    )
    text = F.col("text")
    discharge = text_evidence(
        noteevents.filter(F.col("category").isin(fixed.DISCHARGE_CATEGORIES)),
        ["hadm_id"],
        {"cmo_ds": occurs(text, fixed.DISCHARGE_CMO_PATTERN)},
        text.contains(fixed.DISCHARGE_CMO_PREFILTER),
    )
    mentions = nursing_mentions(noteevents, flagged_only=use_note_flag)
    # One row per stay and arrival; its windows may differ in their end, and the earliest note of any of them counts.
    stay = [*ADMISSION, "icustay_id", "intime"]
    windows = icustays.select(*stay, "outtime").distinct()
    notes = interval_summary(
        windows, mentions, ["hadm_id"], "charttime", "intime", "outtime", {"_note_time": F.min("charttime")}
    )
    timed = notes.groupBy(*stay).agg(F.min("_note_time").alias("_note_time"))
    joined = timed.join(charts, "icustay_id", "left").join(discharge, "hadm_id", "left")
    names = list(fixed.CODE_STATUS_VALUES)
    return joined.select(
        *ADMISSION,
        "icustay_id",
        *[f"{name}_first" for name in names],
        *[f"{name}_last" for name in names],
        *names,
        F.coalesce("cmo_ds", F.lit(0)).alias("cmo_ds"),
        "timednr_chart",
        "timecmo_chart",
        F.when(F.col("cmo") == 1, F.col("_note_time")).alias("timecmo_nursingnote"),
    )


def nursing_mentions(noteevents: DataFrame, flagged_only: bool = False) -> DataFrame:
    """(hadm_id, charttime, cmo): nursing and physician notes that mention comfort measures.

    ``flagged_only`` leaves those with ``cmo`` 1. The patterns are then a filter, which runs where the notes are read: no
    text goes through a join that the notes come from.
    """
    text = F.col("text")
    lowered = F.lower(text)
    pattern = F.lit(False)
    for expression in fixed.NURSING_CMO_PATTERNS:
        pattern = pattern | occurs(text, expression)
    for expression in fixed.NURSING_CMO_LOWERED_PATTERNS:
        pattern = pattern | occurs(lowered, expression)
    prefilter = lowered.contains(fixed.NURSING_CMO_PREFILTER)
    return text_evidence(
        noteevents.filter(F.col("category").isin(fixed.NURSING_CATEGORIES)),
        ["hadm_id", "charttime"],
        {"cmo": F.lit(True) if flagged_only else pattern},
        prefilter & pattern if flagged_only else prefilter,
    )


def with_exclusion_flags(cohort: DataFrame, status: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Add ``flag_dnidnr`` (limits on resuscitation) and ``flag_esrt`` (end-stage renal disease), per admission."""
    limited = F.lit(False)
    for name in ["dnr", "dnr_first", "dnr_last", "dni", "dni_first", "dni_last", "dncpr_first", "dncpr_last"]:
        limited = limited | (F.col(name) == 1)
    flagged = flag_exists(cohort, status.filter(limited), ADMISSION, "flag_dnidnr")
    renal = diagnoses.filter(F.col("icd9_code").isin(fixed.END_STAGE_RENAL))
    return flag_exists(flagged, renal, ADMISSION, "flag_esrt")


def adult_counts(cohort: DataFrame, people: DataFrame, count: Callable[..., DataFrame] = attrition) -> DataFrame:
    """Attrition of the sepsis and heart-failure cohort: flags, then adult, then the longest stay allowed."""
    joined = cohort.join(people.select(*ADMISSION, "age_flag"), ADMISSION, "left")
    return count(
        joined,
        "subject_id",
        [
            ("severe sepsis", F.col("angus") == 1),
            ("heart failure", F.col("chd") == 1),
            ("adult", F.col("age_flag") == 1),
            ("within 2880 hours", F.col("timeadtodischarge") <= LONG_STAY_HOURS),
            ("within 1440 hours", F.col("timeadtodischarge") <= SHORT_STAY_HOURS),
        ],
    )


def _infusions(mv: DataFrame, items: list[int], rules: list[DoseRule], above: float) -> DataFrame:
    amount = whole_units(normalise_unit(F.col("amount"), F.col("amountuom"), fixed.MILLILITRES_PER_UNIT))
    chosen = F.col("itemid").isin(items) & (F.col("statusdescription") != fixed.REWRITTEN_STATUS)
    return (
        mv.filter(chosen & dose_predicate(rules))
        .select("icustay_id", F.col("starttime").alias("charttime"), amount.alias("amount"))
        .filter(F.col("amount") > above)
    )


def _charted(df: DataFrame, items: list[int], amount: str, above: float, closed: bool) -> DataFrame:
    kept = F.col("itemid").isin(items) & in_band(F.col(amount), above, fixed.BOLUS_UPPER_ML, closed)
    return df.filter(kept).select("icustay_id", "charttime", whole_units(F.col(amount)).alias("amount"))


def crystalloid_bolus(inputevents_mv: DataFrame, inputevents_cv: DataFrame) -> DataFrame:
    above = fixed.CRYSTALLOID_ABOVE_ML
    rate, rate_unit = F.col("rate"), F.col("rateuom")
    amount, amount_unit = F.col("amount"), F.col("amountuom")
    rules = [
        DoseRule(rate, rate_unit, "mL/hour", above),
        DoseRule(rate, rate_unit, "mL/min", above / 60.0),
        DoseRule(amount, amount_unit, "L", above / 1000.0, only_if_null=rate),
        DoseRule(amount, amount_unit, "ml", above, only_if_null=rate),
    ]
    return union_of_sums(
        [
            _infusions(inputevents_mv, fixed.CRYSTALLOID_MV_ITEMS, rules, above),
            _charted(
                inputevents_cv.filter(F.col("amountuom") == "ml"),
                fixed.CRYSTALLOID_CV_ITEMS,
                "amount",
                above,
                closed=True,
            ),
        ],
        ["icustay_id", "charttime"],
        "amount",
        "crystalloid_bolus",
    )


def colloid_bolus(inputevents_mv: DataFrame, inputevents_cv: DataFrame, chartevents: DataFrame) -> DataFrame:
    above = fixed.COLLOID_ABOVE_ML
    rate, rate_unit = F.col("rate"), F.col("rateuom")
    rules = [
        DoseRule(rate, rate_unit, "mL/hour", above),
        DoseRule(rate, rate_unit, "mL/min", above / 60.0),
        DoseRule(rate * F.col("patientweight"), rate_unit, "mL/kg/hour", above),
    ]
    return union_of_sums(
        [
            _infusions(inputevents_mv, fixed.COLLOID_MV_ITEMS, rules, above),
            _charted(inputevents_cv, fixed.COLLOID_CV_ITEMS, "amount", above, closed=False),
            _charted(chartevents, fixed.COLLOID_CHARTED_ITEMS, "valuenum", above, closed=False),
        ],
        ["icustay_id", "charttime"],
        "amount",
        "colloid_bolus",
    )
