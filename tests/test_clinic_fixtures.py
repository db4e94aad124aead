"""Edge rows of the clinical tables, one assertion each."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortloom import fixed_values as fixed
from cohortloom.functions.codes import has_prefix
from cohortloom.functions.temporal import age_flag, whole_hours, whole_years
from cohortloom.operators.phrases import catalogue_rows
from cohortloom.plans import note_cohorts, sepsis

T = datetime
ADM = "subject_id INT, hadm_id INT, admittime TIMESTAMP_NTZ, dischtime TIMESTAMP_NTZ, deathtime TIMESTAMP_NTZ"
STAY = "subject_id INT, hadm_id INT, icustay_id INT, intime TIMESTAMP_NTZ, outtime TIMESTAMP_NTZ"
DIAG = "subject_id INT, hadm_id INT, icd9_code STRING"
CHART = "icustay_id INT, charttime TIMESTAMP_NTZ, itemid INT, value STRING, valuenum DOUBLE, error INT"
NOTE = (
    "row_id INT, subject_id INT, hadm_id INT, charttime TIMESTAMP_NTZ, category STRING, description STRING, text STRING"
)
MV = (
    "icustay_id INT, starttime TIMESTAMP_NTZ, itemid INT, amount DOUBLE, amountuom STRING, rate DOUBLE, "
    "rateuom STRING, patientweight DOUBLE, statusdescription STRING"
)
CV = "icustay_id INT, charttime TIMESTAMP_NTZ, itemid INT, amount DOUBLE, amountuom STRING"
DAY = T(2100, 1, 1)


def at(hour, minute=0, second=0, day=1):
    return T(2100, 1, day, hour, minute, second)


def rows(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)


def test_fixed_value_counts():
    assert [len(codes) for codes in fixed.INFECTION.values()] == [93, 10, 6]
    assert [len(codes) for codes in fixed.ORGAN_DYSFUNCTION.values()] == [4, 8]
    assert len(set(fixed.HEART_FAILURE)) == 22
    assert [len(set(codes)) for codes in fixed.HEART_FAILURE_CLASSES.values()] == [4, 4, 4, 3, 10]
    assert set(fixed.HEART_FAILURE) <= {c for codes in fixed.HEART_FAILURE_CLASSES.values() for c in codes}
    assert len(set(fixed.CRYSTALLOID_CV_ITEMS)) == 77 and len(set(fixed.COLLOID_CV_ITEMS)) == 21
    catalogue = catalogue_rows(fixed.PHRASES)
    assert len(catalogue) == 121 and len({phrase for *_, phrase in catalogue}) == 105
    levels = {}
    for _, level, phrase in catalogue:
        levels.setdefault(phrase, set()).add(level)
    assert all(len(found) == 1 for found in levels.values())


def test_index_keeps_parents_and_orders_by_id(spark):
    patients = spark.createDataFrame([(1,), (2,), (3,)], "subject_id INT")
    admissions = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "subject_id INT, hadm_id INT")
    stays = spark.createDataFrame(
        [
            (1, 10, 300, at(1), at(2)),
            (1, 10, 100, at(9), at(10)),
            (1, 10, 200, at(5), at(6)),
            (1, 10, 100, at(9), at(10)),
            (1, 10, None, at(1), at(2)),
            (9, 20, 900, at(1), at(2)),
        ],
        STAY,
    )
    index = sepsis.admissions_index(patients, admissions, stays)
    assert rows(index, "subject_id", "hadm_id", "icustay_id", "ind") == sorted(
        [
            (1, 10, 100, 1),
            (1, 10, 100, 1),
            (1, 10, 200, 2),
            (1, 10, 300, 3),
            (1, 10, None, 4),
            (1, 11, None, 1),
            (2, 20, None, 1),
            (3, None, None, 1),
        ],
        key=repr,
    )


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_years_and_hours(spark, zone):
    data = [
        (T(2000, 2, 29), T(2001, 2, 28), 0),
        (T(2000, 2, 29), T(2001, 3, 1), 1),
        (T(2082, 1, 2), T(2100, 1, 1), 17),
        (T(2082, 1, 1), T(2100, 1, 1), 18),
        (None, T(2100, 1, 1), None),
    ]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(data, "dob TIMESTAMP_NTZ, at TIMESTAMP_NTZ, want INT")
        age = whole_years(F.col("dob"), F.col("at"))
        got = df.select("want", age.alias("age"), age_flag(age).alias("flag")).collect()
        assert [row.age for row in got] == [row.want for row in got]
        assert [row.flag for row in got] == [0, 0, 0, 1, 1]
        hours = [
            (at(0), at(0, 59), 0),
            (at(0), at(1, 59), 1),
            (at(5), at(3, 30), -1),
            (at(0), None, None),
            (T(2100, 1, 1), T(2100, 3, 2), 1440),
        ]
        df = spark.createDataFrame(hours, "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ, want INT")
        got = df.select("want", whole_hours(F.col("a"), F.col("b")).alias("h")).collect()
        assert [row.h for row in got] == [row.want for row in got]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_prefix_codes(spark):
    codes = ["0380", "56201", "5620", "995", "99592", None]
    df = spark.createDataFrame([(code,) for code in codes], "code STRING")
    got = df.select(has_prefix(F.col("code"), fixed.INFECTION), has_prefix(F.col("code"), fixed.EXPLICIT_SEPSIS))
    assert [tuple(row) for row in got.collect()] == [
        (True, False), (True, False), (False, False), (False, False), (False, True), (False, False),
    ]


def test_sepsis_rule_and_heart_failure(spark):
    admissions = spark.createDataFrame([(s, s * 10) for s in range(1, 9)], "subject_id INT, hadm_id INT")
    diagnoses = spark.createDataFrame(
        [
            (1, 10, "0380"), (1, 10, "5849"),  # infection + organ
            (2, 20, "0380"),  # infection + ventilation
            (3, 30, "5849"),  # organ only
            (4, 40, "78552"),  # explicit
            (5, 50, "42821"), (5, 50, "4280"),
            (6, 60, "42831"), (6, 60, "42840"),
            (7, 70, "40403"),
            (99, 80, "99592"), (99, 80, "4280"),  # same admission, other subject
        ],
        DIAG,
    )
    procedures = spark.createDataFrame([(2, 20, "9671"), (3, 30, None)], DIAG)
    flags = sepsis.with_heart_failure(sepsis.sepsis_flags(admissions, diagnoses, procedures), diagnoses)
    assert rows(flags, "subject_id", "angus", "chd", "chd_class") == [
        (1, 1, 0, None),
        (2, 1, 0, None),
        (3, 0, 0, None),
        (4, 1, 0, None),
        (5, 0, 1, "UNSPECIFIED"),
        (6, 0, 1, "DIASTOLIC"),
        (7, 0, 0, "DRG"),
        (8, 1, 0, None),
    ]


def _status(spark, charts, notes=(), stays=None, **options):
    stays = stays or [(1, 10, 100, at(0), at(12))]
    return sepsis.code_status(
        spark.createDataFrame(stays, STAY),
        spark.createDataFrame(list(charts), CHART),
        spark.createDataFrame(list(notes), NOTE),
        **options,
    )


def test_status_rows(spark):
    charts = [
        (100, at(1), 128, "Full Code", None, None),
        (100, at(2), 128, "DNR / DNI", None, 0),
        (100, at(0), 128, "Comfort Measures", None, 1),  # error
        (100, at(0), 128, None, None, None),
        (100, at(0), 128, "Other/Remarks", None, None),
        (100, at(0), 999, "Comfort Measures", None, None),
    ]
    row = _status(spark, charts).first()
    assert (row.fullcode_first, row.fullcode_last, row.fullcode) == (1, 0, 1)
    assert (row.dnr_last, row.dni_last, row.dnr_first) == (1, 1, 0)
    assert (row.cmo, row.cmo_ds, row.timednr_chart, row.timecmo_chart) == (0, 0, at(2), None)


def test_status_null_time_is_last_both_ways(spark):
    # A NULL time sorts last ascending and first descending, so it is the "last" record.
    charts = [(100, None, 128, "DNI (do not intubate)", None, None), (100, at(1), 128, "Full code", None, None)]
    row = _status(spark, charts).first()
    assert (row.fullcode_first, row.dni_first, row.dni_last, row.fullcode_last) == (1, 0, 1, 0)


def test_status_tie_is_stable(spark):
    charts = [(100, at(1), 128, value, None, None) for value in ["Full Code", "DNI (do not intubate)"]]
    picks = {tuple(_status(spark, order).first()) for order in (charts, charts[::-1])}
    assert len(picks) == 1


def test_stay_without_rows(spark):
    row = _status(spark, [(999, at(1), 128, "Full Code", None, None)]).first()
    assert (row.fullcode_first, row.fullcode, row.cmo_ds, row.timecmo_nursingnote) == (None, None, 0, None)


def test_note_times_and_limits(spark):
    charts = [(100, at(1), 128, "Comfort Measures", None, None)]

    def note(time, text="cmo", category="Nursing"):
        return (1, 1, 10, time, category, None, text)

    assert _status(spark, charts, [note(at(0))]).first().timecmo_nursingnote == at(0)  # at the start
    assert _status(spark, charts, [note(at(12))]).first().timecmo_nursingnote == at(12)  # at the end
    assert _status(spark, charts, [note(at(12, 0, 1))]).first().timecmo_nursingnote is None  # a second late
    assert _status(spark, charts, [note(at(3)), note(at(2))]).first().timecmo_nursingnote == at(2)
    assert _status(spark, charts, [note(at(3), category="Echo")]).first().timecmo_nursingnote is None
    # By default any mention counts; with the option only a matching note.
    mixed = [note(at(2), "not cmo"), note(at(4), "made CMO")]
    assert _status(spark, charts, mixed, use_note_flag=True).first().timecmo_nursingnote == at(4)
    # Without a chart entry of that status the note time is not reported.
    other = [(100, at(1), 128, "Full Code", None, None)]
    assert _status(spark, other, [note(at(2))]).first().timecmo_nursingnote is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("CMO at start", 0), ("is CMO", 1), ("on ECMO", 0), ("ECMO, later CMO", 1)],
)
def test_discharge_pattern(spark, text, want):
    notes = [(1, 1, 10, at(1), "Discharge summary", None, text)]
    assert _status(spark, [(100, at(1), 128, "Full Code", None, None)], notes).first().cmo_ds == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("pt. is cmo", 1),
        ("pt\n is cmo", 1),
        ("cmo.. Code status:\r\n  Comfort measures only", 1),
        ("Code status: Comfort measures only, CMO", 1),
        ("was made cmo", 0),
        ("CMO ordered", 1),
    ],
)
def test_nursing_patterns(spark, text, want):
    df = spark.createDataFrame([(1, 1, 10, at(1), "Nursing", None, text)], NOTE)
    assert sepsis.nursing_mentions(df).first().cmo == want


def test_flagged_mentions_are_those_with_the_flag_and_carry_no_text_through_joins(spark):
    texts = ["pt. is cmo", "was made cmo", "is CMO. Code status: \n Comfort measures only", None, "nothing", "not cmo", "made CMO"]
    notes = [(i, 1, i % 4, at(i % 3), "Nursing", None, text) for i, text in enumerate([*texts, *reversed(texts)])]
    notes += [(90, 1, None, at(1), "Nursing", None, "pt. is cmo"), (91, 1, 2, None, "Nursing", None, "pt. is cmo")]
    read = spark.createDataFrame(notes, NOTE).repartition(2)
    df = read.join(spark.range(100).select(F.col("id").cast("int").alias("row_id")).repartition(2), "row_id")
    columns = ["hadm_id", "charttime", "cmo"]
    flagged = sepsis.nursing_mentions(df, flagged_only=True)
    assert rows(flagged, *columns) == rows(sepsis.nursing_mentions(df).filter("cmo = 1"), *columns)
    assert flagged.count() > 1
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join ", 1)
    assert "text" not in above and "text" in below


def test_many_notes_and_charts_give_one_row(spark):
    charts = [(100, at(h), 128, "Comfort Measures", None, None) for h in range(1, 11)]
    notes = [(h, 1, 10, at(h), "Nursing", None, "cmo") for h in range(1, 11)]
    assert _status(spark, charts, notes).count() == 1


def _mv(spark, *items):
    base = dict(
        icustay_id=1, starttime=DAY, itemid=225158, amount=500.0, amountuom="ml", rate=None, rateuom=None,
        patientweight=None, statusdescription="FinishedRunning",
    )
    return spark.createDataFrame([tuple((base | item).values()) for item in items], MV)


def _bolus(spark, mv=(), cv=()):
    mv_df = _mv(spark, *mv) if mv else spark.createDataFrame([], MV)
    cv_df = spark.createDataFrame([(1, DAY, 30018, *c) for c in cv], CV)
    return sorted(row.crystalloid_bolus for row in sepsis.crystalloid_bolus(mv_df, cv_df).collect())


@pytest.mark.parametrize(
    ("item", "want"),
    [
        (dict(amount=0.249, amountuom="L"), [249.0]),
        (dict(amount=248.0), []),
        (dict(amount=248.4), []),
        (dict(amount=249.5), [250.0]),
        (dict(amount=250.5), [250.0]),
        (dict(rate=249.0, rateuom="mL/hour"), [500.0]),
        (dict(rate=248.0, rateuom="mL/hour"), []),
        (dict(rate=4.2, rateuom="mL/min"), [500.0]),
        (dict(rate=249.0, rateuom="mL/hour", amount=100.0), []),
        (dict(amountuom="ML"), []),
        (dict(rate=249.0, rateuom="mL/hour", amountuom="ML"), []),
        (dict(statusdescription=None), []),
        (dict(statusdescription="Rewritten"), []),
        (dict(itemid=1), []),
    ],
)
def test_crystalloid_pump_rules(spark, item, want):
    assert _bolus(spark, mv=[item]) == want


@pytest.mark.parametrize(
    ("amount", "unit", "want"),
    [
        (248.4, "ml", [248.0]), (248.0, "ml", []), (2000.0, "ml", [2000.0]), (2000.5, "ml", []), (500.0, "cc", []),
        (249.5, "ml", [250.0]), (250.5, "ml", [250.0]),
    ],
)
def test_crystalloid_charted_rules(spark, amount, unit, want):
    assert _bolus(spark, cv=[(amount, unit)]) == want


def test_branches_merge_equal_sums_only(spark):
    assert _bolus(spark, mv=[{}], cv=[(500.0, "ml")]) == [500.0]
    assert _bolus(spark, mv=[{}], cv=[(600.0, "ml")]) == [500.0, 600.0]
    assert _bolus(spark, mv=[{}, {}], cv=[(600.0, "ml"), (400.0, "ml")]) == [1000.0]
    assert _bolus(spark, mv=[dict(icustay_id=None)]) == [500.0]  # a NULL stay is a group


def test_colloid_rules(spark):
    mv = _mv(
        spark,
        dict(icustay_id=1, itemid=220864, rate=2.0, rateuom="mL/kg/hour", patientweight=60.0),
        dict(icustay_id=2, itemid=220864, rate=None, rateuom="mL/hour"),
        dict(icustay_id=3, itemid=220864, rate=2.0, rateuom="mL/min"),
        dict(icustay_id=4, itemid=220864, rate=1.0, rateuom="mL/kg/hour", patientweight=60.0),
        dict(icustay_id=5, itemid=220864, rate=101.0, rateuom="mL/hour", amount=100.4),
    )
    cv = spark.createDataFrame([(6, DAY, 30008, 2000.0, "cc"), (7, DAY, 30008, 101.0, None)], CV)
    charts = spark.createDataFrame(
        [(8, DAY, 3087, None, 150.0, 1), (9, DAY, 3087, None, None, None), (10, DAY, 3087, None, 100.0, None)], CHART
    )
    got = rows(sepsis.colloid_bolus(mv, cv, charts), "icustay_id", "colloid_bolus")
    assert got == [(1, 500.0), (3, 500.0), (7, 101.0), (8, 150.0)]


def test_exclusion_flags_use_the_admission(spark):
    cohort = spark.createDataFrame([(1, 10, 100), (2, 20, 200), (3, 30, 300)], "subject_id INT, hadm_id INT, icustay_id INT")
    # The limit was charted in another stay of the admission; comfort measures alone do not count.
    stays = [(1, 10, 101, at(0), at(1)), (2, 20, 200, at(0), at(1)), (8, 30, 301, at(0), at(1))]
    charts = [
        (101, at(0), 128, "Do Not Resuscita", None, None),
        (200, at(0), 128, "Comfort Measures", None, None),
        (301, at(0), 128, "Do Not Intubate", None, None),
    ]
    status = _status(spark, charts, stays=stays)
    diagnoses = spark.createDataFrame([(2, 20, "5856"), (2, 20, "40403"), (9, 30, "5856")], DIAG)
    got = sepsis.with_exclusion_flags(cohort, status, diagnoses)
    assert rows(got, "subject_id", "flag_dnidnr", "flag_esrt") == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]


def test_cohort_columns_and_durations(spark):
    flags = spark.createDataFrame(
        [(1, 10, 1, 0, 1, 0, 1, 1, "DRG"), (2, 20, 0, 0, 0, 0, 0, 1, "DRG")],
        "subject_id INT, hadm_id INT, infection INT, explicit_sepsis INT, organ_dysfunction INT, mech_vent INT, "
        "angus INT, chd INT, chd_class STRING",
    )
    index = spark.createDataFrame(
        [(1, 10, None, 1), (1, 10, 5, 2), (2, 20, 6, 1)], "subject_id INT, hadm_id INT, icustay_id INT, ind BIGINT"
    )
    admissions = spark.createDataFrame([(1, 10, at(10), at(8), None), (2, 20, at(1), at(2), at(3))], ADM)
    cohort = sepsis.sepsis_cohort(flags, index, admissions)
    assert rows(cohort, "subject_id", "icustay_id", "timeadtodischarge", "timeadtodeath") == [(1, None, -2, None)]
    times = sepsis.discharge_times(flags, index, admissions)
    assert rows(times, "subject_id", "timeadtodischarge", "timeadtodeath") == [(1, -2, None), (2, 1, 2)]
    people = spark.createDataFrame([(1, 10, 0)], "subject_id INT, hadm_id INT, age_flag INT")
    assert [row.n_rows for row in sepsis.adult_counts(cohort, people).collect()] == [1, 1, 0, 0, 0]


def test_note_cohorts(spark):
    name = fixed.ADMISSION_NOTE_DESCRIPTION
    notes = spark.createDataFrame(
        [
            (1, 1, 10, at(1), "Physician", name, "known chf"),
            (2, 1, None, at(1), "Physician", name, "HFpEF"),
            (3, 2, 20, at(1), "Physician", name, None),
            (4, 2, 20, at(1), None, "Nursing ADMISSION note", "x"),
            (5, 2, 20, at(1), "Nursing", None, "Congestive heart failure"),
        ],
        NOTE,
    )
    admissions = spark.createDataFrame(
        [(1, 10, "CONGESTIVE HEART FAILURE"), (2, 20, None), (3, 30, "R/O CHF")],
        "subject_id INT, hadm_id INT, diagnosis STRING",
    )
    external = spark.createDataFrame([(10, 1), (20, 0), (None, 1)], "hadm_id INT, angus INT")
    assert rows(note_cohorts.admission_note_types(notes), "label", "n") == [
        ("None Nursing ADMISSION note", 1),
        (f"Physician {name}", 3),
    ]
    assert rows(note_cohorts.heart_failure_notes(notes), "row_id") == [(1,), (2,)]
    assert rows(note_cohorts.heart_failure_admissions(admissions), "hadm_id") == [(10,)]
    assert rows(
        note_cohorts.heart_failure_admissions(admissions, fixed.HEART_FAILURE_KEYWORDS), "hadm_id"
    ) == [(10,), (30,)]
    assert rows(note_cohorts.heart_failure_ids(notes, admissions), "id") == [(10,)]
    assert rows(note_cohorts.heart_failure_sepsis_notes(notes, external), "row_id") == [(1,)]
    row = note_cohorts.agreement(notes, admissions, external).first()
    assert (row.n_note_hf, row.n_sepsis, row.n_admission_note, row.n_union) == (1, 1, 2, 2)
