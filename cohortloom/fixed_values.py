"""Fixed values.

Everything in this module has to equal a published definition for the results to be right: diagnosis and
procedure code lists, item lists, status texts, note patterns, keywords, the phrase catalogue and the dose
thresholds. Nothing here is logic; the operators take these values as parameters.
"""

from __future__ import annotations

# --- Severe sepsis (Angus et al. 2001, ICD-9-CM appendices), matched on the leading 3, 4 or 5 characters --------

INFECTION = {
    3: """
        001 002 003 004 005 008
        009 010 011 012 013 014 015 016 017 018
        020 021 022 023 024 025 026 027 030 031
        032 033 034 035 036 037 038 039 040 041
        090 091 092 093 094 095 096 097 098 100
        101 102 103 104 110 111 112 114 115 116
        117 118 320 322 324 325 420 421 451 461
        462 463 464 465 481 482 485 486 494 510
        513 540 541 542 566 567 590 597 601 614
        615 616 681 682 683 686 730
    """.split(),
    4: "5695 5720 5721 5750 5990 7110 7907 9966 9985 9993".split(),
    5: "49121 56201 56203 56211 56213 56983".split(),
}
ORGAN_DYSFUNCTION = {
    3: "458 293 570 584".split(),
    4: "7855 3483 3481 2874 2875 2869 2866 5734".split(),
}
EXPLICIT_SEPSIS = {5: "99592 78552".split()}
MECHANICAL_VENTILATION = {4: "9670 9671 9672".split()}

# --- Heart failure and end-stage renal disease, whole codes ---------------------------------------------------

HEART_FAILURE = """
    4280 4281 4289 42820 42821 42822 42823 42830 42831 42832 42833 42840 42841 42843 42842
    39891 40201 40211 40291 40401 40411 40491
""".split()

# Rising priority: where an admission carries codes of several classes, the last one listed here wins.
HEART_FAILURE_CLASSES = {
    "SYSTOLIC": "42820 42821 42822 42823".split(),
    "COMBINED": "42840 42841 42842 42843".split(),
    "DIASTOLIC": "42830 42831 42832 42833".split(),
    "UNSPECIFIED": "4280 4281 4289".split(),
    "DRG": "39891 40201 40211 40291 40401 40411 40491 40403 40413 40493".split(),
}
END_STAGE_RENAL = "5856 40403 40413 40493".split()

# --- Code status ----------------------------------------------------------------------------------------------

CODE_STATUS_ITEMS = [128, 223758]
CODE_STATUS_IGNORED_VALUE = "Other/Remarks"
CODE_STATUS_VALUES = {
    "fullcode": ["Full Code", "Full code"],
    "cmo": ["Comfort Measures", "Comfort measures only"],
    "dnr": ["Do Not Resuscita", "DNR (do not resuscitate)", "DNR / DNI"],
    "dni": ["Do Not Intubate", "DNI (do not intubate)", "DNR / DNI"],
    "dncpr": ["CPR Not Indicate"],
}
DISCHARGE_CATEGORIES = ["Discharge summary"]
DISCHARGE_CMO_PREFILTER = "CMO"
DISCHARGE_CMO_PATTERN = "[^E]CMO"
NURSING_CATEGORIES = ["Nursing/other", "Nursing", "Physician"]
NURSING_CMO_PREFILTER = "cmo"  # on the lower-cased text
NURSING_CMO_PATTERNS = ["made CMO", r"Code status:([ \r\n]+)Comfort measures only"]
NURSING_CMO_LOWERED_PATTERNS = ["cmo ordered", "pt. is cmo"]

# --- Fluids ---------------------------------------------------------------------------------------------------

MILLILITRES_PER_UNIT = {"L": 1000.0, "ml": 1.0}
REWRITTEN_STATUS = "Rewritten"

CRYSTALLOID_MV_ITEMS = [225158, 225828, 225944, 225797]
CRYSTALLOID_CV_ITEMS = [int(item) for item in """
    30018 30021 30058 40850 41491 42639 30065 42187 43819 30063 41430 40712 44160 42383 30169 42297 42453 40872
    41915 41490 46501 45045 41984 41371 41582 41322 40778 41896 41428 43936 44200 41619 40424 41457 41581 42844
    42429 41356 40532 42548 44184 44521 44741 44126 44110 44633 44983 44815 43986 45079 46781 45155 43909 41467
    44367 41743 40423 44263 42749 45480 44491 41695 46169 41580 41392 45989 45137 45154 44053 41416 44761 41237
    44426 43975 44894 41380 42671
""".split()]
CRYSTALLOID_ABOVE_ML = 248
COLLOID_MV_ITEMS = [220864, 220862, 225174, 225795, 225796]
COLLOID_CV_ITEMS = [int(item) for item in """
    30008 30009 42832 40548 45403 44203 30181 46564 43237 43353 30012 46313 42975 42944 46336 46729 40033 45410
    30011 30016 42731
""".split()]
COLLOID_CHARTED_ITEMS = [2510, 3087, 6937, 3088]
COLLOID_ABOVE_ML = 100
BOLUS_UPPER_ML = 2000  # closed for crystalloids, open for colloids

# --- Notes ----------------------------------------------------------------------------------------------------

ADMISSION_NOTE_DESCRIPTION = "Physician Resident Admission Note"
ECHO_CATEGORY = "Echo"
HEART_FAILURE_DIAGNOSIS = ["Congestive heart failure"]
HEART_FAILURE_KEYWORDS = [
    "Congestive heart failure",
    "heart failure with reduced ejection",
    "heart failure with preserved ejection fraction",
    "HFpEF",
    "HFrEF",
    "diastolic heart failure",
    "systolic heart failure",
    "CHF",
]
SAMPLE_SEEDS = [10, 20, 30, 40, 50]

# --- Phrase search --------------------------------------------------------------------------------------------

PHRASE_SLOP = 4
PEEK_RANK = 11
SEVERITY_COHORTS = {
    "severely": ["severely"],
    "mild_moderate": ["mild_moderate"],
    "either": ["severely", "mild_moderate"],
}
CATEGORY_TITLES = {
    "LVSF": "Search terms used to categorize left ventricular systolic function",
    "LVCF": "Search terms used to categorize left ventricular cavity function",
    "RVSF": "Search terms used to categorize right ventricular systolic function",
    "RVCF": "Search terms used to categorize right ventricular cavity function",
}
PHRASES = {
    ("LVSF", "normal"): """
        Overall normal LVEF (>55%)
        Normal LV wall thickness, cavity size and regional/global systolic function (LVEF >55%)
        Low normal LVEF
        Normal LV wall thickness, cavity size, and systolic function (LVEF>55%)
        Mild symmetric LVH with normal cavity size and regional/global systolic function (LVEF>55%)
        Overall left ventricular systolic function is normal (LVEF>55%)
        Normal LV wall thickness, cavity size, and global systolic function (LVEF>55%)
        Left ventricular wall thickness, cavity size, and systolic function are normal (LVEF>55%)
        Mild symmetric LVH with normal cavity size and systolic function (LVEF>55%)
        Mild symmetric LVH with normal cavity size and global systolic function (LVEF>55%)
        Overall left ventricular systolic function is low normal (LVEF 50-55%)
        There is mild symmetric left ventricular hypertrophy with normal cavity size and systolic function (LVEF>55%)
        Normal LV wall thickness, cavity size and regional/global function (LVEF >55%)
        Normal LV wall thickness, cavity size, and global function (LVEF>55%)
        Left ventricular wall thickness, cavity size, and systolic function are normal
        There is mild symmetric left ventricular hypertrophy with normal cavity size and systolic function
        Low normal LVEF (50-55%)
        Hyperdynamic LVEF >75%
        Hyperdynamic LVEF
        Left ventricular systolic function is hyperdynamic (EF>75%)
        Hyperdynamic left ventricular systolic function
        Hyperdynamic LVEF (>75%)
    """,
    ("LVSF", "mild_moderate"): """
        Mildly depressed LVEF
        Mild global LV hypokinesis
        Depressed LVEF
        Overall left ventricular systolic function is mildly depressed
        depressed LVEF
        Mildly depressed LVEF (40-55%)
        global LV hypokinesis
        LV systolic function appears depressed
        There is mild global left ventricular hypokinesis
        Intrinsic LV systolic function depressed given the severity of valvular regurgitation
        Moderately depressed LVEF
        Overall left ventricular systolic function is moderately depressed
        Moderate global LV hypokinesis
        There is moderate global left ventricular hypokinesis
        Mild-moderate global left ventricular hypokinesis
        Moderately depressed LVEF (30-39%)
    """,
    ("LVSF", "severely"): """
        Severely depressed LVEF
        Severe global LV hypokinesis
        Overall left ventricular systolic function is severely depressed
        There is severe global left ventricular hypokinesis
        Moderate-severe global left ventricular hypokinesis
        Severely depressed LVEF (<30%)
        -severe global left ventricular hypokinesis
    """,
    ("LVCF", "normal"): """
        Normal LV cavity size
        Normal LV wall thickness, cavity size and regional/global systolic function (LVEF >55%)
        The left ventricular cavity size is normal
        Normal LV wall thickness and cavity size
        Mild symmetric LVH with normal cavity size
        Normal LV wall thickness, cavity size, and systolic function (LVEF>55%)
        Mild symmetric LVH with normal cavity size and regional/global systolic function (LVEF>55%)
        Normal LV wall thickness, cavity size, and global systolic function (LVEF>55%)
        Left ventricular wall thickness, cavity size, and systolic function are normal (LVEF>55%)
        Normal LV wall thicknesses and cavity size
        Mild symmetric LVH with normal cavity size and systolic function (LVEF>55%)
        Left ventricular wall thicknesses and cavity size are normal
        Mild symmetric LVH with normal cavity size and global systolic function (LVEF>55%)
        There is mild symmetric left ventricular hypertrophy with normal cavity size and systolic function (LVEF>55%)
        There is mild symmetric left ventricular hypertrophy with normal cavity size
        The left ventricular cavity size is top normal/borderline dilated
        Normal LV wall thickness, cavity size, and global function (LVEF>55%)
        Left ventricular wall thickness, cavity size, and systolic function are normal
        LV cavity normal for BSA
        There is mild symmetric left ventricular hypertrophy with normal cavity size and systolic function
        Top /borderline dilated LV cavity size
        Normal LV thickness and cavity size
        Normal LV wall thickness, cavity size and regional/global function (LVEF >55%)
    """,
    ("LVCF", "mild_moderate"): """
        Mildly dilated LV cavity
        The left ventricular cavity is mildly dilated
        Dilated LV cavity
        The left ventricular cavity is dilated
        Mildly dilated LV cavity
        Moderately dilated LV cavity
        The left ventricular cavity is moderately dilated
    """,
    ("LVCF", "severely"): """
        Severely dilated LV cavity
        The left ventricular cavity is severely dilated
    """,
    ("RVSF", "normal"): """
        Normal RV chamber size and free wall motion
        Right ventricular chamber size and free wall motion are normal
        Normal RV systolic function
        Right ventricular systolic function is borderline normal
        Borderline normal RV systolic function
        Right ventricular systolic function is normal
        Right ventricular chamber size and systolic function are normal
        TASPE normal (>=1.6cm) Normal interventricular septal motion
        TASPE normal (>=1.6cm)
        Normal RV chamber size and free motion
        Normal RV function
    """,
    ("RVSF", "mild_moderate"): """
        Mild global RV free wall hypokinesis
        There is mild global right ventricular free wall hypokinesis
        Right ventricular systolic function appears depressed
        RV function depressed
        Mild global RV free hypokinesis
        TASPE depressed (<1.6cm)
        TASPE depressed (<1.6cm) RV function depressed
        TASPE depressed (<1.6cm) Abnormal systolic septal motion/position consistent with RV pressure overload
        TASPE depressed (<1.6cm) Abnormal septal motion/position consistent with RV pressure/volume overload
        TASPE depressed (<1.6cm) Intrinsic RV systolic function likely more depressed given the severity of TR
        TASPE depressed (<1.6cm) Paradoxical septal motion consistent with conduction abnormality/ventricular pacing
        TASPE depressed (<1.6cm) Normal interventricular septal motion
        TASPE depressed (<1.6cm) Paradoxical septal motion consistent with prior cardiac surgery
        TASPE depressed (<1.6cm) Abnormal septal motion/position
        There is moderate global right ventricular free wall hypokinesis
        Moderate global RV free wall hypokinesis
        Moderate global RV free hypokinesis
    """,
    ("RVSF", "severely"): """
        There is severe global right ventricular free wall hypokinesis
        Severe global RV free wall hypokinesis
    """,
    ("RVCF", "normal"): """
        Normal RV chamber size and free wall motion
        Right ventricular chamber size and free wall motion are normal
        Normal RV chamber size
        Right ventricular chamber size is normal
        Right ventricular chamber size and systolic function are normal
        Normal RV chamber size and free motion
        Right ventricular chamber size and free motion are normal
    """,
    ("RVCF", "mild_moderate"): """
        Mildly dilated RV cavity
        Dilated RV cavity
        The right ventricular cavity is dilated
        The right ventricular cavity is mildly dilated
    """,
    ("RVCF", "severely"): """
        Moderately dilated RV cavity
        Markedly dilated RV cavity
        The right ventricular cavity is moderately dilated
        The right ventricular cavity is markedly dilated
    """,
}
