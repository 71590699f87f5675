"""Fixed values of the domain.

These constants must equal the values of the published model so that results agree. They are facts
(codes, labels, sentinels), kept together here as plain text. Every operator takes them as keyword
defaults, so none of them ties the library to one country's files.
"""

# --- labels of this library -------------------------------------------------
CANCER = "CANCER"
COVID = "COVID"
OTHER = "OTHER"
SURGERY = "SURGERY"
CLINICAL = "CLINICAL"

FINE_TYPES = (
    "CANCER_CLINICAL",
    "CANCER_SURGERY",
    "COVID_CLINICAL",
    "COVID_SURGERY",
    "OTHER_CLINICAL",
    "OTHER_SURGERY",
)
COARSE_TYPES = ("CANCER_CLINICAL", "CANCER_SURGERY", "OTHER_CLINICAL", "OTHER_SURGERY")
CANCER_TYPES = ("CANCER_CLINICAL", "CANCER_SURGERY")
COVID_TYPES = ("COVID_CLINICAL", "COVID_SURGERY")
OTHER_TYPES = ("OTHER_CLINICAL", "OTHER_SURGERY")

# --- values found in the source data ----------------------------------------
CANCER_CHAPTER = "Neoplasms (C00-D48)"
COVID_CODE = "B342"
SURGICAL_GROUP = "Procedimentos cirúrgicos"
CANCER_SURGERY_BED_CODES = (12,)
CANCER_CLINICAL_BED_CODES = (44,)
SURGICAL_BED_KINDS = (1,)
UNKNOWN_OCCUPATION = "Outros"
OVERFLOW_OCCUPATION = "Médico"
CSV_ENCODING = "ISO-8859-1"

# --- model constants ----------------------------------------------------------
EARTH_RADIUS_KM = 6373.0
SAME_PLACE_KM = 1.0
OVERFLOW_FACILITY = 0
OVERFLOW_KM = 99999.9
OVERFLOW_BEDS = 99999999
OVERFLOW_STAFF = 999999
OVERFLOW_CENSUS = 999999
RELAXED_VALUE = 9999999
ATTACK_FACTOR = 0.52
HOURS_DIVISOR = 5

# Hours of staff time one patient takes per day, by type name.
HOURS_PER_PATIENT = {"CANCER_CLINICAL": 1, "CANCER_SURGERY": 2}

# --- run defaults -------------------------------------------------------------
PLANNING_START = "2021-03-01"
PLANNING_DAYS = 120
SEGMENTS = 7
WEIGHT_STEP = 0.1
BASELINE_START = "2019-01-01"
BASELINE_END = "2020-03-01"  # exclusive
AREA_PREFIX = "23"

# Home areas left out of the flow graph.
EXCLUDED_AREAS = (
    231260, 231085, 231025, 231020, 230970, 230960, 230770, 230765, 230625,
    230523, 230495, 230440, 230428, 230395, 230370, 230350, 230100,
)
