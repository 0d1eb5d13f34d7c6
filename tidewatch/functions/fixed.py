"""Fixed values that results must agree with.

These are domain constants of the hazard model (band edges, advisory texts,
district profiles, bounds).  They are stated here plainly, in their natural
order, and every other module reads them from this one place.
"""

from __future__ import annotations

# --- fixed values: risk band edges -------------------------------------------
LOW_THRESHOLD = 0.25
MEDIUM_THRESHOLD = 0.50
HIGH_THRESHOLD = 0.75
INSUFFICIENT_DATA_MESSAGE = "Insufficient data — manual assessment recommended"

RISK_LEVELS = ["Low", "Medium", "High", "Critical"]

# --- fixed values: display colours per level ----------------------------------
RISK_COLORS = {
    "Low": "#2E7D32",
    "Medium": "#F9A825",
    "High": "#EF6C00",
    "Critical": "#C62828",
}

# --- fixed values: Urdu level names -------------------------------------------
RISK_LABELS_UR = {
    "Low": "کم",
    "Medium": "درمیانہ",
    "High": "زیادہ",
    "Critical": "انتہائی",
}

# --- fixed values: recommended actions (English, Urdu) ------------------------
RISK_ACTIONS = {
    "Low": {
        "en": "Continue routine monitoring and keep village contact lists updated.",
        "ur": "معمول کی نگرانی جاری رکھیں اور دیہی رابطہ فہرستیں تازہ رکھیں۔",
    },
    "Medium": {
        "en": "Alert union councils and prepare evacuation transport standby.",
        "ur": "یونین کونسلز کو الرٹ کریں اور انخلا کے لیے ٹرانسپورٹ تیار رکھیں۔",
    },
    "High": {
        "en": "Issue district-level warning and pre-position rescue teams near high-risk zones.",
        "ur": "ضلعی وارننگ جاری کریں اور ریسکیو ٹیموں کو بلند خطرے والے علاقوں کے قریب تعینات کریں۔",
    },
    "Critical": {
        "en": "Start immediate evacuation in vulnerable settlements and activate emergency shelters.",
        "ur": "کمزور آبادیوں میں فوری انخلا شروع کریں اور ہنگامی پناہ گاہیں فعال کریں۔",
    },
}

# --- fixed values: level order (override may only raise) and alert order ------
RISK_ORDER = {"Low": 1, "Medium": 2, "High": 3, "Critical": 4}
ALERT_SEVERITY = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
UNKNOWN_ALERT_SEVERITY = 99

# --- fixed values: people-at-risk rates per level -----------------------------
SEVERITY_RATE = {"Low": 0.002, "Medium": 0.007, "High": 0.015, "Critical": 0.030}
MAX_CAP_RATE = {"Low": 0.01, "Medium": 0.03, "High": 0.06, "Critical": 0.10}
MINIMUM_PEOPLE = {"Low": 50, "Medium": 150, "High": 300, "Critical": 500}

# --- fixed values: district -> region, exposure profile, region divisor -------
DISTRICT_TO_REGION = {
    "Sindh_District": "Sindh",
    "Jacobabad": "Sindh",
    "KP_District": "KP",
    "Nowshera": "KP",
    "Balochistan_District": "Balochistan",
}

DISTRICT_RISK_PROFILE = {
    "Sindh_District": {"exposure_factor": 0.85, "max_exposed_share": 0.08},
    "Jacobabad": {"exposure_factor": 0.95, "max_exposed_share": 0.09},
    "KP_District": {"exposure_factor": 0.80, "max_exposed_share": 0.07},
    "Nowshera": {"exposure_factor": 0.90, "max_exposed_share": 0.08},
    "Balochistan_District": {"exposure_factor": 0.55, "max_exposed_share": 0.05},
}
DEFAULT_RISK_PROFILE = {"exposure_factor": 0.75, "max_exposed_share": 0.06}

REGION_DISTRICT_DIVISOR = {
    "Sindh": 2,
    "KP": 2,
    "Balochistan": 1,
}
DEFAULT_DIVISOR = 1

# --- fixed values: field report vocabularies -----------------------------------
SOIL_CONDITION_TO_VALUE = {
    "Dry": 0.20,
    "Moist": 0.45,
    "Saturated": 0.70,
}
VISIBLE_WATER_OPTIONS = ["Yes", "No"]
RAIN_MIN_MM = 0.0
RAIN_MAX_MM = 500.0

# --- fixed values: model feature lists ----------------------------------------
MODEL_NUMERIC_FEATURES = [
    "precipitation",
    "precip_3day_avg",
    "precip_7day_avg",
    "soil_moisture",
    "soil_3day_avg",
    "water_area_km2_lag1",
    "water_area_change_lag1",
    "water_area_pct_change_lag1",
    "temperature",
    "humidity",
    "pressure",
    "evaporation",
    "month",
    "day_of_year",
    "is_monsoon",
    "rain_soil_interaction",
    "monsoon_cumulative_precip",
    "avg_elevation_m",
]

MODEL_CATEGORICAL_FEATURES = [
    "district",
    "terrain_type",
]

LEAKAGE_PRONE_FEATURES = [
    "water_area_km2",
    "water_area_change",
    "water_area_pct_change",
    "ds_idx",
]

DROP_COLUMNS = [
    "flood_event",
    "date",
    "elevation",
    "latitude",
    "longitude",
]

# --- fixed values: raw columns coerced to numbers ------------------------------
NUMERIC_COLUMNS = [
    "elevation",
    "evaporation",
    "latitude",
    "longitude",
    "precipitation",
    "pressure",
    "soil_moisture",
    "temperature",
    "water_area_km2",
    "wind_speed",
    "humidity",
    "precip_3day_avg",
    "precip_7day_avg",
    "temp_3day_avg",
    "soil_3day_avg",
    "day_of_year",
    "month",
    "year",
    "is_monsoon",
    "water_area_change",
    "water_area_pct_change",
    "ds_idx",
    "flood_event",
]

# --- fixed values: plausible ranges ("phantom" rows fall outside) --------------
OUTLIER_BOUNDS = {
    "soil_moisture": (0.0, 1.0),
    "humidity": (0.0, 100.0),
    "temperature": (-20.0, 60.0),
    "precipitation": (0.0, 500.0),
    "water_area_km2": (0.0, None),
    "wind_speed": (0.0, None),
}

# --- fixed values: cleaning and feature rules ----------------------------------
DATE_PATTERN = "M/d/yyyy"
RAIN_SENTINEL = -999.0
MONSOON_MONTHS = [7, 8, 9]
WINSOR_LOW = 0.01
WINSOR_HIGH = 0.99
LAG_COLUMNS = ["water_area_km2", "water_area_change", "water_area_pct_change"]

# --- fixed values: report -> feature row blends --------------------------------
REPORT_BLEND_3DAY = 0.5          # 0.5 * report + 0.5 * baseline
REPORT_BLEND_7DAY = 0.3          # 0.3 * report + 0.7 * baseline
REPORT_SOIL_BASE_SHARE = 0.6     # 0.6 * baseline + 0.4 * report
PCT_CHANGE_FLOOR = 0.001
UNKNOWN_TERRAIN = "Unknown"

# --- fixed values: stress rows ("surge") ---------------------------------------
SURGE_DEFAULT_DISTRICTS = ["Sindh_District", "KP_District"]
SURGE_DEFAULT_PCT = 300.0
SURGE_RAIN_FALLBACK = 50.0
SURGE_DEFAULT_LAST_DATE = "2024-12-31"

# --- fixed values: faulty-sensor imputation ------------------------------------
IMPUTE_DEFAULT_DISTRICT = "Sindh_District"
IMPUTE_DONORS = 2
IMPUTE_BLEND = {"precip_3day_avg": 0.6, "precip_7day_avg": 0.35}

# --- fixed values: stress audit of every district ------------------------------
STRESS_RAIN_MM = 500.0

# --- fixed values: model choice weights ----------------------------------------
CHOICE_WEIGHTS = {"holdout_recall": 0.60, "holdout_auc": 0.30, "folds_recall": 0.20, "folds_auc": 0.10}
PREFERRED_HOLDOUT_YEAR = 2024

# --- fixed values: feature-name prefixes removed for display --------------------
FEATURE_PREFIXES = ["num__", "cat__", "feature__"]
