"""Fixed values that must equal the reference's rules for equal results.

Fixed values (stated as text, natural order):
"""

# String sentinels that mean "missing" (exact match, no trim).
STRING_NULLS = [" ?", "?", "N/A", "NA", "none", "None", "null", "unknown", "Unknown", "missing", "MISSING", ""]

# Numeric sentinels that mean "missing" when frequent enough.
NUMERIC_NULLS = [-1, -999, 999, 9999]

# Name patterns for ID-like columns (exact, "<p>_" prefix or "_<p>" suffix).
ID_PATTERNS = ["id", "uuid", "guid", "key", "hash", "idx", "index", "rowid", "row_id", "record"]

# Built-in ordinal order for a column named "education".
ORDERED_ORDINALS = {
    "education": [
        "Preschool", "1st-4th", "5th-6th", "7th-8th", "9th", "10th", "11th", "12th",
        "HS-grad", "Some-college", "Assoc-voc", "Assoc-acdm", "Bachelors", "Prof-school",
        "Masters", "Doctorate",
    ],
}

# Text forms mapped to 1 / 0 by the boolean-text repair.
BOOLEAN_TRUE = ["yes", "true"]
BOOLEAN_FALSE = ["no", "false"]

# Thresholds.
MIN_ROWS, MAX_ROWS = 50, 100_000
MIN_COLS, MAX_COLS = 2, 500
MULTICLASS_MAX = 20
IMBALANCE_NONE, IMBALANCE_WEIGHTS, IMBALANCE_SMOTE = 0.40, 0.15, 0.05
ROWS_SMALL, ROWS_MEDIUM = 500, 50_000
ONEHOT_MAX_LEVELS = 15
INDEX_MAX_LEVELS = 1_000  # a string feature with more levels is frequency coded before a model
ID_SHARE_STRICT, ID_SHARE_NAMED = 0.95, 0.80
DATETIME_SAMPLE_SHARE, DATETIME_FULL_SHARE, DATETIME_MIN_SAMPLE = 0.8, 0.7, 5
TEXT_MIN_DISTINCT, TEXT_DISTINCT_SHARE, TEXT_MIN_MEAN_LEN = 50, 0.3, 25
NULL_LOW, NULL_HIGH, NULL_DROP = 0.05, 0.20, 0.60
NUMERIC_PARSE_SHARE = 0.85
CLIP_LOW, CLIP_HIGH = 0.01, 0.99
COLLINEAR_LIMIT = 0.95
INTERACTION_MIN_R, INTERACTION_TOP = 0.2, 3
LOG_SKEW, BIN_SKEW = 1.0, 2.0
SCOUT_FRACTION, SCOUT_MIN, SCOUT_MAX = 0.10, 200, 2000
TUNE_SMALL_ROWS, TUNE_DRAWS, TUNE_FOLDS = 2000, 20, 5
SEED = 42
THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]
