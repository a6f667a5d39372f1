"""Fixed values that must equal the reference's for the same results.

These are rules of the reference (name patterns, placeholder strings,
severity weights, thresholds).  They are stated here once, as plain text.
"""

# --- fixed values -----------------------------------------------------------

# Column-name pattern of a suspected identifier (case-insensitive).
ID_NAME_PATTERN = r"(^|_)(id|uuid|guid|key|index|identifier|pk|code)($|_)"

# Column-name pattern of a likely target (case-insensitive).
TARGET_NAME_PATTERN = (
    r"(^|_)(target|label|class|y|response|outcome|price|salary|churn|survived|status|default|sales|revenue)($|_)"
)

# Column-name pattern of quantities that should never be negative (case-insensitive).
NON_NEGATIVE_NAME_PATTERN = r"(^|_)(age|price|salary|revenue|cost|count|quantity|volume|amount|duration|tenure)($|_)"

# Strings that stand for a missing value once trimmed and lower-cased.
PLACEHOLDER_NULLS = ("?", "na", "n/a", "null", "none", "", "nan", "inf", "-inf", "missing", "unknown")

# Health-score penalties per issue severity.
SEVERITY_PENALTY = {"critical": 25.0, "high": 10.0, "medium": 5.0, "low": 2.0}

# Profile thresholds.
ID_NEAR_UNIQUE_RATIO = 0.98
PROFILE_HIGH_CARDINALITY = 50

# Quality-audit thresholds.
MISSING_EXTREME_PCT = 80.0
MISSING_HIGH_PCT = 40.0
DUPLICATE_HIGH_PCT = 10.0
DUPLICATE_MEDIUM_PCT = 1.0
IMBALANCE_MAX_CLASSES = 20
IMBALANCE_MIN_CLASS_PCT = 5.0
QUALITY_HIGH_CARD_MIN = 50
QUALITY_HIGH_CARD_RATIO = 0.7
OUTLIER_MIN_VALUES = 10
OUTLIER_IQR_FACTOR = 3.0
OUTLIER_SIGMA_FACTOR = 3.0
OUTLIER_ISSUE_PCT = 0.5

# Cleaning thresholds.
CLEAN_MISSING_DROP = 0.80
CLEAN_TEXT_ID_MIN_DISTINCT = 100
CLEAN_TEXT_ID_RATIO = 0.3
CLEAN_DATE_PARSE_RATIO = 0.5
CLEAN_DATE_NAME_TOKENS = ("date", "time")
CLEAN_WINSOR_MIN_ROWS = 10
MODE_FALLBACK = "Missing"

# Notebook cleaning variant.
NOTEBOOK_DATE_NAME_TOKENS = ("date", "time", "timestamp", "day", "created", "period")
NOTEBOOK_DATE_PARSE_RATIO = 0.7
NOTEBOOK_NULL_TOKENS = ("?", "na", "n/a", "null", "none", "", "nan")

# Feature generation.
LOG_MIN_VALUES = 10
LOG_MIN_SKEW = 2.0
PAIR_MAX_COLUMNS = 4
RATIO_EPSILON = 1e-6
MAX_NEW_FEATURES = 10

# Encoding.
MAX_LOW_CARDINALITY = 12
ONEHOT_MISSING = "missing"
FREQ_NULL_TEXT = "nan"

# Leakage.
LEAKAGE_MIN_ABS_R = 0.999
LEAKAGE_MIN_PAIRS = 5
CONTAMINATION_CRITICAL_PCT = 10.0
TARGET_NAME_MIN_LEN = 3

# Exploratory statistics.
HIST_MAX_COLUMNS = 12
HIST_BINS = 30
CAT_MAX_COLUMNS = 8
CAT_TOP_N = 10
CORR_MAX_COLUMNS = 20
BOX_MAX_COLUMNS = 12
BOX_MIN_VALUES = 5
BOX_WHISKER = 1.5
TARGET_MAX_FEATURES = 6
TARGET_CAT_MAX_DISTINCT = 5
TARGET_TOP_CATEGORIES = 8
SKEW_INSIGHT_MIN_N = 5
SKEW_INSIGHT_ABS = 1.5
COLLINEAR_ABS_R = 0.75
COLLINEAR_TOP = 5
TARGET_CORR_TOP = 3

# Splitting.
RANDOM_SEED = 42
TEST_SIZE = 0.20
VAL_SIZE = 0.15
MIN_SPLIT_ROWS = 5

# Models.
KNN_NEIGHBOURS = 5
KNN_MAX_TRAIN = 10000
CLUSTER_QUALITY_SAMPLE = 2000
TOP_MODELS = 4

# Stop rule.
STOP_R2_GOOD = 0.85
STOP_R2_POOR = 0.30
STOP_ACC_GOOD = 0.90
STOP_ACC_POOR = 0.65
