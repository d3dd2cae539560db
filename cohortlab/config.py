"""Study constants.

Fixed values that must equal the original study's for identical results are
listed together, in their natural order, under the marker below.
"""

# --- fixed values (must match the study definition) -------------------------
TD_PRIMARY = "SQALE_DEBT_RATIO"
TD_FEATURES = [
    "SQALE_DEBT_RATIO",
    "SQALE_INDEX",
    "CODE_SMELLS",
    "COMPLEXITY",
    "COGNITIVE_COMPLEXITY",
    "DUPLICATED_LINES_DENSITY",
    "NCLOC",
]
TARGET = "BIC"
MIN_COMMITS_PER_PROJECT = 50
MIN_SONAR_SNAPSHOTS = 5
TEST_SIZE_RATIO = 0.20
RANDOM_STATE = 42
FORWARD_WINDOWS_DAYS = [30, 60, 90]
PROJECT_PREFIX = "org.apache:"
THRESHOLD = 0.5

FEATURES_M0: list[str] = []
FEATURES_M1 = ["log_churn", "log_ncloc"]
FEATURES_M2 = ["SQALE_DEBT_RATIO", "log_churn", "log_ncloc", "DUPLICATED_LINES_DENSITY"]
FEATURES_M3 = ["SQALE_DEBT_RATIO", "log_churn", "log_ncloc", "DUPLICATED_LINES_DENSITY",
               "HAS_REFACTORING", "TDR_x_REF"]
FEATURES_M4 = FEATURES_M3
FEATURES_M5 = FEATURES_M3

SENSITIVITY_FEATURES = {
    "CODE_SMELLS": ["CODE_SMELLS", "log_churn", "log_ncloc"],
    "COMPLEXITY": ["COMPLEXITY", "log_churn", "log_ncloc"],
    "COGNITIVE_COMPLEXITY": ["COGNITIVE_COMPLEXITY", "log_churn", "log_ncloc"],
    "log_sqale_index": ["log_sqale_index", "log_churn", "log_ncloc"],
}

MODEL_ORDER = ["M0_dummy", "M1_lr_baseline", "M2_lr_tdr_rq1", "M3_lr_tdr_ref_rq2",
               "M4_random_forest", "M5_xgboost"]
MODEL_DISPLAY_NAMES = {
    "M0_dummy": "M0: Dummy",
    "M1_lr_baseline": "M1: LR Baseline",
    "M2_lr_tdr_rq1": "M2: LR + TDR (RQ1)",
    "M3_lr_tdr_ref_rq2": "M3: LR + TDR + Ref (RQ2)",
    "M4_random_forest": "M4: Random Forest",
    "M5_xgboost": "M5: XGBoost ★",
}
MODEL_FEATURES = {
    "M0_dummy": FEATURES_M0,
    "M1_lr_baseline": FEATURES_M1,
    "M2_lr_tdr_rq1": FEATURES_M2,
    "M3_lr_tdr_ref_rq2": FEATURES_M3,
    "M4_random_forest": FEATURES_M4,
    "M5_xgboost": FEATURES_M5,
}

LR_MAX_ITER = 1000
RF_N_ESTIMATORS = 300
RF_MAX_DEPTH = 15
RF_MIN_SAMPLES_LEAF = 50
GBT_N_ESTIMATORS = 300
GBT_MAX_DEPTH = 6
GBT_LEARNING_RATE = 0.05
GBT_SUBSAMPLE = 0.8
GBT_COLSAMPLE = 0.8

DESCRIBE_VARIABLES = ["SQALE_DEBT_RATIO", "DUPLICATED_LINES_DENSITY", "NCLOC", "CHURN",
                      "HAS_REFACTORING", "log_churn", "log_ncloc", "TDR_x_REF"]
VIF_VARIABLES = ["SQALE_DEBT_RATIO", "log_sqale_index", "CODE_SMELLS", "COMPLEXITY",
                 "COGNITIVE_COMPLEXITY", "DUPLICATED_LINES_DENSITY", "log_ncloc", "log_churn"]
CORR_VARIABLES = TD_FEATURES
ATTRIBUTION_FEATURES = ["SQALE_DEBT_RATIO", "log_churn", "log_ncloc",
                        "DUPLICATED_LINES_DENSITY", "HAS_REFACTORING", "TDR_x_REF"]
QUARTILE_LABELS = ["Q1 (Low TD)", "Q2", "Q3", "Q4 (High TD)"]
RATE_BUCKET_EDGES = [15, 8]          # percent: > 15 high, > 8 mid, else low
NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A"]
# --- end of fixed values ----------------------------------------------------
