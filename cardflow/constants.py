"""Fixed values. Results only agree with the specification when these are used as they stand."""

# Channel codes expanded into one share column each.
CHANNEL_CODES = [
    "0097", "0056", "0025", "0006", "0053", "0003", "0018",
    "9999", "0001", "0052", "8100", "0116", "0029", "0038",
]

# Channels flagged on the last row of a card.
LAST_ROW_CHANNELS = ["0097", "0056", "0006", "0053"]

# Clearing types and the cash category.
INTERBANK = "interbank_txn"
ON_US = "on_us_bank_txn"
CASH_CATEGORY = "01"

# Second look-backs: tag -> seconds before the card's last transaction.
SECOND_LOOKBACKS = {"h1": 3600, "h6": 21600, "h24": 86400}
DAY_LOOKBACKS = [1, 3, 7]

# Code expansion limits.
TOP_SUMMARY_CODES = 15
COVERAGE_FLOOR = 300
MAX_SUMMARY_CODES = 80
MAX_CHANNEL_CODES = 40

# Exposure encoding.
N_FOLDS = 5
FOLD_SEED = 42
LOW_DEGREE_LIMIT = 100
ACCOUNT_VARIANTS = ["aa", "ao", "ai", "aol", "aop"]
NAME_VARIANTS = ["na", "no", "nol"]
EXPOSURE_STATS = ["nf_max", "ncp_f1", "ncp_f2", "rate_max", "rate_wavg", "amt_f", "txnf_share"]

# Silence.
SILENCE_CAP_DAYS = 32
SILENCE_BINS = 20
SILENCE_COLUMNS = [
    "sil_days", "sil_hours", "sil_beyond_norm", "first_sil_days",
    "last_hour", "last_wd", "last_is_bizhour", "last_is_deepnight",
    "ntxn_x_sil", "ntxn_div_sil", "insum_x_sil", "bal_x_sil",
    "t1share_x_sil", "t3share_x_sil", "netflow_x_sil", "retention_x_sil",
    "txnrate_x_sil", "sil_div_span",
    "sil_pct_in_ntxn_bin", "ntxn_pct_in_sil_bin",
    "bal_pct_in_sil_bin", "insum_pct_in_sil_bin",
]

# Account and balance columns, in the order the model matrix needs.
ACCOUNT_COLUMNS = [
    "AB_acc_in_hhi", "AB_primary_in_share", "AB_acc_out_hhi", "AB_primary_out_share",
    "AB_relresid_after_mean", "AB_acc_resid_best_p90_mean", "AB_resid_after_p90",
]

WEALTH_COLUMNS = ["in_vs_aum", "bal_vs_aum", "inmax_vs_aum", "in_retention", "sender_per_in"]
FREQUENCY_COLUMNS = [
    "crdisu_lvl1_insid", "crdisu_lvl2_insid", "gender", "marital_status", "occupation", "industry",
]

# Scoring.
TOP_FRACTION = 0.01
RULE_SILENCE_DAYS = 32
