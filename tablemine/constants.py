"""Fixed values.

Everything in this module is a value that has to equal the original
pipeline's for results to agree: word lists, sentinels, table kinds and
metric rules.  They are listed plainly and in their original order; the
operators build their patterns from them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: sentinels used at table boundaries
# ---------------------------------------------------------------------------
UNSPECIFIED = "xx"
FAILED = "<FAILED>"
NO_LINK = ""
KEY_SEP = "<|SEP|>"

# ---------------------------------------------------------------------------
# FIXED VALUES: broad preference-tuning keywords (83 terms)
# ---------------------------------------------------------------------------
KEYWORDS = [
    "RLHF", "RLAIF", "RL from human feedback", "RL from AI feedback",
    "reinforcement learning with human feedback",
    "reinforcement learning from human preferences",
    "reinforcement learning from AI preferences",
    "human preference reinforcement learning",
    "learning from human feedback", "learning from preferences",
    "Advantage Weighted Reinforcement Learning from Human Feedback",
    "AWRHF",
    "PPO", "Proximal Preference Optimization",
    "DPO", "Direct Preference Optimization",
    "IPO", "Implicit Preference Optimization",
    "f-DPO", "f-divergence Direct Preference Optimization",
    "KTO", "Kahneman-Tversky Optimization",
    "ORPO", "Odds Ratio Preference Optimization",
    "SimPO", "Simple Preference Optimization",
    "RRHF", "Rank Responses with Human Feedback",
    "CPL", "Contrastive Preference Learning",
    "RPO", "Relative Preference Optimization",
    "OPPO", "Offline Preference-guided Policy Optimization",
    "IRPO", "Iterative Reasoning Preference Optimization",
    "SLiC", "SLiC-HF", "Sequence Likelihood Calibration with Human Feedback",
    "GPO", "Generalized Preference Optimization",
    "GRPO", "Group Relative Policy Optimization",
    "Preference-aware fine-tuning", "preference-conditioned fine-tuning",
    "reward modeling", "reward model", "reward function learning",
    "preference model", "preference predictor", "preference score model",
    "human alignment", "AI alignment", "value alignment",
    "alignment tuning", "safety tuning", "instruction preference",
    "human evaluation", "feedback-based training", "feedback optimization",
    "choice modeling", "comparison-based learning",
    "instruction fine-tuning", "instruction-tuned", "prompt preference",
    "prompt-based preference", "instruction optimization", "prompt optimization",
    "human-in-the-loop tuning", "interactive preference tuning",
    "preference optimization", "preference tuning", "preference-based fine-tuning",
    "preference-based RL", "preference learning", "preference-aware training",
    "ranking-based fine-tuning", "preference signal", "preference supervision",
    "reward shaping", "policy shaping", "feedback shaping", "guided fine-tuning",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: the ten preference algorithms (abbreviation, full name)
# ---------------------------------------------------------------------------
ALGORITHMS = [
    ("DPO", "Direct Preference Optimization"),
    ("KTO", "Kahneman-Tversky Optimization"),
    ("IPO", "Implicit Preference Optimization"),
    ("SimPO", "Simple Preference Optimization"),
    ("GPO", "Generalized Preference Optimization"),
    ("SLiC-HF", "Sequence Likelihood Calibration with Human Feedback"),
    ("IRPO", "Iterative Reasoning Preference Optimization"),
    ("OPPO", "Offline Preference-guided Policy Optimization"),
    ("RPO", "Relative Preference Optimization"),
    ("ORPO", "Odds Ratio Preference Optimization"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: LaTeX block kinds searched for tables, in search order.
# "table" is a prefix (table, table*) and every hit is kept; the others are
# kept only when they hold both a tabular begin and end.
# ---------------------------------------------------------------------------
TABLE_PREFIX_KIND = "table"
WRAPPING_KINDS = ["wraptable", "sidewaystable", "figure", "center", "minipage"]

# FIXED VALUES: table rule commands removed before splitting rows
TABLE_RULES = ["\\hline", "\\bottomrule", "\\toprule", "\\midrule"]

# ---------------------------------------------------------------------------
# FIXED VALUES: metric standardisation rules
# ---------------------------------------------------------------------------
PERCENT_METRICS = ["Accuracy", "Win Rate", "Exact Match", "F1", "BLEU", "Rouge",
                   "Precision", "Recall"]
RANKING_METRICS = ["MRR"]
CORRELATION_METRICS = ["Correlation Coefficient"]
ERROR_METRICS = ["MSE", "MAE"]

# ---------------------------------------------------------------------------
# FIXED VALUES: dataset-name patterns
# ---------------------------------------------------------------------------
DIFFICULTY_WORDS = ["Easy", "Medium", "Hard", "Complex"]
VERSION_PATTERNS = [r"[-+](?:Pro|Redux|\d+\.*\d*[vV]\d+|\d+\.*\d*)", r"\+"]
EXPLICIT_ABBREV_PATTERN = r"\(([A-Z][A-Z0-9-]*)\)"
BARE_ABBREV_PATTERN = r"^[A-Z][A-Z0-9-]{1,11}$"

# ---------------------------------------------------------------------------
# FIXED VALUES: description sections and post-processing keys
# ---------------------------------------------------------------------------
DESCRIPTION_SECTIONS = ["Dataset Summary", "Task Explanation", "Subset Description"]
DEDUPE_KEY = ["dataset_name", "subset", "pref_tuning_method", "hyperparameters", "metric"]
DEDUPE_VALUE = "metric_value"

# FIXED VALUES: record fields produced by extraction, in prompt order
RECORD_FIELDS = ["value", "metric", "evaluation_method", "benchmark_or_task", "dataset",
                 "dataset_citation_tag", "subset", "base_model", "pref_tuning_method",
                 "hyperparameters", "PEFT"]

# FIXED VALUES: year folders of the source tree, keyed by id prefix
YEAR_FOLDERS = [("23", "arxiv_src_2023"), ("24", "arxiv_src_2024")]

# FIXED VALUES: budgets
TABLE_PROMPT_MAX_CHARS = 10000
CONTEXT_CHARS = 30
TITLE_F1_THRESHOLD = 0.8

