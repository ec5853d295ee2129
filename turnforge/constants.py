"""Fixed values.

These must equal the values the original pipeline uses for results to agree
(markers, keys, sampling parameters, budgets).  They are stated plainly here,
together, in their natural order.
"""

# --- fixed values -----------------------------------------------------------
END_MARKER = "END_OF_DIALOGUE"

LANGUAGES = ["chinese", "english", "french", "german", "portuguese", "spanish"]

ISSUE_KEYS = [
    "uninterpretable",
    "unsafe",
    "lacks_empathy",
    "lacks_commonsense",
    "repetitive",
    "incoherent",
    "irrelevant",
    "nonfactual",
    "other",
]
RATING_KEY = "overall_quality_rating"

STARTER_PARAMS = {"temperature": 1.5, "top_p": 1.0, "frequency_penalty": 1.0,
                  "presence_penalty": 0.6, "max_tokens": 1024}
STARTER_VERDICT_PARAMS = {"temperature": 0.1, "max_tokens": 64}
USER_TURN_PARAMS = {"temperature": 0.9, "top_p": 0.95, "frequency_penalty": 1.0,
                    "presence_penalty": 0.6, "max_tokens": 512}
TURN_VERDICT_MODEL = "verdict-model"
TURN_VERDICT_PARAMS = {"temperature": 0.1, "top_p": 0.95, "frequency_penalty": 1.0,
                       "presence_penalty": 0.6, "max_tokens": 512}
JUDGE_PARAMS = {"temperature": 0.0, "top_p": 1.0, "max_tokens": 2048}

MAX_STARTER_ROUNDS = 10
MAX_TURN_ROUNDS = 5
MAX_TRIES = 5

COMPAT_COMPLETION_ALLOWANCE = 15

LANG_LINE = "\nLanguage/Culture: "

CHAT_URL = "/v1/chat/completions"
TYPED_PARTS_MODEL_TAG = "gemma-3"
# -----------------------------------------------------------------------------
