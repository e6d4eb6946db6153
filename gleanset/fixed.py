"""Values that results depend on literally.

Everything here is a FIXED VALUE: the output of a run is only right when these
strings and numbers are exactly the ones below.  No logic lives in this module.
"""

# fixed values: instruction and system text attached to every record
INSTRUCTION = "What is the sentiment of this? Please choose an answer from {negative/neutral/positive}."
SYSTEM_PROMPT = "You are a precise financial sentiment analysis assistant. Analyze the provided text and classify its sentiment as positive, negative, or neutral, according to the user's instruction."

# fixed values: the closed label set, in metric order, and the marker for answers without a label
LABELS = ("negative", "neutral", "positive")
UNPARSEABLE = "unparseable"

# fixed values: source labels that fold into each of the three labels
LABEL_TERMS = {
    "positive": ("positive", "moderately positive", "mildly positive", "strong positive"),
    "negative": ("negative", "moderately negative", "mildly negative", "strong negative"),
    "neutral": ("neutral",),
}

# fixed values: integer codes of the second-language source
SENTIMENT_CODES = {0: "negative", 1: "neutral", 2: "positive"}
TOPIC_CODES = {0: "lecturer", 1: "training_program", 2: "facility", 3: "others"}

# fixed values: the second-language sentence known to carry contradicting labels
CONTRADICTED_SENTENCES = ("thầy dạy hay , tuy nhiên còn nhiều chỗ chưa thu hút .",)

# fixed values: quotas, thresholds and the seed
SEED = 42
EN_TRAIN_ROWS, EN_EVAL_ROWS, EN_MIN_WORDS = 3000, 250, 3
VI_TRAIN_ROWS, VI_EVAL_ROWS, VI_MIN_WORDS = 3000, 250, 2
SYNTHETIC_ROWS, SYNTHETIC_ATTEMPT_TARGET, ATTEMPTS_PER_PROMPT = 500, 800, 5
SNIPPET_MIN_WORDS, SNIPPET_MAX_WORDS = 4, 80
SHARE_FLOOR, LONG_TEXT_WORDS, SHORT_TEXT_WORDS = 0.1, 500, 5
HISTOGRAM_BINS = 50
