"""Label vocabularies, taxonomy, thresholds, prompt parts.

Everything in this module is data that results depend on (order included), so
it is stated literally.  Operators take these as default arguments only.
"""

# The 28 fine labels; the position is the label id.
LABELS28 = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring",
    "confusion", "curiosity", "desire", "disappointment", "disapproval",
    "disgust", "embarrassment", "excitement", "fear", "gratitude", "grief",
    "joy", "love", "nervousness", "optimism", "pride", "realization",
    "relief", "remorse", "sadness", "surprise", "neutral",
]

# The 7 coarse labels in roll-up order.
COARSE7 = ["anger", "disgust", "fear", "joy", "sadness", "surprise", "neutral"]

# The 7 dialogue labels; the position is the label id.
DIALOGUE7 = ["neutral", "joy", "surprise", "anger", "sadness", "disgust", "fear"]

# Coarse label -> the fine labels it covers.
TAXONOMY = {
    "anger": ["anger", "annoyance", "disapproval"],
    "disgust": ["disgust"],
    "fear": ["fear", "nervousness"],
    "joy": ["joy", "amusement", "approval", "excitement", "gratitude", "love",
            "optimism", "relief", "pride", "admiration", "desire", "caring"],
    "sadness": ["sadness", "disappointment", "embarrassment", "grief", "remorse"],
    "surprise": ["surprise", "realization", "confusion", "curiosity"],
    "neutral": ["neutral"],
}

# Thresholds, chunk geometry, defaults.
LABEL_THRESHOLD = 0.3       # >= when labelling a corpus, > in sample predictions
EVAL_THRESHOLD = 0.5        # > in evaluation
CHUNK_SIZE = 400
CHUNK_OVERLAP = 50
VOCAB_SIZE = 8000
SPECIAL_TOKENS = ["<unk>", "<s>", "</s>"]
PARAM_DEFAULTS = {"batch_size": 16, "dropout": 0.1, "weight_decay": 0.01}
INVALID = "invalid"
NEUTRAL = "neutral"

# Candidate names of the text column, first hit wins.
TEXT_CANDIDATES_LABELLING = ["text", "speech", "transcript", "content", "Speech", "Text", "Transcript"]
TEXT_CANDIDATES_EVALUATION = ["speech", "text", "content"]
TEXT_CANDIDATES_ADAPTATION = ["speech", "Speech", "transcript", "Transcript", "text", "Text", "content"]

# The few-shot examples and the format of one prompt block.
PROMPT_SHOTS = [
    ("I've never felt worse.", "sadness"),
    ("This is the best day ever!", "joy"),
    ("Wow! I can't believe it!", "surprise"),
    ("That's so rude!", "anger"),
]
PROMPT_BLOCK = 'Sentence: "{sentence}"\nAllowed emotions: {allowed}\nEmotion ='

# Measured bytes up to which a table of tokens is broadcast, and the overhead of a broadcast row.
BROADCAST_BYTES = 128 * 1024 * 1024
ROW_BYTES = 64
