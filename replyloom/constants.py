"""Column names, taxonomy, keyword tables, word lists and default settings."""

from __future__ import annotations

# --- Fixed values: message columns -------------------------------------------------------------------------
MESSAGE_COLUMNS = (
    "tweet_id",
    "author_id",
    "inbound",
    "created_at",
    "text",
    "response_tweet_id",
    "in_response_to_tweet_id",
)
ID_COLUMNS = ("tweet_id", "author_id", "response_tweet_id", "in_response_to_tweet_id")
LINK_COLUMNS = ("response_tweet_id", "in_response_to_tweet_id")
PAIR_COLUMNS = (
    "conversation_id",
    "customer_tweet_id",
    "response_tweet_id",
    "tweet_ids",
    "customer_message",
    "support_response",
    "customer_created_at",
    "response_created_at",
    "created_at",
    "turn",
)
WORKSHEET_COLUMNS = ("conversation_id", "tweet_id", "created_at", "author_id", "text")

# --- Fixed values: default settings ------------------------------------------------------------------------
SEED = 42
TOP_AUTHORS = 25
TOP_TERMS = 15
TOP_BIGRAMS = 10
TOP_TOPIC_PAIRS = 8
THREAD_HISTOGRAM_MAX = 20
VAL_RATIO = 0.15
TEST_RATIO = 0.15
FOLDS = 5
CONFIDENCE_THRESHOLD = 0.60
ERROR_TEXT_CHARS = 160
EMBEDDING_DIM = 384
OTHER = "other"
TEXT_GRID = tuple(
    {"C": c, "class_weight": cw, "min_df": md}
    for c in (0.01, 0.1, 1.0, 10.0)
    for cw in (None, "balanced")
    for md in (1, 2)
)
VECTOR_GRID = tuple({"C": c, "class_weight": cw} for c in (0.1, 1.0, 10.0, 100.0) for cw in (None, "balanced"))

# --- Fixed values: message length buckets (label, low, high) -----------------------------------------------
MESSAGE_BUCKETS = (
    ("1-25", 1, 25),
    ("26-50", 26, 50),
    ("51-75", 51, 75),
    ("76-100", 76, 100),
    ("101-150", 101, 150),
    ("151-200", 151, 200),
    ("201+", 201, None),
)

# --- Fixed values: intent taxonomy (label, name, signals, typically escalated), in report order -------------
TAXONOMY = (
    (
        "software_bug",
        "Software / OS bug",
        ("update", "ios", "macos", "bug", "glitch", "crash", "freeze", "frozen", "stuck", "lag", "slow", "app",
         "restart", "reboot"),
        False,
    ),
    (
        "device_hardware",
        "Device / hardware fault",
        ("screen", "battery", "broke", "broken", "button", "water", "camera", "speaker", "charger", "charging",
         "drop", "dead", "wont turn on", "black screen", "crack"),
        False,
    ),
    (
        "account_icloud",
        "Account / Apple ID / iCloud",
        ("apple id", "password", "sign in", "login", "verification code", "2fa", "icloud", "backup", "sync",
         "storage full", "restore"),
        False,
    ),
    (
        "connectivity",
        "Connectivity",
        ("wifi", "wi-fi", "bluetooth", "signal", "cellular", "network", "internet", "hotspot", "airdrop",
         "connect", "no sim"),
        False,
    ),
    (
        "billing_purchases",
        "Billing / purchases / orders",
        ("charge", "charged", "bill", "invoice", "refund", "money back", "purchase", "bought", "subscription",
         "trial", "order", "delivery", "shipping", "tracking"),
        True,
    ),
    (
        "repair_warranty",
        "Repair / warranty",
        ("warranty", "repair", "replace", "replacement", "genius bar", "out of warranty", "service"),
        True,
    ),
    (
        "security_privacy",
        "Security / privacy",
        ("phishing", "scam", "hack", "hacked", "stolen", "compromised", "suspicious", "fake email", "fake text",
         "spam", "privacy"),
        True,
    ),
    (
        "general_complaint",
        "General complaint / venting",
        ("angry venting", "sarcasm", "brand criticism", "switching to competitor",
         "no concrete symptom mentioned"),
        False,
    ),
    (
        "support_process",
        "Support-process problem",
        ("speak to a person", "actual person", "call me", "human", "automated answer", "support page",
         "no one answers"),
        True,
    ),
    (
        "other",
        "Other / out of scope",
        ("pre-sales question", "discount", "availability", "ambiguous", "off-topic"),
        True,
    ),
)
LABELS = tuple(row[0] for row in TAXONOMY)

# --- Fixed values: keyword topics, in priority order (topic, label, keywords) -------------------------------
TOPICS = (
    (
        "Account / Apple ID",
        "account_icloud",
        ("apple id", "password", "passcode", "sign in", "sign-in", "login", "log in", "log-in", "account",
         "verification code", "verify", "two factor", "2fa"),
    ),
    (
        "iCloud / Backup",
        "account_icloud",
        ("icloud", "backup", "back up", "backed up", "cloud", "sync", "storage full", "restore"),
    ),
    (
        "Billing / Payments",
        "billing_purchases",
        ("bill", "billing", "charge", "charged", "payment", "card", "invoice", "receipt", "credit",
         "double charg", "overcharg"),
    ),
    (
        "Refunds / Purchases",
        "billing_purchases",
        ("refund", "money back", "purchase", "bought", "paid", "in-app", "in app", "app store purchase"),
    ),
    (
        "Subscriptions",
        "billing_purchases",
        ("subscription", "subscribe", "apple music", "apple tv", "applecare", "trial", "renewal", "renew"),
    ),
    (
        "Device / Hardware",
        "device_hardware",
        ("screen", "battery", "crack", "broke", "broken", "button", "water", "camera", "speaker", "microphone",
         "charger", "charging port", "headphone", "drop", "dropped", "dead", "wont turn on", "won't turn on",
         "black screen"),
    ),
    (
        "Software / Apps",
        "software_bug",
        ("update", "updated", "upgrade", "ios", "ipados", "macos", "bug", "glitch", "crash", "crashing",
         "frozen", "froze", "freeze", "hang", "stuck", "app", "reset", "reboot", "restart"),
    ),
    (
        "Connectivity",
        "connectivity",
        ("wifi", "wi-fi", "wi fi", "network", "internet", "bluetooth", "pair", "connect", "connection",
         "signal", "cellular", "hotspot", "airdrop"),
    ),
    (
        "Repair / Warranty",
        "repair_warranty",
        ("warranty", "repair", "replace", "replacement", "genius bar", "genius", "service", "out of warranty"),
    ),
    (
        "Order / Delivery",
        "billing_purchases",
        ("order", "delivery", "deliver", "ship", "shipping", "shipped", "tracking", "track", "arrive",
         "package", "parcel", "dispatch"),
    ),
    (
        "Security / Privacy",
        "security_privacy",
        ("phishing", "scam", "fraud", "hack", "hacked", "hacker", "stolen", "steal", "stole", "compromised",
         "suspicious", "fake email", "fake text", "spam", "privacy"),
    ),
)

# --- Fixed values: characters stripped from token edges, and words left out of the term lists ---------------
TOKEN_EDGE_CHARS = ".,!?;:'\"()[]{}…—-"
DISPLAY_STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "your", "youre", "youve", "with", "that", "this", "have",
    "from", "they", "them", "their", "there", "here", "what", "when", "where", "which", "while", "will", "just",
    "would", "could", "should", "than", "then", "been", "being", "were", "was", "has", "had", "does", "did",
    "doing", "into", "onto", "over", "under", "again", "more", "most", "some", "such", "only", "very", "much",
    "many", "also", "because", "about", "after", "before", "between", "through", "during", "above", "below", "both",
    "each", "few", "other", "same", "own", "too", "can", "cant", "cannot", "how", "why", "who", "whom", "its",
    "it's", "im", "ive", "id", "ill", "my", "me", "we", "our", "ours", "us", "he", "him", "his", "she", "her",
    "hers", "get", "got", "getting", "go", "going", "want", "wants", "need", "needs", "like", "know", "really",
    "still", "even", "ever", "never", "always", "please", "pls", "plz", "thanks", "thank", "thx", "hey", "hi",
    "hello", "sorry", "help", "back", "one", "two", "let", "lets", "try", "tried", "trying", "see", "look", "looks",
    "way", "thing", "things", "stuff", "anyone", "anybody", "someone", "somebody", "guys", "via", "dm", "pms",
    "now", "all", "any", "anything", "something", "nothing", "everything", "else", "without", "within", "per",
)
