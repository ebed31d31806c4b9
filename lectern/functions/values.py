"""Fixed values that results depend on: names, limits, prices, orders. Stated as they are, in one place."""

from __future__ import annotations

# Card types, in the order in which cards of one chunk are shown.
CARD_TYPE_ORDER = {"discover": 0, "raw_commentary": 1, "passage": 2, "glossary": 3, "contrast": 4, "connect": 5, "flashcard": 6, "quiz": 7}
OTHER_TYPE_ORDER = 5
CARD_TYPES = tuple(CARD_TYPE_ORDER)

# Card types by how many distinct cards a reader has seen: up to 30, up to 80, more.
EARLY_TYPES = ("discover", "raw_commentary", "passage")
MID_TYPES = (*EARLY_TYPES, "flashcard", "glossary", "contrast")
ALL_TYPES = (*MID_TYPES, "quiz")
EARLY_LIMIT, MID_LIMIT = 30, 80

REVIEW_TYPES = ("flashcard", "quiz")
COMPANION_TYPES = ("discover", "raw_commentary", "passage", "glossary")
INTRO_TYPES = ("discover", "raw_commentary", "passage")

# Feed.
FEED_LIMIT, FEED_MAX, OVER_FETCH, RECENT_EVENTS = 10, 50, 3, 20
UNKNOWN_AFFINITY, NOVELTY = 0.7, 1.5
COOLDOWN_DAYS = {"skipped": 14, "engaged": 7, "other": 3}
MASTERED_REPETITIONS = MASTERED_ENGAGEMENTS = 3

# Engagement: milliseconds of dwell below which a card was scrolled past, or only glanced at.
GLANCE_MS, ENGAGE_MS = 1500, 4000
DWELL_GRADES = {"scrolled_past": 0, "glanced": 2, "engaged": 4}
RIGHT_GRADE, WRONG_GRADE, REVEALED_GRADE, LIKE_GRADE = 5, 1, 3, 5
BATCH_LIMIT = 50

# Spaced repetition (SM-2).
FIRST_INTERVAL, SECOND_INTERVAL, FIRST_EASE, LEAST_EASE, PASS_GRADE = 1.0, 6.0, 2.5, 1.3, 3
# Our own: due times stay within what a timestamp can hold.
REVIEWED_DAYS_LIMIT = 1_000_000.0

# Card types and every how many chunks, by document type and reading goal.
STRATEGIES = {
    ("fiction", "casual"): (("passage",), 3),
    ("fiction", "reflective"): (("discover", "passage"), 3),
    ("fiction", "study"): (("discover", "passage", "glossary"), 2),
    ("scripture", "casual"): (("passage",), 3),
    ("scripture", "reflective"): (("discover", "passage", "raw_commentary"), 1),
    ("scripture", "study"): (("discover", "passage", "raw_commentary", "glossary"), 1),
    ("book", "casual"): (("discover", "raw_commentary", "flashcard"), 3),
    ("book", "reflective"): (("discover", "raw_commentary", "flashcard"), 2),
    ("book", "study"): (("discover", "raw_commentary", "flashcard", "glossary", "contrast"), 1),
    ("manual", "casual"): (("discover", "raw_commentary", "flashcard"), 2),
    ("manual", "reflective"): (("discover", "raw_commentary", "flashcard", "quiz"), 1),
    ("manual", "study"): (("discover", "raw_commentary", "flashcard", "quiz", "glossary", "contrast"), 1),
}
LIKE_BOOK = ("book", "paper", "article", "note", "other")
DEFAULT_STRATEGY = (("discover", "raw_commentary"), 1)
TYPE_LABELS = {"discover": "Discover", "raw_commentary": "Notes", "connect": "Connect", "flashcard": "Flashcard", "quiz": "Quiz", "glossary": "Glossary", "contrast": "Contrast", "passage": "Passage"}

# Domains.
DOCUMENT_TYPES = ("book", "paper", "article", "manual", "note", "scripture", "other", "fiction")
READING_GOALS = ("casual", "reflective", "study")
STATUSES = ("pending", "preview", "chunking", "generating", "ready", "error")
PRIORITIES = {"pinned": 0, "active": 1, "normal": 2}
FEED_EVENT_TYPES = ("scrolled_past", "glanced", "engaged")
CARD_ACTIONS = ("like", "dismiss", "bookmark")
CHUNK_TYPES = ("text", "image", "code")
TOC_SECTIONS = ("front", "main", "back")

# Quotas by tier: bytes stored, cards a day.
TIER_LIMITS = {"free": (500 * 1024 * 1024, 100), "plus": (5 * 1024 * 1024 * 1024, 500)}
UPLOAD_BYTES, IMAGE_BYTES = 100 * 1024 * 1024, 10 * 1024 * 1024

# Dollars a million tokens, in and out.
MODEL_PRICES = {"gemini-2.0-flash": (0.10, 0.40), "gemini-2.0-flash-lite": (0.02, 0.10), "gemini-2.5-flash": (0.30, 2.50), "gemini-2.5-pro": (1.25, 10.00)}

# Segments and chunks.
LEAST_SEGMENT_WORDS, CHUNK_LEAST, CHUNK_MOST = 10, 200, 400
HEADING_BYTES, CAPITALS_BYTES = 80, 60
HEADING_WORDS = ("chapter ", "part ", "book ", "section ", "prologue", "epilogue", "preface", "introduction", "conclusion", "afterword", "appendix")
AI_WINDOW, AI_OVERLAP = 15, 3
SMALL_CODE_WORDS = 50
SUMMARIES_KEPT = 15

# Scheduling: cards a turn, weights, cards shown before front matter, minutes after which a lock is stale, times to try again.
QUANTUM, PRIORITY_WEIGHT, PLUS_WEIGHT, MAIN_FIRST, LOCK_MINUTES, MAX_RETRIES = 10, 3, 2, 10, 10, 3
VIRTUAL_TIME_LIMIT = 10_000
TRANSIENT_ERRORS = ("exited null", "exited 137", "exited 139", "SIGKILL|SIGTERM", "ENOMEM|ENOSPC", "ETIMEDOUT|ECONNRESET|ECONNREFUSED", "fetch failed", "rate limit", "Too Many Requests|429", "Service Unavailable|503")

# Titles of front and back matter.
FRONT_MATTER = r"copyright|dedication|foreword|preface|acknowledg|title\s*page|table\s*of\s*contents|front\s*matter|also\s*by|epigraph|half[\s-]?title|series\s*page"
BACK_MATTER = r"appendix|bibliograph|index(?:es)?|glossary|about\s*the\s*author|colophon|back\s*matter|endnotes?|references|further\s*reading|permissions|credits"

# Names of monospaced fonts; languages that a CSS class may name by itself; media types.
MONO_FONTS = ("courier", "consolas", "menlo", "monaco", "inconsolata", "source code", "sourcecodepro", "fira code", "firacode", "dejavu sans mono", "dejavusansmono", "liberation mono", "droid sans mono", "ubuntu mono", "roboto mono", "lucida console", "andale mono", "monospace")
CODE_LANGUAGES = ("python", "javascript", "typescript", "rust", "go", "java", "c", "cpp", "csharp", "ruby", "php", "swift", "kotlin", "scala", "haskell", "lua", "perl", "r", "sql", "html", "css", "xml", "json", "yaml", "toml", "bash", "shell", "sh", "zsh", "fish", "powershell")
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "jp2": "image/jp2", "bmp": "image/bmp"}

# Minutes that a document stays affine; how much a client buffers, and for how long.
AFFINITY_MINUTES = 15
FLUSH_ITEMS, FLUSH_SECONDS = 20, 10

# English words that a search leaves out.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)

# What follows the escaped letter in the formula commands that are told from written escapes; ``(?![a-z])`` ends a command.
FORMULA_COMMANDS = {
    "n": ("abla", "u(?![a-z])", "eg", "eq", "ewline", "leq", "geq", "mid", "otin", "ot(?![a-z])", "i(?![a-z])", "olimits", "onumber", "orm"),
    "t": ("imes", "heta", "au", "ext", "extbf", "extit", "extrm", "o(?![a-z])", "op", "riangle", "an(?![a-z])", "anh", "frac"),
    "b": ("eta", "inom", "ar(?![a-z])", "ig(?![a-z])", "igg(?![a-z])", "igcap", "igcup", "igvee", "igwedge", "ot(?![a-z])", "oldsymbol", "f(?![a-z])"),
    "r": ("ho", "ight(?![a-z])", "ightarrow", "angle", "ceil", "floor", "m(?![a-z])", "oot"),
    "f": ("rac", "orall", "lat", "rown"),
}
