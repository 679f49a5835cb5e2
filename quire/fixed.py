"""Values that must equal the behaviour being reproduced.

Everything in this module is a fixed value (a constant, a character class or a
literal marker) whose exact content decides whether results match.  They are
kept together and in their natural order on purpose.
"""

# --- fixed values -----------------------------------------------------------

# Block repair: lower-case letters that let a hyphenated line end join the next
# block (ASCII a-z plus these accented letters, in this order).
HYPHEN_JOIN_LOWER = "a-záàâãéêíóôõúç"
# Characters that end a sentence, optionally followed by one closing quote.
SENTENCE_END_CHARS = ":.!?…"
SENTENCE_END_QUOTES = "\"'”’"
# A lone closing double quote also ends a sentence.
SENTENCE_END_ALONE = "\"”"
# A heading is 1 to 6 '#' followed by whitespace.
HEADING_MAX_LEVEL = 6
# Image marker produced by div replacement; never joined to its neighbours.
IMAGE_MARKER = "[IMAGE]"
# Separator used between pages, blocks and abstracts.
BLANK_LINE = "\n\n"

# Chunk compression target: int(len(chunk) * 0.10), i.e. a tenth.
TARGET_DIVISOR = 10

# Summary cleaning (evaluation): headings removed with their newline, then the
# text is cut at the first keyword marker (Portuguese marker wins).
SUMMARY_HEADINGS = ("Resumo do livro:\n", "Book Summary:\n")
KEYWORD_MARKERS = ("Palavras-chave", "Keywords")

# Evaluation layout.
SKIP_LANGUAGE_DIRS = ("do_not_use",)
REFERENCE_PROVIDER = "human"
SUMMARY_FILENAME = "summary.txt"
# Language folder name (lower-cased) -> code; anything else is "en".
LANGUAGE_CODES = {"english": "en", "spanish": "es", "italian": "it"}
DEFAULT_LANGUAGE_CODE = "en"

# Output kinds and the two summary variants.
KIND_ABSTRACTS = "abstract_contents"
KIND_SUMMARY = "summary"
KIND_SUMMARY_NO_INTRO = "summary_without_intro"
KIND_KEYWORDS = "keywords"
KIND_CATEGORIES = "categories"
SUMMARY_KINDS = (KIND_SUMMARY, KIND_SUMMARY_NO_INTRO)

# Model call retry policy: transient HTTP codes, transient exception-name parts,
# wait = 5 * 2 ** min(attempt, 5) seconds.
RETRYABLE_STATUS_CODES = (429, 500, 502, 503, 504)
RETRYABLE_NAME_PARTS = ("Connection", "Timeout", "Network")
RETRY_BASE_SECONDS = 5
RETRY_MAX_DOUBLINGS = 5

# OCR page files: "<anything>_<digits>.md"; files starting with this prefix are
# merged outputs, not pages.
PAGE_ID_PATTERN = r"_(\d+)\.md$"
MERGED_PREFIX = "merged"
CACHED_CONTENT_FILE = "book_content.md"

# --- end of fixed values ----------------------------------------------------


def python_whitespace() -> str:
    """Characters ``str.strip()`` removes, derived from ``str.isspace``."""
    return "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


WHITESPACE = python_whitespace()


def java_class_body(chars: str) -> str:
    """Escape characters for use inside a Java regex character class."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


def re2_class_body(chars: str) -> str:
    """Escape characters for use inside an RE2 (DuckDB) character class."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


# Word characters as Python's Unicode ``\w`` sees them (letters, numbers, _).
WORD_CLASS = r"\p{L}\p{N}_"

# Markup patterns (fixed values)
DIV_PATTERN = r"<div[^>]*>.*?</div>"
ALT_PATTERN = r'(?iu)alt="([^"]+)"'
TABLE_PATTERN = r"<table[^>]*>.*?</table>"

# Columns of the score table, in order (fixed values)
SCORE_COLUMNS = ["bert_precision", "bert_recall", "bert_f1", "rouge1_p", "rouge1_r", "rouge1_f",
                 "rouge2_p", "rouge2_r", "rouge2_f", "rougeL_p", "rougeL_r", "rougeL_f"]
