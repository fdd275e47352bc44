"""Values of the curation pipeline; validated where a user may change them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# Markers, word lists, patterns and thresholds that results depend on.
BOILERPLATE_EXACT = (
    "<<< begin of text >>>",
    "<<< end of text >>>",
    "*** start of this project gutenberg ebook",
    "*** end of this project gutenberg ebook",
    "*** start of the project gutenberg ebook",
    "*** end of the project gutenberg ebook",
)
BOILERPLATE_PREFIXES = ("*** start of", "*** end of", "article url:", "source:", "category:", "tags:", "title:", "url:")
CONTROL = r"[\x{fffd}\x{feff}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
CODE_SYMBOLS = "{}[]<>=\\_"
CODE_KEYWORDS = (
    "def", "elif", "except", "finally", "lambda", "self", "yield", "assert", "const", "async", "await", "typeof", "instanceof", "undefined",
    "prototype", "require", "void", "boolean", "namespace", "implements", "extends", "override", "abstract", "virtual", "protected", "struct",
    "enum", "sizeof", "typedef", "goto", "template", "inline", "volatile", "extern", "register", "println", "printf", "malloc", "nullptr",
    "stdin", "stdout", "argv", "argc", "endl", "iostream", "strcmp",
)
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "of", "for", "with", "is", "was", "are", "were", "it", "that", "this", "as",
    "from", "be", "by", "have", "had", "has", "not", "he", "she", "they", "we", "you", "i", "his", "her", "their", "its", "my", "our", "your",
)
FENCE = r"(?i)```|~~~|<code>|</code>|&lt;/?code&gt;"
CODE_WORD = r"\b(def|function|public|private|package|namespace|var|let|const|struct|enum)\b"
BRACKET_LINE = r"^\s*[\[\{]|^[\]\}]\s*[,;]?\s*$"
QUERY_LINE = r"^(SELECT |INSERT |UPDATE |DELETE |CREATE TABLE|DROP )"
COMMENT_LINE = r"^(#include|#!|//|/\*|\*/|\$)"
HEADING = r"(?m)^[A-Z][A-Z\s]{4,40}$"
ARTIFACTS = (
    ("html", r"</?[a-zA-Z][^>]{0,200}>"), ("code", r"(?s)```.+?```|<code>|</code>|&lt;code&gt;"), ("header", r"(?im)^(title|category|comments?|permalink|posted by|tags):"),
    ("stacktrace", r"(?i)Traceback \(most recent call last\)|Exception in thread"), ("non_ascii", r"[^\t\n\r\x20-\x7e]"),
)
SOCIAL = r"(?i)\b(retweet|rt\b|hashtag|upvote|downvote|karma|subreddit|tweet|follow us|subscribe|like and share|click here)\b"
LEGAL = r"(?i)\b(all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|copyright \d{4}|disclaimer)\b"
OLD_CHECKPOINT = r"^\d+_epoch_\d+_step$"
MAX_HTML, MAX_SYMBOLS, MAX_KEYWORDS = 0.02, 0.10, 3
MIN_WORDS, MIN_CHARS, MAX_WORD, REPEAT_WORDS, MAX_REPEATS = 50, 200, 40, 10, 3
MAX_ELLIPSIS = 0.1
SHINGLE, PERMUTATIONS, BANDS, EMPTY_HASH = 5, 16, 4, 2**32 - 1
#: Least similarity of near-duplicates where it is verified.
SIMILAR = 0.8
OVERLAP_CHARS, MAX_OVERLAP = 13, 0.8
TOKENS_PER_DOC, ATTRITION, SHARD_DOCS = 1085, 0.30, 50_000
FULL_CORPUS_DOCS = 8_013_769
NO_WORDS_LOG_PROB = -20.0

#: Modulus and coefficients of the min-hash family (a * h + b) mod PRIME; with 28-bit h they stay within a long.
PRIME = 2**31 - 1
HASHES = tuple((1 + (7919 * (i + 1) * 104729) % (PRIME - 1), (15485863 * (i + 1)) % PRIME) for i in range(PERMUTATIONS))


@dataclass(frozen=True)
class Config:
    """What one run of the pipeline does. Unknown keys are left out by of()."""

    seed: int = 42
    language: str = "en"
    min_confidence: float = 0.8
    min_tokens: int = 64
    context_length: int = 1024
    val_ratio: float = 0.01
    filter_mode: str = "heuristic"
    skip: frozenset[str] = frozenset()
    topic_distribution: dict[str, float] = field(default_factory=lambda: {"web_news": 0.34, "encyclopedia": 0.33, "forum_threads": 0.33})
    topic_classes: tuple[str, ...] = ("web_news", "encyclopedia", "forum_threads", "product_reviews")

    def __post_init__(self):
        if self.filter_mode not in ("none", "heuristic", "classifier"):
            raise ValueError(f"filter_mode: {self.filter_mode}")
        if not 0 < self.val_ratio < 1 or self.context_length < 1 or self.min_tokens < 0 or not 0 <= self.min_confidence <= 1:
            raise ValueError("a value is out of its range")
        if self.topic_distribution:
            if sum(self.topic_distribution.values()) <= 0:
                raise ValueError("topic_distribution must have a positive sum")
            if extra := set(self.topic_distribution) - set(self.topic_classes):
                raise ValueError(f"topic_distribution has classes that are not kept: {sorted(extra)}")

    @classmethod
    def of(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in values.items() if k in known})


