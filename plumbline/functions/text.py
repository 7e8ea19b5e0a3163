"""Text normalisers and tokenisers as Column expressions. They differ on purpose; none stands for another."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace sees it, for Java's regular expressions.
SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]"
#: The same characters one by one, for trimming.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Word characters as Python's \w sees them.
WORD = r"[\p{L}\p{N}_]"

# The quotes and dashes that the normalisers fold.
_QUOTES_ANCHOR = ("‘’‛“”–—", "'''\"\"--")
_QUOTES_TEXT = ("‘’“”–— ", "''\"\"-- ")

# The two stop lists.
RELEVANCE_STOP = [
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on",
    "or", "that", "the", "this", "to", "what", "when", "where", "which", "who", "why", "with",
]
NAVIGATION_STOP = [
    "a", "an", "and", "are", "as", "at", "be", "between", "by", "consider", "contract", "does", "for", "from", "in",
    "is", "it", "of", "on", "or", "the", "this", "to", "what", "when", "where", "which", "who", "with",
]


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What casefold still changes after lower: one to one, and one to several characters."""
    one, to, several = [], [], []
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.lower() == c and (folded := c.casefold()) != c:
            if len(folded) == 1:
                one.append(c)
                to.append(folded)
            elif c != "ß":
                several.append((c, folded))
    return "".join(one), "".join(to), tuple(several)


@lru_cache(maxsize=1)
def _plain() -> str:
    """A class of the characters up to U+20FF that casefold leaves as they are once lower-cased, as ranges."""
    one, _, several = _folds()
    odd = sorted({ord(c) for c in one} | {ord(c) for c, _ in several})
    edges = [-1, *(p for p in odd if p < 0x2100), 0x2100]
    return "[" + "".join(f"\\x{{{a + 1:x}}}-\\x{{{b - 1:x}}}" for a, b in zip(edges, edges[1:], strict=False) if b - a > 1) + "]"


# Of the characters of _plain, those that nearly all texts consist of: taken off in one go, they need not be held against its many ranges.
_COMMON = r"[\x{0}-\x{b4}\x{b6}-\x{148}\x{2010}-\x{206f}]++"


def casefold(x: Column) -> Column:
    """Python's str.casefold. ASCII is lower-cased only; the rare folds and expansions are tried only on texts with
    characters that may have one."""
    one, to, several = _folds()
    low = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    uncommon = F.regexp_replace(low, _COMMON, "")
    rare = low
    for c, folded in several:
        rare = F.replace(rare, F.lit(c), F.lit(folded))
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).when(uncommon.rlike(f"^{_plain()}*+$"), low).otherwise(F.translate(rare, one, to))


def collapse(x: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


# What the anchor normaliser keeps besides single spaces, within a class of a regular expression.
_KEPT = r"""\p{L}\p{N}$%£€.,'"\-"""


def normalise_anchor(x: Column) -> Column:
    """What excerpts and sources are compared as. A run of other characters, underscores and spaces becomes one space in one pass, which
    leaves single spaces alone; ASCII has no quotes to fold."""
    folded = casefold(x)
    for c, plain in zip(*_QUOTES_ANCHOR, strict=True):
        folded = F.replace(folded, F.lit(c), F.lit(plain))
    folded = F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(folded)
    return F.trim(F.regexp_replace(folded, f"[^{_KEPT} ][^{_KEPT}]*| [^{_KEPT}]+", " "))


def normalise_text(x: Column) -> Column:
    """Folds quotes, dashes and no-break spaces, keeps punctuation, casefolds."""
    return casefold(collapse(F.translate(x, *_QUOTES_TEXT)))


def normalise_grounding(x: Column) -> Column:
    """As C2 with lower instead of casefold."""
    return F.lower(collapse(F.translate(x, *_QUOTES_TEXT)))


def match_tokens(x: Column) -> Column:
    """C4: distinct ``[a-z0-9]+`` of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), 1))


def word_tokens(x: Column) -> Column:
    """Distinct words of the casefolded text."""
    return F.array_distinct(F.regexp_extract_all(casefold(x), F.lit(f"({WORD}+)"), 1))


def emission_key(x: Column) -> Column:
    """Casefolded, all but a-z, 0-9, %, $, £, € as spaces."""
    return F.trim(F.regexp_replace(casefold(x), "[^a-z0-9%$£€]+", " "))


def merge_key(x: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(collapse(x))


def content_tokens(x: Column, stop: list[str] | None = None) -> Column:
    """Distinct ``[a-z0-9]+`` of the casefolded text without stop words."""
    found = F.array_distinct(F.regexp_extract_all(casefold(x), F.lit("([a-z0-9]+)"), 1))
    return F.array_except(found, F.array(*map(F.lit, RELEVANCE_STOP if stop is None else stop)))


def numeric_tokens(x: Column) -> Column:
    """Amounts and numbers, in order, with repeats."""
    return F.regexp_extract_all(x, F.lit(r"([$£€]?\p{Nd}[\p{Nd},.]*%?)"), 1)


def sentences_of_line(x: Column, least: int = 8) -> Column:
    """Sentences of one line, at least ``least`` characters long."""
    parts = F.split(x, r"""(?<=[.!?])\s+(?=[A-Z$£€0-9'"])""")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def sentences_of_text(x: Column, least: int = 10) -> Column:
    """C11: sentences split at line ends too, longer than ``least`` characters."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > least)


def reading_text(x: Column, comment_prefix: str = "evidence", question_marker: str = "evidence-question") -> Column:
    """Markdown as it is read: link labels, no evidence comments, no ``#``, ``*`` and backticks."""
    text = F.regexp_replace(x, r"\[([^\]]+)\]\(https?://[^\s)\"]+(?:\s+\"[^\"]*\")?\)", "$1")
    for marker in (f"{quoted(comment_prefix)}-(?:quote|locator)", quoted(question_marker)):
        text = F.regexp_replace(text, rf"(?is)\s*<!--\s*{marker}:.*?-->", "")
    return collapse(F.translate(text, "#*`", "   "))


def reflow(x: Column) -> Column:
    """Runs of blanks and tabs become one space."""
    return F.regexp_replace(x, "[ \\t]+", " ")


def node_title(x: Column, default: str, width: int = 180) -> Column:
    """C14: the collapsed text's first characters, or a default."""
    return F.coalesce(F.nullif(F.substring(collapse(x), 1, width), F.lit("")), F.lit(default))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays; null if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both)


def lexical_overlap(a: Column, b: Column) -> Column:
    """Jaccard of C5 tokens, six digits; 1 if neither has a word."""
    return F.round(F.coalesce(jaccard(word_tokens(a), word_tokens(b)), F.lit(1.0)), 6)


def quoted(value: str) -> str:
    """A literal for Java's regular expressions."""
    return re.escape(value)
