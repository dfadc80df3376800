"""Text normalisation as column expressions.

Every step works on the whole text of one row with a built-in function, so a
corpus is normalised by one narrow ``select``: no shuffle and no Python worker.
Regular expressions run once over the text instead of once per token, and cannot
backtrack over long runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and pairs cut off a token, and the tokens that are
# dropped when nothing but punctuation is left.
PREFIX_PAIRS = ["</", "&#"]
PREFIX_CHARS = ['"', "'", "(", "<", "#", ".", "”", "“"]
SUFFIX_PAIRS = [',"', ">,", ".,", ".>", '."', "),"]
SUFFIX_CHARS = ['"', "'", ")", ">", ",", ".", "?", "!", ";", "”", "“"]
SPECIAL_TOKENS = [
    " ", ";", "/", ".", ",", '"', "\t", "#", "\u00a0", "(", ")", "[", "]", "!", "?",
    "'", ":", "&", "=", "-", "<", ">", "–", "{", "}", "\\", "...", "*", "+", "$", "@",
    "\u00a9", "\u00d7", "\u00ae", "\u00ad", "\u2028", "\u0323", "\u0300", "\u0301",
    "\u0302", "\u0303", "\u0309", "”", "“", '",', '":', ":/", '">', '=""', '="">',
    '="', '".', '?"', "=”", "=“", "”,", "”.", "“,", "“.", "〞,", "〞.", "〝,", "〝.",
    "?”.", "://", "_", "…", "’", "--",
]
MIN_TOKENS = 20


def _one_of(strings: Sequence[str]) -> str:
    return "|".join(re.escape(s) for s in strings)


_CONTROL_CHARS = "".join(map(chr, range(0x21)))
_PREFIX = "[" + "".join(map(re.escape, PREFIX_CHARS)) + "]"
_SUFFIX = "[" + "".join(map(re.escape, SUFFIX_CHARS)) + "]"

# Words stand between blanks. At the head of a word: a word of one character, or
# a pair and a character to cut. At its tail: a character and a pair, from the
# inside out. Both start with a cheap test, since most positions match neither.
_HEAD = rf" (?:[^ ](?= )|(?:{_one_of(PREFIX_PAIRS)}){_PREFIX}?|{_PREFIX})"
_TAIL = rf"(?={_SUFFIX})(?:{_SUFFIX}?(?:{_one_of(SUFFIX_PAIRS)})|{_SUFFIX}) "


def split_lines(text: Column) -> Column:
    """Lines of a text in document order, without their terminators."""
    return F.split(text, r"\r\n|\r|\n")


def trim_controls(line: Column) -> Column:
    """Strip every character up to U+0020 at both ends."""
    return F.btrim(line, F.lit(_CONTROL_CHARS))


def lower_lines(text: Column) -> Column:
    """Lower-cased, trimmed lines; a two-character line end adds an empty line."""
    return F.transform(F.split(F.lower(text), "[\r\n]"), trim_controls)


def words(line: Column) -> Column:
    """Split on blanks only; a tab stays inside its word."""
    return F.filter(F.split(line, " "), lambda w: w != "")


def trimmed_words(text: Column) -> Column:
    """Words of a text without those of one character, affixes cut.

    At most one pair and one character are cut off each end. Words made only of
    affixes come back empty.
    """
    padded = F.concat(F.lit(" "), F.array_join(lower_lines(text), " "), F.lit(" "))
    return F.split(F.regexp_replace(F.regexp_replace(padded, _HEAD, " "), _TAIL, " "), " ")


def keep_content_words(tokens: Column, stopwords: Sequence[str] = ()) -> Column:
    """Drop empty tokens, punctuation tokens and stopwords (exact equality)."""
    dropped = list(dict.fromkeys(["", *SPECIAL_TOKENS, *stopwords]))
    return F.filter(tokens, lambda t: ~t.isin(dropped))


def text_tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Normalised token sequence of a whole raw text."""
    return keep_content_words(trimmed_words(text), stopwords)


def content_tokens(content: Column) -> Column:
    """Tokens of stored content, one per line.

    Inner empty lines are tokens, trailing ones are not; an empty content is one
    empty token, as splitting an empty string gives one part.
    """
    kept = F.regexp_replace(content, r"(?<!\n)\n++\z", "")
    nothing_left = (F.length(content) > 0) & (F.length(F.translate(content, "\n", "")) == 0)
    return F.when(nothing_left, F.array().cast("array<string>")).otherwise(F.split(kept, "\n"))


def token_content(tokens: Column) -> Column:
    """Stored form of a token sequence."""
    return F.array_join(tokens, "\n")
