"""Text cleaning and tokens as column expressions. The order of the steps matters: punctuation goes before stop
words, so `don't` becomes `dont` and stays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.stopwords import stopword_pattern, whole_stopword_pattern

# What each step removes. `(?U)` makes \s and \S Unicode-aware. An e-mail match always covers the
# whole run between spaces, so matching starts at run starts only: that keeps the time linear on long runs.
URL = r"(?U)https?://\S+|www\.\S+"
EMAIL = r"(?U)(?<!\S)\S+@\S+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
DIGITS = r"\p{Nd}+"
# Everything but the Latin blocks U+0000-024F (ASCII, Latin-1, Extended-A, Extended-B) and U+1E00-1EFF (Extended
# Additional). Written as what to remove: the negated class costs ten times as much in Java.
NON_LATIN = r"[ɐ-᷿ἀ-\x{10FFFF}]"
SPACES = r"(?U)\s+"
# Both in one class: digits outside ASCII lie outside the Latin blocks as well.
DIGITS_AND_NON_LATIN = r"[0-9ɐ-᷿ἀ-\x{10FFFF}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_urls(c):
    return F.regexp_replace(_col(c), URL, "")


def strip_emails(c):
    return F.regexp_replace(_col(c), EMAIL, "")


def strip_punctuation(c):
    return F.regexp_replace(_col(c), PUNCTUATION, "")


def strip_stopwords(c, pattern: str | None = None):
    return F.regexp_replace(_col(c), pattern or stopword_pattern(), "")


def strip_digits(c):
    return F.regexp_replace(_col(c), DIGITS, "")


def strip_non_latin(c):
    return F.regexp_replace(_col(c), NON_LATIN, "")


def collapse_spaces(c):
    return F.trim(F.regexp_replace(_col(c), SPACES, " "))


def split_tokens(c):
    return F.split(_col(c), " ")


def keep_long_tokens(tokens, min_length: int = 2):
    """Drop empty and short tokens; length is in characters."""
    return F.filter(_col(tokens), lambda t: F.length(t) >= min_length)


def without_links(c):
    """Lower case, without URLs, e-mail addresses and ASCII punctuation."""
    return strip_punctuation(strip_emails(strip_urls(F.lower(_col(c)))))


def tokens(c, pattern: str | None = None) -> Column:
    """Clean text and split it. Digits and non-Latin characters go in one pass, and splitting on runs of spaces
    stands for collapse, trim and split: the empty tokens at the ends are dropped with the short ones."""
    words = strip_stopwords(without_links(c), pattern)
    letters = F.regexp_replace(words, DIGITS_AND_NON_LATIN, "")
    return keep_long_tokens(F.split(letters, SPACES))


def clean_and_tokenize(
    df: DataFrame, columns: str | list[str], pattern: str | None = None, suffix: str | None = "_tokens"
) -> DataFrame:
    """Add `<column>_tokens` (or replace the column, with `suffix=None`) and drop rows whose text is null."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    pattern = pattern or stopword_pattern()
    named = {f"{c}{suffix or ''}": tokens(c, pattern) for c in columns}
    return df.na.drop(subset=columns).withColumns(named)


def clean_tokens_reduced(c, pattern: str | None = None) -> Column:
    """Short chain: digits, non-Latin letters and short tokens stay; so does the empty token of an empty text."""
    return split_tokens(collapse_spaces(strip_stopwords(without_links(c), pattern)))


def clean_tokens_strict(c, pattern: str | None = None) -> Column:
    """Only alphabetic tokens of three or more letters."""
    return F.filter(tokens(c, pattern), lambda t: (F.length(t) > 2) & t.rlike(r"^\p{L}+$"))


def clean_tokens_by_predicate(c, words: Iterable[str] | None = None) -> Column:
    """Judge each space-separated token as a whole: links, addresses, stop words and pure punctuation go, other
    tokens keep their punctuation and repeated tokens stay."""
    stop = whole_stopword_pattern(words)
    parts = F.split(F.lower(_col(c)), SPACES)
    return F.filter(
        parts,
        lambda t: (F.length(t) > 0)
        & ~t.rlike(r"^(?:https?://|www\.).")
        & ~t.rlike(r"^[^@]+@[^@]+$")
        & ~t.rlike(r"^[!-/:-@\[-`{-~]+$")
        & ~t.rlike(stop),
    )


def explode_tokens(df: DataFrame, tokens: Column | str, keep: tuple[str, ...] = (), name: str = "token") -> DataFrame:
    """One row per token. From a plain `explode` Spark infers a filter on the list and pushes it below its
    computation, which would clean every text twice; the outer form with a filter behind it does not."""
    exploded = df.select(*keep, F.explode_outer(tokens).alias(name))
    return exploded.where(F.col(name).isNotNull())
