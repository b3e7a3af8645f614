"""Eleven statistics per text column, on the raw text.

Missing text counts as the one-letter text ``m``. Ratios without words are null.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.text import words
from riskframe.functions.wordlists import STOP_WORDS

MISSING_TEXT = "m"
UPPER_WORD = r"^[^\p{IsLowercase}\p{Lt}]*\p{IsUppercase}[^\p{IsLowercase}\p{Lt}]*$"
# A title word has a cased letter, no lower-case letter without a cased one before it, and no
# upper-case or title letter after a cased one. Flat patterns: a repeated group would recurse once
# for every letter of a long word.
CASED = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"
NOT_TITLE = rf"(?<!{CASED})\p{{IsLowercase}}|(?<={CASED})[\p{{IsUppercase}}\p{{Lt}}]"


def word_count(w: Column) -> Column:
    return F.size(w).cast("long")


def unique_word_count(w: Column) -> Column:
    return F.size(F.array_distinct(w)).cast("long")


def char_count(text: Column) -> Column:
    return F.length(text).cast("long")


def punctuation_count(text: Column) -> Column:
    """ASCII punctuation characters."""
    kept = F.translate(text, string.punctuation, "")
    return (F.length(text) - F.length(kept)).cast("long")


def upper_word_count(w: Column) -> Column:
    return F.size(F.filter(w, lambda x: x.rlike(UPPER_WORD))).cast("long")


def title_word_count(w: Column) -> Column:
    return F.size(F.filter(w, lambda x: x.rlike(CASED) & ~x.rlike(NOT_TITLE))).cast("long")


def stopword_count(w: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long")


def mean_word_length(w: Column) -> Column:
    return F.try_divide(F.length(F.array_join(w, "")), F.size(w))


def unique_word_percent(w: Column) -> Column:
    return F.try_divide(F.size(F.array_distinct(w)) * 100, F.size(w))


def punctuation_percent(text: Column, w: Column) -> Column:
    """Punctuation characters per hundred words; can exceed 100."""
    return F.try_divide(punctuation_count(text) * 100, F.size(w))


def lexical_diversity(text: Column) -> Column:
    """Characters per distinct character; null for an empty text."""
    distinct = F.size(F.array_distinct(F.split(text, "")))
    return F.when(F.length(text) > 0, F.length(text) / distinct)


def pick(name: str, text: Column, w: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """One statistic by its short name."""
    return {
        "word_count": lambda: word_count(w),
        "unique_word_count": lambda: unique_word_count(w),
        "char_count": lambda: char_count(text),
        "punctuation_count": lambda: punctuation_count(text),
        "upper_word_count": lambda: upper_word_count(w),
        "title_word_count": lambda: title_word_count(w),
        "stopword_count": lambda: stopword_count(w, stop_words),
        "mean_word_length": lambda: mean_word_length(w),
        "unique_word_percent": lambda: unique_word_percent(w),
        "punctuation_percent": lambda: punctuation_percent(text, w),
        "lexical_diversity": lambda: lexical_diversity(text),
    }[name]()


# Short name of a statistic and the column it becomes, for a text column ``{}``.
FEATURE_NAMES = {
    "word_count": "count_word_raw_{}",
    "unique_word_count": "count_unique_word_raw_{}",
    "char_count": "count_letters_raw_{}",
    "punctuation_count": "count_punctuations_raw_{}",
    "upper_word_count": "count_words_upper_raw_{}",
    "title_word_count": "count_words_title_raw_{}",
    "stopword_count": "count_stopwords_raw_{}",
    "mean_word_length": "mean_word_len_raw_{}",
    "unique_word_percent": "word_unique_percent_raw_{}",
    "punctuation_percent": "punctuation_percent_raw_{}",
    "lexical_diversity": "lexical_diversity_{}",
}


def with_text_stats(
    df: DataFrame, columns: Sequence[str], stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """Add the eleven statistics of every column in ``columns``; nulls become ``m``.

    The words of a text are split once and shared by the statistics.
    """
    filled = df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(MISSING_TEXT)) for c in columns}
    )
    split = filled.withColumns({f"_words_{c}": words(F.col(c)) for c in columns})
    features = {
        feature.format(c): pick(name, F.col(c), F.col(f"_words_{c}"), stop_words)
        for c in columns
        for name, feature in FEATURE_NAMES.items()
    }
    return split.withColumns(features).drop(*[f"_words_{c}" for c in columns])


def mark_counts(df: DataFrame, text: str) -> DataFrame:
    """Add counts of words, commas, exclamation marks and quotes, and the mean word length."""

    def occurrences(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")

    return (
        df.withColumn("_words", words(F.col(text)))
        .withColumns(
            {
                "num_words": word_count(F.col("_words")),
                "num_commas": occurrences(","),
                "num_bangs": occurrences("!"),
                "num_quotes": occurrences("\"'"),
                "avg_word": mean_word_length(F.col("_words")),
            }
        )
        .drop("_words")
    )
