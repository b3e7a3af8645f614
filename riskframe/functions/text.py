"""Text normalisation as native column expressions.

Every function maps a string column to a string column, works on whole texts and
keeps nulls null. The results follow Python's notions of digit and white space,
which are those of Unicode, not of ASCII.
"""

from __future__ import annotations

import unicodedata
import sys
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from riskframe.functions.wordlists import CONTRACTED_VERBS

# Class body of the characters Python's str.split() and str.strip() treat as space.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = f"[^{SPACE}]+"
# The same characters one by one, for trimming.
SPACE_CHARS = "".join(c for c in map(chr, range(0x10000)) if c.isspace())

# Code that runs in Python workers travels with the task, so that workers do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """All characters of the basic plane whose decomposition leaves one base character."""
    accented, plain = [], []
    for code in range(0xA0, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        bases = _bases(char)
        if len(bases) == 1 and bases != char:
            accented.append(char)
            plain.append(bases)
    return "".join(accented), "".join(plain)


def _bases(text: str) -> str:
    return "".join(
        c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"
    )


@F.pandas_udf(StringType())
def _strip_accents_arrow(texts: pd.Series) -> pd.Series:
    return texts.map(_bases, na_action="ignore")


def strip_accents(c: Column, all_scripts: bool = False) -> Column:
    """Canonical decomposition without combining marks.

    The native form covers every character of the basic plane that keeps one base
    character. ``all_scripts`` also decomposes the rest (Hangul syllables, a few
    vowel signs, higher planes) in Arrow batches.
    """
    if all_scripts:
        return _strip_accents_arrow(c)
    return F.regexp_replace(F.translate(c, *_accent_table()), r"\p{Mn}+", "")


def expand_contractions(c: Column) -> Column:
    """Write out thirteen negative contractions: cut ``n't``, add `` not``."""
    # The rare ending comes first, the verbs are only looked back for where it stands.
    return F.regexp_replace(c, f"n't(?<=(?:{'|'.join(CONTRACTED_VERBS)})n't)", " not")


def strip_br(c: Column) -> Column:
    """Replace ``<br>`` and ``<br/>`` by a space."""
    return F.regexp_replace(c, "<br/?>", " ")


def pad_punctuation(c: Column) -> Column:
    """Put a space on both sides of ``, ; . : ! ?``."""
    return F.regexp_replace(c, "([,;.:!?])", " $1 ")


def blank_breaks(c: Column) -> Column:
    """Replace newlines and tabs by spaces."""
    return F.translate(c, "\n\t", "  ")


def mask_digits(c: Column) -> Column:
    """Replace every decimal digit of any script by the letter ``d``."""
    return F.regexp_replace(c, r"\p{Nd}", "d")


def squeeze_spaces(c: Column) -> Column:
    """Collapse runs of spaces, then strip all white space from both ends."""
    return F.btrim(F.regexp_replace(c, " {2,}", " "), F.lit(SPACE_CHARS))


def normalize_text(c: Column, all_scripts: bool = False) -> Column:
    """The whole chain, in its fixed order."""
    c = F.lower(strip_accents(c, all_scripts))
    for step in (
        expand_contractions, strip_br, pad_punctuation, blank_breaks, mask_digits, squeeze_spaces,
    ):
        c = step(c)
    return F.lower(c)


def words(c: Column) -> Column:
    """White-space separated words, as Python's ``str.split()`` gives them."""
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def preview(df: DataFrame, key: str, text: str, *more: Column, rows: int = 20) -> DataFrame:
    """The first ``rows`` texts beside their normalised form and the expressions ``more``.

    Rows are chosen first, so nothing is computed for the others.
    """
    first = df.orderBy(key).limit(rows)
    return first.select(F.col(key), F.col(text), normalize_text(F.col(text)).alias("normalized"), *more)
