"""Token arrays: tokenising, filtering, stemming, tagging.

All of these are narrow: an array column in, an array or string column out, no
shuffle. Tokenising follows the published Penn Treebank rules, stemming Porter's
published algorithm with NLTK's documented departures from it. Tags come from closed
word classes and word endings; a caller with a real lexicon joins it with
``operators.lexicon.rewrite_tokens``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

from riskframe.functions.text import normalize_text, words
from riskframe.functions.wordlists import (
    CLOSED_CLASS_TAGS,
    STOP_WORDS,
    SUFFIX_TAGS,
    TAG_CLASSES,
)

# Penn Treebank word separation, in its fixed order, on a text padded with spaces.
# Sentence ends are expected to stand alone already (``text.pad_punctuation``). Where a
# rule looks back, a cheap look at the current letter comes first.
TREEBANK_RULES = (
    (r'"(?<=[ (\[{<]")', " `` "),
    (r'"', " '' "),
    (r"([\]\[(){}<>;@#$%&?!])", " $1 "),
    (r"--", " -- "),
    (r"'(?<=[^']') ", " ' "),
    (r"(?=['nN])(?<=[^' ])('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T)(?= )", " $1"),
    (r"(?i)(?=[cglw])(?<= )(can(?=not )|(gim|lem)(?=me )|(gon|wan)(?=na )|got(?=ta ))", "$1 "),
)


def tokenize(c: Column) -> Column:
    """Split a text into words, numbers and punctuation marks."""
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, replacement in TREEBANK_RULES:
        c = F.regexp_replace(c, pattern, replacement)
    return words(c)


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def remove_stopwords(tokens: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*stop_words))


def remove_short(tokens: Column, at_least: int = 3) -> Column:
    return F.filter(tokens, lambda x: F.length(x) >= at_least)


# --- Porter stemmer -------------------------------------------------------------
#
# A word is [C](VC)^m[V]; y is a vowel after a consonant. Conditions are patterns
# on the part before the suffix. A leading y is a consonant and is marked as Y.

_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
M_OVER_0 = f"^({_C})?{_V}{_C}"
M_IS_1 = f"^({_C})?{_V}{_C}({_V})?$"
M_OVER_1 = f"^({_C})?{_V}{_C}{_V}{_C}"
HAS_VOWEL = f"^({_C})?[aeiouy]"
SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]$"
SHORT_VC = "^[aeiou][^aeiou]$"
# A private-use character, which no text holds.
MARK = "\uE0FF"
DOUBLE_END = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# Irregular forms with a fixed stem.
IRREGULAR_STEMS = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffixes of steps 2, 3 and 4 of the algorithm with what replaces them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive",
    "biliti": "ble", "fulli": "ful",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))


def cut(w: Column, letters: int | Column) -> Column:
    letters = F.lit(letters) if isinstance(letters, int) else letters
    return F.substring(w, F.lit(1), F.length(w) - letters)


def longest_suffix(w: Column, suffixes: Sequence[str]) -> Column:
    # The leftmost match of an anchored alternation is the longest suffix.
    return F.regexp_extract(w, f"({'|'.join(suffixes)})$", 1)


def may_end_in(w: Column, suffixes: Sequence[str]) -> Column:
    """A cheap test of the last two letters, ahead of the pattern of all suffixes."""
    return F.substring(w, -2, 2).isin(*sorted({s[-2:] for s in suffixes}))


def _mark(w: Column) -> Column:
    return F.when(w.startswith("y"), F.concat(F.lit("Y"), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)


def _step_1a(w: Column) -> Column:
    return (
        F.when(~w.endswith("s"), w)
        .when(w.endswith("sses"), cut(w, 2))
        .when(w.endswith("ies"), F.when(F.length(w) == 4, cut(w, 1)).otherwise(cut(w, 2)))
        .when(w.endswith("ss"), w)
        .otherwise(cut(w, 1))
    )


def _step_1b(w: Column) -> Column:
    stem = F.regexp_extract(w, "^(.*)(ed|ing)$", 1)
    return (
        F.when(
            w.endswith("ied"), F.when(F.length(w) == 4, cut(w, 1)).otherwise(cut(w, 2))
        )
        .when(w.endswith("eed"), F.when(cut(w, 3).rlike(M_OVER_0), cut(w, 1)).otherwise(w))
        # The mark tells the second half of the step which words to repair.
        .when(
            (w.endswith("ed") | w.endswith("ing")) & stem.rlike(HAS_VOWEL),
            F.concat(stem, F.lit(MARK)),
        )
        .otherwise(w)
    )


def _step_1b_repair(w: Column) -> Column:
    stem = cut(w, 1)
    return (
        F.when(~w.endswith(MARK) | w.endswith(MARK + MARK), w)
        .when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike(DOUBLE_END), cut(stem, 1))
        .when(stem.rlike(SHORT_END) | stem.rlike(SHORT_VC), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def _step_1c(w: Column) -> Column:
    changed = F.regexp_replace(w, "^(.+[^aeiou])y$", "$1i")
    return F.when(w.endswith("y"), changed).otherwise(w)


def _swap(table: Mapping[str, str], condition: str) -> Callable[[Column], Column]:
    def step(w: Column) -> Column:
        suffix = longest_suffix(w, list(table))
        stem = cut(w, F.length(suffix))
        return F.when(
            may_end_in(w, list(table)) & (suffix != "") & stem.rlike(condition),
            F.concat(stem, F.element_at(literal_map(table), suffix)),
        ).otherwise(w)

    return step


def _step_2(w: Column) -> Column:
    # The condition for "logi" counts its l as part of the stem.
    logi = w.endswith("logi") & cut(w, 3).rlike(M_OVER_0)
    return F.when(logi, cut(w, 1)).otherwise(_swap(STEP_2, M_OVER_0)(w))


def _step_2_again(w: Column) -> Column:
    # "alli" becomes "al", on which the step is taken once more.
    marked = w.endswith("alli") & cut(w, 4).rlike(M_OVER_0)
    return F.when(marked, cut(w, 2)).otherwise(w)


def _step_4(w: Column) -> Column:
    suffix = longest_suffix(w, STEP_4)
    stem = cut(w, F.length(suffix))
    allowed = (suffix != "ion") | stem.rlike("[st]$")
    ends = may_end_in(w, STEP_4) & (suffix != "")
    return F.when(ends & stem.rlike(M_OVER_1) & allowed, stem).otherwise(w)


def _step_5a(w: Column) -> Column:
    stem = cut(w, 1)
    short = stem.rlike(SHORT_END) | stem.rlike(SHORT_VC)
    drop = stem.rlike(M_OVER_1) | (stem.rlike(M_IS_1) & ~short)
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _step_5b(w: Column) -> Column:
    return F.when(w.endswith("ll") & cut(w, 1).rlike(M_OVER_1), cut(w, 1)).otherwise(w)


PORTER_STEPS: tuple[Callable[[Column], Column], ...] = (
    _mark, _step_1a, _step_1b, _step_1b_repair, _step_1c,
    _step_2_again, _step_2, _swap(STEP_3, M_OVER_0), _step_4, _step_5a, _step_5b, F.lower,
)


def stem_tokens(tokens: Column) -> Column:
    """Porter stems of lower-cased tokens; tokens of one or two letters stay.

    Each step is one pass over the array, so that a step sees the finished result
    of the step before it. Tokens whose result is fixed from the start are wrapped
    in marks, which no step matches, until the end.
    """
    irregular = literal_map(IRREGULAR_STEMS)

    def fixed(w: Column) -> Column:
        return F.concat(F.lit(MARK), w, F.lit(MARK + MARK))

    def protect(w: Column) -> Column:
        return (
            F.when(F.length(w) <= 2, fixed(w))
            .when(w.isin(*IRREGULAR_STEMS), fixed(F.element_at(irregular, w)))
            .otherwise(w)
        )

    def release(w: Column) -> Column:
        return F.replace(w, F.lit(MARK), F.lit(""))

    for step in (protect, *PORTER_STEPS, release):
        tokens = F.transform(tokens, step)
    return tokens


# --- Tags ----------------------------------------------------------------------

PUNCTUATION_TAG = "."
NUMBER_TAG = "CD"
DEFAULT_TAG = "NN"


def tag(w: Column) -> Column:
    """Penn Treebank tag of one token, from closed classes, then from its ending."""
    lowered = F.lower(w)
    closed = F.when(F.lit(False), "")
    for name, members in CLOSED_CLASS_TAGS.items():
        closed = closed.when(lowered.isin(*members.split()), name)
    # One hash lookup sends most words past the closed classes.
    every = " ".join(CLOSED_CLASS_TAGS.values()).split()
    out = F.when(lowered.isin(*every), closed)
    out = out.when(~w.rlike(r"[\p{L}\p{N}]"), PUNCTUATION_TAG)
    out = out.when(w.rlike(r"^[\p{Nd}.,/-]+$"), NUMBER_TAG)
    for ending, name in SUFFIX_TAGS:
        out = out.when(lowered.endswith(ending) & (F.length(w) > len(ending) + 1), name)
    return out.otherwise(DEFAULT_TAG)


def tag_tokens(tokens: Column) -> Column:
    """The tag of every token, as an array of the same length."""
    return F.transform(tokens, tag)


def tag_class_count(tags: Column, name: str) -> Column:
    """How many tags belong to ``noun``, ``pron``, ``verb``, ``adj`` or ``adv``."""
    return F.size(F.filter(tags, lambda t: t.isin(*TAG_CLASSES[name]))).cast("long")


# --- The cleaned text ----------------------------------------------------------


def clean_tokens(
    c: Column, stop_words: Sequence[str] = STOP_WORDS, at_least: int = 3, stem: bool = True
) -> Column:
    """Normalise, tokenise, drop stop words and short tokens, stem."""
    tokens = lower_tokens(tokenize(normalize_text(c)))
    tokens = remove_short(remove_stopwords(tokens, stop_words), at_least)
    return stem_tokens(tokens) if stem else tokens


def clean_text(c: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """The stems joined by spaces; a missing text counts as ``m``.

    A plain expression, also for streams; ``lexicon.clean_texts`` goes on to tag and rewrite the stems.
    """
    return F.array_join(clean_tokens(F.coalesce(c, F.lit("m")), stop_words), " ")
