"""Golden rows for normalisation and statistics, and Python's own rules as brute force."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from riskframe.functions import stats, text, tokens
from riskframe.functions.wordlists import STOP_WORDS

# text, words, distinct, characters, punctuation, upper, title, stop words (with the
# list Spark ships), mean length, distinct %, punctuation %, diversity, normalised
GOLDEN = [
    ("Netflix, Inc", 2, 2, 12, 1, 0, 2, 0, 5.5, 100, 50, 1.0, "netflix , inc"),
    ("pearl harbor naval shipyard", 4, 4, 27, 0, 0, 0, 0, 6.0, 100, 0, 1.8, "pearl harbor naval shipyard"),
    ("CIGNA", 1, 1, 5, 0, 1, 0, 0, 5.0, 100, 0, 1.0, "cigna"),
    ("paythebillsoff", 1, 1, 14, 0, 0, 0, 0, 14.0, 100, 0, 1.166667, "paythebillsoff"),
    ("Debt Consolidation and Major Purchase", 5, 5, 37, 0, 0, 4, 1, 6.6, 100, 0, 1.85,
     "debt consolidation and major purchase"),
    ("Credit cards to refinance, thanks LC!", 6, 6, 37, 2, 1, 1, 1, 5.333333, 100, 33.333333, 2.055556,
     "credit cards to refinance , thanks lc !"),
    ("Mike's loan", 2, 2, 11, 1, 0, 0, 0, 5.0, 100, 50, 1.0, "mike's loan"),
    ("rags to riches ", 3, 3, 15, 0, 0, 0, 1, 4.0, 100, 0, 1.363636, "rags to riches"),
    ("  Borrower added on 12/14/11 > looking to be debt free in 3 yrs or less!!<br>", 15, 15, 77, 7, 0, 1, 5,
     4.066667, 100, 46.666667, 2.961538,
     "borrower added on dd/dd/dd > looking to be debt free in d yrs or less ! !"),
    ("m", 1, 1, 1, 0, 0, 0, 0, 1.0, 100, 0, 1.0, "m"),
    ("I can't pay, and don't owe 5 more", 8, 8, 33, 3, 1, 1, 5, 3.25, 100, 37.5, 1.941176,
     "i ca not pay , and do not owe d more"),
]
# The same columns, with the library's own stop list: worked out once by Python's rules and kept.
EDGES = [
    ('', 0, 0, 0, 0, 0, 0, 0, None, None, None, None, ''),
    ('   ', 0, 0, 3, 0, 0, 0, 0, None, None, None, 3.0, ''),
    ('\xc9', 1, 1, 1, 0, 1, 1, 0, 1.0, 100.0, 0.0, 1.0, 'e'),
    ('\xdf', 1, 1, 1, 0, 0, 0, 0, 1.0, 100.0, 0.0, 1.0, '\xdf'),
    ('go \U0001f600 now \U0001f600', 4, 3, 10, 0, 0, 0, 1, 1.75, 75.0, 0.0, 1.666667, 'go \U0001f600 now \U0001f600'),
    ('\u0663 eggs', 2, 2, 6, 0, 0, 0, 0, 2.5, 100.0, 0.0, 1.2, 'd eggs'),
    ('a\xa0b', 2, 2, 3, 0, 0, 0, 1, 1.0, 100.0, 0.0, 1.0, 'a\xa0b'),
    ('x<br/>y<br>z', 1, 1, 12, 5, 0, 0, 0, 12.0, 100.0, 500.0, 1.5, 'x y z'),
    ('again again', 2, 1, 11, 0, 0, 0, 2, 5.0, 50.0, 0.0, 2.2, 'again again'),
    ('A1b AbcDef', 2, 2, 10, 0, 0, 0, 0, 4.5, 100.0, 0.0, 1.25, 'adb abcdef'),
    ('\u01c4 \u01c5 \u01c6', 3, 3, 5, 0, 1, 2, 0, 1.0, 100.0, 0.0, 1.25, '\u01c6 \u01c6 \u01c6'),
    ('\xaaB', 1, 1, 2, 0, 0, 0, 0, 2.0, 100.0, 0.0, 1.0, '\xaab'),
    ('tab\there\nand\r\nthere', 4, 4, 19, 0, 0, 0, 3, 3.75, 100.0, 0.0, 1.727273, 'tab here and\r there'),
    ("wouldn't Couldn't HADN'T hasn't", 4, 4, 31, 4, 1, 0, 4, 7.0, 100.0, 100.0, 1.722222, 'would not could not had not has not'),
    ('\ufb01 \u2167 \u24d0 \u24b6', 4, 4, 7, 0, 2, 2, 0, 1.0, 100.0, 0.0, 1.4, '\ufb01 \u2177 \u24d0 \u24d0'),
    ('\u2003wide\u2003', 1, 1, 6, 0, 0, 0, 0, 4.0, 100.0, 0.0, 1.2, 'wide'),
    ('na\xefve caf\xe9 \xc5ngstr\xf6m \u03a9\u03bc\u03ad\u03b3\u03b1 \u0391\u03a3', 5, 5, 28, 0, 1, 2, 0, 4.8, 100.0, 0.0, 1.217391, 'naive cafe angstrom \u03c9\u03bc\u03b5\u03b3\u03b1 \u03b1\u03c2'),
    ('e\u0301\u0323x', 1, 1, 4, 0, 0, 0, 0, 4.0, 100.0, 0.0, 1.0, 'ex'),
    ('don\u2019t', 1, 1, 5, 0, 0, 0, 0, 5.0, 100.0, 0.0, 1.0, 'don\u2019t'),
    ('\x1cfs\x1d', 1, 1, 4, 0, 0, 0, 0, 2.0, 100.0, 0.0, 1.0, 'fs'),
]


def counted(spark, texts, stop_words=STOP_WORDS):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    rows = stats.with_text_stats(df, ["x"], stop_words).orderBy("i").collect()
    return [tuple(r[n.format("x")] for n in stats.FEATURE_NAMES.values()) for r in rows]


def test_golden_statistics(spark):
    stop_words = StopWordsRemover.loadDefaultStopWords("english")
    found = counted(spark, [g[0] for g in GOLDEN], stop_words)
    for golden, row in zip(GOLDEN, found):
        assert row == pytest.approx(golden[1:12], abs=1e-6), golden[0]


def test_statistics_follow_python_on_edge_cases(spark):
    for edge, row in zip(EDGES, counted(spark, [e[0] for e in EDGES])):
        assert row == pytest.approx(edge[1:12], abs=1e-6), repr(edge[0])


def test_missing_text_counts_as_one_letter(spark):
    assert counted(spark, [None]) == [(1, 1, 1, 0, 0, 0, 1 if "m" in STOP_WORDS else 0, 1.0, 100.0, 0.0, 1.0)]


def test_normalisation_follows_python(spark):
    texts = [g[0] for g in (*GOLDEN, *EDGES)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    rows = df.select("i", text.normalize_text(F.col("x")).alias("n")).orderBy("i").collect()
    for wanted, row in zip((*GOLDEN, *EDGES), rows):
        assert row["n"] == wanted[12], repr(wanted[0])


def test_other_scripts_in_arrow_batches(spark):
    texts = ["한글 텍스트", "ồ", None, "\U0001d15e"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    rows = df.select("i", text.strip_accents(F.col("x"), all_scripts=True).alias("n")).orderBy("i").collect()
    for s, row in zip(texts, rows):
        expected = s and "".join(
            c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"
        )
        assert row["n"] == expected


def test_preview_computes_the_first_rows_only(spark):
    df = spark.createDataFrame([(i, f"Text {i}") for i in range(50)], "i int, x string")
    rows = text.preview(df, "i", "x", F.upper("x").alias("clean"), rows=3).collect()
    assert [(r["i"], r["normalized"], r["clean"]) for r in rows] == [
        (i, "text d", f"TEXT {i}") for i in range(3)
    ]


LONG_WORDS = ("A1" * 50_000, "a" * 100_000, "Ab" * 50_000, "Aa1" * 33_000, "A" * 100_000, "." * 100_000)


def test_long_words_need_no_deep_recursion(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(LONG_WORDS)], "i int, x string")
    featured = stats.with_text_stats(df, ["x"]).orderBy("i").collect()
    title = stats.FEATURE_NAMES["title_word_count"].format("x")
    assert [bool(r[title]) for r in featured] == [w.istitle() for w in LONG_WORDS]
    cleaned = df.select(
        F.length(text.normalize_text(F.col("x"))).alias("n"),
        F.size(tokens.tokenize(F.col("x"))).alias("t"),
        F.length(tokens.clean_text(F.col("x"))).alias("c"),
    )
    assert cleaned.count() == len(LONG_WORDS) and all(r["n"] > 0 for r in cleaned.collect())
