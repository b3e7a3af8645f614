"""Vocabulary, n-grams and bag of words.

Terms and n-grams are counted by slices of rows inside each task (``grams``), so what a
task hands on is one row per distinct term of a slice. Document and collection
frequencies then take one shuffle with map-side combination, whatever share of the
documents holds a term.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.text import SPACE, strip_accents
from riskframe.functions.wordlists import STOP_WORDS
from riskframe.operators import grams
from riskframe.operators.lookup import BROADCAST_BYTES, lookup_join, measured_bytes
from riskframe.operators.rank import key_rank, range_totals
from riskframe.session import checkpointed

TERM_PATTERN = r"([\p{L}\p{N}_]+)"


def bow_tokens(c: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased runs of letters, digits and underscores, without stop words.

    Vectorizers ship stop lists of their own; pass theirs for the same vocabulary.
    """
    tokens = F.regexp_extract_all(F.lower(c), F.lit(TERM_PATTERN), F.lit(1))
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda x: ~x.isin(*stop_words))


def _longer(grams: Column, tokens: Column, n: int, separator: str) -> Column:
    # n-grams from (n-1)-grams: join each with the token that follows it.
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return F.zip_with(
        F.slice(grams, F.lit(1), count),
        F.slice(tokens, F.lit(n), count),
        lambda a, b: F.concat(a, F.lit(separator), b),
    )


def with_ngrams(
    df: DataFrame,
    tokens: str,
    name: str,
    low: int = 1,
    high: int = 3,
    separator: str = " ",
) -> DataFrame:
    """Add an array of all n-grams of the array column ``tokens``, for n in low..high.

    Each length is built from the one before it, so the work is linear in the text.
    """
    columns = [tokens]
    for n in range(2, high + 1):
        column = f"_grams_{n}"
        df = df.withColumn(column, _longer(F.col(columns[-1]), F.col(tokens), n, separator))
        columns.append(column)
    wanted = [F.col(c) for c in columns[low - 1 : high]]
    return df.withColumn(name, F.flatten(F.array(*wanted))).drop(*columns[1:])


def with_term_counts(df: DataFrame, terms: str, name: str) -> DataFrame:
    """Add ``array<struct<term, tf>>``: every distinct term of the row and its count.

    Sorts the array and measures its runs.
    """
    ordered = df.withColumn("_ordered", F.sort_array(terms))
    starts = F.filter(
        F.transform(
            "_ordered",
            lambda x, i: F.when(
                (i == 0) | (F.get(F.col("_ordered"), i - 1) != x), i
            ),
        ),
        lambda i: i.isNotNull(),
    )
    # The end of each run is the start of the next one.
    with_starts = ordered.withColumn("_starts", starts).withColumn(
        "_ends",
        F.concat(
            F.slice("_starts", F.lit(2), F.greatest(F.size("_starts") - 1, F.lit(0))),
            F.array(F.size("_ordered")),
        ),
    )
    runs = F.when(
        F.size("_ordered") > 0,
        F.zip_with(
            "_starts",
            "_ends",
            lambda start, end: F.struct(
                F.get(F.col("_ordered"), start).alias("term"),
                (end - start).cast("long").alias("tf"),
            ),
        ),
    )
    return with_starts.withColumn(name, runs).drop("_ordered", "_starts", "_ends")


def exploded_terms(df: DataFrame, key: str, terms: str) -> DataFrame:
    """``(key, term, tf)`` for every distinct term of every row, without a shuffle."""
    counted = with_term_counts(df.select(key, terms), terms, "_counts")
    return _explode_counts(counted, key).select(key, "_t.term", "_t.tf")


def _explode_counts(df: DataFrame, *keep: str) -> DataFrame:
    # The outer form keeps the optimiser from testing the array's size beneath the
    # projection, which would count every row's terms twice.
    exploded = df.select(*keep, F.explode_outer("_counts").alias("_t"))
    return exploded.filter(F.col("_t").isNotNull())


def term_stats(df: DataFrame, terms: str) -> DataFrame:
    """``(term, tf, df)``: occurrences of every term and rows that hold it."""
    return _gram_stats(df, terms, 1, 1, "", [])


def _gram_stats(df: DataFrame, tokens: str, n: int, low: int, separator: str, maps: Sequence[np.ndarray]) -> DataFrame:
    # Counted by slices of rows in each task, then added up.
    shared = df.sparkSession.sparkContext.broadcast(list(maps))
    counted = df.select(tokens).mapInArrow(grams.count_task(tokens, n, low, separator, shared), "term string, tf long, df long")
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def vocabulary(
    df: DataFrame,
    terms: str,
    min_df: int = 1,
    max_df: float | None = None,
    max_features: int = 10_000,
) -> DataFrame:
    """``(term, tf, df, term_id)``: the most frequent terms, ids from 0 in term order.

    ``max_df`` is a share of the rows. Equal counts are cut in term order. The
    result has at most ``max_features`` rows, so numbering them is small work.
    """
    stats = term_stats(df, terms).filter(F.col("df") >= min_df)
    if max_df is not None:
        stats = stats.filter(F.col("df") <= max_df * df.count())
    return top_vocabulary(stats, max_features)


#: Bits of the map that says which parts are frequent; a fixed size, and a full map merely prunes less.
MAP_BITS = 1 << 24


def frequent_map(stats: DataFrame) -> np.ndarray:
    """The terms of ``stats`` as a map of bits, 64 of them to a number."""
    found = stats.select("term").mapInArrow(grams.map_task(MAP_BITS), "word int, bits long")
    words = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    full = np.zeros(MAP_BITS // 64, np.int64)
    full[words["word"].to_numpy()] = words["bits"].to_numpy()
    return full


def frequent_terms(
    df: DataFrame, tokens: str, high: int = 3, min_df: int = 5, separator: str = " ", low: int = 1, max_features: int | None = None
) -> DataFrame:
    """``(term, tf, df)`` of all ``low``- to ``high``-grams that at least ``min_df`` rows hold.

    ``tokens`` is an array of words, or a string, whose words are its characters. Length by length: an n-gram
    can be frequent only where both its (n-1)-grams are. Those are marked in a bit map, which is broadcast, and only
    n-grams of marked parts are counted. The map has one size at any scale; two terms that share a bit cost a
    needless count, never a term. With ``max_features``, terms that cannot be among so many most frequent ones go: an
    n-gram occurs no more often than its parts, so the count of the last one so far is a lower bound for all.
    """
    found, maps = [], []
    least = 0
    for n in range(low, high + 1):
        stats = _gram_stats(df, tokens, n, low, separator, maps).filter((F.col("df") >= min_df) & (F.col("tf") >= least))
        found.append(checkpointed(stats))
        if n == high:
            break
        if max_features is not None:
            first = reduce(DataFrame.unionByName, found).orderBy(F.desc("tf")).limit(max_features)
            last = first.agg(F.min("tf").alias("tf"), F.count("*").alias("n")).first()
            least = last["tf"] if last["n"] == max_features and max_features else 0
        maps.append(frequent_map(found[-1].filter(F.col("tf") >= least)))
    return reduce(DataFrame.unionByName, found)


def top_vocabulary(stats: DataFrame, max_features: int = 10_000) -> DataFrame:
    """``(term, tf, df, term_id)``: the most frequent terms of ``stats``, ids from 0 in term order.

    Equal counts are cut in term order. There are at most ``max_features`` rows, so numbering them is small work.
    """
    top = stats.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)
    return top.withColumn("term_id", (F.row_number().over(Window.partitionBy().orderBy("term")) - 1).cast("long"))


def ngram_vocabulary(
    df: DataFrame, tokens: str, high: int = 3, min_df: int = 5, max_features: int = 10_000, low: int = 1, separator: str = " "
) -> DataFrame:
    """The vocabulary of the ``low``- to ``high``-grams of ``tokens``: the same rows as ``vocabulary`` of all n-grams."""
    return top_vocabulary(frequent_terms(df, tokens, high, min_df, separator, low, max_features), max_features)


def word_index(
    df: DataFrame, tokens: str, min_count: int = 5, parts: int | None = None
) -> tuple[DataFrame, int]:
    """``(term, tf, word_id)`` for all terms, ids from 1 by falling count, and the size.

    The size is the number of terms with at least ``min_count`` occurrences, which
    under this order are exactly the ids up to it.
    """
    stats = checkpointed(term_stats(df, tokens).select("term", "tf"))
    one = F.lit(1).cast("long")
    ranked = range_totals(stats, {"word_id": one}, [F.col("tf").desc(), F.col("term")], parts=parts)
    size = stats.filter(F.col("tf") >= min_count).count()
    return ranked.select("term", "tf", "word_id"), size


def _small(vocab: DataFrame) -> DataFrame | None:
    """``vocab`` (one row per term) computed once, numbered from 0 in ``_place``; None if it is too large to broadcast."""
    vocab = checkpointed(vocab)
    if measured_bytes(vocab) > BROADCAST_BYTES:
        return None
    number = F.row_number().over(Window.partitionBy().orderBy("term")) - 1
    return checkpointed(vocab.withColumn("_place", number.cast("int")))


def _known_cells(
    df: DataFrame, key: str, terms: str, small: DataFrame, low: int, high: int, separator: str, sublinear: bool | None = None
) -> DataFrame:
    """``(_key, _places, _values, _square)`` of every row: the terms of ``small`` it holds and their counts.

    With ``sublinear`` given, values are tf-idf weights by the column ``_idf``. ``_square`` is the sum of their squares.
    """
    known = small.toArrow().sort_by("_place")
    words = known["term"].to_pylist()
    idf = None if sublinear is None else known["_idf"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast((words, grams.prefixes(words, separator) if high > 1 else [], idf))
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(terms).alias("_terms")).mapInArrow(
        grams.lookup_task("_terms", low, high, separator, shared, bool(sublinear)),
        f"_key {kind}, _places array<int>, _values array<double>, _square double",
    )


def _cells_of(found: DataFrame, key: str, small: DataFrame, *more: str) -> DataFrame:
    listed = found.select(F.col("_key").alias(key), *more, F.explode(F.arrays_zip("_places", "_values")).alias("_c"))
    cells = listed.select(key, *more, F.col("_c._places").alias("_place"), F.col("_c._values").alias("_value"))
    return cells.join(F.broadcast(small), "_place")


def _all_grams(df: DataFrame, terms: str, low: int, high: int, separator: str) -> DataFrame:
    if df.schema[terms].dataType.simpleString() == "string":
        df = df.withColumn(terms, F.split(terms, ""))
    return df if low == high == 1 else with_ngrams(df, terms, "_grams", low, high, separator).drop(terms).withColumnRenamed("_grams", terms)


def bow_counts(
    df: DataFrame, key: str, terms: str, vocab: DataFrame, low: int = 1, high: int = 1, separator: str = " "
) -> DataFrame:
    """Long form ``(key, term_id, tf)`` of the vocabulary terms of every row.

    ``terms`` is an array of words (or a string, whose words are its characters); counted are its ``low``- to
    ``high``-grams. Up to 64 MB the vocabulary is broadcast and n-grams are looked up in the task that reads the row.
    """
    ids = vocab.select("term", "term_id")
    small = _small(ids)
    if small is not None:
        cells = _cells_of(_known_cells(df, key, terms, small, low, high, separator), key, small)
        return cells.select(key, "term_id", F.col("_value").cast("long").alias("tf"))
    every = _all_grams(df.select(key, terms), terms, low, high, separator)
    joined = lookup_join(exploded_terms(every, key, terms), ids, ["term"], "inner")
    return joined.select(key, "term_id", "tf")


def bow_binary(
    df: DataFrame, key: str, terms: str, vocab: DataFrame, low: int = 1, high: int = 1, separator: str = " "
) -> DataFrame:
    """Long form ``(key, term_id, present)`` with every count turned into 1."""
    counts = bow_counts(df, key, terms, vocab, low, high, separator)
    return counts.select(key, "term_id", (F.col("tf") > 0).cast("int").alias("present"))


def bow_vectorizer(
    vocab: DataFrame, terms: str, output: str, binary: bool = True
) -> CountVectorizerModel:
    """A Spark ML stage that turns an array of terms into a sparse vector.

    The terms become part of the model, as in a fitted ``CountVectorizer``; their
    number is bounded by the vocabulary's ``max_features``.
    """
    ordered = [r["term"] for r in vocab.orderBy("term_id").select("term").collect()]
    return CountVectorizerModel.from_vocabulary(
        ordered, inputCol=terms, outputCol=output, minTF=1.0, binary=binary
    )


def tfidf(
    df: DataFrame, key: str, terms: str, vocab: DataFrame, sublinear: bool = False, low: int = 1, high: int = 1, separator: str = " "
) -> DataFrame:
    """Long form ``(key, term, term_id, tfidf)``, unit length per key; ``terms`` as for ``bow_counts``.

    idf = ln((1 + n) / (1 + df)) + 1. With ``sublinear`` a count c weighs 1 + ln c. Where no key repeats, a row
    knows its norm and nothing moves; else there is one shuffle by key.
    """
    n = df.count()
    idf = vocab.select(
        "term", "term_id", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("_idf")
    )
    small = _small(idf)
    if small is not None:
        found = _known_cells(df, key, terms, small, low, high, separator, sublinear)
        if not df.groupBy(key).count().filter("count > 1").isEmpty():
            found = found.withColumn("_square", F.sum("_square").over(Window.partitionBy("_key")))
        cells = _cells_of(found, key, small, "_square")
        return cells.select(key, "term", "term_id", (F.col("_value") / F.sqrt("_square")).alias("tfidf"))
    placed = _all_grams(df.select(key, terms).repartition(key), terms, low, high, separator)
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    found = lookup_join(exploded_terms(placed, key, terms), idf, ["term"], "inner")
    weighted = found.withColumn("_weight", tf * F.col("_idf"))
    norm = F.sqrt(F.sum(F.col("_weight") * F.col("_weight")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", "term_id", (F.col("_weight") / norm).alias("tfidf"))


def stacked(key: str, blocks: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Long form ``(key, block, feature_id, value)`` of several blocks of features side by side.

    A block is its name, its cells ``(key, term_id, value)`` and its vocabulary, whose size is the offset of
    the blocks after it. Cells stay sparse, and nothing is shuffled for the union.
    """
    offset, parts = 0, []
    for name, cells, known in blocks:
        feature = (F.col("term_id") + offset).alias("feature_id")
        parts.append(cells.select(key, F.lit(name).alias("block"), feature, F.col("value").cast("double").alias("value")))
        offset += known.count()
    return reduce(DataFrame.unionByName, parts)


def char_terms(c: Column) -> Column:
    """Lower-cased characters without accents, runs of white space as one space."""
    return F.regexp_replace(strip_accents(F.lower(c)), f"[{SPACE}]{{2,}}", " ")


def dict_vectorize(df: DataFrame, key: str, record: str) -> DataFrame:
    """Long form ``(key, feature_id, value)`` of a map column; ids from 0 in name order."""
    cells = df.select(key, F.explode(record).alias("_name", "value"))
    distinct = checkpointed(cells.select("_name").distinct())
    names = key_rank(distinct, "_name").select("_name", (F.col("rank") - 1).alias("feature_id"))
    return lookup_join(cells, names, ["_name"], "inner", spread_by=[key, "_name"]).select(
        key, "feature_id", "value"
    )
