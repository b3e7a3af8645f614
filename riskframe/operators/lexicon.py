"""Operators that look every token up in a table: rewriting, scoring, stem tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from riskframe.functions.tokens import clean_tokens, stem_tokens, tag
from riskframe.functions.wordlists import STOP_WORDS, TAG_CLASSES
from riskframe.operators import grams
from riskframe.operators.lookup import BROADCAST_BYTES, lookup_join, measured_bytes
from riskframe.session import checkpointed


def distinct_tokens(df: DataFrame, tokens: str) -> DataFrame:
    """``(token)``: the distinct tokens of an array column."""
    per_row = df.select(F.explode_outer(F.array_distinct(tokens)).alias("token"))
    return per_row.filter(F.col("token").isNotNull()).distinct()


def stem_map(df: DataFrame, tokens: str) -> DataFrame:
    """``(token, stem)`` for every distinct token."""
    return distinct_tokens(df, tokens).withColumn(
        "stem", F.get(stem_tokens(F.array("token")), F.lit(0))
    )


def lemma_lexicon(vocab: DataFrame) -> DataFrame:
    """``(token, class, lemma)`` from a table of known words (column ``token``).

    The usual detachment rules: a noun may lose its plural ending, a verb its
    inflection, and the result counts if it is itself a known word. Among several
    results the longest wins.
    """
    t = F.col("token")

    def candidate(kind: str, ending: str, instead: str):
        stem = F.substring(t, F.lit(1), F.length(t) - len(ending))
        applies = t.endswith(ending) & (F.length(t) > len(ending) + 1)
        return F.when(
            applies,
            F.struct(F.lit(kind).alias("class"), F.concat(stem, F.lit(instead)).alias("lemma")),
        )

    rules = [candidate(kind, *rule) for kind, rule in DETACHMENT_RULES]
    candidates = vocab.select("token", F.explode(F.array_compact(F.array(*rules))).alias("_c"))
    known = vocab.select(F.col("token").alias("lemma"))
    return (
        candidates.select("token", "_c.class", "_c.lemma")
        .join(known, "lemma", "left_semi")
        .groupBy("token", "class")
        .agg(F.max(F.struct(F.length("lemma").alias("n"), "lemma")).alias("best"))
        .select("token", "class", F.col("best.lemma").alias("lemma"))
    )


# Word-class endings and what replaces them, as published for WordNet's morphology.
DETACHMENT_RULES = (
    ("noun", ("s", "")), ("noun", ("ses", "s")), ("noun", ("ves", "f")),
    ("noun", ("xes", "x")), ("noun", ("zes", "z")), ("noun", ("ches", "ch")),
    ("noun", ("shes", "sh")), ("noun", ("men", "man")), ("noun", ("ies", "y")),
    ("verb", ("s", "")), ("verb", ("ies", "y")), ("verb", ("es", "e")), ("verb", ("es", "")),
    ("verb", ("ed", "e")), ("verb", ("ed", "")), ("verb", ("ing", "e")), ("verb", ("ing", "")),
)


def rewrite_tokens(
    df: DataFrame,
    key: str,
    tokens: str,
    lexicon: DataFrame,
    name: str = "lemmas",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(key, name)``: tokens replaced by ``(token, class) -> lemma`` where listed.

    Verb tags look up class ``verb``, all other tags class ``noun``. Every row of
    ``df`` appears, with an empty array where it has no tokens. The tag of a token depends on the token alone, so
    a block of rows looks each of its distinct tokens up once; texts do not move.
    """
    return looked_up(df, key, tokens, rewrites(lexicon), "lemma", name, max_bytes, keep_unknown=True)


def looked_up(
    df: DataFrame, key: str, tokens: str, table: DataFrame, value: str, name: str, max_bytes: int = BROADCAST_BYTES, keep_unknown: bool = False
) -> DataFrame:
    """``(key, name)``: for the tokens of every key, in order, their ``value`` in ``table`` (column ``token``, one row each).

    Unknown tokens are dropped, or with ``keep_unknown`` stay as they are. A block of rows asks once for each of its
    tokens. Rows of one key are put together by places.
    """
    blocks = in_blocks(df.select(key, F.col(tokens).alias("_tokens")))
    blocks = checkpointed(blocks.select(F.monotonically_increasing_id().alias("_row"), "_words", "_codes", "_rows"))
    distinct = blocks.select("_row", F.explode("_words").alias("token")).filter(F.col("token").isNotNull())
    found = _with_hits(blocks, distinct, table.select("token", value), value, max_bytes)
    fields = [df.schema[key], StructField(name, ArrayType(table.schema[value].dataType)), StructField("_places", ArrayType(IntegerType()))]
    rows = found.select("_words", "_codes", "_rows", "_from", "_to").mapInArrow(_value_task(keep_unknown, [f.name for f in fields]), StructType(fields))
    if df.groupBy(key).count().filter("count > 1").isEmpty():
        return rows.select(key, name)
    cells = F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("_places").alias("place"), F.col(name).alias("value")))))
    return rows.groupBy(key).agg(F.transform(cells, lambda x: x["value"]).alias(name))


def _with_hits(blocks: DataFrame, distinct: DataFrame, table: DataFrame, value: str, max_bytes: int) -> DataFrame:
    """``blocks`` with ``_from`` and ``_to``: those of their ``distinct`` tokens ``(_row, token)`` that ``table`` holds, and their values."""
    hits = lookup_join(distinct, table, ["token"], "inner", max_bytes, spread_by=["_row"])
    per_block = checkpointed(hits.groupBy("_row").agg(F.collect_list("token").alias("_from"), F.collect_list(value).alias("_to")))
    # A block has one row on either side, so none is hot.
    return blocks.join(F.broadcast(per_block) if measured_bytes(per_block) <= max_bytes else per_block, "_row", "left")


def _value_task(keep_unknown: bool, names: Sequence[str]) -> Callable:
    """Blocks to rows: the key, the values of the tokens that have one, and their places in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, codes, rows, old, new = (batch.column(n).slice(i, 1).flatten() for n in ("_words", "_codes", "_rows", "_from", "_to"))
                values = new.take(pc.index_in(words, old))
                values = (pc.coalesce(values, words) if keep_unknown else values).take(codes.flatten())
                lengths = pc.list_value_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
                known = pc.is_valid(values).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lengths)), lengths)
                place = (np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row[known], minlength=len(lengths)))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (values.drop_null(), pa.array(place[known]))]
                yield pa.RecordBatch.from_arrays([*rows.flatten(), *lists], names=names)

    return run


def word_class(token: Column) -> Column:
    """``verb`` for tokens with a verb tag, else ``noun``: the class a token is looked up under."""
    return F.when(tag(token).isin(*TAG_CLASSES["verb"]), "verb").otherwise("noun")


def corpus_lexicon(df: DataFrame, tokens: str) -> DataFrame:
    """``(token, lemma)`` of the distinct tokens of a corpus that are rewritten, each tagged once."""
    return rewrites(lemma_lexicon(known_words(df, tokens)))


def rewrites(lexicon: DataFrame) -> DataFrame:
    """``(token, lemma)``: the entries of a lexicon under the class of their token that change it.

    The tag of a token depends on the token alone, so it has one entry at most (of repeated ones, the greatest).
    """
    entries = lexicon.where((F.col("class") == word_class(F.col("token"))) & (F.col("lemma") != F.col("token")))
    return entries.groupBy("token").agg(F.max("lemma").alias("lemma"))


def clean_texts(
    df: DataFrame,
    column: str,
    lexicon: DataFrame | None = None,
    name: str = "clean_text",
    stop_words: Sequence[str] = STOP_WORDS,
    keep_source: bool = False,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` with the cleaned text to its end: stems, tagged and rewritten by a lexicon, joined by spaces.

    ``lexicon`` is a table ``(token, class, lemma)``; without one, it is derived from the stems of the
    texts themselves. A missing text counts as ``m`` and gives an empty string, like a text without words.
    Texts are tokenised once, into a checkpoint of blocks of rows (without ``column`` unless ``keep_source``).
    Every distinct token of a block is stemmed once, every distinct stem of the corpus tagged and looked up once,
    a block's stems once each, and only those that change come back to it.
    """
    words = clean_tokens(F.coalesce(F.col(column), F.lit("m")), stop_words, stem=False)
    source = df if keep_source else df.drop(column)
    if not source.columns:
        return clean_texts(df, column, lexicon, name, stop_words, True, max_bytes).select(name)
    blocks = in_blocks(df.withColumn("_tokens", words).select("_tokens", *source.columns))
    blocks = checkpointed(
        blocks.select(F.monotonically_increasing_id().alias("_row"), stem_tokens(F.col("_words")).alias("_stems"), "_codes", "_rows")
    )
    changes = corpus_lexicon(blocks, "_stems") if lexicon is None else rewrites(lexicon)
    distinct = blocks.select("_row", F.explode(F.array_distinct("_stems")).alias("token"))
    found = _with_hits(blocks, distinct, changes, "lemma", max_bytes)
    return _out_of_blocks(found, StructType([*source.schema.fields, StructField(name, StringType())]))


def in_blocks(df: DataFrame) -> DataFrame:
    """``(_words, _codes, _rows)``: runs of rows with the distinct words of their ``_tokens``.

    ``_codes`` has for every row its words as places in ``_words``, ``_rows`` the other columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grams.slices(batch, "_tokens"):
                tokens = part.column("_tokens")
                flat = pc.list_flatten(tokens).dictionary_encode()
                lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
                codes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), flat.indices)
                names = [n for n in part.schema.names if n != "_tokens"]
                rows = pa.StructArray.from_arrays([part.column(n) for n in names], names=names)
                yield pa.RecordBatch.from_arrays([_one(x) for x in (flat.dictionary, codes, rows)], names=["_words", "_codes", "_rows"])

    fields = StructType([f for f in df.schema.fields if f.name != "_tokens"])
    return df.mapInArrow(
        run,
        StructType([
            StructField("_words", ArrayType(StringType())),
            StructField("_codes", ArrayType(ArrayType(IntegerType()))),
            StructField("_rows", ArrayType(fields)),
        ]),
    )


def _one(values: pa.Array) -> pa.ListArray:
    """A list array of one cell."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _out_of_blocks(blocks: DataFrame, schema: StructType) -> DataFrame:
    """The rows of ``in_blocks`` and, last, the text of their stems, those of ``_from`` replaced by ``_to``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                stems, codes, rows, old, new = (batch.column(n).slice(i, 1) for n in ("_stems", "_codes", "_rows", "_from", "_to"))
                stems, codes, rows = stems.flatten(), codes.flatten(), rows.flatten()
                if old.is_valid()[0].as_py():
                    stems = pc.coalesce(new.flatten().take(pc.index_in(stems, old.flatten())), stems)
                words = stems.take(codes.flatten())
                ends = np.append(0, np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False)))
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words), " ")
                yield pa.RecordBatch.from_arrays([*rows.flatten(), texts], names=schema.names)

    return blocks.select("_stems", "_codes", "_rows", "_from", "_to").mapInArrow(run, schema)


def lexicon_score(
    df: DataFrame, key: str, tokens: str, scores: DataFrame, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``(key, score)``: the sum of ``scores(token, score)`` over the tokens, 0 if none."""
    exploded = df.select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    found = lookup_join(exploded, scores, ["token"], "left", max_bytes, spread_by=[key, "pos"])
    return found.groupBy(key).agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))


def tag_map(df: DataFrame, tokens: str) -> DataFrame:
    """``(token, tag)`` for every distinct token."""
    return distinct_tokens(df, tokens).withColumn("tag", tag(F.col("token")))


def known_words(df: DataFrame, tokens: str) -> DataFrame:
    """The distinct tokens, computed once."""
    return checkpointed(distinct_tokens(df, tokens))


def known_stems(df: DataFrame, tokens: str) -> DataFrame:
    """The distinct stems of the tokens as ``token``, each distinct token stemmed once."""
    stems = stem_map(df, tokens).select(F.col("stem").alias("token"))
    return checkpointed(stems.distinct())
