"""The queries of this package over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm import (
    alignment,
    bpe,
    filter_audit,
    fingerprint,
    langid,
    lm_corpus,
    minhash,
    packing,
    pii,
    quality_crf,
    quality_rules,
    toxicity,
    urlfilter,
)
from riskframe.llm.common import id_remainder
from riskframe.plans.registry import Run

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(coded, path, public_tokenizers.PATTERN).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(packing.tokenise(table(spark, folder, "documents"), path))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = id_remainder("doc_id", 5) == 0
    model = quality_crf.learn(docs, table(spark, folder, "labels"), ~held)
    return quality_crf.score(docs, model).withColumn("held_out", held)


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_rules.judge(docs, quality_rules.learn(docs, table(spark, folder, "labels")))


def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, folder, "documents"))
    # The contract's ``kept`` compares ids; the operator's also picks one of rows that share an id.
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))


def op7_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = id_remainder("doc_id", 3) == 1
    return langid.predict(docs, langid.learn(docs, ~held)).withColumn("held_out", held)


def op8_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.neighbour_report(table(spark, folder, "documents"))


# The rules of the url contract, and the labels of listed hosts.
URL_RULES = (
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
)
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op9_url_cascade(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in LISTED_LABELS]))
    return urlfilter.judge(table(spark, folder, "pages"), URL_RULES, listed)


def op10_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    remainder = id_remainder("doc_id", 7)
    scored = lm_corpus.score_corpus(docs, (remainder != 2) & F.col("doc_id").isNotNull())
    return scored.withColumn("held_out", remainder == 2)


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.detect(table(spark, folder, "documents")))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    path_a, path_b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.report(alignment.align_documents(table(spark, folder, "documents"), path_a, path_b), path_b)


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    failures = filter_audit.corpus_failures(table(spark, folder, "documents"))
    return filter_audit.audit(filter_audit.contingency(failures, table(spark, folder, "labels")))


_LISTED = ", ".join(f"'{x}'" for x in LISTED_LABELS)
ORACLES["op9_url_cascade"] = f"""
WITH split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.)*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.)*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    len(list_intersect(string_split(host, '.'), [{_LISTED}])) > 0 AS listed
  FROM split)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled"""

ORACLES["op13_filter_audit"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM worded GROUP BY text),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT w.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
     100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text),
     regexp_matches(w.text, '[#$%&*|]'), coalesce(w.doc_id > f.least, false)] AS fails
  FROM worded w JOIN firsts f ON f.text = w.text LEFT JOIN marks m ON m.doc_id = w.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM judged GROUP BY part, fails),
orders(filter_order) AS (
  SELECT ''
  UNION ALL
  SELECT filter_order || letter
  FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter)
  WHERE NOT contains(filter_order, letter)),
steps AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS f,
    [instr('ABCDE', x) FOR x IN string_split(filter_order[1:step - 1], '') IF x <> ''] AS earlier
  FROM orders, range(1, 6) AS r(step)
  WHERE length(filter_order) = 5),
seen AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failing,
    len([e FOR e IN earlier IF fails[e]]) > 0 AS gone, len([x FOR x IN fails IF x]) = 1 AS one
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failing AND one THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted"""

QUERIES |= {
    "op1_bpe": op1_bpe,
    "op2_packing": op2_packing,
    "op3_quality_crf": op3_quality_crf,
    "op4_quality_rules": op4_quality_rules,
    "op5_minhash": op5_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_langid": op7_langid,
    "op8_fingerprint": op8_fingerprint,
    "op9_url_cascade": op9_url_cascade,
    "op10_lm": op10_lm,
    "op11_pii": op11_pii,
    "op12_alignment": op12_alignment,
    "op13_filter_audit": op13_filter_audit,
}
