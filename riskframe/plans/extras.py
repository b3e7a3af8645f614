"""Sequences, embeddings, topics and the remaining feature blocks."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from riskframe.functions import stats
from riskframe.operators import classify, embeddings, lexicon, prep, sequences, topics, vocab
from riskframe.plans.registry import query
from riskframe.plans.tables import documents, table
from riskframe.plans.texts import (
    SQL_BOW,
    SQL_TOKENS,
    bow_frame,
    kept_tokens,
    rounded,
    sql_words,
    tfidf_words,
)
from riskframe.session import checkpointed, scratch_path
from riskframe.sources import tables as readers

# --- Sequences --------------------------------------------------------------------------

SQL_INDEX = f"""{SQL_BOW},
occurrences AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM bow),
word_index AS (
  SELECT term, count(*) AS tf, row_number() OVER (ORDER BY count(*) DESC, term) AS word_id FROM occurrences GROUP BY term)"""
SQL_IDS = f"""{SQL_INDEX},
limits AS (SELECT count(*) AS size FROM word_index WHERE tf >= 5),
ids AS (
  SELECT b.doc_id, list(w.word_id ORDER BY o.pos) FILTER (w.word_id IS NOT NULL) AS ids
  FROM bow b LEFT JOIN occurrences o USING (doc_id)
  LEFT JOIN (SELECT * FROM word_index, limits WHERE word_id < size) w USING (term) GROUP BY b.doc_id)"""


def id_frame(spark, folder):
    terms = bow_frame(spark, folder)
    index, size = vocab.word_index(terms, "terms")
    return sequences.text_to_ids(terms, "doc_id", "terms", index, size)


@query("word_index", f"WITH {SQL_INDEX} SELECT term, tf, word_id FROM word_index")
def _(spark, folder):
    index, _ = vocab.word_index(bow_frame(spark, folder), "terms")
    return index


@query("text_to_ids", f"WITH {SQL_IDS} SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS ids FROM ids")
def _(spark, folder):
    texts = F.transform("ids", lambda i: i.cast("string"))
    return id_frame(spark, folder).select("doc_id", F.array_join(texts, " ").alias("ids"))


@query(
    "pad_sequences",
    f"""
    WITH {SQL_IDS}
    SELECT doc_id, array_to_string(list_resize(coalesce(ids, [])[1:500], 500, 0), ' ') AS ids FROM ids
    """,
)
def _(spark, folder):
    padded = sequences.pad(F.col("ids"), 500)
    texts = F.transform(padded, lambda i: i.cast("string"))
    return id_frame(spark, folder).select("doc_id", F.array_join(texts, " ").alias("ids"))


@query(
    "text_length_stats",
    f"SELECT round(avg(len({sql_words('text')})), 6) AS mean_words, max(len({sql_words('text')})) AS max_words FROM documents",
)
def _(spark, folder):
    return rounded(sequences.length_stats(documents(spark, folder), "text"))


# --- Embeddings ---------------------------------------------------------------------------


@query(
    "embedding_text_scan",
    """
    SELECT 'w' || vec_id AS word, len(embedding)::INTEGER AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total,
      round(embedding[1]::DOUBLE, 5) AS first, round(embedding[64]::DOUBLE, 5) AS last FROM embeddings
    """,
)
def _(spark, folder):
    path = scratch_path(spark, "vectors")
    values = F.transform("embedding", lambda v: v.cast("string"))
    line = F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "), F.array_join(values, " "))
    table(spark, folder, "embeddings").select(line.alias("value")).write.text(path)
    vector = F.transform("vector", lambda v: v.cast("double"))
    total = F.aggregate(vector, F.lit(0.0), lambda a, v: a + v)
    return readers.read_embeddings(spark, path).select(
        "word",
        F.size("vector").alias("size"),
        F.round(total, 4).alias("total"),
        F.round(F.get(vector, F.lit(0)), 5).alias("first"),
        F.round(F.get(vector, F.lit(63)), 5).alias("last"),
    )


@query(
    "embedding_moments",
    """
    SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)
    """,
)
def _(spark, folder):
    return rounded(embeddings.moments(table(spark, folder, "embeddings"), "embedding"))


def word_vectors(spark, folder):
    """Vectors for words: the word index numbers the vectors it takes from ``embeddings``."""
    index, _ = vocab.word_index(bow_frame(spark, folder), "terms")
    index = checkpointed(index.select("term", "word_id"))
    vectors = table(spark, folder, "embeddings").select((F.col("vec_id") * 2 + 1).alias("word_id"), "embedding")
    return index, checkpointed(vectors.join(index, "word_id").select("term", "embedding"))


SQL_DRAW = """mean + std * sqrt(-2 * ln((('0x' || md5(term || ':' || (j // 2))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))
  * (CASE WHEN j % 2 = 0 THEN cos(2 * pi() * (('0x' || md5(term || ':' || (j // 2))[9:16])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)
     ELSE sin(2 * pi() * (('0x' || md5(term || ':' || (j // 2))[9:16])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE) END)"""


@query(
    "embedding_matrix",
    f"""
    WITH {SQL_INDEX},
    known AS (SELECT term, embedding FROM word_index JOIN embeddings ON word_id = vec_id * 2 + 1),
    m AS (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM (SELECT unnest(embedding)::DOUBLE AS v FROM known)),
    cells AS (
      SELECT word_id, term, j, CASE WHEN k.embedding IS NULL THEN {SQL_DRAW} ELSE k.embedding[j + 1] END AS v
      FROM word_index LEFT JOIN known k USING (term), m, unnest(range(64)) AS u(j))
    SELECT word_id, term, round(sum(v), 4) + 0.0::DOUBLE AS total, round(max(v), 5) AS largest, round(min(v), 5) AS smallest
    FROM cells GROUP BY word_id, term
    """,
)
def _(spark, folder):
    index, vectors = word_vectors(spark, folder)
    matrix = embeddings.embedding_matrix(index, vectors, "term", "embedding")
    total = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v)
    return matrix.select(
        "word_id",
        "term",
        # + 0.0 turns a rounded -0.0 into 0.0
        (F.round(total, 4) + 0.0).alias("total"),
        F.round(F.array_max("vector"), 5).alias("largest"),
        F.round(F.array_min("vector"), 5).alias("smallest"),
    )


@query(
    "embedding_pool",
    """
    SELECT label, place::INTEGER - 1 AS place, round(max(v), 6) AS max_pool, round(avg(v), 6) AS mean_pool FROM (
      SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS place FROM embeddings)
    GROUP BY label, place
    """,
)
def _(spark, folder):
    pooled = embeddings.pool(table(spark, folder, "embeddings"), ["label"], "embedding")
    cells = pooled.select("label", F.posexplode(F.arrays_zip("max_pool", "mean_pool")).alias("place", "_c"))
    return rounded(cells.select("label", "place", "_c.max_pool", "_c.mean_pool"))


@query(
    "document_vectors",
    f"""
    WITH {SQL_INDEX},
    known AS (SELECT term, embedding FROM word_index JOIN embeddings ON word_id = vec_id * 2 + 1),
    cells AS (
      SELECT doc_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS place
      FROM occurrences JOIN known USING (term)),
    pooled AS (SELECT doc_id, place, max(v) AS hi, avg(v) AS mean FROM cells GROUP BY doc_id, place)
    SELECT d.doc_id, round(sum(hi), 4) AS max_total, round(sum(mean), 4) AS mean_total
    FROM documents d LEFT JOIN pooled USING (doc_id) GROUP BY d.doc_id
    """,
)
def _(spark, folder):
    _, vectors = word_vectors(spark, folder)
    pooled = embeddings.document_vectors(
        bow_frame(spark, folder), "doc_id", "terms", vectors, "term", "embedding"
    )

    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 4)

    return pooled.select("doc_id", total("max_pool").alias("max_total"), total("mean_pool").alias("mean_total"))


@query("mlp_classifier")
def _(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        (F.col("label") % 2).alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("_v"),
        F.array_max("embedding").cast("double").alias("peak"),
    )
    scaled = prep.MinMaxScaler.fit(rows, ["peak"]).transform(rows)
    assembled = VectorAssembler(inputCols=["_v", "peak"], outputCol="features").transform(scaled)
    model = classify.fit_perceptron(assembled, "label", [65, 13, 2])
    return classify.scored(model, assembled, ["vec_id", "label"])


# --- Topics -------------------------------------------------------------------------------

TOPICS, TOP_TERMS = 5, 10


def lda_model(spark, folder):
    _, known = tfidf_words(spark, folder)
    counts = vocab.bow_vectorizer(known, "terms", "counts", binary=False)
    rows = checkpointed(counts.transform(bow_frame(spark, folder)).select("doc_id", "counts"))
    return topics.fit_lda(rows, "counts", TOPICS), rows, known


@query("lda_topics")
def _(spark, folder):
    model, rows, _ = lda_model(spark, folder)
    return topics.lda_documents(model, rows, "doc_id")


@query("topic_terms")
def _(spark, folder):
    model, _, known = lda_model(spark, folder)
    return topics.top_terms(topics.lda_topic_terms(model, TOP_TERMS), known, TOP_TERMS)


def weight_rows(spark, folder):
    weights, known = tfidf_words(spark, folder)
    return checkpointed(topics.term_rows(weights, "doc_id", "tfidf")), known


@query("nmf_topics")
def _(spark, folder):
    rows, known = weight_rows(spark, folder)
    size = known.count()
    tables = []
    for loss in ("frobenius", "kullback-leibler"):
        H = topics.fit_nmf(rows, size, TOPICS, loss, max_iter=10)
        best = topics.top_terms(topics.nmf_topic_terms(rows, H), known, TOP_TERMS)
        tables.append(best.withColumn("loss", F.lit(loss)))
    return tables[0].unionByName(tables[1])


BODY_DIMENSIONS, SUBJECT_MIN_DF = 50, 50


def body_block(spark, folder):
    """``(doc_id, projection)`` of all documents, from tf-idf of all terms, and the dimensions.

    Zeros where a document has no term.
    """
    terms = bow_frame(spark, folder)
    known = checkpointed(vocab.term_stats(terms, "terms")).withColumn("term_id", F.lit(None).cast("long"))
    weights = vocab.tfidf(terms, "doc_id", "terms", known)
    cells = checkpointed(weights.select("doc_id", "term", F.col("tfidf").alias("value")))
    found, _, size = topics.svd_of_cells(cells, "doc_id", BODY_DIMENSIONS)
    zeros = F.array_repeat(F.lit(0.0), size)
    every = documents(spark, folder).select("doc_id").join(found, "doc_id", "left")
    return every.select("doc_id", F.coalesce("projection", zeros).alias("projection")), size


@query("tfidf_svd")
def _(spark, folder):
    return body_block(spark, folder)[0]


# --- Other feature blocks -------------------------------------------------------------------


@query("weighted_union")
def _(spark, folder):
    # Subject: tf-idf of the source name. Body: tf-idf in few dimensions. Statistics of the text.
    projected, dimensions = body_block(spark, folder)
    body = projected.select("doc_id", array_to_vector("projection").alias("body"))
    subject_terms = documents(spark, folder).select("doc_id", vocab.bow_tokens(F.col("source")).alias("terms"))
    subject_known = checkpointed(vocab.vocabulary(subject_terms, "terms", min_df=SUBJECT_MIN_DF))
    subject = topics.tfidf_vectors(subject_terms, "doc_id", "terms", subject_known, "subject")
    counted = stats.mark_counts(table(spark, folder, "documents").select("doc_id", "text"), "text").drop("text")
    numbers = ["num_words", "num_commas", "num_bangs", "num_quotes", "avg_word"]
    filled = prep.MeanImputer.fit(counted, numbers).transform(counted)
    block = VectorAssembler(inputCols=numbers, outputCol="stats").transform(filled).select("doc_id", "stats")
    joined = subject.select("doc_id", "subject").join(body, "doc_id").join(block, "doc_id")
    sizes = {"subject": subject_known.count(), "body": dimensions, "stats": len(numbers)}
    for stage in prep.weighted_union({"subject": 0.8, "body": 1.0, "stats": 1.0}, sizes, "features"):
        joined = stage.transform(joined)
    return joined.select("doc_id", vector_to_array("features").alias("features"))


@query(
    "dict_vectorize",
    """
    WITH records AS (SELECT event_id, 'k' AS name, (props->>'$.k')::DOUBLE AS value FROM events
      UNION ALL SELECT event_id, 'event_type=' || event_type, 1.0 FROM events),
    names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS feature_id FROM (SELECT DISTINCT name FROM records))
    SELECT event_id, feature_id, value FROM records JOIN names USING (name)
    """,
)
def _(spark, folder):
    events = table(spark, folder, "events")
    numbers = F.from_json("props", "map<string,double>")
    kinds = F.create_map(F.concat(F.lit("event_type="), "event_type"), F.lit(1.0))
    records = events.select("event_id", F.map_concat(numbers, kinds).alias("record"))
    return vocab.dict_vectorize(records, "event_id", "record")


SENTIMENT_SQL = """
scores AS (
  SELECT token, ((('0x' || md5(token)[1:4])::BIGINT % 11) - 5)::DOUBLE AS score FROM (SELECT DISTINCT unnest(tokens) AS token FROM toks)
  WHERE ('0x' || md5(token)[5:8])::BIGINT % 4 = 0)"""


@query(
    "lexicon_score",
    f"""
    WITH {SQL_TOKENS}, {SENTIMENT_SQL},
    occurrences AS (SELECT doc_id, unnest(tokens) AS token FROM toks)
    SELECT t.doc_id, coalesce(sum(s.score), 0)::DOUBLE AS score
    FROM toks t LEFT JOIN occurrences o USING (doc_id) LEFT JOIN scores s USING (token) GROUP BY t.doc_id
    """,
)
def _(spark, folder):
    # A word list as large as the vocabulary: a quarter of the words, scored -5 to 5 by hash.
    kept = checkpointed(kept_tokens(spark, folder))

    def digits(start):
        return F.conv(F.substring(F.md5("token"), start, 4), 16, 10).cast("long")

    words = lexicon.distinct_tokens(kept, "tokens").filter(digits(5) % 4 == 0)
    scores = words.select("token", (digits(1) % 11 - 5).cast("double").alias("score"))
    return lexicon.lexicon_score(kept, "doc_id", "tokens", scores)
