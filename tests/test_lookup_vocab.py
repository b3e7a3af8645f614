from __future__ import annotations

import random

from collections import Counter
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from riskframe.operators import embeddings, lookup, sequences, vocab

DOCS = {
    1: "pay the loan pay the card".split(),
    2: "loan for a car".split(),
    3: [],
    4: "pay pay pay".split(),
    5: "car loan".split(),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "id long, t array<string>")


def grams_of(words, low=1, high=3):
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_is_the_same_by_broadcast_and_by_salted_shuffle(spark, how):
    # One key holds two thirds of the rows.
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    small = lookup.lookup_join(df, table, ["k"], how)
    large = lookup.lookup_join(df, table, ["k"], how, max_bytes=0, spread_by=["id"])
    assert small.count() == large.count() == df.join(table, "k", how).count()
    assert small.exceptAll(large.select(small.columns)).count() == 0
    plan = large._jdf.queryExecution().toString()
    assert "_salt" in plan and "ResolvedHint" not in plan


def test_ngrams(docs):
    found = vocab.with_ngrams(docs, "t", "g").collect()
    assert {r["id"]: sorted(r["g"]) for r in found} == {i: sorted(grams_of(w)) for i, w in DOCS.items()}
    only = vocab.with_ngrams(docs, "t", "g", 2, 2).collect()
    assert {r["id"]: r["g"] for r in only} == {i: grams_of(w, 2, 2) for i, w in DOCS.items()}


def test_term_counts(docs):
    exploded = vocab.exploded_terms(docs, "id", "t").collect()
    expected = {(i, t): n for i, w in DOCS.items() for t, n in Counter(w).items()}
    assert {(r["id"], r["term"]): r["tf"] for r in exploded} == expected
    stats = {r["term"]: (r["tf"], r["df"]) for r in vocab.term_stats(docs, "t").collect()}
    assert stats["pay"] == (5, 2) and stats["loan"] == (3, 3) and stats["the"] == (2, 1)


def test_vocabulary_keeps_the_most_frequent(docs):
    found = vocab.vocabulary(docs, "t", min_df=2, max_features=2).orderBy("term_id").collect()
    assert [(r["term"], r["tf"], r["df"]) for r in found] == [("loan", 3, 3), ("pay", 5, 2)]
    rare = vocab.vocabulary(docs, "t", max_df=0.4).collect()
    assert {r["term"] for r in rare} == {"pay", "the", "card", "for", "a", "car"}


def test_fitting_on_train_ignores_test(docs):
    train = docs.filter(F.col("id") <= 2)
    assert "car loan" not in {
        r["term"] for r in vocab.vocabulary(vocab.with_ngrams(train, "t", "g"), "g").collect()
    }


def test_bag_of_words_long_and_vector_form_agree(docs):
    known = vocab.vocabulary(docs, "t")
    long = {(r["id"], r["term_id"]): r["tf"] for r in vocab.bow_counts(docs, "id", "t", known).collect()}
    model = vocab.bow_vectorizer(known, "t", "v", binary=False)
    vectors = {}
    for r in model.transform(docs).collect():
        for i, n in zip(r["v"].indices, r["v"].values):
            vectors[(r["id"], int(i))] = int(n)
    assert long == vectors
    binary = vocab.bow_binary(docs, "id", "t", known)
    assert {r["present"] for r in binary.collect()} == {1} and binary.count() == len(long)


def test_tfidf_by_hand(docs):
    known = vocab.vocabulary(docs, "t", min_df=2)
    for sublinear in (False, True):
        found = {(r["id"], r["term"]): r["tfidf"] for r in vocab.tfidf(docs, "id", "t", known, sublinear).collect()}
        terms = {"pay", "loan", "car"}
        df = {t: sum(t in w for w in DOCS.values()) for t in terms}
        for i, words in DOCS.items():
            raw = {
                t: (1 + log(n) if sublinear else n) * (log(6 / (1 + df[t])) + 1)
                for t, n in Counter(words).items() if t in terms
            }
            norm = sqrt(sum(v * v for v in raw.values()))
            for t, v in raw.items():
                assert found.pop((i, t)) == pytest.approx(v / norm)
        assert not found


def test_word_index_and_sequences(docs):
    index, size = vocab.word_index(docs, "t", min_count=2)
    rows = sorted((r["word_id"], r["term"], r["tf"]) for r in index.collect())
    counts = Counter(w for words in DOCS.values() for w in words)
    expected = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    assert rows == [(i, t, n) for i, (t, n) in enumerate(expected, start=1)]
    assert size == sum(n >= 2 for n in counts.values())
    ids = {t: i for i, t, _ in rows}
    for limit in (None, 3):
        found = sequences.text_to_ids(docs, "id", "t", index, limit)
        padded = found.select("id", sequences.pad(F.col("ids"), 4).alias("ids")).collect()
        for r in padded:
            known = [ids[w] for w in DOCS[r["id"]] if limit is None or ids[w] < limit]
            assert r["ids"] == (known + [0] * 4)[:4]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_sequences_of_repeated_null_and_unknown(spark, max_bytes):
    rows = [(1, ["b", "a", None, "z", "a"]), (2, ["z"]), (2, ["a", "b"]), (3, None), (None, ["b"])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    index = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, word_id long")
    found = sequences.text_to_ids(df, "id", "t", index, max_bytes=max_bytes)
    assert found.schema.simpleString() == "struct<id:bigint,ids:array<bigint>>"
    assert {r["id"]: r["ids"] for r in found.collect()} == {1: [2, 1, 1], 2: [1, 2], 3: [], None: [2]}
    once = sequences.text_to_ids(df.where("id != 2"), "id", "t", index, max_bytes=max_bytes)
    assert {r["id"]: r["ids"] for r in once.collect()} == {1: [2, 1, 1], 3: []}
    if max_bytes:
        assert "Exchange hashpartitioning" not in once._jdf.queryExecution().executedPlan().toString()


def test_dict_vectorize(spark):
    df = spark.createDataFrame([(1, {"b": 2.0, "a": 1.0}), (2, {"c": 3.0})], "id long, m map<string,double>")
    found = {(r["id"], r["feature_id"]): r["value"] for r in vocab.dict_vectorize(df, "id", "m").collect()}
    assert found == {(1, 0): 1.0, (1, 1): 2.0, (2, 2): 3.0}


def test_embedding_table_keeps_known_vectors_and_draws_the_rest(spark):
    index = spark.createDataFrame([(f"w{i}", i) for i in range(1, 400)], "term string, word_id long")
    vectors = spark.createDataFrame([("w1", [1.0, 3.0]), ("w2", [5.0, 7.0])], "w string, v array<float>")
    rows = embeddings.embedding_matrix(index, vectors, "w", "v").collect()
    table = {r["term"]: r["vector"] for r in rows}
    assert table["w1"] == [1.0, 3.0] and table["w2"] == [5.0, 7.0]
    drawn = [v for t, vec in table.items() if t not in ("w1", "w2") for v in vec]
    assert len(drawn) == 2 * 397
    mean, std = 4.0, sqrt(5.0)
    assert sum(drawn) / len(drawn) == pytest.approx(mean, abs=0.3)
    assert sqrt(sum((v - mean) ** 2 for v in drawn) / len(drawn)) == pytest.approx(std, abs=0.3)
    again = embeddings.embedding_matrix(index.repartition(7), vectors, "w", "v").collect()
    assert {r["term"]: r["vector"] for r in again} == table


def test_document_pooling(spark, docs):
    vectors = spark.createDataFrame([("pay", [1.0, -2.0]), ("loan", [0.0, 4.0])], "w string, v array<double>")
    found = {r["id"]: r for r in embeddings.document_vectors(docs, "id", "t", vectors, "w", "v").collect()}
    assert set(found) == {r["id"] for r in docs.collect()}
    assert {k for k, r in found.items() if r["max_pool"] is None} == set(found) - {1, 2, 4, 5}
    assert found[1]["max_pool"] == [1.0, 4.0]
    assert found[1]["mean_pool"] == pytest.approx([2 / 3, 0.0])


def test_document_pooling_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_CELLS", 40)
    draw = random.Random(7)
    rows = [(i % 60, [f"w{draw.randrange(30)}" for _ in range(draw.randrange(9))]) for i in range(90)]
    df = spark.createDataFrame([*rows, (None, ["w1"]), (70, None), (71, ["none"])], "id int, t array<string>")
    table = [(f"w{i}", [draw.gauss(0, 1) for _ in range(3)]) for i in range(0, 30, 2)] + [("w2", [9.0, -9.0, 0.5])]
    vectors = spark.createDataFrame(table, "w string, v array<float>")

    def run(max_bytes):
        found = embeddings.document_vectors(df, "id", "t", vectors, "w", "v", max_bytes=max_bytes)
        assert max_bytes or "Summarizer" not in found._jdf.queryExecution().toString()
        return sorted(map(tuple, found.collect()), key=str)

    want, found = run(1 << 20), run(0)
    assert [r[0] for r in found] == [r[0] for r in want] and len(found) == 93
    for (_, *a), (_, *b) in zip(found, want, strict=True):
        assert [x is None for x in a] == [x is None for x in b]
        assert a[0] is None or a[0] == b[0] and a[1] == pytest.approx(b[1])


def test_pruned_vocabulary_equals_counting_all_ngrams(spark, monkeypatch):
    draw = random.Random(4)
    words = ["a", "b", "c", "dd", "ee", "f g"]
    rows = [(i, [draw.choice(words[: 1 + i % 6]) for _ in range(draw.randrange(12))]) for i in range(80)] + [(90, []), (91, None)]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    # A small map lets terms share bits, which costs counts, not terms.
    for bits in (vocab.MAP_BITS, 64):
        monkeypatch.setattr(vocab, "MAP_BITS", bits)
        for high, min_df in ((1, 2), (2, 3), (3, 4), (3, 30)):
            whole = vocab.term_stats(vocab.with_ngrams(df, "t", "g", 1, high), "g").filter(F.col("df") >= min_df)
            found = vocab.frequent_terms(df, "t", high, min_df)
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    assert vocab.ngram_vocabulary(df, "t", max_features=7).count() == 7


def test_blocks_of_features_stand_side_by_side(spark):
    first = spark.createDataFrame([(1, 0, 0.5), (1, 2, 0.25)], "id int, term_id long, value double")
    second = spark.createDataFrame([(1, 0, 1), (2, 1, 1)], "id int, term_id long, value int")
    known = [spark.range(n) for n in (3, 2)]
    cells = vocab.stacked("id", [("a", first, known[0]), ("b", second, known[1])]).collect()
    assert sorted(map(tuple, cells)) == [(1, "a", 0, 0.5), (1, "a", 2, 0.25), (1, "b", 3, 1.0), (2, "b", 4, 1.0)]


def test_grams_are_looked_up_as_they_are_counted(spark, monkeypatch):
    draw = random.Random(5)
    words = ["a", "b", "c", "dd", "f g"]
    rows = [(i % 37, [draw.choice(words) for _ in range(draw.randrange(9))]) for i in range(50)] + [(None, ["a", "b"]), (None, ["b"]), (99, None)]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    listed = vocab.with_ngrams(df, "t", "g").select("id", "g")
    known = vocab.vocabulary(listed, "g", min_df=3)
    weights = known.select("term", "term_id", "df")
    ways = []
    for limit in (vocab.BROADCAST_BYTES, 0):
        monkeypatch.setattr(vocab, "BROADCAST_BYTES", limit)
        ways += [vocab.bow_counts(df, "id", "t", known, high=3), vocab.bow_counts(listed, "id", "g", known)]
        tfidf = vocab.tfidf(df, "id", "t", weights, True, high=3).select("id", "term", F.round("tfidf", 9))
        ways.append(tfidf)
    found = [sorted(map(tuple, w.collect()), key=repr) for w in ways]
    assert found[0] == found[1] == found[3] == found[4] and found[2] == found[5] and found[0] and found[2]


def test_vocabulary_of_characters_equals_counting_all(spark):
    draw = random.Random(6)
    rows = [(i, "".join(draw.choice("aab \U0001f600é") for _ in range(draw.randrange(30)))) for i in range(60)] + [(98, ""), (99, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    chars = df.select("id", F.split("t", "").alias("t"))
    every = vocab.with_ngrams(chars, "t", "g", 2, 6, separator="")
    for size in (5, 40, 300, 10**6):
        whole = vocab.top_vocabulary(vocab.term_stats(every, "g"), size)
        found = vocab.ngram_vocabulary(df, "t", 6, 1, size, low=2, separator="")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_cleaned_texts_do_not_depend_on_blocks(spark, monkeypatch):
    from riskframe.functions.tokens import clean_text
    from riskframe.operators import lexicon

    rows = [(i, f"Running loans paid {i} times, the {w}'s payments running", [w]) for i, w in enumerate(["bank", "lender", "house"] * 9)]
    df = spark.createDataFrame([*rows, (None, None, None), (98, "", []), (98, "of the", ["x"])], "id int, text string, more array<string>")
    nothing = spark.createDataFrame([], "token string, class string, lemma string")
    plain = sorted(map(tuple, df.select("id", "more", clean_text(F.col("text"))).collect()), key=repr)
    assert sorted(map(tuple, lexicon.clean_texts(df, "text", nothing).collect()), key=repr) == plain
    stems = sorted({w for r in plain for w in r[2].split()})
    found = lexicon.known_stems(df.selectExpr("split(lower(regexp_replace(text, '[^A-Za-z]+', ' ')), ' ') AS t"), "t")
    assert {s for s in stems if s.isalpha()} <= {r["token"] for r in found.collect()}
    changed = lexicon.clean_texts(df.select("text"), "text", spark.createDataFrame([("bank", "noun", "shore")], nothing.schema))
    assert changed.columns == ["clean_text"]
    assert sum("shore" in r[0].split() for r in changed.collect()) == sum("bank" in r[2].split() for r in plain) == 9
