"""The trained operators: brute-force parts, held-out accuracy and odd rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import common, langid, quality_crf, quality_rules, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 50_000, None), (3, "\n \n\t", "en")]


def odd(spark, extra="score string"):
    return spark.createDataFrame(ODD, f"doc_id long, text string, {extra}")


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(8).cache()
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def held_out(result, labels, target, modulus=5):
    joined = result.join(labels.select("doc_id", F.col(target).alias("_truth")), "doc_id").toPandas()
    return joined[joined.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % modulus == 0)]


# --- quality rules -----------------------------------------------------------------------------


def plain_counts(text):
    """The contract's counts, word by word."""
    words, at = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [at] if at else []
            at = ""
        else:
            at += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = text.split("\n")
    duplicates = sum(1 for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r") and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(inside)


def test_rule_counts():
    draw = np.random.default_rng(1)
    parts = ["a", "b", "é#", "|", " ", " ", "\n", "\n", "\t", "\x0b", "  ", "漢", "\x85", "\xa0"]
    for _ in range(400):
        text = "".join(draw.choice(parts, draw.integers(0, 60)))
        assert quality_rules.rule_counts(text.encode()) == plain_counts(text)


def test_quality_rules_separate_held_out_rows(spark, tables):
    docs, labels = tables
    eligible = common.id_remainder("doc_id", 5) != 0
    model = quality_rules.fit(common.labelled_sample(docs, labels, "quality", 4000, eligible))
    rows = held_out(quality_rules.judge(docs, model), labels, "quality")
    # Clean documents that pass the base rules stay.
    assert rows[(rows._truth == 1) & ~rows.base_failed].kept.mean() > 0.97
    assert (~rows[rows._truth == 0].kept).mean() > 0.5


def test_quality_rules_on_odd_rows(spark, tables):
    docs, labels = tables
    model = quality_rules.fit(common.labelled_sample(docs, labels, "quality", 100))
    rows = quality_rules.judge(odd(spark), model).collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 0, 0, 50_000]
    assert all(r.base_failed and not r.kept and 0 <= r.score <= 1 for r in rows)
    assert quality_rules.judge(odd(spark).limit(0), model).count() == 0
    assert quality_rules.filter_documents(odd(spark), model).count() == 0
    kept = quality_rules.filter_documents(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality_rules.judge(docs, model).where("kept").count()


def test_fits_without_labels_decide_nothing(spark, tables):
    docs, labels = tables
    none = labels.limit(0)
    assert quality_rules.learn(docs, none) is quality_rules.UNDECIDED
    assert quality_crf.learn(docs, none) is quality_crf.UNDECIDED
    clean = toxicity.learn(docs, none)
    assert toxicity.score(docs, clean).where("toxic").count() == 0


def test_labelled_sample_is_bounded_and_ignores_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 3, 4, 4)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 1), (3, None), (None, 1), (4, 7), (4, 1), (9, 1)], "doc_id long, quality int"
    )
    rows = sorted((r.doc_id, r.label, r.text) for r in common.labelled_sample(docs, labels, "quality", 10).collect())
    assert rows == [(1, 0, "t1"), (2, 1, "t2"), (4, 1, "t4")]
    assert common.labelled_sample(docs, labels, "quality", 1).count() <= 1


# --- conditional random field ------------------------------------------------------------------


def test_forward_backward_against_all_labellings():
    draw = np.random.default_rng(4)
    emission, transition = draw.normal(size=9), draw.normal(size=(2, 2))
    lengths = np.array([1, 5, 3])
    chain = quality_crf.forward_backward(emission, lengths, transition)
    at = 0
    for n in lengths:
        e = emission[at : at + n]
        total, good, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(transition[y[i - 1], y[i]] for i in range(1, n)))
            total += weight
            good += weight * np.array(y)
            for i in range(1, n):
                pairs[i, y[i - 1], y[i]] += weight
        assert np.allclose(chain.good[at : at + n], good / total)
        assert np.allclose(chain.pairs[at : at + n], pairs / total)
        at += n


def test_line_features_see_neighbours():
    x, sizes, lines = quality_crf.line_features([b"AAA bbb\nccc", b"", b"d\nd"])
    assert lines.tolist() == [2, 1, 2] and sizes.tolist() == [8, 4, 1, 2, 2]
    upper, again = quality_crf.OWN.index("upper"), quality_crf.OWN.index("repeated_line")
    assert x[0, upper] == pytest.approx(np.sqrt(3 / 7)) and x[1, upper] == 0
    before = len(quality_crf.OWN) + quality_crf.SHARED.index(upper)
    assert x[1, before] == x[0, upper] and x[2, before] == 0
    assert x[:, again].tolist() == [0, 0, 0, 0, 1]


def test_crf_accuracy_and_odd_rows(spark, tables):
    docs, labels = tables
    model = quality_crf.learn(docs, labels, common.id_remainder("doc_id", 5) != 0)
    rows = held_out(quality_crf.score(docs, model), labels, "quality")
    assert (rows.predicted == rows._truth).mean() > 0.95
    scored = quality_crf.score(odd(spark), model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.n_lines == 1 and r.doc_id != 2}) == 1
    assert quality_crf.score(odd(spark).limit(0), model).count() == 0
    assert quality_crf.label_lines(odd(spark), model).count() == 3 + 1 + 3
    many = spark.createDataFrame([(1, "line of words\n" * 20_000)], "doc_id long, text string")
    assert quality_crf.score(many, model).first().n_lines == 20_001


def test_crf_query_never_learns_from_held_out_rows(spark):
    from riskframe.llm.queries import QUERIES

    rows = QUERIES["op3_quality_crf"](spark, SF).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (1 if r.score >= 0.3 else 0) for r in rows)


# --- toxicity ----------------------------------------------------------------------------------


def test_ordinal_fit_orders_grades():
    draw = np.random.default_rng(5)
    truth = np.array([2.0, 1.0, 0.0, -1.0])
    values = draw.integers(0, 3, (3000, 4)).astype(np.float32)
    z = values @ truth + draw.logistic(size=3000)
    grade = (z > 2).astype(int) + (z > 5)
    x = common.Sparse([np.arange(4)] * 3000, list(values), 4)
    w, t = toxicity.fit_ordinal(x, grade, penalty=1e-4, steps=2000)
    assert t[0] <= t[1]
    assert np.allclose(w, truth, atol=0.25) and np.allclose(t, [2, 5], atol=0.5)


def test_toxic_rows_are_caught_and_clean_ones_left(spark, tables):
    docs, labels = tables
    model = toxicity.fit(common.labelled_sample(docs, labels, "toxic", 8000, common.id_remainder("doc_id", 5) != 0))
    scored = toxicity.score(docs, model).withColumnRenamed("toxic", "found")
    rows = held_out(scored, labels, "toxic")
    assert rows[rows._truth == 0].found.mean() < 0.01
    english = rows[(rows._truth == 1)]
    assert english.found.mean() > 0.5
    every = scored.toPandas()
    assert ((every.p_severe <= every.p_toxic) & (every.severity <= 2) & (every.severity >= 0)).all()


def test_toxicity_on_odd_rows(spark, tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and not any(r.toxic for r in rows)
    assert toxicity.score(odd(spark).limit(0), model).count() == 0
    assert toxicity.filter_documents(odd(spark), model).columns == ["doc_id", "text", "score"]
    kept = toxicity.filter_documents(docs, model).count()
    assert kept == toxicity.score(docs, model).where("not toxic").count()


# --- language ----------------------------------------------------------------------------------


def test_language_of_held_out_rows(spark):
    from riskframe.llm.queries import QUERIES

    rows = QUERIES["op7_langid"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    pandas = rows.toPandas()
    assert len(pandas) == 1000
    held = pandas[pandas.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert all(h == (zlib.crc32(str(k).encode()) % 3 == 1) for k, h in zip(pandas.doc_id, pandas.held_out, strict=True))


def test_language_backs_off_to_shorter_grams():
    rows = {(0, "the"): 0, (3, "ing"): 1, (1, "z"): 2}
    table = np.array([[0, -1], [-1, -3], [-5, -2], [0, 0]], np.float32)
    model = langid.Model(["a", "b"], rows, table)
    assert model.vector("the").tolist() == [0, -1]
    assert model.vector("sing").tolist() == [-1, -3]
    assert model.vector("zz").tolist() == [-5, -2]
    assert model.vector("qq").tolist() == [0, 0]


def test_vectors_of_words_are_taken_together():
    grams = ["abc", "bcd", "cde", "the", "z"]
    rows = {(len(g), g): i for i, g in enumerate(grams)} | {(0, "abc"): 5}
    table = np.random.default_rng(3).normal(size=(7, 4)).astype(np.float32)
    table[-1] = 0
    model = langid.Model(list("abcd"), rows, table)
    want = {"abc": [5], "abcd": [0, 1], "xabcde": [0, 1, 2], "zz": [4, 4], "q": [6], "other": [3]}
    found = model.vectors(list(want))
    assert found.tolist() == [table[r].mean(0).tolist() for r in want.values()]
    assert model.vectors([]).shape == (0, 4)


def test_language_on_odd_rows(spark):
    learn = spark.createDataFrame([("the cat", "en"), ("le chat", "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.learn(learn)
    assert model.langs == ["en", "fr"]
    rows = [(1, None), (2, ""), (3, "12 ½ ² !"), (4, "THE the"), (5, "chat"), (5, "chat"), (None, "le " * 40_000), (6, "qqq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, model).collect()]
    assert {(k, p) for k, p, _ in out} == {
        (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (None, "fr"), (6, "en")
    }
    assert all(0 <= s <= 1 for _, _, s in out) and all(s == 0 for _, p, s in out if p == "und")
    assert langid.predict(df.limit(0), model).count() == 0
    nothing = langid.learn(learn.limit(0))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
