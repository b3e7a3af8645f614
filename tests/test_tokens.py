from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskframe.functions import text, tokens
from riskframe.operators import lexicon

# Examples from the published description of the stemmer, and words with fixed stems.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "enjoy": "enjoy", "cry": "cri",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ",
    "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog",
    "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener",
    "oscillators": "oscil", "consolidation": "consolid", "dies": "die", "dying": "die",
    "news": "news", "succeed": "succeed", "spied": "spi", "died": "die", "using": "use", "yes": "ye",
}


def test_published_stems(spark):
    df = spark.createDataFrame([(list(STEMS),)], "w array<string>")
    stems = df.select(tokens.stem_tokens(F.col("w")).alias("s")).first()["s"]
    assert dict(zip(STEMS, stems)) == STEMS


@pytest.mark.parametrize(
    ("sentence", "expected"),
    [
        ("mike's loan (now)", ["mike", "'s", "loan", "(", "now", ")"]),
        ("i've paid 100% - cannot stop", ["i", "'ve", "paid", "100", "%", "-", "can", "not", "stop"]),
        ('a "free" ride', ["a", "``", "free", "''", "ride"]),
        ("won't the dogs' owner", ["wo", "n't", "the", "dogs", "'", "owner"]),
        ("dd/dd/dd debt-free gonna--go", ["dd/dd/dd", "debt-free", "gon", "na", "--", "go"]),
    ],
)
def test_word_separation(spark, sentence, expected):
    df = spark.createDataFrame([(sentence,)], "x string")
    assert df.select(tokens.tokenize(F.col("x")).alias("t")).first()["t"] == expected


def test_clean_text(spark):
    rows = [(0, "Borrower added on 12/14/11 > looking to be debt free!!<br>"), (1, None), (2, "   ")]
    df = spark.createDataFrame(rows, "i int, x string")
    found = [r["c"] for r in df.orderBy("i").select(tokens.clean_text(F.col("x")).alias("c")).collect()]
    assert found == ["borrow ad dd/dd/dd look debt free", "", ""]


def test_tags(spark):
    words = ["the", "quickly", "running", "loans", "I", "paid", "!", "12", "not", "debt", "useful"]
    df = spark.createDataFrame([(words,)], "w array<string>").select(tokens.tag_tokens(F.col("w")).alias("t"))
    assert df.first()["t"] == ["DT", "RB", "VBG", "NNS", "PRP", "VBD", ".", "CD", "RB", "NN", "JJ"]
    assert df.select(tokens.tag_class_count(F.col("t"), "noun")).first()[0] == 2


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_rewriting_by_lexicon(spark, max_bytes):
    rows = [(1, ["loans", "paying", "loan", "pay", "loans"]), (2, []), (3, ["cities", "paying"])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    known = spark.createDataFrame([(w,) for w in ("loans", "loan", "paying", "pay", "cities", "city")], "token string")
    lemmas = lexicon.lemma_lexicon(known)
    found = lexicon.rewrite_tokens(df, "id", "t", lemmas, max_bytes=max_bytes).orderBy("id").collect()
    assert [r["lemmas"] for r in found] == [["loan", "pay", "loan", "pay", "loan"], [], ["city", "pay"]]


def test_rewriting_moves_blocks_not_tokens(spark):
    rows = [(7, ["loans", None, "x"]), (None, ["paying"]), (7, ["paying", "loans"]), (None, ["y"]), (3, None)]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    lemmas = spark.createDataFrame(
        [("loans", "noun", "loan"), ("paying", "verb", "pay"), ("paying", "noun", "wrong"), ("y", "noun", None)], "token string, class string, lemma string"
    )
    rewritten = lexicon.rewrite_tokens(df, "id", "t", lemmas)
    # Rows of one key are put together by places, equal places in the order of the words.
    assert {r["id"]: r["lemmas"] for r in rewritten.collect()} == {7: ["loan", "pay", "loan", "x"], None: ["pay", "y"], 3: []}
    alone = lexicon.rewrite_tokens(df.where("id = 3 or t[0] = 'y'"), "id", "t", lemmas)
    assert "Exchange hashpartitioning" not in alone._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"] or 0, r["lemmas"]) for r in alone.collect()) == [(0, ["y"]), (3, [])]


def test_lexicon_score(spark):
    df = spark.createDataFrame([(1, ["good", "good", "bad"]), (2, []), (3, ["plain"])], "id long, t array<string>")
    scores = spark.createDataFrame([("good", 2.0), ("bad", -1.5)], "token string, score double")
    found = {r["id"]: r["score"] for r in lexicon.lexicon_score(df, "id", "t", scores).collect()}
    assert found == {1: 2.5, 2: 0.0, 3: 0.0}


def test_stem_table_has_one_row_per_word(spark):
    df = spark.createDataFrame([(1, ["loans", "loan", "loans"])], "id long, t array<string>")
    found = {(r["token"], r["stem"]) for r in lexicon.stem_map(df, "t").collect()}
    assert found == {("loans", "loan"), ("loan", "loan")}


def test_stateless_functions_run_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("Can't PAY 5!",), ("ok",)], "x string").write.parquet(source)
    stream = spark.readStream.schema("x string").parquet(source).select(
        text.normalize_text(F.col("x")).alias("n"), F.size(text.words(F.col("x"))).alias("w")
    )
    name = "normalized_stream"
    running = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    running.processAllAvailable()
    running.stop()
    assert {tuple(r) for r in spark.table(name).collect()} == {("ca not pay d !", 3), ("ok", 1)}
