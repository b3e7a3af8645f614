"""The pipeline's stages against plain code, on the small tables and on odd rows."""

import __spark_entry__
import corpus_pipeline

from riskframe.llm import minhash, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


def test_pipeline_is_registered():
    queries = __spark_entry__.queries()
    assert queries["pipeline"] is corpus_pipeline.run
    assert sum(name.startswith("op") for name in queries) == 13
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = corpus_pipeline.keep_good(spark, docs, SF)
    want = quality_rules.judge(docs, quality_rules.learn(docs, labels)).where("kept")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in want.collect())
    clean = corpus_pipeline.keep_clean(spark, good, SF)
    toxic = toxicity.score(good, toxicity.learn(good, labels)).where("not toxic")
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in toxic.collect())
    one = corpus_pipeline.keep_one_of_each(spark, clean, SF)
    assert one.columns == docs.columns
    kept = minhash.near_duplicates(clean).where("kept")
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in kept.collect())
    pieces = corpus_pipeline.pack(spark, one, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in one.select("doc_id").collect()}
    totals = {}
    for p in pieces:
        totals[p.sequence_id] = totals.get(p.sequence_id, 0) + p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in totals.values())


def test_stages_on_odd_rows(spark):
    rows = [(None, None, "x", 1), (1, "", "x", 1), (1, "", "x", 1), (2, "word " * 30_000, "x", 1)]
    rows += [(i, " ".join(f"w{i}x{j}" for j in range(80)), "x", 1) for i in range(3, 8)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, n int")
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns
            docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
