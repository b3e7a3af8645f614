"""The learned operators, and the whole pipeline, against plain code."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from riskframe.llm import bpe, langid, minhash, quality_rules, toxicity
from riskframe.llm.common import Sparse

SMALL = "/root/testdata/sf0.001"


def plain_words(text):
    """Runs of letters of the lower-cased text, numerals taken out."""
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    return [w for w in ("".join(c for c in x if c.isalpha()) for x in found) if w]


# --- language ----------------------------------------------------------------------------------


def plain_language(learned, texts, share):
    """Counts by (language, kind), then sums of log frequencies of the words or their longest known n-grams."""
    counts = defaultdict(Counter)
    for text, lang in learned:
        for w in plain_words(text):
            counts[lang, 0][w] += 1
            padded = f" {w} "
            for n in range(1, 6):
                for i in range(len(padded) - n + 1):
                    counts[lang, n][padded[i : i + n]] += 1
    langs = sorted({lang for _, lang in learned})
    logs = {}
    for kind in range(6):
        own = {lang: counts[lang, kind] for lang in langs}
        known = {k for c in own.values() for k, v in c.items() if v >= share * sum(c.values())}
        for k in known:
            logs[kind, k] = [
                math.log10((own[x][k] + 0.5) / (sum(own[x][y] for y in known) + 0.5 * len(known))) for x in langs
            ]
    out = []
    for text in texts:
        total, n = [0.0] * len(langs), 0
        for w in plain_words(text):
            n += 1
            rows = [logs[0, w]] if (0, w) in logs else []
            for size in (5, 4, 3, 2, 1):
                padded = f" {w} "
                rows = rows or [logs[size, g] for g in (padded[i : i + size] for i in range(len(padded) - size + 1)) if (size, g) in logs]
            for i in range(len(langs)):
                total[i] += sum(r[i] for r in rows) / len(rows) if rows else 0.0
        best = max(range(len(langs)), key=lambda i: total[i])
        score = 1 / sum(10 ** (langid.DAMPING * (t - total[best])) for t in total)
        out.append((langs[best], score, n) if n else ("und", 0.0, 0))
    return out


@pytest.mark.parametrize("share", [1e-5, 0.02])
def test_language_equals_plain_counts(spark, share):
    draw = random.Random(1)
    stems = {"aa": ["the", "thing", "over"], "bb": ["der", "ding", "über"], "cc": ["el", "cosa", "niño"]}
    learned = [(" ".join(draw.choice(stems[k]) + draw.choice(["", "s", "x²"]) for _ in range(9)), k) for k in stems for _ in range(20)]
    texts = ["the thing", "xyzzy overding", "niños über 12", "", None, "123", "ding ding the q", "él"]
    model = langid.learn(spark.createDataFrame(learned + [(None, "aa"), ("zz", None)], "text string, lang string"), share=share)
    rows = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    for r, (lang, score, n) in zip(rows, plain_language(learned, texts, share), strict=True):
        assert (r.lang_pred, r.n_words) == (lang, n) and r.score == pytest.approx(score, abs=1e-4)


def test_language_memory_grows_and_empties(monkeypatch):
    monkeypatch.setattr(langid, "MEMORY_WORDS", 3)
    table = np.array([[-1.0, -2.0], [0.0, 0.0]])
    model = langid.Model(["a", "b"], {(0, "ab"): 0}, table)
    texts = [f"ab w{'xyz'[i % 3] * (i % 50 + 1)} ab" for i in range(3000)]
    sums, sizes = langid.Scorer(model).sums(texts)
    assert (sums == [-2.0, -4.0]).all() and (sizes == 3).all()
    scorer = langid.Scorer(model)
    assert all((scorer.sums([t])[0] == [-2.0, -4.0]).all() for t in texts[:200])


# --- toxicity ----------------------------------------------------------------------------------


def ordinal_objective(X, grade, w, t, penalty):
    z = X @ w
    upper = np.where(grade == 0, 1.0, 1 / (1 + np.exp(-(z - t[np.maximum(grade - 1, 0)]))))
    lower = np.where(grade == 2, 0.0, 1 / (1 + np.exp(-(z - t[np.minimum(grade, 1)]))))
    return -np.log(np.maximum(upper - lower, 1e-12)).mean() + penalty * np.abs(w).sum()


def test_ordinal_fit_reaches_the_minimum_of_a_plain_solver():
    draw = np.random.default_rng(6)
    X = (draw.random((150, 8)) < 0.4) * 1.0
    grade = np.clip((X @ [2, 1, 0, 0, -1, 0, 0, 0] + draw.logistic(size=150)).round(), 0, 2).astype(int)
    penalty = 0.01
    # Subgradient-free plain search: one coordinate after the other by golden sections.
    w, t = np.zeros(8), np.array([0.0, 1.0])
    for _ in range(60):
        for i in range(10):
            low, high = -8.0, 8.0
            def at(x, i=i):
                a, b = w.copy(), t.copy()
                if i < 8:
                    a[i] = x
                else:
                    b[i - 8] = x
                return ordinal_objective(X, grade, a, b, penalty) if b[0] <= b[1] else np.inf
            for _ in range(60):
                m, n = low + 0.382 * (high - low), low + 0.618 * (high - low)
                low, high = (low, n) if at(m) < at(n) else (m, high)
            best = min((low + high) / 2, 0.0, w[i] if i < 8 else t[i - 8], key=at)
            if i < 8:
                w[i] = best
            else:
                t[i - 8] = best
    rows = [np.flatnonzero(x).astype(np.int32) for x in X]
    sparse = Sparse(rows, [np.ones(len(r), np.float32) for r in rows], 8)
    found, cuts = toxicity.fit_ordinal(sparse, grade, penalty=penalty, steps=5000)
    plain = ordinal_objective(X, grade, w, t, penalty)
    assert ordinal_objective(X, grade, found, cuts, penalty) <= plain + 1e-4
    assert np.allclose(found, w, atol=0.02) and np.allclose(cuts, t, atol=0.02)


def plain_toxic(text, model):
    """P(grade >= 1) from the weights of every distinct word and its starts."""
    total = 0.0
    for w in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
        for name in [" " + w, *(f"{n} {w[:n]}" for n in (4, 5, 6) if len(w) > n)]:
            total += float(model.weights[zlib.crc32(name.encode()) % toxicity.BUCKETS])
    return 1 / (1 + math.exp(-(total - model.thresholds[0])))


# --- quality -----------------------------------------------------------------------------------


def plain_quality(text, model):
    """The calibrated score, n-gram by n-gram, and the base rules."""
    raw = (text or "").encode()
    words = raw.split()
    mask = (1 << 32) - 1
    spread = lambda h: (h * 2654435761 & mask) >> 16
    hashes = [zlib.crc32(w) for w in words]
    first = [spread(h) for h in hashes] + [spread((a * 31 + b * 17 + 7) & mask) for a, b in zip(hashes, hashes[1:])]
    second = []
    for n in quality_rules.GRAMS:
        for i in range(len(raw) - n + 1):
            h = n
            for c in raw[i : i + n]:
                h = (h * 16777619 + c) & mask
            second.append(spread(h) + quality_rules.BUCKETS)
    total = model.bias + sum(quality_rules.SCALE * sum(float(model.weights[c]) for c in b) / len(b) for b in (first, second) if b)
    score = 1 / (1 + math.exp(-(model.slope * total + model.offset)))
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    return score, len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def test_quality_scores_equal_plain_code(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    model = quality_rules.learn(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.judge(docs, model).collect():
        score, failed = plain_quality(texts[r.doc_id], model)
        assert r.score == pytest.approx(score, abs=1e-4) and r.base_failed == failed


# --- the pipeline ------------------------------------------------------------------------------


def plain_near(texts):
    """The least id of every group of linked texts, and ids without words."""
    sets = {}
    for k, text in texts.items():
        w = (text or "").encode().lower().split() if (text or "").isascii() else minhash_words(text)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k for k in ids if not sets[k] or find(k) == k}


def minhash_words(text):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return (text or "").encode().translate(lower).split()


def test_pipeline_run_equals_a_plain_chain(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good_text = max((t for t in texts.values() if t), key=len)
    planted = [(900, "spam " * 200), (901, "short"), (902, good_text), (903, good_text + " tail"), (904, None), (905, "")]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path / "tables")
    rows.unionByName(more).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    model = quality_rules.learn(docs, labels)
    judged = {k: plain_quality(t, model) for k, t in texts.items()}
    kept = {k for k, (score, failed) in judged.items() if not failed and score >= quality_rules.KEEP_FROM}
    assert not {900, 901, 904, 905} & kept
    left = docs.where(docs.doc_id.isin(*kept))
    model = toxicity.learn(left, labels)
    kept = {k for k in kept if plain_toxic(texts[k], model) < toxicity.TOXIC_FROM}
    kept = plain_near({k: texts[k] for k in kept})

    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == kept
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    totals, found = Counter(), defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        totals[p.sequence_id] += p.length
        found[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    for k in kept:
        assert found[k] == tokenizer.encode(texts[k], add_special_tokens=False).ids + [1]
    assert all(n == 2048 or n & (n - 1) == 0 for n in totals.values())


# --- names -------------------------------------------------------------------------------------


def test_helper_columns_take_no_name_of_the_callers(spark):
    rows = [(1, "a b c d e f", "x", b"y"), (2, "a b c d e f", "x", b"y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text_hash_0 string, _ids_0 binary")
    one = minhash.keep_one(df).collect()
    assert [tuple(r) for r in one] == [(1, "a b c d e f", "x", bytearray(b"y"))] and minhash.keep_one(df).columns == df.columns
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(df, path, pattern).withColumnRenamed("n_tokens", "_ids_0")
    assert {bytes(r.decoded) for r in bpe.decode(coded, path, pattern).collect()} == {b"a b c d e f"}
