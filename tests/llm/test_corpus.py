"""Near-duplicates, fingerprints, url filter and language model against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import fingerprint, lm, lm_corpus, minhash, urlfilter
from riskframe.llm.queries import LISTED_LABELS, ORACLES, QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().translate(LOWER).split()


# --- near-duplicates ---------------------------------------------------------------------------


def plain_set(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return set(zip(*[w[i:] for i in range(5)]))


def plain_components(rows):
    """Smallest id reachable, by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                part[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i, (k, _) in enumerate(rows):
        members.setdefault(find(i), []).append(k)
    ids = {r: min((k for k in m if k is not None), default=None) for r, m in members.items()}
    return [(k, len(sets[i]), ids[find(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)]


def edited_group(draw, origin, n, edits):
    out = []
    for _ in range(n):
        w = origin.split()
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"w{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [4, 512])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(block)
    vocabulary = [f"v{i}" for i in range(4000)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 120))) for _ in range(60)]
    passage = " ".join(draw.choices(vocabulary, k=60))
    # Many texts share a passage without being alike; near copies differ by a few words or by many.
    texts += [passage + " " + " ".join(draw.choices(vocabulary, k=90)) for _ in range(40)]
    for edits in (3, 6, 12):
        texts += edited_group(draw, " ".join(draw.choices(vocabulary, k=150)), 50, edits)
    texts += [texts[0]] * 30 + ["one two", "ONE  two", "two one", "", None, "  \n"]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n int").repartition(4)
    got = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "A b c d e f"), (None, None), (9, ""), (None, "z z z")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, text_hash string")
    got = minhash.near_duplicates(df).collect()
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(plain_components(rows), key=order)
    assert sum(r.kept for r in got) == 1 + 3
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(7, "a b c d e f"), (None, None), (9, ""), (None, "z z z")], key=str
    )
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.keep_one(df.limit(0)).count() == 0


def test_entries_are_shared_up_to_the_guaranteed_distance(spark):
    draw = np.random.default_rng(6)
    base = draw.integers(0, 1 << 16, minhash.COMPONENTS).astype("<u2")
    rows = [(0, base.tobytes(), 1)]
    for i in range(1, 300):
        other = base.copy()
        at = draw.choice(minhash.COMPONENTS, minhash.GUARANTEED, replace=False)
        other[at] ^= 1
        rows.append((i, other.tobytes(), 1))
    df = spark.createDataFrame(rows, "set long, signature binary, n long")
    found = minhash.entries(df, "n")
    own = {r.entry for r in found.where("set = 0").collect()}
    assert len(own) == minhash.CHUNKS * minhash.CHUNK
    assert {r.set for r in found.collect() if r.entry in own} == set(range(300))


def test_duplicates_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op5_minhash"](spark, small).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(plain_components(rows))


def test_connected_on_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(i + 1, i) for i in range(100, 110)] + [(200, 300)]
    parts = minhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.set: r.part for r in parts} == {
        **{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 111)}, 200: 200, 300: 200
    }


def test_connected_keeps_about_one_edge_a_set(spark, monkeypatch):
    # Sets 10..129 all touch the same ten; 200 and 201 only each other.
    edges = [(i, c) for i in range(10, 130) for c in range(10)] + [(201, 200)]
    kept = []
    checkpointed = minhash.checkpointed

    def counted(df):
        out = checkpointed(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(minhash, "checkpointed", counted)
    parts = minhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.set: r.part for r in parts} == {**{i: 0 for i in range(130)}, 200: 200, 201: 200}
    assert max(kept) <= 2 * len(parts)


# --- fingerprints ------------------------------------------------------------------------------


def check_neighbours(rows, table):
    table = sorted(((k, t or "") for k, t in table), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for i, (k, t) in enumerate(table):
        following = table[(i + 1) % len(table)][1]
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        marks = [fingerprint.fingerprint(x.encode()) for x in (t, changed, following)]
        sha = hashlib.sha256(changed.encode()).hexdigest()
        want.append((k, len(t), sha, *marks[:2], fingerprint.likeness(*marks[:2]), fingerprint.likeness(marks[0], marks[2])))
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in rows)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_neighbours_against_plain_code(spark, ranges):
    draw = random.Random(ranges)
    table = [(draw.randrange(-40, 400), "".join(draw.choices("abc dé漢", k=draw.randint(0, 80)))) for _ in range(90)]
    table += [(5, "same"), (5, "same"), (5, None), (None, "none"), (None, ""), (401, "x" * 100_000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in table], "doc_id long, text string, part int").repartition(4)
    check_neighbours(fingerprint.neighbour_report(df, ranges=ranges).collect(), table)


def test_neighbours_of_one_and_no_rows(spark):
    df = spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")
    row = fingerprint.neighbour_report(df).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert fingerprint.neighbour_report(df.limit(0)).count() == 0


def test_likeness_is_bounded_and_tells_edits_from_strangers(spark, small):
    rows = QUERIES["op8_fingerprint"](spark, small).toPandas()
    assert rows.near_edited.between(0, 1).all() and rows.near_next.between(0, 1).all()
    assert rows.near_edited.mean() > rows.near_next.mean() + 0.3
    a, b = fingerprint.fingerprint(b"some text " * 30), fingerprint.fingerprint(b"")
    assert fingerprint.likeness(a, a) == 1 and 0 <= fingerprint.likeness(a, b) < 1
    assert fingerprint.fingerprint(b"a") != fingerprint.fingerprint(b"b")
    assert fingerprint.fingerprints(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().fingerprint == b


# --- urls --------------------------------------------------------------------------------------


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:end].encode().translate(LOWER).decode()
    path = rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    return host, path, None, "block" if set(host.split(".")) & set(LISTED_LABELS) else "allow"


URLS = [None, "", "no scheme", "http://", "HTTP://A.NET/x", "x://net/", "x://net", "x://xnet/", "x://Example.NET/en/1?q#f",
        "x://a.example.com/de/", "x://example.com?/de/", "x://a.org/fr/x", "x://b.org/fr", "x://spam-farm.example.org/en/",
        "x://a.spam-farm.b/#x", "x://Ünï.net/ß", "a://b://c/d", "x://free-bets.example.com/de/1", "x://q\n.net/a\nb?c"]


def test_urls_against_plain_code(spark):
    df = spark.createDataFrame([(i, u, "h", True) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, listed boolean")
    listed = F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in LISTED_LABELS]))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, URL_RULES, listed).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate([*URLS, *URLS])}
    assert urlfilter.judge(df.limit(0), URL_RULES, listed).count() == 0
    assert {r.verdict for r in urlfilter.judge(df, [], F.lit(False)).collect()} == {"allow"}


def test_cascade_is_exact_and_needs_several_levels(spark, monkeypatch):
    # Few bits a key make many false positives, hence several levels.
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 4)
    monkeypatch.setattr(urlfilter, "PROBES", 3)
    keys = spark.range(20_000).selectExpr("concat('k', id) as key", "id % 5 = 0 as listed")
    cascade = urlfilter.build_cascade(keys.union(keys.limit(100)), "key", F.col("listed"))
    assert len(cascade.levels) > 2
    assert cascade.holds(keys, "key", "found").where("found != listed").count() == 0


def test_url_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(ORACLES["op9_url_cascade"]).fetchall()
    got = QUERIES["op9_url_cascade"](spark, SF).select("page_id", "host", "path", "rule", "verdict", "listed").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))


# --- language model ----------------------------------------------------------------------------


def test_levels_and_filter_give_back_quantised_counts():
    draw = np.random.default_rng(7)
    for least in (1, 5):
        counts = draw.integers(1, 3000, 2000)
        levels = lm.levels_of(counts, least)
        assert (levels[counts < least] == 0).all()
        low = least * 2.0 ** (levels - 1)
        inside = levels > 0
        assert ((counts >= low) & (counts < 2 * low))[inside].all()
        assert (lm.counts_of(levels, least)[inside] < 2 * low[inside]).all()
    assert lm.counts_of(np.array([0, 1]), 1).tolist() == [0, 1]


def test_filter_reads_back_levels(spark):
    draw = np.random.default_rng(8)
    ngrams = draw.integers(0, 1 << 63, 3000)
    counts = draw.integers(1, 500, 3000)
    levels = lm.levels_of(counts, 1)
    entries = spark.createDataFrame([(int(h), int(n)) for h, n in zip(ngrams, counts, strict=True)], "hash long, n long")
    found = lm.build_filter(entries, 1, int(levels.sum())).levels(ngrams.view(np.uint64))
    # Never below, and above only by a false positive of the next level.
    assert (found >= levels).all() and (found > levels).mean() < 0.03
    strangers = draw.integers(0, 1 << 63, 3000).view(np.uint64)
    assert (lm.build_filter(entries, 1, int(levels.sum())).levels(strangers) > 0).mean() < 0.03


def check_scores(rows, table, learned):
    tokens = {k: [*words(t), None] for k, t in table}
    counts, pairs = Counter(), Counter()
    for k in learned:
        counts.update(tokens[k])
        pairs.update(zip([None, *tokens[k]], tokens[k]))
    n, v = sum(counts.values()), len(counts)
    gap = []
    for r in rows:
        w = tokens[r.doc_id]
        assert r.n_tokens == len(w) and r.n_known == sum(counts[x] > 0 for x in w) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        exact = sum(
            math.log10((pairs[h, x] + lm.MU * (counts[x] + 1) / (n + v + 1)) / (counts[h] + lm.MU))
            for h, x in zip([None, *w], w)
        )
        gap.append((r.score - exact) / len(w))
        assert r.score <= 0
    # Quantised counts are off by less than a factor of two either way.
    assert np.abs(gap).mean() < 0.2 and np.abs(gap).max() < 2 * math.log10(2) + 0.1


def test_scores_against_exact_counts(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op10_lm"](spark, SF).collect()
    assert len(rows) == len(table)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    check_scores(rows, table, [k for k, _ in table if zlib.crc32(str(k).encode()) % 7 != 2])


def test_packed_numbers_come_back():
    draw = np.random.default_rng(2)
    for size in (0, 1, 500):
        hashes = np.unique(draw.integers(0, 1 << 64, size, np.uint64))
        assert (lm_corpus.unpacked_sorted(lm_corpus.packed_sorted(hashes)) == hashes).all()
        edges = lm_corpus.shard_edges(hashes, 7)
        assert edges[0] == 0 and edges[-1] == len(hashes) and (np.diff(edges) >= 0).all() and len(edges) == 8
        # A shard's part can be packed by itself.
        part = hashes[edges[3] : edges[4]]
        assert (lm_corpus.unpacked_sorted(lm_corpus.packed_sorted(part)) == part).all()


@pytest.mark.parametrize("block_bytes, shard_tokens", [(1 << 24, 1 << 21), (200, 40)])
def test_corpus_scores_by_blocks_and_shards(spark, block_bytes, shard_tokens):
    draw = random.Random(3)
    table = [(i, f"the the cat {i % 9} sat\non THE mat {draw.random()}") for i in range(120)]
    table += [(120, None), (121, ""), (122, "the " * 20_000)]
    rows = [(k, t, "x", "y", 1.0) for k, t in table]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, block string, score double").repartition(4)
    found = lm_corpus.score_corpus(df, F.col("doc_id") % 5 > 0, block_bytes=block_bytes, shard_tokens=shard_tokens).collect()
    assert len(found) == len(table)
    check_scores(found, table, [k for k, _ in table if k % 5])
    model, counts = lm.learn(df, F.col("doc_id") % 5 > 0)
    want = {r.doc_id: r.score for r in lm.score(df, model, counts).collect()}
    # The same levels but for false positives, which differ with the filter's layout.
    gap = [abs(r.score - want[r.doc_id]) / r.n_tokens for r in found]
    assert np.mean(gap) < 0.02
    base = {r.doc_id: r.base_score for r in lm.score(df, model, counts).collect()}
    assert all(r.base_score == pytest.approx(base[r.doc_id]) for r in found)


def test_corpus_scores_of_odd_rows(spark):
    repeated = spark.createDataFrame([(None, "cat"), (None, "cat"), (1, "qq")], "doc_id string, text string")
    out = lm_corpus.score_corpus(repeated, F.col("doc_id").isNull()).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in out) == [("1", 2, 1), ("None", 2, 2), ("None", 2, 2)]
    assert lm_corpus.score_corpus(repeated.limit(0), F.lit(True)).count() == 0
    row = lm_corpus.score_corpus(repeated.where("doc_id = 1"), F.lit(None).cast("boolean")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (2, 0, 0, 0.0, 0.0)


def test_scores_with_a_join_for_rare_words(spark, monkeypatch):
    # A large share leaves most words to the join and most bigrams to the smoothing.
    monkeypatch.setattr(lm, "HEAD_SHARE", 0.05)
    table = [(i, f"the the cat {i} sat\non THE mat") for i in range(30)] + [(30, None), (31, ""), (32, "the " * 30_000)]
    df = spark.createDataFrame([(k, t, 0.5) for k, t in table], "doc_id long, text string, score double")
    model, counts = lm.learn(df, F.col("doc_id") < 31)
    rows = lm.score(df, model, counts).collect()
    check_scores(rows, table, range(31))
    repeated = spark.createDataFrame([(None, "cat"), (None, "cat"), (1, "qq")], "doc_id long, text string")
    out = lm.score(repeated, model, counts).collect()
    assert sorted((str(r.doc_id), r.n_known) for r in out) == [("1", 1), ("None", 2), ("None", 2)]
    assert lm.score(repeated.limit(0), model, counts).count() == 0


def test_scores_without_learning_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model, counts = lm.learn(df.limit(0))
    row = lm.score(df, model, counts).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_rare_ngrams_of_a_large_corpus_are_held(spark):
    # More than 2^21 tokens: n-grams seen once count all the same.
    table = [(0, "the " * 2_200_000), (1, "cat sat on mats"), (2, "cat sat")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    model, counts = lm.learn(df)
    found = model.filter.levels(np.array([lm.xxhash.xxh64_intdigest(w) for w in (b"cat", b"on", b"mats")], np.uint64))
    assert found[0] >= 2 and (found[1:] >= 1).all()
    check_scores(lm.score(df.where("doc_id > 0"), model, counts).collect(), table, range(3))


def test_filter_in_shards_scores_like_a_broadcast_one(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BITS", 1024)
    monkeypatch.setattr(lm, "GROUP", 2)
    table = [(i, f"the the cat {i} sat\non THE mat") for i in range(200)] + [(200, None), (201, "the " * 30_000)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    model, counts = lm.learn(df)
    assert model.shards > 3 and len(model.filter.words) * 64 == model.shards * model.bits
    want = {r.doc_id: r.score for r in lm.score(df, model, counts).collect()}
    monkeypatch.setattr(lm, "BROADCAST_BITS", 0)
    model, counts = lm.learn(df)
    assert model.filter is None
    rows = lm.score(df, model, counts).collect()
    assert len(rows) == len(table) and {r.doc_id: r.score for r in rows} == pytest.approx(want)
    check_scores(rows, table, range(202))
