"""Encoding, decoding and packing against the tokenizer libraries and plain code."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from riskframe.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = [" ", "  ", "\n", "\t", chr(28), chr(133), chr(160), chr(0x3000), "a", "A", "H", chr(0x331), chr(0x301), "É",
          chr(0x6F22), "1", chr(0x663), "!", "'s", "'LL", "Σ", chr(0x1F642), chr(0x200B), "Hello", "world.", "_",
          chr(0x212A), "ß", chr(0x130), ".,", "word,", "x|", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=3000, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choices(PIECES, k=draw.randint(0, 14))) for _ in range(n)]


def test_codec_equals_tiktoken(reference):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for text in [*texts(), "x" * 30_000, "ab " * 10_000, "\n" * 500]:
        ids = reference.encode_ordinary(text)
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_codec_reaches_every_token(reference):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for token in codec.tokens[::7]:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        ids = reference.encode_ordinary(text)
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_codec_on_odd_rows(spark, reference):
    rows = [(None, None, 1.0), (1, "", 2.0), (1, "Two  words", 3.0), (1, "Two  words", 3.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens double")
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    out = bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(len(r.ids) // 4 for r in out) == [0, 0, 3, 3] == sorted(r.n_tokens for r in out)
    assert sorted(bytes(r.decoded) for r in out) == [b"", b"", b"Two  words", b"Two  words"]
    assert bpe.decode(bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0


def test_codec_query(spark, small, reference):
    from riskframe.llm.queries import QUERIES

    texts_by_id = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op1_bpe"](spark, small).collect()
    assert len(rows) == len(texts_by_id)
    for r in rows:
        ids = reference.encode_ordinary(texts_by_id[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts_by_id[r.doc_id].encode()).hexdigest()


def tokenizer():
    out = Tokenizer.from_file(WORD_BPE)
    out.encode_special_tokens = True
    return out


def test_words_encode_as_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY_WORDS", 500)
    own, whole = packing.WordEncoder(WORD_BPE, 1), tokenizer()
    sample = [*texts(4000, 2), None, "x" * 20_000]
    for i in range(0, len(sample), 300):
        for text, ids in zip(sample[i : i + 300], own.encode(sample[i : i + 300]), strict=True):
            want = whole.encode(text or "", add_special_tokens=False).ids + [1]
            assert np.frombuffer(ids, own.kind).tolist() == want


def test_plain_words_skip_the_normal_form():
    own, whole = packing.WordEncoder(WORD_BPE, 1), Tokenizer.from_file(WORD_BPE)
    plain = ["Äpfel", "straße", "ÀÖØÞß", "don", "tiktok!?", "...", "a_b", "'s", "x's", "l'été", "ÿ}", "`^", "Q.", "<end>", "ZÏ''"]

    class Counting:
        """Counts the texts that take the whole way."""

        seen = 0

        def encode_batch_fast(self, texts, **how):
            self.seen += sum(bool(packing.PLAIN.fullmatch(t.replace(" ", ""))) for t in texts)
            return whole.encode_batch_fast(texts, **how)

    whole.encode_special_tokens = True
    own.tokenizer = Counting()
    text = " ".join(plain * 60 + [a + b for a in plain for b in plain])
    ids = np.frombuffer(own.encode([text])[0], own.kind).tolist()
    assert ids == whole.encode(text, add_special_tokens=False).ids + [1]
    assert own.tokenizer.seen == 0


def test_special_tokens_in_texts_encode_as_by_default():
    own, whole = packing.encoder(WORD_BPE, 1), Tokenizer.from_file(WORD_BPE)
    sample = ["a <|endoftext|> b", "Plain text.", "x<|startoftext|>y\n<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> é", "a <| b"]
    assert whole.encode(sample[0], add_special_tokens=False).ids == [320, 49407, 321]
    for text, ids in zip(sample * 2, own.encode(sample * 2), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == whole.encode(text, add_special_tokens=False).ids + [1]


def check_pieces(rows, ids_by_key, window):
    """Every id in one piece, sequences gapless and full, or a power of two long."""
    by_key, by_sequence = {}, {}
    for r in rows:
        by_key.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for key, wanted in ids_by_key.items():
        at = 0
        for p in sorted(by_key[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(wanted)
            assert bytes(p.ids) == struct.pack(f"<{p.length}I", *wanted[at : at + p.length])
            at += p.length
        assert at == len(wanted)
    padding = 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


@pytest.mark.parametrize("window", [8, 64, 2048])
def test_packing_small_table(spark, window):
    draw = random.Random(window)
    table = [(i, " ".join(draw.choices(["one", "two,", "Three", "cats!"], k=draw.randint(0, 90)))) for i in range(150)]
    table += [(150, None), (151, ""), (152, "word " * 3000)]
    # One length that a third of the rows share.
    table += [(200 + i, "same words in every row here") for i in range(80)]
    df = spark.createDataFrame([(k, t, 7) for k, t in table], "doc_id long, text string, length int").repartition(5)
    rows = packing.pack(packing.tokenise(df, WORD_BPE), window).collect()
    whole = tokenizer()
    check_pieces(rows, {k: whole.encode(t or "", add_special_tokens=False).ids + [1] for k, t in table}, window)


def test_packing_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c"), (3, "c")], "doc_id long, text string")
    rows = packing.pack(packing.tokenise(df, WORD_BPE)).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 2 + 2
    assert packing.pack(packing.tokenise(df.limit(0), WORD_BPE)).count() == 0


def test_combinations_are_complete():
    lengths, window = np.array([1, 2, 3, 5, 7]), 8
    want = {(0, 1, 7), (0, 3, 5), (1, 2, 5), (2, 3, 3)}
    assert {tuple(r) for r in packing.combinations(lengths, window).tolist()} == want


def test_solve_recovers_exact_counts_and_rounding_stays_inside():
    draw = np.random.default_rng(3)
    window = 64
    parts = packing.combinations(np.arange(1, window), window)
    histogram = np.zeros(window, np.int64)
    np.add.at(histogram, parts[draw.integers(0, len(parts), 4000)].ravel(), 1)
    histogram[0] = 0
    x = packing.solve(parts, histogram, rounds=200)
    assert (x >= 0).all()
    fit = np.bincount(parts.ravel(), np.repeat(x, 3), window)[1:]
    assert np.abs(fit - histogram[1:]).sum() < 0.02 * histogram.sum()
    n = packing.rounded(parts, x, histogram)
    used = np.bincount(parts.ravel(), np.repeat(n, 3), window)[1:]
    assert (used <= histogram[1:]).all() and used.sum() > 0.9 * histogram.sum()


def test_end_cuts():
    assert packing.end_cuts(2048 * 3 + 1500, 2048) == [
        (6144, 1024), (7168, 256), (7424, 128), (7552, 64), (7616, 16), (7632, 8), (7640, 4)
    ]
    assert packing.end_cuts(4096, 2048) == []


def test_packing_query(spark, small):
    from riskframe.llm.queries import QUERIES

    whole = tokenizer()
    rows = QUERIES["op2_packing"](spark, small).collect()
    ids = {
        r.doc_id: whole.encode(r.text, add_special_tokens=False).ids + [1]
        for r in spark.read.parquet(f"{small}/documents.parquet").collect()
    }
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
