"""Personal data, token alignment and the filter audit against plain code."""

import hashlib
import itertools
import random
import re
from collections import Counter

import public_tokenizers
import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskframe.llm import alignment, filter_audit, pii, queries

SMALL = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


# --- personal data -----------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain_base(text):
    """The contract's patterns as they are."""
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), list(PLAIN).index(kind), kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def odd_texts(seed, count):
    draw = random.Random(seed)
    parts = ["@", ".", "-", "+", " ", "1", "22", "4111 1111 1111 1111", "5500-0000-0000-0004", "255", "256", "(", ")", "a",
             "b@c.de", "x@y", ".com", "%", "é", "漢", "🙂", "\n", "+1 (212) 555-0100", "10.0.0.1", "0010.1.1.1",
             "0000000000000000000000000000000007"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(count)]


def test_base_spans_equal_the_plain_patterns():
    for text in odd_texts(1, 4000):
        assert [(k, a, b) for a, b, k in pii.base_spans(text)] == plain_base(text), text


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a.b@" * 80_000, "+1" + "(" * 300_000, "12 " * 100_000, "AB12" * 60_000):
        pii.find(text)


def test_checksums_and_words_decide_on_candidates():
    def kinds(text):
        return [(s.kind, text[s.start : s.end]) for s in pii.find(text) if not s.base]

    assert kinds("to DE89 3704 0044 0532 0130 00 AND MORE") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("to DE88 3704 0044 0532 0130 00") == []
    assert kinds("GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")]
    assert kinds("his SSN is 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("the part 123-45-6789") == []
    assert kinds("his SSN is 000-45-6789") == []
    assert kinds("call 212-555-0100 now") == [("phone", "212-555-0100")]
    assert kinds("item 212-555-0100 now") == []
    # The base run has 24 digits and is dropped as a whole; the card inside it is found by itself.
    assert kinds("12345678 4111111111111111") == [("card", "4111111111111111")]
    assert kinds("order 12345678 4111111111111111") == []
    # Base spans stay and no candidate overlaps them.
    assert [(s.kind, s.base) for s in pii.find("card 4111111111111111")] == [("card", True)]


def test_pii_query_equals_plain_code(spark, small):
    texts = dict(zip(*pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    rows = queries.QUERIES["op11_pii"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in PLAIN]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_pii_odd_rows(spark):
    schema = "doc_id string, text string, spans string, key int, kind string"
    rows = [(None, None, "x", 1, None), ("a", "", None, 2, "y"), ("b", "m@n.org", None, 3, None), ("b", "m@n.org", None, 3, None)]
    found = pii.report(pii.detect(spark.createDataFrame(rows, schema))).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or "", r.n_email, r.spans, r.base_sha256 == empty) for r in found) == [
        ("", 0, "", True), ("a", 0, "", True), ("b", 1, "email:0:7", False), ("b", 1, "email:0:7", False)
    ]
    assert pii.detect(spark.createDataFrame([], schema)).count() == 0


# --- alignment ---------------------------------------------------------------------------------


class PlainAligner:
    def __init__(self):
        self.a = Tokenizer.from_file(BYTE_BPE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
        self.bytes_a, self.bytes_b = alignment.byte_level_tokens(BYTE_BPE), alignment.piece_tokens(PIECE_BPE)

    def __call__(self, text):
        """Ids of A and B, groups, linked id pairs."""
        if not text:
            return [], [], [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = (" " + text).encode()
        if b"".join(self.bytes_a[i] for i in a) != raw or b"".join(self.bytes_b[i] for i in b) != raw:
            return [], [], [], []
        ends_a = list(itertools.accumulate(len(self.bytes_a[i]) for i in a))
        ends_b = list(itertools.accumulate(len(self.bytes_b[i]) for i in b))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            ii, jj = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((a[i:ii], b[j:jj]))
            links.append((a[ii - 1], b[jj - 1]))
            i, j = ii, jj
        return a, b, groups, links


def expected(texts):
    plain = PlainAligner()
    found = [plain(t) for t in texts]
    counts = Counter(link for _, _, _, links in found for link in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for a, b, groups, links in found:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[x] == highest[x[1]] for x in links)
        digest = hashlib.sha256(written.encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return out


PARTS = [" ", "  ", "\n", "\r", "\r\n", "\t", chr(28), chr(133), chr(160), chr(0x180E), chr(0x3000), chr(0x2581), chr(0xFEFF), "a", "Hello",
         "world.", "'s", "</s>", "<s>", "<|endoftext|>", "<0x41>", "é", chr(0x301), "漢字", "🙂", "123", ");\r", "\0", "ﬁ", " the", "and "]


def columns(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def test_alignment_equals_the_libraries_on_odd_texts(spark):
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(14))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "   ", "x" * 5000, "ab " * 30_000, "same words", "same words"]
    schema = "doc_id int, text string, pair string, n_a string, key int"
    docs = spark.createDataFrame([(i, t, "p", "q", 7) for i, t in enumerate(texts)], schema)
    rows = alignment.report(alignment.align_documents(docs, BYTE_BPE, PIECE_BPE), PIECE_BPE).orderBy("doc_id").collect()
    for text, r, want in zip(texts, rows, expected(texts), strict=True):
        assert columns(r) == want, repr(text)


def test_alignment_query_equals_the_libraries(spark, small):
    table = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    rows = queries.QUERIES["op12_alignment"](spark, small).orderBy("doc_id").collect()
    assert list(map(columns, rows)) == expected(table["text"].to_pylist())


class Counted:
    """An encoder that notes how many texts it is given."""

    def __init__(self, inner):
        self.inner, self.given = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.given += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


def test_alignment_encodes_chunks_together():
    words = [f"w{i}\u00e9{'x' * (i % 70)}" for i in range(600)]
    odd = ["a\t b\u200b c", "  \n\n x", "tail \n", "", None, "\u2581 no", "<|endoftext|> it's", "\ufeff\n\u00a0 y z ", "\u4e2d\u6587 \U0001f600\n"]
    texts = [" ".join(words), *odd, "\n".join(reversed(words)), *odd]
    work = alignment.Encoder(BYTE_BPE, PIECE_BPE)
    work.a = counted = Counted(work.a)
    together = work.encode(texts)
    assert counted.given < 100
    a, b = counted.inner, work.b
    for text, of_a, of_b in zip(texts, together[0].to_pylist(), together[1].to_pylist(), strict=True):
        known = text and "\u2581" not in text
        assert of_a == (a.encode(" " + text, add_special_tokens=False).ids if known else [])
        assert of_b == (b.encode(text) if known else [])


def test_ids_are_cut_only_at_ends_of_tokens():
    ids = alignment.Ids.of([[0, 1, 0]], [b"ab", b"c", b""], np.array([2, 1, 0]))
    assert ids.cut_at(np.array([3, 5])).lengths.tolist() == [2, 1]
    assert ids.cut_at(np.array([1, 5])) is None
    assert ids.cut_at(np.array([3, 6])) is None
    assert alignment.Ids.of([[0, 2, 1]], ids.tokens, ids.sizes).cut_at(np.array([2, 3])) is None
    assert ids.without_first().flat.tolist() == [1, 0]


def test_alignment_memory_emptied_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY_CHUNKS", 3)
    work = alignment.Encoder(BYTE_BPE, PIECE_BPE)
    texts = ["one two three four five", None, "six one", "x" * 100 + " one"]
    again = [[side.to_pylist()[0] for side in work.encode([t])] for t in texts]
    whole = alignment.Encoder(BYTE_BPE, PIECE_BPE).encode(texts)
    assert again == [list(pair) for pair in zip(*(side.to_pylist() for side in whole))]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.report(alignment.align_documents(empty, BYTE_BPE, PIECE_BPE), PIECE_BPE).count() == 0


def test_pair_bound_holds_for_every_suffix_pair():
    a, b = [b"ab", b"b", b"", b"cab"], [b"b", b"ab", b"b", b"zab"]
    ends = sum(1 for x in a for y in b if x and y and (x.endswith(y) or y.endswith(x)))
    assert alignment.pair_bound(a, b) == ends
    assert alignment.pair_bound(alignment.byte_level_tokens(BYTE_BPE), alignment.piece_tokens(PIECE_BPE)) == 324_297


# --- filter audit ------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Rows of (doc_id, text, lang) and (doc_id, quality, toxic), filtered one by one."""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    facts = []
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [d for d, t, _ in docs if (t or "") == text and d is not None]
        fails = (
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search("[#$%&*|]", text)),
            doc is not None and min(copies) < doc,
        )
        facts.append((lang or "", fails, doc in good, doc in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own, total = [f for f in facts if f[0] == part], Counter()
        for order in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                out_now = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                total[f] += len(out_now)
                failing = sum(x[1][f] for x in own)
                alone = sum(x[1][f] and sum(x[1]) == 1 for x in own)
                name = "".join("ABCDE"[g] for g in order)
                out[part, name, step] = [len(left), len(out_now), failing - len(out_now), alone, sum(x[2] for x in out_now), sum(x[3] for x in out_now)]
        for (p, name, step), values in out.items():
            if p == part:
                values.append(total["ABCDE".index(name[step - 1])])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_filtering_one_by_one(spark, seed):
    draw = random.Random(seed)
    words = ["a", "B", "CC", "dd", "e#", "f", "\n", "g"]
    texts = [" ".join(draw.choice(words) for _ in range(n)) for n in (0, 3, 99, 100, 101)]
    texts += [" ".join(f"{x}{i}" for i in range(130)) for x in ("w", "W", "w%")] + [None, ""]
    docs = [(draw.choice([None, *range(40)]), draw.choice(texts), draw.choice(["en", "de", "", None])) for _ in range(60)]
    labels = [(draw.choice([None, *range(45)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(50)]
    frame = spark.createDataFrame([(*d, "x", 5, 6) for d in docs], "doc_id int, text string, lang string, part string, n int, key int")
    marks = spark.createDataFrame([(*x, 9) for x in labels], "doc_id int, quality int, toxic int, good int")
    table = filter_audit.contingency(filter_audit.corpus_failures(frame), marks)
    rows = filter_audit.audit(table).collect()
    found = {(r.part, r.filter_order, r.step): [r[m] for m in filter_audit.MEASURES] for r in rows}
    assert len(rows) == len(found) and found == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.contingency(filter_audit.corpus_failures(frame), marks)).count() == 0
