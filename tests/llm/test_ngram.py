"""The language model against a plain count of the same model."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quadspark.llm import ngram
from quadspark.llm.ngram import decode, decode_triples, discounts, encode, encode_triples, score, score_documents, train


START = ("start",)  # no word


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


class Plain:
    """The same model by plain counts: the highest order by count, the others by the number of distinct tokens before them."""

    def __init__(self, texts, order):
        self.order = order
        self.c, self.triples = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            self.triples.update(zip([START, START, *w[:-2]] if len(w) > 1 else [START], [START, *w[:-1]], w, strict=True))
        self.pairs = Counter()
        for (_, b, c), k in self.triples.items():
            self.pairs[b, c] += 1 if order == 3 else k
        self.follow = Counter(b for _, b in self.pairs)
        of = lambda counts: discounts(*(sum(k == i for k in counts.values()) for i in (1, 2, 3, 4)))
        self.t, self.d, self.w = of(self.triples), of(self.pairs), of(self.follow)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.after, self.of = defaultdict(list), defaultdict(list)
        for (a, b, _), k in self.triples.items():
            self.after[a, b].append(k)
        for (a, _), k in self.pairs.items():
            self.of[a].append(k)
        self.rest = sum(self.w[min(k, 3) - 1] for k in self.follow.values()) / max(1, len(self.pairs))
        gamma = lambda x, d: (sum(x), sum(d[min(k, 3) - 1] for k in x) / sum(x))
        self.gamma3, self.gamma = {k: gamma(x, self.t) for k, x in self.after.items()}, {k: gamma(x, self.d) for k, x in self.of.items()}

    def base(self, w):
        return math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def one(self, w):
        types = len(self.pairs)
        if not types:
            return 1 / (self.v + 1)
        k = self.follow[w]
        return (max(k - self.w[min(k, 3) - 1], 0) if k else 0) / types + self.rest / (self.v + 1)

    def two(self, a, w):
        if a not in self.gamma:
            return self.one(w)
        (total, gamma), k = self.gamma[a], self.pairs[a, w]
        return (max(k - self.d[min(k, 3) - 1], 0) if k else 0) / total + gamma * self.one(w)

    def three(self, a, b, w):
        if self.order == 2 or (a, b) not in self.gamma3:
            return self.two(b, w)
        (total, gamma), k = self.gamma3[a, b], self.triples[a, b, w]
        return (max(k - self.t[min(k, 3) - 1], 0) if k else 0) / total + gamma * self.two(b, w)

    def score(self, text):
        w = tokens(text)
        before = [START, START, *w]
        return sum(math.log10(self.three(*x)) for x in zip(before, before[1:], w))


def check(rows, texts, model):
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(model.c[x] > 0 for x in w), model.n)
        assert r.base_score == pytest.approx(sum(map(model.base, w)), rel=1e-9)
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-9)


@pytest.mark.parametrize("order, small", [(2, False), (2, True), (3, False), (3, True)])
def test_against_plain_counts(spark, order, small, monkeypatch):
    if small:  # many buckets, many flushes
        monkeypatch.setattr(ngram, "BUCKET_BYTES", 2000)
    rng = random.Random(4)
    words = [f"w{i}" if i % 3 else f"É{i}" for i in range(60)]
    texts = {i: " ".join(rng.choice(words[: rng.choice([3, 60])]) for _ in range(rng.randrange(40))) for i in range(120)}
    texts |= {200: None, 201: "", 202: " \t\n", 203: "unseen words W1 w2", 204: "w1 " * 30_000, 205: "<s> </s>"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    model = Plain([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10], order)
    rows = score_documents(df, order=order).collect()
    assert len(rows) == len(texts)
    check(rows, texts, model)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    # probabilities of a context sum to one, the unseen token included
    for a in (START, "w1", "never"):
        for b in (START, "w1", "w2", "never"):
            assert sum(model.three(a, b, w) for w in model.c) + model.three(a, b, "never") == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 3])
def test_driver_rows(spark, order):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in df.collect()}
    check(score_documents(df, order=order).collect(), texts, Plain([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10], order))


def test_no_training_text(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert all(math.isfinite(r.score) and r.train_tokens == 0 and r.n_known == 0 for r in score(df, train(df.limit(0))).collect())
    rows = score_documents(df).collect()
    assert len(rows) == 2 and not any(r.held_out for r in rows)
    assert score_documents(df.limit(0)).collect() == []


def test_blobs():
    import numpy as np

    keys = np.array([0, 1, 2**32, 2**63 + 5, 2**64 - 1], dtype=np.uint64)
    counts = np.array([1, 2**33 + 7, 3, 4, 5])
    k, c = decode(encode(keys, counts))
    assert (k == keys).all() and (c == counts).all()


def test_blobs_of_triples():
    import numpy as np

    k = np.array([3, 3, 2**40, 2**40, 2**40, 2**64 - 1], dtype=np.uint64)
    t, c = np.array([0, 2**32 - 1, 1, 2, 3, 9], dtype=np.uint32), np.array([1, 2, 2**35, 255, 256, 7])
    for n in (0, 1, 6):
        assert all((x == y).all() for x, y in zip(decode_triples(encode_triples(k[:n], t[:n], c[:n])), (k[:n], t[:n], c[:n]), strict=True))


def test_clashing_columns_and_repeated_rows(spark):
    rows = [("1", "a b a b", 5, "x"), ("1", "a b a b", 5, "x"), ("y", None, 6, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, score int, bucket string")
    got = score(df, train(df)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"] and len({r.score for r in got if r.doc_id == 1}) == 1
