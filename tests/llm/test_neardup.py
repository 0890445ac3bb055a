"""Near-dedup against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from quadspark.llm import neardup
from quadspark.llm.neardup import COUNTS, _counts, _most, _sizes_and_counts, near_duplicates
from quadspark.llm.sketch import sketch
from quadspark.llm.textops import mix64


def brute(rows):
    sets, comp = {}, {}
    for doc, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        sets.setdefault(doc, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        comp[doc] = doc
    ids = [d for d in sets if d is not None]

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {d: find(d) for d in ids}, sets


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a b c", "A b  C", "a b c d", "a b c d e", "a b c d e f", "É x", "é x", "x" * 10_000, "w " * 50_000, "w " * 50_001]
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 150]))]
        texts += family(rng, base, 40, 6) + [" ".join(base)] * 5
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want, sets = brute(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id][0]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_odd_rows(spark):
    t = "one two three four five six seven"
    rows = [(5, t, 1), (5, t, 1), (3, t, 2), (None, t, 2), (None, None, 2), (9, "other words stand here and now", 2), (9, t, 2), (10, "other words stand here and now", 0)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id long")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by == {5: {(3, False)}, 3: {(3, True)}, None: {(None, True)}, 9: {(3, False), (9, True)}, 10: {(9, False)}}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    for n in (3, 40, 400):
        agree = []
        for _ in range(60):
            v = mix64(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            a, b = v[:n], v[n // 4 : n // 4 + n]
            s = sketch(np.concatenate((a, b)), np.array([0, n, 2 * n]), 128)
            agree.append((s[0] == s[1]).mean())
        k = n // 4
        assert abs(np.mean(agree) - (n - k) / (n + k)) < 0.03
    assert (sketch(np.zeros(0, np.uint64), np.array([0, 0]), 8) == 0).all()


@pytest.mark.parametrize("options", [{"hot": 30}, {"hot": 4}, {"sure": 0.0}])
def test_hot_buckets_lose_no_link(spark, options):
    """Documents that share a long passage meet in many buckets without being alike; those that are alike are found."""
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        own = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        texts += family(rng, shared + own, 2, 4)
    rows = list(enumerate(texts))
    want, _ = brute(rows)
    assert len(set(want.values())) > 20
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_ids_of_other_types_and_repeated_rows(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [("7", t, "c"), ("007", t, "c"), ("x", t, "c"), ("9", t + " eleven", "c")] + [("8", t + " twelve", "c")] * 40
    got = near_duplicates(spark.createDataFrame(rows, "doc_id string, text string, sketch string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(7, 7, True), (None, None, True), (8, 7, False), (9, 7, False)}


def test_counts_rule_out_no_link():
    rng = np.random.default_rng(6)
    for n in (1, 5, 300, 20_000, 400_000):
        x = mix64(rng.choice(2**62, 2 * n, replace=False).astype(np.uint64))
        x[: n // 2] &= ~np.uint64(COUNTS - 1)  # a cell of many
        for k in (0, 1, n // 8, n // 2, n):
            a, b = x[:n], x[k : k + n + k // 2]
            v = np.concatenate((a, b))
            rows = [bytes(r) for r in _counts(v, np.array([0, len(a), len(v)]))]
            (na, ca), (nb, cb) = (_sizes_and_counts([r]) for r in rows)
            same = n - k
            assert (na[0], nb[0]) == (len(a), len(b))
            assert _most(na, ca, nb, cb)[0] >= same / (len(a) + len(b) - same)
            assert k or _most(na, ca, nb, cb)[0] == 1.0


def bare_links(groups, others):
    """Groups of documents that share a passage, where only the last two are alike, and barely."""
    texts = []
    for g in groups:
        shared = [f"g{g}w{j}" for j in range(116)]
        texts += [" ".join(shared + [f"g{g}x{k}y{j}" for j in range(100)]) for k in range(others)]
        texts += [" ".join(shared + [f"g{g}{c}{j}" for j in range(18)]) for c in "ab"]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [10**6, 10])
def test_bare_links_among_many_classes(spark, hot):
    """Pairs that meet only in buckets whose hub is far from both.  In sketches of 512 bins these pairs
    differ in a band before the first that they share, but not in the low bytes of its bins."""
    rows = bare_links((411, 626, 1107, 1135, 1192, 1227), 60)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.component_id != r.doc_id) == [(62 * k + 61, 62 * k + 60) for k in range(6)]


def test_hot_buckets_with_one_band(spark, monkeypatch):
    """Pairs that share no more than one band, which is hot, are found."""
    rows = bare_links(range(60), 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "BANDS", 2)
    cool = {r.doc_id: r.component_id for r in near_duplicates(docs, sure=0.0).collect()}
    assert len(set(cool.values())) < len(rows)
    hot = {r.doc_id: r.component_id for r in near_duplicates(docs, sure=0.0, hot=1).collect()}
    assert [d for d, c in cool.items() if hot[d] != hot[c]] == []
