"""Decontamination against a plain dynamic program over every pair."""

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quadspark.llm.decontaminate import Index, Item, _indexes, best_match, drop_leaks, find_leaks, normal


def semi_global(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("abé", min_size=1, max_size=70), st.text("abé", max_size=90), st.integers(0, 20))
def test_myers(pattern, text, budget):
    want = semi_global(pattern, text)
    got = best_match(Item(0, pattern, budget), text)
    if text and want <= budget:
        d, a, b = got
        assert d == want and semi_global(pattern, text[a:b]) == d
    else:
        assert got is None


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        i, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("xyzé😀")
        elif kind == 1:
            s.insert(i, rng.choice("qué "))
        else:
            del s[i]
    return "".join(s)


def test_all_pairs_within_the_budget_are_found():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "an", "é", "ing", "o", "re"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [Item(k, t, int(0.1 * len(t))) for k, t in enumerate(normal(prose(rng.randrange(12, 60))) for _ in range(12))]
    docs = [None, ""]
    for it in items:
        for n in (0, 1, it.budget // 2, it.budget, it.budget + 3):
            docs.append(prose(30) + " \n\t" + edited(rng, it.text, n).upper().replace(" ", "\n  ") + " " + prose(20))
    got = {(r, k): d for r, k, d, _, _ in Index(items).matches(pa.array(docs))}
    for r, t in enumerate(docs):
        for k, it in enumerate(items):
            d = semi_global(it.text, normal(t or ""))
            assert (d <= it.budget) == ((r, k) in got), (r, k, d, it.budget)
            if d <= it.budget:
                assert got[r, k] == d


def test_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    text = "é😀 x\n" + item.replace(" ", "  ").title() + " end"
    docs = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (2, None, "s"), (3, "", None), (None, item, "t"), (4, "clean", "t"), (5, "w " * 300_000 + item, "t")], "doc_id long, text string, distance string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "short")], "item_id long, text string")
    got = sorted(find_leaks(docs, bench).collect(), key=str)
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "5", "None"]
    for r in got:
        if r.doc_id == 1:
            assert (r.distance, text[r.match_start : r.match_end]) == (0, item.replace(" ", "  ").title())
    assert sorted(r.doc_id for r in drop_leaks(docs, bench).collect()) == [2, 3, 4]
    assert drop_leaks(docs, bench).columns == docs.columns
    assert find_leaks(docs, bench.limit(0)).collect() == [] and drop_leaks(docs.limit(0), bench).collect() == []
    # blocks of one item each
    two = spark.createDataFrame([(7, item), (8, item[::-1])], "item_id long, text string")
    assert len(find_leaks(docs, two, block_chars=1).collect()) == 4


def test_driver_rows(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    texts = [(r.doc_id, normal(r.text)) for r in docs.collect()]
    for b in bench.collect():
        t = normal(b.text)
        assert {(k, b.item_id) for k, x in texts if t in x} <= found


def test_short_items(spark):
    """Items of any length: exact for those without an error to spare, as whole words under 10 characters."""
    docs = ["The answer: Forty-two!", "catalogue", "a Cat sat", "my concat", "x 7 y", "17", "the quick brawn fox", "quick brown fix", "é", "éé", None, ""]
    items = ["cat", "7", "quick brown fox", "forty-two", "é", " ", "the answer is known"]
    got = {(r.doc_id, r.item_id, r.distance) for r in find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, text string")).collect()}
    assert got == {(2, 0, 0), (4, 1, 0), (6, 2, 1), (7, 2, 1), (0, 3, 0), (8, 4, 0)}
    rng = random.Random(9)
    words = ["al", "be", "ga", "é", "x"]
    items = [Item(k, t, int(0.1 * len(t))) for k, t in enumerate({normal(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for _ in range(60)})]
    docs = ["".join(rng.choice([*words, " ", " ", "ab"]) for _ in range(60)) for _ in range(60)]
    for index in _indexes(items):
        got = {(r, index.items[k].item_id): d for r, k, d, _, _ in index.matches(pa.array(docs))}
        for r, t in enumerate(docs):
            for it in index.items:
                d, x = semi_global(it.text, normal(t)), normal(t)
                hit = d <= it.budget
                if len(it.text) < 10:
                    hit = any(x.startswith(it.text, i) and not (i and x[i - 1].isalnum()) and not x[i + len(it.text) : i + len(it.text) + 1].isalnum() for i in range(len(x)))
                assert hit == ((r, it.item_id) in got), (t, it)
                assert not hit or got[r, it.item_id] == d


def test_types_of_ids(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    for kind, one, two in (("string", "a", "b"), ("int", 1, 2), ("long", 1, 2)):
        docs = spark.createDataFrame([(one, item), (two, "clean"), (None, item)], f"doc_id {kind}, text string")
        bench = spark.createDataFrame([(one, item), (None, "alpha beta gamma")], f"item_id {kind}, text string")
        got = find_leaks(docs, bench)
        assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and got.schema["item_id"].dataType == bench.schema["item_id"].dataType
        assert sorted(((r.doc_id, r.item_id) for r in got.collect()), key=str) == sorted([(one, one), (one, None), (None, one), (None, None)], key=str)
        assert len(find_leaks(docs, bench, block_chars=1).collect()) == 4
        assert [r.doc_id for r in drop_leaks(docs, bench, block_chars=1).collect()] == [two]


def test_driver_items_against_every_pair(spark):
    """Every pair of the smallest table's documents and items, edited ones included, by the plain program."""
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    found = {(r.doc_id, r.item_id): r.distance for r in find_leaks(docs, bench).collect()}
    items = {b.item_id: normal(b.text) for b in bench.collect()}
    texts = {r.doc_id: normal(r.text) for r in docs.collect()}
    rng = random.Random(1)
    some = set(rng.sample([(k, i) for k in texts for i in items if len(texts[k]) < 1500], 120)) | set(found)
    for k, i in some:
        if len(texts[k]) < 5000:
            w = semi_global(items[i], texts[k])
            assert ((k, i) in found) == (w <= int(0.1 * len(items[i])))
            assert (k, i) not in found or found[k, i] == w
