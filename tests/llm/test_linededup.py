"""Line dedup against a plain count."""

import random
from collections import Counter

from quadspark.llm.linededup import drop_boilerplate_lines


def brute(rows, max_ratio, min_pages):
    pages, lines = Counter(h for h, t in {(h, t) for _, t, h in rows if t is not None}), Counter()
    for t, h in {(t, h) for _, t, h in rows}:
        lines.update({(h, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    out = []
    for i, t, h in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        all_ = t.split("\n")
        kept = [x for x in all_ if not x.strip(" ") or lines[h, x.strip(" ")] < min_pages or lines[h, x.strip(" ")] <= max_ratio * pages[h]]
        out.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=str)


def check(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = drop_boilerplate_lines(df, **k)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows, k.get("max_ratio", 0.05), k.get("min_pages", 2))


def test_against_a_plain_count(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["menu", " menu ", f"line {rng.randrange(400)}", "", "é\t", f"s{rng.randrange(9)}"]) for _ in range(rng.randrange(12))), f"h{min(rng.randrange(9), 4)}") for i in range(300)]
    rows += [(500, None, "h1"), (501, "", "h1"), (502, "menu\nmenu", None), (None, "menu", None), (503, "x\n" * 20_000, "h2")] + [rows[0]] * 3
    check(spark, rows)
    check(spark, rows, max_ratio=0.02, min_pages=1)
    check(spark, rows, max_ratio=0.1, min_pages=5)


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "same\nown " + str(i), "h", i, "k") for i in range(6)], "doc_id long, text string, source string, n_lines int, host string")
    got = drop_boilerplate_lines(df).collect()
    assert {(r.text, r.n_lines, r.n_dropped, r.host) for r in got} == {(f"own {i}", 2, 1, "k") for i in range(6)}
    assert drop_boilerplate_lines(df.limit(0)).collect() == []


def test_lines_on_a_tenth_of_the_pages_go_on_every_host(spark):
    """Small hosts, large ones and one with a third of all rows; copies of a page and quoted passages stay."""
    rng = random.Random(5)
    rows, notice, quote = [], "Contact the site for terms of use", "a passage that two pages quote"
    for host, n in [("hot", 3000), *((f"mid{i}", 500) for i in range(6)), *((f"small{i}", 40) for i in range(20))]:
        with_notice = set(rng.sample(range(n), n // 10))
        for i in range(n):
            text = f"page {rng.randrange(10**9)} of its own\n" + (notice + "\n" if i in with_notice else "") + (quote if n >= 500 and i < 2 else f"end {rng.randrange(10**9)}")
            rows.append((len(rows), text, host))
    rows += [(len(rows) + i, "a copy\nof one page", "mid0") for i in range(300)]
    got = drop_boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    before = {i: t for i, t, _ in rows}
    for r in got:
        assert r.text == before[r.doc_id].replace(notice + "\n", "") and r.n_dropped == (notice in before[r.doc_id])


def test_clashing_working_columns(spark):
    df = spark.createDataFrame([(i, f"same\nown {i}", "h", 1, [2], "k") for i in range(4)], "doc_id long, text string, source string, `drop` int, kept array<int>, host string")
    got = drop_boilerplate_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert {(r.text, r["drop"], r.host, r.n_dropped) for r in got.collect()} == {(f"own {i}", 1, "k", 1) for i in range(4)}
