"""The pipeline, each stage against a plain version over what the stage before it kept."""

import math
from collections import Counter, defaultdict

import corpus_pipeline
from corpus_pipeline import STAGES

from quadspark.llm.decontaminate import normal
from quadspark.llm.packing import added_tokens, encoder

from .test_decontaminate import semi_global
from .test_neardup import brute

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    kept = [r.asDict() for r in docs.collect()]
    assert [n for n, _ in STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]

    out = [r.asDict() for r in STAGES[0][1](spark, docs, D).collect()]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in out}
    assert sum((i in ids) == (quality[i] == 1) for r in kept if (i := r["doc_id"]) in quality) >= 0.97 * len([r for r in kept if r["doc_id"] in quality])
    before = {r["doc_id"]: r for r in kept}
    assert all(before[r["doc_id"]] == r for r in out)
    kept, frame = out, spark.createDataFrame(out, docs.schema)

    each = {(r["source"], r["text"]) for r in kept}
    pages, lines = Counter(h for h, _ in each), Counter()
    for h, t in each:
        lines.update({(h, x.strip(" ")) for x in t.split("\n") if x.strip(" ")})
    want = []
    for r in kept:
        drop = lambda x, s=r["source"]: lines[s, x.strip(" ")] >= 2 and lines[s, x.strip(" ")] > 0.05 * pages[s]
        text = "\n".join(x for x in r["text"].split("\n") if not drop(x))
        if text == r["text"] or text.strip(" "):
            want.append(r | {"text": text, "n_chars": r["n_chars"] if text == r["text"] else len(text)})
    by_id = lambda rows: sorted(rows, key=lambda r: r["doc_id"])
    out = [r.asDict() for r in STAGES[1][1](spark, frame, D).collect()]
    assert by_id(out) == by_id(want)
    kept, frame = out, spark.createDataFrame(out, docs.schema)

    comp, _ = brute([(r["doc_id"], r["text"]) for r in kept])
    out = [r.asDict() for r in STAGES[2][1](spark, frame, D).collect()]
    assert by_id(out) == by_id([r for r in kept if comp[r["doc_id"]] == r["doc_id"]])
    kept, frame = out, spark.createDataFrame(out, docs.schema)

    items = [normal(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    out = [r.asDict() for r in STAGES[3][1](spark, frame, D).collect()]
    stay = {r["doc_id"] for r in out}
    for r in kept:
        t = normal(r["text"])
        exact = any(i in t for i in items)
        assert not exact or r["doc_id"] not in stay
        # what goes has an item within the budget, and what stays has none (texts of up to 500 characters, for time)
        if not exact and (r["doc_id"] not in stay or len(t) <= 500):
            assert (r["doc_id"] in stay) == all(semi_global(i, t) > math.floor(0.1 * len(i)) for i in items)
    kept, frame = out, spark.createDataFrame(out, docs.schema)
    assert frame.columns == columns

    rows = STAGES[4][1](spark, frame, D).collect()
    import public_tokenizers

    enc = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    length, used = Counter(), defaultdict(int)
    for r in rows:
        length[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert length == {r["doc_id"]: len(enc.encode(r["text"], allowed_special="all")) + 1 for r in kept}
    assert max(used.values()) <= 1024


def test_run(spark):
    rows = corpus_pipeline.run(spark, D).collect()
    assert rows and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0].asDict())


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, gone long, n_lines int, n_dropped int, of int, `key` string, text_key int"


def odd(rows):
    return [(i, t, "en", h, len(t or ""), 0.5, 7, 1, 2, 3, 4, "k", 6) for i, t, h in rows]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with the names the stages work with."""
    item = "a benchmark question of some length that nobody would write by chance in a page"
    prose = [f"text number {i} says " + " ".join(f"w{i * 37 + k * 11 % 97}" for k in range(30)) for i in range(8)]
    spark.createDataFrame([(i, 1) for i in range(8)] + [(50, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, t, "h") for i, t in enumerate(prose)] + [(20, None, "h"), (21, "", None), (None, prose[0], "h"), (0, prose[0], "h"), (0, "other words under the same id stand here alone", "h")]
    rows += [(30, prose[1] + " end", "h"), (31, f"see {item} there", "h"), (32, "long " * 60_000, "x"), (33, " \n ", "x")]
    frame = spark.createDataFrame(odd(rows), ODD)
    stages = dict(STAGES)

    def kept(name, df=frame):
        out = stages[name](spark, df, str(tmp_path))
        assert out.columns == df.columns and stages[name](spark, df.limit(0), str(tmp_path)).collect() == []
        got = out.collect()
        assert all(tuple(r)[5:] == (0.5, 7, 1, 2, 3, 4, "k", 6) for r in got)
        return got

    assert len(kept("quality")) == len(rows)  # no text is like the one rejected label, which is not in the table
    assert sorted(((r.doc_id, r.text) for r in kept("line_dedup")), key=str) == sorted(((i, t) for i, t, _ in rows), key=str)
    with_menu = spark.createDataFrame(odd([(i, f"menu\n{t}" if i % 2 else t, "h") for i, t in enumerate(prose)] + [(90, "menu", "h")]), ODD)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept("line_dedup", with_menu)) == [(i, t, len(t)) for i, t in enumerate(prose)]
    near = [(r.doc_id, r.text) for r in kept("near_dedup")]
    gone = [(30, prose[1] + " end")]
    assert sorted(near, key=str) == sorted([(i, t) for i, t, _ in rows if (i, t) not in gone], key=str)
    assert sorted((str(r.doc_id) for r in kept("decontamination"))) == sorted(str(i) for i, _, _ in rows if i != 31)
    packed = stages["packing"](spark, frame, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _, _ in rows)
    assert stages["packing"](spark, frame.limit(0), str(tmp_path)).collect() == []
