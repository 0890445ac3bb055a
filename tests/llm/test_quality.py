"""Quality classifier: held-out accuracy, features against a plain loop, and odd rows."""

import numpy as np
import pyarrow as pa

from quadspark.llm.quality import features, fit, score_documents, scores, train


def test_features_match_a_plain_count():
    texts = ["", "a", "a a b", "é ö\n\tx  yy", "one two three four", " ", "ab"]
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    groups = features(data, off, 18)
    for i, t in enumerate(texts):
        n, w = len(t.encode()), len(t.split())
        got = [int(first[i + 1] - first[i]) for _, first in groups]
        assert got == [w, max(0, w - 1), max(0, n - 2), max(0, n - 4)], t
        alone = features(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, n]), 18)
        for (f, first), (g, _) in zip(groups, alone, strict=True):
            assert (f[first[i] : first[i + 1]] == g).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in score_documents(docs, train(docs, labels)).collect()}
    assert len(got) == docs.count()
    held = [r for r in labels.selectExpr("doc_id", "quality", "crc32(cast(cast(doc_id as string) as binary)) % 5 as m").collect() if r.m == 0 and r.doc_id in got]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) >= 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "some text", None), (3, "some text", "t"), (3, "some text", "t"), (4, "w " * 200_000, "t")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score_documents(docs, train(docs, none)).collect()
    assert len(got) == 6 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert len(score_documents(docs, train(docs, labels)).collect()) == 6
    assert score_documents(docs.limit(0), train(docs.limit(0), labels)).collect() == []


def test_scores_do_not_depend_on_neighbours():
    m = fit(["good words here and there", "BAD!! BAD!! BAD!!"] * 5, [1, 0] * 5)
    texts = ["good and there", "BAD!! x", "", "z"]
    assert np.allclose(scores(m, pa.array(texts)), np.concatenate([scores(m, pa.array([t])) for t in texts]))
