"""Sharding: the law of keys, gapless slots, even weights."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quadspark.llm.sharding import Node, grown, place, shard_documents, topology


def test_law(spark):
    rows = [(i, None if i % 7 == 0 else f"é{i % 5}" * (i % 3)) for i in range(4000)] + [(3, "again"), (3, "again"), (None, "x")]
    got = shard_documents(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, shard int"), topology(16), buckets=8).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    # a row's shard is its id's alone
    again = {r.doc_id: r.shard for r in shard_documents(spark.createDataFrame([(i, "other") for i in range(50)], "doc_id long, text string"), topology(16)).collect()}
    assert all(r.shard == again[r.doc_id] for r in got if r.doc_id in again)
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string"), topology(16)).collect() == []


def test_weights_and_confinement(spark):
    tree = topology(16)
    heavy = Node("root", (*tree.children[:-1], Node("region3", (*tree.children[-1].children[:-1], Node("rack7", (Node("shard14", shard=14), Node("shard15", shard=15, leaf_weight=3.0)))))))
    df = spark.range(40_000).select(place(F.col("id"), tree).alias("a"), place(F.col("id"), heavy).alias("b"), place(F.col("id"), grown(tree)).alias("c")).collect()
    n = Counter(r.a for r in df)
    assert all(abs(k - 2500) < 300 for k in n.values())
    assert abs(Counter(r.b for r in df)[15] - 40_000 * 3 / 18) < 500
    # rows move into the region whose weight grew, or within it
    assert all(r.a == r.b or r.b >= 12 for r in df) and all(r.c in (r.a, 16) for r in df)
    assert abs(sum(r.c == 16 for r in df) - 40_000 / 17) < 300
