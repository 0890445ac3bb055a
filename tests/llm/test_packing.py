"""Packing: places are sound, ids equal those of the tokenizers library, and few sequences are used."""

import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadspark.llm.packing import added_tokens, pack, plan

PATHS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids)
        assert len(ids) > capacity or len(by_doc[doc]) == 1
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_edges(spark):
    texts = {1: None, 2: "", 3: "a", 4: "word " * 3000, 5: "x" * 3000, 6: "<|endoftext|> é😀\n\n  ", 7: " " * 2000, 8: "y " * 1022, 9: "y " * 1023, 10: "hi <|endoftext|> there<|endoftext|><|endoftext|>x<|endoftext", 11: "a<|endoftext|>" * 900}
    rows = pack(spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, length int"), *PATHS).collect()
    check(rows, texts, 1024)


def test_driver_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack(docs, *PATHS).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()}, 1024)
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1


def test_empty_and_repeated(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
    rows = pack(spark.createDataFrame([(1, "a b")] * 700, "doc_id long, text string"), *PATHS).collect()
    assert len(rows) == 700 and len({(r.sequence_id, r.offset) for r in rows}) == 700


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50)))
def test_plan_uses_each_piece_once(counts):
    used = defaultdict(int)
    for pattern, n in plan(counts, 64):
        assert n > 0 and sum(pattern) <= 64
        for x in pattern:
            used[x] += n
    assert used == counts


def test_plan_of_a_large_histogram():
    """Few sequences, and in time: the driver waits for it."""
    rng = np.random.default_rng(6)
    lengths = np.minimum(1024, rng.lognormal(5.5, 1.2, 100_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    began = time.process_time()
    made = plan(counts, 1024)
    assert time.process_time() - began < 1
    used = defaultdict(int)
    for pattern, n in made:
        for x in pattern:
            used[x] += n
    assert used == counts
    assert sum(n for _, n in made) <= -(-int(lengths.sum()) // 1024) + 2
