"""The queries of the corpus operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .decontaminate import find_leaks
from .embeddings import near_duplicate_vectors
from .linededup import drop_boilerplate_lines
from .neardup import near_duplicates
from .ngram import score_documents as score_language
from .packing import added_tokens, pack
from .pii import extract_pii
from .quality import score_documents, train
from .sharding import shard_documents, topology
from .warc import read_archive, write_archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_find_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "archive").path
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_extract_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pii(table(spark, sf_dir, "documents"))


def op6_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), topology(16))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


def op8_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_score_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op1_find_leaks": op1_find_leaks, "op2_line_dedup": op2_line_dedup, "op3_near_duplicates": op3_near_duplicates, "op4_warc_archive": op4_warc_archive, "op5_extract_pii": op5_extract_pii, "op6_shard_documents": op6_shard_documents, "op7_pack": op7_pack, "op8_near_duplicate_vectors": op8_near_duplicate_vectors, "op9_score_language": op9_score_language, "op10_quality": op10_quality}
ORACLE: dict[str, str] = {
    "op2_line_dedup": """
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
hosts AS (SELECT source, count(DISTINCT text) AS pages FROM documents GROUP BY source),
often AS (
  SELECT l.source, l.k FROM (SELECT source, trim(line, ' ') AS k, count(DISTINCT text) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY ALL) l
  JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE n >= 2 AND n > 0.05 * pages),
kept AS (
  SELECT l.*, o.k IS NOT NULL AS gone FROM lines l
  LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND trim(l.line, ' ') = o.k),
docs AS (
  SELECT doc_id, coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '') AS text,
         count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, k.text, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN docs k USING (doc_id)""",
    "op3_near_duplicates": """
WITH RECURSIVE
low AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM low),
cls AS (SELECT min(doc_id) AS cid, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
each AS (SELECT cid, len(s) AS n, unnest(s) AS x FROM cls),
pairs AS (
  SELECT a.cid AS a, b.cid AS b FROM each a JOIN each b ON a.x = b.x AND a.cid < b.cid
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT cid, cid FROM cls UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(m.c, t.doc_id) AS component_id, coalesce(m.c, t.doc_id) = t.doc_id AS kept
FROM sets t LEFT JOIN cls k ON list_sort(t.s) = k.s LEFT JOIN comp m ON m.a = k.cid""",
    "op4_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, h, strlen(h) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS top,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(((CAST('0x' || substr(sha1(h), CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d""",
    "op8_near_duplicate_vectors": """
WITH RECURSIVE
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, comp.c AS component_id, comp.c = vec_id AS kept
FROM embeddings JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id""",
}
