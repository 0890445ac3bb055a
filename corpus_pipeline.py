"""Corpus cleaning as a chain of the corpus operators: classify, drop boilerplate lines, drop near-duplicates, drop
contaminated documents, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.llm import quality
from quadspark.llm.common import Workspace, unused
from quadspark.llm.decontaminate import drop_leaks
from quadspark.llm.linededup import drop_boilerplate_lines
from quadspark.llm.neardup import near_duplicates
from quadspark.llm.packing import added_tokens, pack

# Every stage takes a table with doc_id, text and source (of the first also what labels go by) and any more columns, whatever
# their names; null and empty texts, repeated rows and empty tables go through.


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more); null and empty texts score as the bias alone."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = unused(docs, "score"), unused(docs, "predicted")
    return quality.score_documents(docs, model, keep=docs.columns, names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sites' boilerplate lines; n_chars, where there is one, follows the text.  A document of
    nothing but boilerplate goes; one that was null or blank before stays as it is."""
    away = {c: unused(docs, c) for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    out = drop_boilerplate_lines(docs.withColumnsRenamed(away))
    changed = F.col("n_dropped") > 0
    out = out.where(~changed | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(away.get(c, c)).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.  Rows that repeat an id are judged each by
    their own text; those that repeat the text too stay or go together.  A null id stays."""
    gone, key = unused(docs, "gone"), unused(docs, "key")
    drop = near_duplicates(docs, text_key=True).where("not kept").select(F.col("doc_id").alias(gone), F.col("text_key").alias(key)).distinct()
    drop = Workspace(spark, "pipeline").table(drop, "gone")
    return docs.join(drop, (F.col("doc_id") == F.col(gone)) & (F.xxhash64("text") == F.col(key)), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 1024 tokens."""
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)


STAGES = [("quality", classify), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("decontamination", decontaminate), ("packing", pack_sequences)]

#: A trained classifier and a tokenizer are not SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written to the shared folder and read back, and goes when the
    next one is written."""
    ws = Workspace(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = ws.write(docs, name)
            if last:
                ws.drop(last)
            last = path
    return docs
