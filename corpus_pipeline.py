"""The corpus pipeline: documents pass quality rules, near-duplicate removal, benchmark decontamination, removal of personal data, and encoding.

Each stage gets all documents that the one before kept, as reread from Parquet, and returns the columns of documents; the last one returns tokens.
Extra columns of documents come through all but the last stage, whatever their names. Rows with a null text fall to the first stage, as they have no words.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.llm import op1_quality_rules, op2_jaccard_join, op7_decontamination, op8_pii, op9_byte_bpe
from quarterdeck.llm.staging import staged

ORACLE_SQL = None  # learned rules, patterns and tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions


def apart(docs: DataFrame) -> DataFrame:
    """The documents with all columns renamed, so that no result replaces one."""
    return docs.toDF(*[f"in_{c}" for c in docs.columns])


def back(docs: DataFrame, changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of docs from a frame made of apart(docs)."""
    return [(changed or {}).get(c, F.col(f"`in_{c}`")).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    keyed = apart(docs).withColumn("doc_id", F.col("in_doc_id"))
    judged, _ = op1_quality_rules.judge(keyed, spark.read.parquet(f"{sf_dir}/labels.parquet"), text="in_text")
    return judged.filter("kept").select(*back(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies; of rows that share it, the first by text. Rows without doc_id stay."""
    first = op2_jaccard_join.join(docs).filter("doc_id = component_id").select("doc_id").distinct()
    held = docs.join(first, docs["doc_id"] == first["doc_id"], "left_semi")
    one = held.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id", "text"))).filter("__k = 1").drop("__k")
    return one.union(docs.filter(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    found = op7_decontamination.search(apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text="in_text")
    return found.filter(~F.col("contaminated")).select(*back(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the kind in brackets; n_chars counts the new text."""
    found = op8_pii.find(apart(docs), text="in_text").withColumn("__new", op8_pii.redacted(F.col("in_text")))
    return found.select(*back(docs, {"text": F.col("__new"), "n_chars": F.length("__new").cast("long")}))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding gives the text back."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = op9_byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return op9_byte_bpe.decode(encoded, ranks).select("doc_id", "lang", "source", "n_tokens", "ids", whole.alias("round_trip"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
