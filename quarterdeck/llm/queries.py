"""The registered queries of the operators, with production parameters over whole tables."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (op1_quality_rules, op2_jaccard_join, op3_token_store, op4_chat_format, op5_language_id, op6_quality_classifier, op7_decontamination, op8_pii, op9_byte_bpe,
               op10_license_scan, op11_kd_shards, op12_token_alignment, op13_ranked_search)
from .staging import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(by))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = op1_quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return judged.select("doc_id", *op1_quality_rules.BASE, "base_failed", "kept", "rule")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_jaccard_join.join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = op3_token_store.store_path(spark)
    op3_token_store.write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return op3_token_store.read_store(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = op4_chat_format.parse(op4_chat_format.render(op4_chat_format.messages(op4_chat_format.as_log(rows))))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select("conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
                       F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 3) == 1).alias("held_out"))
    model = op5_language_id.learn(docs.filter(~F.coalesce("held_out", F.lit(False))))
    return op5_language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder("doc_id", 4) == 2)
    rows = staged(op6_quality_classifier.with_features(docs).select("doc_id", "held_out", *op6_quality_classifier.features()), "op6-features")
    marks = table(spark, sf_dir, "labels").filter(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 1).alias("good"))
    ranking = op6_quality_classifier.learn(rows.filter(~F.col("held_out")).join(marks, "doc_id"))
    return op6_quality_classifier.predict(rows, ranking).select("doc_id", "held_out", "score", "predicted")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = op7_decontamination.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8_pii.find(table(spark, sf_dir, "documents"), carry=["doc_id"])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in op8_pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(op8_pii.listed(op8_pii.KINDS), 256).alias("base_sha256"), op8_pii.listed([*op8_pii.KINDS, "context"]).alias("spans"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = op9_byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    return op9_byte_bpe.decode(rows, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op10_license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("match_lines").cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"),
                        F.round(F.coalesce(F.array_max("match_dice"), F.lit(0.0)), 6).alias("best_dice"), F.array_join("match_lines", ",").alias("match_lines"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    dealt = op11_kd_shards.assign(docs)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "lang")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = op12_token_alignment.alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1, "op2_jaccard_join": op2, "op3_token_store": op3, "op4_chat_format": op4, "op5_language_id": op5, "op6_quality_classifier": op6,
    "op7_decontamination": op7, "op8_pii": op8, "op9_byte_bpe": op9, "op10_license_scan": op10, "op11_kd_shards": op11, "op12_token_alignment": op12, "op13_ranked_search": op13,
}
