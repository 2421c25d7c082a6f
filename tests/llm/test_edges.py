"""Every operator and pipeline stage on empty tables, on columns named like its results, and on rows that share a doc_id."""
import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarterdeck.llm import (op1_quality_rules, op2_jaccard_join, op3_token_store, op4_chat_format, op5_language_id, op6_quality_classifier, op7_decontamination, op8_pii, op9_byte_bpe,
                             op10_license_scan, op11_kd_shards, op12_token_alignment, op13_ranked_search)

A, B, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
CLASH = ["n_words", "word_chars", "base_failed", "kept", "rule", "n_shingles", "component_id", "ids", "n_tokens", "start", "decoded", "lang_pred", "score", "predicted", "n_hit", "items",
         "contaminated", "email", "ip", "card", "phone", "context", "licenses", "match_lines", "size", "shard", "slot", "n_a", "n_links", "pairs", "rank", "h", "form", "token", "_part", "key", "n", "s"]


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string")


def store(spark, docs):
    folder = op3_token_store.store_path(spark)
    op3_token_store.write_store(docs, folder, A)
    return op3_token_store.read_store(spark, folder)


def quality(docs):
    held = op6_quality_classifier.with_features(docs)
    return op6_quality_classifier.predict(held, op6_quality_classifier.learn(held.withColumn("good", F.col("doc_id") == 1)))


OPERATORS = {
    "op1": lambda spark, docs: op1_quality_rules.judge(docs, labels(spark), carry=["doc_id"])[0],
    "op2": lambda spark, docs: op2_jaccard_join.join(docs, size=4, percent=85),
    "op3": store,
    "op5": lambda spark, docs: op5_language_id.predict(docs, op5_language_id.learn(docs)),
    "op6": lambda spark, docs: quality(docs),
    "op7": lambda spark, docs: op7_decontamination.search(docs, bench(spark)),
    "op8": lambda spark, docs: op8_pii.find(docs),
    "op9": lambda spark, docs: op9_byte_bpe.decode(op9_byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS),
    "op10": lambda spark, docs: op10_license_scan.scan(docs),
    "op11": lambda spark, docs: op11_kd_shards.assign(docs, shards=3),
    "op12": lambda spark, docs: op12_token_alignment.alignment(docs, A, B),
}


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.createDataFrame([(1, "one two three a@b.com"), (1, "one two three a@b.com"), (1, "other words 4111111111111111"), (2, None), (3, ""), (None, "no id")], "doc_id long, text string")
    return base.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **{c: F.lit("own") for c in CLASH}})


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_documents(spark, rows, name):
    assert OPERATORS[name](spark, rows.limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_and_shared_ids(spark, rows, name):
    got = OPERATORS[name](spark, rows)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(["1", "1", "1", "2", "3", "None"]) and len(got.columns) == len(set(got.columns))


def test_empty_benchmark_log_and_queries(spark, rows):
    none = bench(spark).limit(0)
    assert {(r["n_hit"], r["contaminated"]) for r in op7_decontamination.search(rows, none).collect()} == {(0, False)}
    assert op13_ranked_search.search(rows, none).collect() == [] and op13_ranked_search.search(rows.limit(0), bench(spark)).collect() == []
    log = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op4_chat_format.parse(op4_chat_format.render(op4_chat_format.messages(op4_chat_format.as_log(log)))).collect() == []


@pytest.mark.parametrize(("name", "stage"), pipeline.STAGES)
def test_stages(spark, rows, name, stage):
    for docs in (rows.limit(0), rows):
        made = stage(spark, docs, "/root/testdata/sf0.001")
        if name != pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
        assert made.count() <= docs.count()
