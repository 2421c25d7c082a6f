"""The pipeline's stages, each held against a plain version on its own input; clean documents stay. Workers give back memory after a task."""
import os
import re
from pathlib import Path

import brute
import corpus_pipeline as pipeline
import duckdb
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken

from quarterdeck.llm import op9_byte_bpe, oracles, queries
from quarterdeck.llm.staging import mapped

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = [{r["doc_id"]: r for r in docs.collect()}]
    for name, stage in pipeline.STAGES:
        docs = pipeline.staged(stage(spark, docs, DIR), name)
        seen.append({r["doc_id"]: r for r in docs.collect()})
    source, good, unique, clean, private, tokens = seen
    kept = {r["doc_id"] for r in queries.op1(spark, DIR).filter("kept").collect()}
    assert set(good) == kept and all(not brute.op1(r["text"])[5] for r in good.values())
    sets = {i: brute.shingle_set(r["text"]) for i, r in good.items()}
    assert set(unique) <= set(good) and all(sets[a] != sets[b] for a in unique for b in unique if a < b)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert set(clean) == {i for i, r in unique.items() if not brute.op7(r["text"], items)[4]}
    assert set(private) == set(clean) and all(brute.op8(r["text"])[:4] == (0, 0, 0, 0) and r["n_chars"] == len(r["text"]) for r in private.values())
    assert all(private[i]["text"] == clean[i]["text"] for i in clean if not brute.op8(clean[i]["text"])[5])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op9_byte_bpe.ranks_of(path), special_tokens={})
    assert set(tokens) == set(private) and all(r["round_trip"] and r["n_tokens"] == len(plain.encode_ordinary(private[i]["text"])) for i, r in tokens.items())


def test_idle_workers_hold_no_spare_memory(spark):
    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    def start():
        first = held()

        def work(batch):
            for _ in range(3):
                arrays = [pa.array([bytes([k % 251]) * 20_000], pa.binary()) for k in range(6_000)]  # 120 MB
            most = held()
            del arrays
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (os.getpid(), first, most)], names=["pid", "first", "most"])

        return work

    def idle(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([held()])], names=["pid", "mb"])

    used = mapped(spark.range(0, 1, 1, 1), "pid long, first long, most long", start).collect()
    found = spark.range(0, 64, 1, 64).mapInArrow(idle, "pid long, mb long").collect()
    for r in used:
        after = [x["mb"] for x in found if x["pid"] == r["pid"]]
        assert r["most"] - r["first"] > 100 and after and max(after) - r["first"] < 40


def test_statements_agree(spark):
    for name in ("documents", "benchmark", "conversations"):
        duckdb.sql(f"create or replace view {name} as select * from '{DIR}/{name}.parquet'")
    for name, statement in oracles.STATEMENTS.items():
        want, got = duckdb.sql(statement).df(), queries.QUERIES[name](spark, DIR).toPandas()
        key = list(got.columns)
        pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want[got.columns].sort_values(key).reset_index(drop=True), check_dtype=False)
