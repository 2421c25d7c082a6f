"""Token-ID output: a store of frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

A store is a folder with two tables. `codebook`: rank and id, the commonest id having rank 0 (ties by id). `blocks`: one row per run of
documents in ascending doc_id order, with their keys and lengths, the control bytes (two bits per id: its length less one, four ids in a
byte, low bits first) and the data bytes (each rank in 1 to 4 little-endian bytes). Decoding looks control bytes up in a table of byte masks.

Texts are encoded once where they lie and only ids are shuffled. Blocks are written by Spark's committer into shared storage, so a lost
executor repeats its task. The driver holds the codebook (at most the vocabulary) and one number per partition.

Defined results: a null text is encoded as an empty one, so it has the end id alone; the string of an added token in a text becomes its id, as the
library does by default; rows with equal doc_id are ordered by their ids, null
doc_id first; an empty table gives an empty store; other columns don't matter.
"""
from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import PieceCache
from .staging import appended, discard, mapped, new_path, staged

END = 2
# Bytes of text that are looked up at a time, and new pieces that the library merges in a call; they decide speed only.
TEXT, RUN = 4 << 20, 100_000
# Fixed value: the split rule of a byte-level pre-tokenizer.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MASKS = np.array([[[k <= (c >> 2 * i & 3) for k in range(4)] for i in range(4)] for c in range(256)])
_HELD: dict[str, PieceCache] = {}
_DEFAULT: dict[str, tuple[Callable[[str], list[int]], list[bytes]]] = {}


def library(path: str) -> PieceCache:
    """The tokenizers library with a file's vocabulary, once per worker process; its own threads are off, Spark's tasks are the threads."""
    if path not in _HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        _HELD[path] = PieceCache(tokenizer, BYTE_LEVEL, run=RUN)
    return _HELD[path]


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    return 1 + max([*made["model"]["vocab"].values(), *(t["id"] for t in made.get("added_tokens", []))])


def default_library(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """The library as its file sets it, for texts that hold an added token's string, and those strings."""
    if path not in _DEFAULT:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _DEFAULT[path] = (lambda text: tokenizer.encode(text, add_special_tokens=False).ids), [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    return _DEFAULT[path]


def encoded(docs: DataFrame, path: str, text: str = "text", end: int = END, width: str = "<u4") -> DataFrame:
    """Adds ids: those of the whole text and the end id, as little-endian unsigned integers of `width`."""

    def start() -> Callable[[list], list[list]]:
        cache, last = library(path), np.array([end], "<u4").tobytes()
        whole, added = default_library(path)

        def work(texts: list) -> list[list]:
            ids = cache.texts(texts)
            for k, text in enumerate(texts):
                if text and any(a in text for a in added):
                    ids[k] = np.array(whole(text.decode("utf-8", "replace")), "<u4").tobytes()
            return [[np.frombuffer(x + last, "<u4").astype(width).tobytes() for x in ids]]

        return work

    return appended(docs, text, [T.StructField("ids", T.BinaryType())], start, TEXT)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes."""
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = extra
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """Ranks from control and data bytes by table lookup."""
    out = np.zeros((count, 4), np.uint8)
    out[_MASKS[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:count]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def write_store(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", block_ids: int = 1 << 20) -> None:
    """Encodes, ranks ids by frequency over all documents, and writes the store. `docs` is read once."""
    spark = docs.sparkSession
    size = vocabulary_size(path)
    narrow = "<u2" if size <= 1 << 16 else "<u4"

    rows = encoded(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), path, width=narrow)
    held = staged(rows.select("key", "ids"), "op3-ids")

    def count() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            seen = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), narrow), minlength=0)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["id", "n"])

        return one

    by_id = mapped(held.select("ids"), "id long, n long", count).groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = sorted(by_id, key=lambda r: (-r["n"], r["id"]))
    rank_of = np.zeros(size, "<u4")
    rank_of[[r["id"] for r in order]] = np.arange(len(order))
    spark.createDataFrame([(k, r["id"]) for k, r in enumerate(order)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/codebook")

    def block() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        state = {"block": 0, "start": 0}

        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys, ids = batch.column(0).to_pylist(), [np.frombuffer(b, narrow) for b in batch.column(1).to_pylist()]
            at = 0
            while at < len(ids):
                to, total = at, 0
                while to < len(ids) and (to == at or total + len(ids[to]) <= block_ids):
                    total += len(ids[to])
                    to += 1
                control, data = pack(rank_of[np.concatenate(ids[at:to])])
                row = {"part": TaskContext.get().partitionId(), "block": state["block"], "start": state["start"], "keys": keys[at:to], "lengths": [len(x) for x in ids[at:to]],
                       "control": control, "data": data}
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)
                state["block"] += 1
                state["start"] += total
                at = to

        return one

    ordered = held.repartitionByRange(F.col("key")).sortWithinPartitions("key", "ids")
    mapped(ordered, _BLOCK, block).write.parquet(f"{folder}/blocks")
    discard(held)


_BLOCK = "part int, block int, start long, keys array<long>, lengths array<long>, control binary, data binary"
_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                          ("control", pa.binary()), ("data", pa.binary())])


def read_store(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document; start counts the ids of all documents before it in the whole store."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    codebook = spark.read.parquet(f"{folder}/codebook").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in codebook], "<u4")
    ids_in = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    totals = blocks.groupBy("part").agg(F.sum(ids_in).alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for r in totals:
        before[r["part"]] = at
        at += r["n"]

    def start() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lengths = np.array(row["lengths"], np.int64)
                ids = id_of[unpack(row["control"], row["data"], int(lengths.sum()))].astype("<u4")
                ends = np.cumsum(lengths)
                firsts = before[row["part"]] + row["start"] + ends - lengths
                cut = [ids[b - n : b].tobytes() for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array(firsts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(cut, pa.binary())],
                                                 names=[key, "start", "n_tokens", "ids"])

        return one

    return mapped(blocks, f"`{key}` long, start long, n_tokens long, ids binary", start)


def store_path(spark: SparkSession) -> str:
    return new_path(spark, "op3-store")
