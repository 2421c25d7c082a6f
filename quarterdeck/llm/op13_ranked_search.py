"""Ranked lexical search by the Best Position Algorithm over impact lists.

Terms are runs of ASCII letters and digits and of all characters past ASCII, A-Z taken as a-z. Documents are read once per block of items: each leaves
its number of terms and the terms that some item has. From these come N (documents with a term), L (all their terms), df and, by partition, the
impact lists. A partition is searched in slices of about `SLICE` postings, so memory is bounded. In a slice every term has a list of documents by
falling impact. For an item the lists of its terms are read from the top in parallel; a document met for the first time has all its
postings fetched by direct access, which gives its score and marks its positions in all lists as seen. The best position of a list is the last one up to
which everything is seen. No document that is still unseen can score more than the sum of the impacts at the best positions (0 for a list seen
to its end), and reading stops once that sum lies strictly below the k-th score, so ties at the k-th place are all met. The k best of each slice are merged
by ranked windows, first within groups of slices.

Impacts and scores are 64-bit integers. An item is a row of the item table; terms count once in it. Items are searched in blocks of some `BLOCK` terms.

Defined results: a null text has no terms; an item without terms, or whose terms no document has, has no rows; a document must score above 0; equal scores
are ranked by doc_id, rows without one last, repeated rows each for themselves; empty tables give no rows; other columns don't matter.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterdeck.shipping import ship

from .staging import appended, bounded, staged

SLICE = 2_000_000
BLOCK = 500_000
_LAST = (1 << 63) - 1
_SHOWN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | str | None) -> list[bytes]:
    value = text.encode() if isinstance(text, str) else text or b""
    return value.translate(_SHOWN).split()


def postings(docs: DataFrame, numbers: dict[bytes, int], text: str = "text") -> DataFrame:
    """Adds n (terms of the text, with repeats), and the wanted terms in it, by number, with their occurrences: little-endian unsigned 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def start() -> Callable[[list], list[list]]:
        number = sent.value.get

        def work(texts: list) -> list[list]:
            words = [terms_of(t) for t in texts]
            sizes = [len(w) for w in words]
            flat = np.fromiter((k for w in words for k in map(number, w, repeat(-1))), np.int64, sum(sizes))
            owner = np.repeat(np.arange(len(texts)), sizes)[flat >= 0]
            keys, times = np.unique((owner << 32) + flat[flat >= 0], return_counts=True)
            cuts = np.searchsorted(keys, np.arange(len(texts) + 1) << 32).tolist()
            terms, times = (keys & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            return [sizes, [terms[i:j].tobytes() for i, j in spans], [times[i:j].tobytes() for i, j in spans]]

        return work

    fields = [T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("times", T.BinaryType())]
    return appended(docs, text, fields, start)


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term, counted in every task and then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["term", "n"])

    found = rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


class Lists:
    """The impact lists of a slice of documents, and the postings of each document for direct access."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, terms: list[np.ndarray], times: list[np.ndarray], corpus: tuple[int, int], size: int):
        count, length = corpus
        self.keys = keys
        self.indptr = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        doc = np.repeat(np.arange(len(keys)), np.diff(self.indptr))
        self.term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(times).astype(np.int64)
        m = 50 + np.array([50 * x * count // length for x in n.tolist()], np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        order = np.lexsort((doc, -self.impact, self.term))
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=size))])
        self.listed_doc, self.listed_impact = doc[order], self.impact[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.weight = np.zeros(size, np.int64)
        self.seen_doc, self.seen_place = np.zeros(len(keys), bool), np.zeros(len(order), bool)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k best documents with a score above 0, and of no others. Weights are above 0."""
        start, end = self.start[terms], self.start[terms + 1]
        full = end > start
        terms, weights, start, end = terms[full], weights[full], start[full], end[full]
        self.weight[terms] = weights
        at, position, step = start.copy(), start.copy(), max(8, k // 4)
        docs, scores, met, marked = np.zeros(0, np.int64), np.zeros(0, np.int64), [], []
        while len(terms):
            to = np.minimum(at + step, end)
            read = np.concatenate([self.listed_doc[i:j] for i, j in zip(at.tolist(), to.tolist(), strict=True)])
            at, step = to, step * 2
            new = np.unique(read[~self.seen_doc[read]])
            if len(new):
                self.seen_doc[new] = True
                sizes = self.indptr[new + 1] - self.indptr[new]
                held = np.repeat(self.indptr[new] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                weight = self.weight[self.term[held]]
                used = weight > 0
                held, owner = held[used], np.repeat(np.arange(len(new)), sizes)[used]
                made = np.zeros(len(new), np.int64)
                np.add.at(made, owner, weight[used] * self.impact[held])
                self.seen_place[self.place[held]] = True
                met.append(new)
                marked.append(self.place[held])
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, made])
                if len(scores) > k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    docs, scores = docs[scores >= least], scores[scores >= least]
            bound = 0
            for i, (p, q, w) in enumerate(zip(position.tolist(), end.tolist(), weights.tolist(), strict=True)):
                while p < q:
                    window = self.seen_place[p : min(q, p + 4096)]
                    gap = int(np.argmin(window))
                    if not window[gap]:
                        p += gap
                        break
                    p += len(window)
                position[i] = p
                if p < q:
                    bound += w * int(self.listed_impact[p - 1])
            if np.all(position >= end) or (len(scores) >= k and bound < np.partition(scores, len(scores) - k)[len(scores) - k]):
                break
        self.weight[terms] = 0
        for docs_, places in zip(met, marked, strict=True):
            self.seen_doc[docs_] = False
            self.seen_place[places] = False
        order = np.lexsort((self.keys[docs], -scores))[:k]
        order = order[scores[order] > 0]
        return docs[order], scores[order]


def slices_best(rows: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], corpus: tuple[int, int], size: int, k: int, slice_postings: int) -> DataFrame:
    """(item, doc_id, score, slice) of the k best documents of every slice."""
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting, number = 0, 0

        def searched() -> Iterator[pa.RecordBatch]:
            ids = [h[0] for h in held]
            keys = np.array([_LAST if x is None else x for x in ids], np.int64)
            lists = Lists(keys, np.array([h[1] for h in held], np.int64), [h[2] for h in held], [h[3] for h in held], corpus, size)
            for item, terms, weights in sent.value:
                docs, scores = lists.best(terms, weights, k)
                if len(docs):
                    same = [pa.array(np.full(len(docs), v, np.int64)) for v in (item, (TaskContext.get().partitionId() << 20) + number)]
                    yield pa.RecordBatch.from_arrays([same[0], pa.array([ids[d] for d in docs.tolist()], pa.int64()), pa.array(scores), same[1]], names=["item", "doc_id", "score", "slice"])

        for batch in batches:
            for key, n, terms, times in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not terms:
                    continue
                held.append((key, n, np.frombuffer(terms, "<u4"), np.frombuffer(times, "<u4")))
                waiting += len(terms) // 4
                if waiting >= slice_postings:
                    yield from searched()
                    held, waiting, number = [], 0, number + 1
        if held:
            yield from searched()

    return rows.select("doc_id", "n", "terms", "times").mapInArrow(run, "item long, doc_id long, score long, slice long")


def weight(count: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int, slice_postings: int) -> DataFrame:
    spark = docs.sparkSession
    words = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(words)}
    rows = staged(postings(docs, number).drop("text"), "op13-postings")
    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms"), F.sum(F.octet_length("terms") / 4).alias("postings")).first()
    corpus = total["docs"], total["terms"] or 0
    df = frequencies(rows, len(words))
    asked = []
    for item, terms in items:
        at = np.array([number[t] for t in sorted(set(terms)) if df[number[t]]], np.int64)
        w = np.array([weight(corpus[0], int(df[t])) for t in at], np.int64)
        asked.append((item, at[w > 0], w[w > 0]))
    parts = max(spark.sparkContext.defaultParallelism, int((total["postings"] or 0) // slice_postings))
    return slices_best(rows.coalesce(parts), asked, corpus, len(words), k, slice_postings)


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", item_key: str = "item_id", text: str = "text", slice_postings: int = SLICE, block_terms: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    bounded(spark)
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = staged(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{text}`").alias("text")), "op13-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (8 * block_terms)))
    found = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()
        rows = search_block(plain, [(r["item"], terms_of(r["text"])) for r in block], k, slice_postings)
        found = rows if found is None else found.union(rows)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("_k", F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("slice"), F.lit(64))).orderBy(*order))).filter(F.col("_k") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select(F.col("item_id").alias(item_key), "rank", F.col("doc_id").alias(key), "score")
