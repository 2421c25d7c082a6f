"""N-gram Jaccard join as a T-occurrence search with DivideSkip.

Two documents link if their sets of distinct word shingles have a Jaccard similarity of at least `percent` / 100. For sets of a and b
shingles that is an overlap of T = ceil(percent (a + b) / (100 + percent)) or more. The shingles of a document are ordered from rare to
common; a partner must occur on one of its short lists, those of its n - ceil(percent n / 100) + 1 rarest shingles.

1. Documents with equal sets form one class; only classes are compared.
2. Short lists: one row per (rare shingle, class), grouped by shingle. A list whose members all lie in one class is gone at once.
   Two members can only reach T if what follows in both their orders is long enough, so most near misses are never paired.
3. Stars: each list pairs its members with one pivot per size band, never with each other. Verified links join classes into components.
4. Remainder: only list members of different components are paired. So a group of n near copies costs about n pairs, yet no link is lost.
5. A pair must meet on T - L short lists, L being the number of long ones; this drops near misses before any whole set is read.
6. Verification, per pivot and block of its partners: the pivot's shingles are looked up as inverted lists over the block. Short lists are
   merged with a heap, giving each partner's count so far; partners that can't reach T any more are dropped; long lists are probed by binary
   search for the rest.

Shingles are compared as 64-bit hashes, on which sizes and links rest; two different ones agree with a chance of 2^-64.

The order of shingles comes from a sample of documents: it only decides how long lists are, any order gives the same links. The table of
frequent shingles has a fixed size, and so has the table of bits that picks the texts to read again.

Defined results: a document without words or with a null text has no shingles and links with nothing (its component is its own id). Rows
that share a doc_id count as linked; a row without a doc_id has no component and links nothing. Empty tables give no rows. Other columns
don't matter.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import merge

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shingles import shingles
from .staging import appended, discard, mapped, staged

CELLS = 22  # bits of the table of frequent shingles
BITS = 25  # bits of the table that picks texts
BLOCK = 128  # partners that one verification task row group holds


def frequent(docs: DataFrame, text: str, size: int, one_in: int = 8, least: int = 3, most: int = 1 << 18) -> np.ndarray:
    """A level for each cell of shingles, higher for those found in more of the sampled documents. At most `most` shingles get a level."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select(text)

    def start() -> Callable[[list], list[list]]:
        return lambda texts: [[s.view(np.int64).tolist() for s in shingles(texts, size)]]

    rows = appended(sample, text, [T.StructField("s", T.ArrayType(T.LongType()))], start)
    level = F.least(F.lit(255), F.floor(8 * F.log2("count"))).cast("int").alias("level")
    counts = staged(rows.select(F.explode("s").alias("s")).groupBy("s").count().filter(F.col("count") >= least).select("s", level), "op2-levels")
    # The lowest level that still fits, from the number of shingles of each level.
    held, floor = 0, 256
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            break
        floor = r["level"]
    cell = F.shiftrightunsigned("s", 64 - CELLS).alias("cell")
    cells = counts.filter(F.col("level") >= floor).groupBy(cell).agg(F.max("level").alias("level")).toArrow()
    discard(counts)
    table = np.zeros(1 << CELLS, np.uint8)
    table[cells.column("cell").to_numpy()] = cells.column("level").to_numpy()
    return table


def profiles(docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, rare): size and digest of each document's set, and its rarest shingles in order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, size))
    fields = [T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("rare", T.ArrayType(T.LongType()))]

    def start() -> Callable[[list], list[list]]:
        level = shared.value

        def work(texts: list) -> list[list]:
            sets = shingles(texts, size)
            rare = []
            for s in sets:
                short = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                order = np.argsort(level[(s >> np.uint64(64 - CELLS)).astype(np.int64)], kind="stable")[:short]
                rare.append(s[order].view(np.int64).tolist())
            return [[len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], rare]

        return work

    return staged(appended(docs, text, fields, start).select("doc_id", "n", "sig", "rare"), "op2-profiles")


def reach(n1: str, at1: str, n2: str, at2: str, percent: int) -> str:
    """SQL: the two sizes allow a link, and so does what follows these positions of a common shingle."""
    most = f"least({n1} - {at1}, {n2} - {at2})"
    return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and (100 + {percent}) * {most} >= {percent} * ({n1} + {n2})"


def short_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(s, key, n, at, band, pivot...) for the lists of rare shingles that two classes or more share; the pivot of a band has the lowest position."""
    lists = classes.select("key", "n", F.posexplode("rare").alias("at", "s"))
    spec = "partition by s, band order by at, key"
    wide = lists.withColumn("band", F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / percent)))))
    wide = wide.selectExpr("*", f"first(key) over ({spec}) pkey", f"first(n) over ({spec}) pn", f"first(at) over ({spec}) pat",
                           "count(*) over (partition by s) members")
    return staged(wide.filter("members > 1").drop("members", "band"), "op2-lists")


class DivideSkip:
    """T-occurrence search of one query set over a block of sets."""

    def __init__(self, block: list[np.ndarray]):
        self.lists: dict[int, list[int]] = {}
        for k, members in enumerate(block):
            for s in members.tolist():
                self.lists.setdefault(s, []).append(k)
        self.sizes = [len(b) for b in block]

    def overlaps(self, query: list[int], needed: list[int]) -> dict[int, int]:
        """The overlap of each set of the block that occurs on `needed[k]` or more lists of the query."""
        lists = sorted((self.lists[s] for s in query if s in self.lists), key=len)
        least = min(needed)
        long = lists[max(0, len(lists) - (least - 1)) :]
        short = lists[: len(lists) - len(long)]
        out: dict[int, int] = {}
        at, count = -1, 0
        for k in merge(*short):  # a heap over the short lists
            if k == at:
                count += 1
                continue
            if count:
                out[at] = count
            at, count = k, 1
        if count:
            out[at] = count
        left = len(long)
        for members in long:
            left -= 1
            for k in list(out):
                i = bisect_left(members, k)
                if i < len(members) and members[i] == k:
                    out[k] += 1
                elif out[k] + left < needed[k]:
                    del out[k]
        return {k: c for k, c in out.items() if c >= needed[k]}


def often_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that meet on T - L short lists or more, L being the number of long lists: what DivideSkip asks of the heap merge. Only
    the rarest shingles of both ends are read for it."""
    ends = classes.select("key", "n", "rare")
    x, y = (ends.select(*[F.col(c).alias(f"{side}_{c}") for c in ends.columns]) for side in "xy")
    met = pairs.join(x, pairs["a"] == x["x_key"]).join(y, pairs["b"] == y["y_key"])
    needed = f"({percent} * (x_n + y_n) + {99 + percent}) div {100 + percent} - greatest(x_n - size(x_rare), y_n - size(y_rare))"
    return met.filter(f"size(array_intersect(x_rare, y_rare)) >= {needed}").select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class keys, which are doc_ids, that link. Only the texts of these documents are read again, picked by a table of
    2^BITS bits before they are shuffled."""
    ends = staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "op2-ends")
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITS))
    bits = ends.groupBy(F.shiftright(cell("doc_id"), 5).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << BITS}) % 32 as int))")).alias("bits"))
    table = np.zeros(1 << (BITS - 5), np.uint32)
    for r in bits.toLocalIterator():  # at most one row per word of the table
        table[r["cell"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(table)
    hashed = docs.select("doc_id", F.col(text).alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITS)).alias("cell"))

    def pick() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        held = shared.value

        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = batch.filter(pa.array((held[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)))
            texts = rows.column(1).cast(pa.binary()).to_pylist()
            for i in range(0, len(texts), 256):
                made = pa.array([s.tobytes() for s in shingles(texts[i : i + 256], size)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(i, 256), made], names=["doc_id", "s"])

        return one

    sets = staged(mapped(hashed.filter("doc_id is not null"), "doc_id long, s binary", pick).join(ends, "doc_id", "left_semi"), "op2-sets")
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    blocks = staged(pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), "op2-blocks")
    partners = blocks.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "block", "b", "s")
    queries = blocks.select("a", "block").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "s")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        asks = [np.frombuffer(s, np.uint64) for s in rows.loc[rows["b"].isna(), "s"]]
        block = rows[rows["b"].notna()]
        sets_here = [np.frombuffer(s, np.uint64) for s in block["s"]]
        keys = block["b"].astype("int64").tolist()
        found: set[int] = set()
        if sets_here:
            index = DivideSkip(sets_here)
            for q in asks:
                needed = [max(1, -(-percent * (len(q) + n) // (100 + percent))) for n in index.sizes]
                found.update(keys[k] for k in index.overlaps(q.tolist(), needed))
        return pd.DataFrame({"a": np.full(len(found), rows["a"].iloc[0], np.int64), "b": np.array(sorted(found), np.int64)})

    links = partners.union(queries).groupBy("a", "block").applyInPandas(search, "a long, b long")
    out = staged(links, "op2-links")
    for used in (ends, sets, blocks):
        discard(used)
    return out


def remainder(lists: DataFrame, reached: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs on a common short list whose ends are in different components and which were not tried. In each list the members of its largest
    component meet the others only, so the work is that of the members left over."""
    rows = lists.select("s", "key", "n", "at").join(reached.withColumnsRenamed({"node": "key"}), "key", "left").withColumn("root", F.coalesce("root", "key"))
    counts = rows.groupBy("s", "root").agg(F.count("*").alias("c")).groupBy("s").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
    open_lists = staged(rows.join(counts.filter("roots > 1"), "s"), "op2-open")
    x = open_lists.filter("root <> main").select("s", *[F.col(c).alias(f"x_{c}") for c in ("key", "n", "at", "root")])
    y = open_lists.select("s", *[F.col(c).alias(f"y_{c}") for c in ("key", "n", "at", "root", "main")])
    met = x.join(y, "s").filter("x_root <> y_root and (y_root = y_main or x_key < y_key)").filter(reach("x_n", "x_at", "y_n", "y_at", percent))
    pairs = met.select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def join(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = profiles(docs, "text", size, percent)
    classes = staged(rows.filter("doc_id is not null and n > 0").groupBy("sig").agg(F.min("doc_id").alias("key"), F.first("n").alias("n"), F.first("rare").alias("rare")), "op2-classes")
    lists = short_lists(classes, percent)
    tried = staged(lists.filter("key <> pkey").filter(reach("n", "at", "pn", "pat", percent)).select(F.least("key", "pkey").alias("a"), F.greatest("key", "pkey").alias("b")).distinct(), "op2-stars")
    member = rows.filter("sig is not null and doc_id is not null").select("doc_id", "sig").join(classes.select("sig", "key"), "sig").select("doc_id", "key")
    least = member.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select("doc_id", "a")
    shared_id = member.join(least, "doc_id").filter("key <> a").select("a", F.col("key").alias("b")).distinct()
    first = verified(staged(often_enough(tried, classes, percent), "op2-pairs"), docs, "text", size, percent)
    reached = components(first)
    rest = staged(often_enough(remainder(lists, reached, tried, percent), classes, percent), "op2-rest")
    links = reached.select(F.col("node").alias("a"), F.col("root").alias("b")).union(shared_id)
    if not rest.isEmpty():
        links = links.union(verified(rest, docs, "text", size, percent))
    roots = components(links)
    named = classes.select("sig", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("sig", F.coalesce("root", "key").alias("component"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(named, "sig", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
