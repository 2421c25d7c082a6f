"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every benchmark text gives windows of 13 consecutive words (one window if it is shorter). Windows of one length share a shift table over
blocks of two words, so most positions of a clean text are never looked at; blocks that end a window lead to a bucket, and a bucket's
windows are compared word by word. Documents stay where they are: no shuffle, no grouping.

The benchmark is sent to the tasks in blocks of at most `block_windows` windows; with more windows, the documents pass through one block
after the other, each block's hits being added to those before, so memory has a bound at any size of the benchmark.

Defined results: null and wordless texts have no words and no hits; benchmark rows without words give no window; a benchmark row without an
id counts for hits but is no item; repeated items count once; empty tables give no rows or no hits; a column of the documents with a
result's name is replaced.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import appended, staged
from .textstats import lower_ascii

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# ASCII letters in lower case, digits and all bytes of longer characters stay; the rest separates words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


class WuManber:
    """Shift and bucket tables for word sequences of one length. A block is two words, or one where the sequences have only one."""

    def __init__(self, patterns: list[tuple[bytes, ...]], numbers: list[int]):
        self.length = len(patterns[0])
        self.block = min(2, self.length)
        self.most = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], int]]]] = {}
        for pattern, number in zip(patterns, numbers, strict=True):
            for end in range(self.block, self.length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.most), self.length - end)
            self.bucket.setdefault(pattern[-self.block :], {}).setdefault(pattern[: self.block], []).append((pattern, number))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, number) of each occurrence, by position."""
        shift, bucket, most, length, block, at, n = self.shift, self.bucket, self.most, self.length, self.block, self.length, len(words)
        while at <= n:
            tail = tuple(words[at - block : at])
            step = shift.get(tail, most)
            if step:
                at += step
                continue
            first = at - length
            for pattern, number in bucket[tail].get(tuple(words[first : first + block]), ()):
                if tuple(words[first:at]) == pattern:
                    yield first, number
            at += 1


def windows_of(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct windows (words joined by a blank) with the items that have them."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), 0)
    w, n = F.col("w"), F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)))
    return (benchmark.select(F.col(item).cast("string").alias("item"), words.alias("w")).filter(n > 0)
            .select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(w, i, WINDOW), " "))).alias("window"))
            .groupBy("window").agg(F.collect_set("item").alias("items")))


_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_from", T.ArrayType(T.LongType())), T.StructField("hit_to", T.ArrayType(T.LongType())),
           T.StructField("items", T.ArrayType(T.StringType()))]


def _searcher(shared) -> Callable[[], Callable[[list], list[list]]]:
    """Per task: the tables of one block of windows; per batch: words, merged hit ranges and items of each text."""

    def start() -> Callable[[list], list[list]]:
        by_length: dict[int, tuple[list, list]] = {}
        items = []
        for number, (window, owners) in enumerate(shared.value):
            words = tuple(window.encode().split(b" "))
            held = by_length.setdefault(len(words), ([], []))
            held[0].append(words)
            held[1].append(number)
            items.append(owners)
        tables = [WuManber(*by_length[k]) for k in sorted(by_length)]

        def work(texts: list) -> list[list]:
            out: list[list] = [[], [], [], []]
            for text in texts:
                words = split_words(text) if text else []
                spans, found = [], set()
                for table in tables:
                    for first, number in table.find(words):
                        spans.append((first, first + table.length))
                        found.add(number)
                merged = merge(sorted(spans))
                for column, value in zip(out, (len(words), [a for a, _ in merged], [b for _, b in merged], sorted({i for k in found for i in items[k]})), strict=True):
                    column.append(value)
            return out

        return work

    return start


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_windows: int = 500_000) -> DataFrame:
    """Adds n_words, hit_from and hit_to (merged ranges of hit words, end exclusive), items (ids as sorted strings), n_hit and contaminated."""
    spark = docs.sparkSession
    windows = staged(windows_of(benchmark, item, item_text), "op7-windows")
    blocks = -(-windows.count() // block_windows) or 1
    out, names = docs, [f.name for f in _FIELDS]
    for k in range(blocks):
        block = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k) if blocks > 1 else windows
        shared = spark.sparkContext.broadcast([(r["window"], r["items"]) for r in block.collect()])
        if k:
            out = staged(out, "op7-block").withColumnsRenamed({f"{n}": f"__{n}" for n in names[1:]})
        out = appended(out, text, _FIELDS, _searcher(shared))
        if k:
            spans = F.array_sort(F.concat(F.arrays_zip(F.col("__hit_from").alias("a"), F.col("__hit_to").alias("b")), F.arrays_zip(F.col("hit_from").alias("a"), F.col("hit_to").alias("b"))))
            out = out.withColumn("__spans", joined(spans)).withColumns({
                "hit_from": F.col("__spans.a"), "hit_to": F.col("__spans.b"), "items": F.array_sort(F.array_union("__items", "items"))}).drop("__spans", *[f"__{n}" for n in names[1:]])
    n_hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def joined(spans: Column) -> Column:
    """Sorted ranges with touching ones merged; each hit range is short, so the fold's array stays as long as the result."""
    kind = "array<struct<a:bigint,b:bigint>>"
    return F.aggregate(spans, F.array().cast(kind), lambda s, x: F.when((F.size(s) > 0) & (x["a"] <= F.get(s, F.size(s) - 1)["b"]), F.concat(
        F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(F.get(s, F.size(s) - 1)["a"].alias("a"), F.greatest(F.get(s, F.size(s) - 1)["b"], x["b"]).alias("b")))))
        .otherwise(F.concat(s, F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"))))))
