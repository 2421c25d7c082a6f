"""Cross-tokenizer alignment by products of token-byte incidence matrices.

A is a byte-level BPE of the tokenizers library, B a piece model of the sentencepiece library, which sets a blank before every text; A gets that blank
too, so both cover the same bytes. Row i of an incidence matrix holds the bytes of token i, in compressed sparse rows. The row product A·Bᵀ
(for every byte of a token of A, the tokens of B at that byte, summed) gives the overlap links with their number of shared bytes. Offsets where a
token of A and one of B end together cut the tokens into groups; the product of the token-group matrices gives the shared-group links. A link of
the corpus counts is an overlap link whose two tokens end together.

Texts are read once. Each row gets its counts and the distinct id pairs of its links with their times; the pairs' corpus-wide counts come from these by
partial sums in every task and one aggregation, and go back to the rows in blocks of about `BLOCK` pairs, each broadcast, so what a task holds doesn't
grow with the corpus. Two vocabularies bound the number of pairs, and blocks take them all.

Defined results: a text that is null or empty, or that one of the tokenizers doesn't give back byte by byte (such as one with U+2581), has no tokens: zeros,
and '' for its groups. Strings of special tokens inside texts are plain text. Repeated rows count each time; an empty table gives no rows; ties for a
B id's highest count are all best; a column of the input with a result's name is replaced.
"""
from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterdeck.shipping import ship

from .op3_token_store import BYTE_LEVEL
from .pieces import PieceCache, byte_characters
from .staging import appended, bounded, discard, mapped, staged

BLOCK = 1_000_000
_HELD: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}
_PARTS = re.compile(" +[^ ]*")


class ByteLevel:
    """Tokenizer A: ids of texts behind a blank, and the bytes of every id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.cache = PieceCache(tokenizer, BYTE_LEVEL, most=250_000)
        byte = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (1 + max(vocabulary.values()))
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        self.lengths = np.array([len(x) for x in self.bytes], np.int32)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of a blank and each text; byte-level tokens always give it back, as every byte has one and nothing is normalised."""
        return self.cache.texts([b" " + t for t in texts])


class Pieces:
    """Tokenizer B. No piece goes on with a blank after another character, so a text's ids are those of its words with the blanks before them."""

    def __init__(self, path: str, most: int = 250_000):
        import sentencepiece

        self.model, self.most, self.known = sentencepiece.SentencePieceProcessor(model_file=path), most, {}
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(k) for k in range(size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int32)
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.blank = [self.model.piece_to_id("▁")]

    def whole(self, text: str) -> bytes | None:
        ids = self.model.encode(text)
        return array("I", ids).tobytes() if "".join([" ", text]).encode() == b"".join([self.bytes[k] for k in ids]) else None

    def ids(self, texts: list[bytes]) -> list[bytes | None]:
        """Little-endian unsigned 32-bit ids of each text; None for one that they don't give back."""
        if len(self.known) > self.most:
            self.known.clear()
        known, shown = self.known, self.bytes
        split = []
        for text in (t.decode("utf-8", "replace") for t in texts):
            if not self.apart or "▁" in text:
                split.append(None)
                continue
            words = text.split(" ")
            split.append(words if all(words) else [p[1:] for p in _PARTS.findall(" " + text)])
        new = list({w for words in split if words is not None for w in words if w not in known})
        for word, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            if not word:
                ids = self.blank
            known[word] = array("I", ids).tobytes() if b"".join([shown[k] for k in ids]) == b" " + word.encode() else None
        out = []
        for words, text in zip(split, texts, strict=True):
            try:
                out.append(b"".join(map(known.__getitem__, words)) if words is not None else self.whole(text.decode("utf-8", "replace")))
            except TypeError:  # a word that isn't given back
                out.append(self.whole(text.decode("utf-8", "replace")))
        for word in new:
            if len(word) > 32:
                del known[word]
        return out


def library(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, once per worker process."""
    if (a_path, b_path) not in _HELD:
        _HELD[a_path, b_path] = ByteLevel(a_path), Pieces(b_path)
    return _HELD[a_path, b_path]


def transposed(indptr: np.ndarray, indices: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The compressed rows of a matrix's transpose."""
    owner = np.repeat(np.arange(len(indptr) - 1, dtype=np.int32), np.diff(indptr))
    sizes = np.bincount(indices, minlength=columns)
    if np.any(indices[1:] < indices[:-1]):
        owner = owner[np.argsort(indices, kind="stable")]
    return np.concatenate([[0], np.cumsum(sizes)]), owner


def product(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gustavson's row product of two 0/1 matrices in compressed rows: for each entry (i, k) of the left one, row k of the right one is added to row i.
    Gives (row, column, sum) of the entries, by row and column."""
    (indptr, indices), (r_indptr, r_indices) = left, right
    row = np.repeat(np.arange(len(indptr) - 1, dtype=np.int32), np.diff(indptr))
    each = np.diff(r_indptr)
    if not np.all(each == 1):
        sizes = each[indices]
        row = np.repeat(row, sizes)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        column = r_indices[np.repeat(r_indptr[:-1][indices], sizes) + inside]
    else:
        column = r_indices[indices]
    change = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
    if np.any((row[1:] == row[:-1]) & (column[1:] < column[:-1])):
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
        change = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
    first = np.concatenate([[0], np.flatnonzero(change) + 1]) if len(row) else np.zeros(0, np.int64)
    return row[first], column[first], np.diff(np.append(first, len(row)))


def incidence(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by bytes: token i holds the bytes after those of the tokens before it."""
    indptr = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return indptr, np.arange(indptr[-1], dtype=np.int32)


class Alignment:
    """The tokens of many texts, one after another, with their products."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray):
        left, right = incidence(a_lengths[a]), incidence(b_lengths[b])
        self.a, self.b, self.a_end, self.b_end = a, b, left[0][1:], right[0][1:]
        self.row, self.column, self.shared = product(left, transposed(*right, int(right[0][-1])))
        ends = self.a_end[self.row] == self.b_end[self.column]
        self.link_a, self.link_b = self.row[ends], self.column[ends]
        self.a_last, self.b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        self.a_last[self.link_a] = True
        self.b_last[self.link_b] = True
        self.a_group = np.cumsum(self.a_last) - self.a_last
        self.b_group = np.cumsum(self.b_last) - self.b_last

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shared-group links: the product of the token-group matrices."""
        count = int(self.a_group[-1]) + 1 if len(self.a) else 0
        left = np.arange(len(self.a) + 1), self.a_group
        return product(left, transposed(np.arange(len(self.b) + 1), self.b_group, count))

    def listed(self, a_size: int, b_size: int) -> np.ndarray:
        """Tokens in the order of a listing by groups, as codes: 2 * id, odd for the last of a group; ids of B come after all of A."""
        a_ends, b_ends = np.flatnonzero(self.a_last) + 1, np.concatenate([[0], np.flatnonzero(self.b_last) + 1])
        out = np.empty(len(self.a) + len(self.b), np.int32)
        out[np.arange(len(self.a)) + b_ends[self.a_group]] = 2 * self.a + self.a_last
        out[np.arange(len(self.b)) + a_ends[self.b_group]] = 2 * (self.b + a_size) + self.b_last
        return out


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", links: bool = False) -> DataFrame:
    """Adds n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, and the distinct id pairs of the links (a id * size of B's vocabulary + b id) with their
    times, as little-endian unsigned 64- and 32-bit integers. With links also a_ids, b_ids, groups (the listing itself), and positions: overlap_a,
    overlap_b, overlap_bytes, and shared_a, shared_b of all pairs within a group, whose number is the product of a group's sizes."""
    long, binary, longs = T.LongType(), T.BinaryType(), T.ArrayType(T.LongType())
    fields = [T.StructField(n, long) for n in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")] + [T.StructField("groups_sha256", T.StringType())]
    fields += [T.StructField(n, binary) for n in ("pairs", "times")]
    if links:
        fields += [T.StructField("groups", T.StringType()), *[T.StructField(n, longs) for n in ("a_ids", "b_ids", "overlap_a", "overlap_b", "overlap_bytes", "shared_a", "shared_b")]]

    def start() -> Callable[[list], list[list]]:
        a_model, b_model = library(a_path, b_path)
        a_size, b_size = len(a_model.bytes), len(b_model.bytes)
        shown = [b"%d%s" % (k, mark) for size, marks in ((a_size, (b",", b"|")), (b_size, (b",", b";"))) for k in range(size) for mark in marks]
        none = [0, 0, 0, 0, 0, "", b"", b""] + (["", *[[] for _ in range(7)]] if links else [])

        def work(texts: list) -> list[list]:
            out = [list(none) for _ in texts]
            full = [k for k, t in enumerate(texts) if t]
            given = [texts[k] for k in full]
            made = []
            for k, t, a_ids, b_ids in zip(full, given, a_model.ids(given), b_model.ids(given), strict=True):
                if b_ids is not None:
                    a, b = np.frombuffer(a_ids, "<u4").astype(np.int64), np.frombuffer(b_ids, "<u4").astype(np.int64)
                    if int(a_model.lengths[a].sum()) == int(b_model.lengths[b].sum()) == len(t) + 1:
                        made.append((k, a, b))
            if not made:
                return [list(c) for c in zip(*out, strict=True)]
            joined = Alignment(np.concatenate([a for _, a, _ in made]), np.concatenate([b for _, _, b in made]), a_model.lengths, b_model.lengths)
            codes = joined.listed(a_size, b_size).tolist()
            a_to, b_to = np.cumsum([len(a) for _, a, _ in made]), np.cumsum([len(b) for _, _, b in made])
            owner = np.searchsorted(a_to, joined.link_a, "right")
            n_links, n_overlaps = np.bincount(owner, minlength=len(made)), np.bincount(np.searchsorted(a_to, joined.row, "right"), minlength=len(made))
            key = (owner.astype(np.uint64) << np.uint64(40)) + (joined.a[joined.link_a] * b_size + joined.b[joined.link_b]).astype(np.uint64)
            distinct, times = np.unique(key, return_counts=True)
            cuts = np.searchsorted(distinct, np.arange(len(made) + 1, dtype=np.uint64) << np.uint64(40)).tolist()
            pairs = distinct & np.uint64((1 << 40) - 1)
            at = 0
            for d, (k, a, b) in enumerate(made):
                to = at + len(a) + len(b)
                said = b"".join(map(shown.__getitem__, codes[at:to]))[:-1]
                n = int(n_links[d])
                out[k][:8] = [len(a), len(b), n, n, int(n_overlaps[d]), hashlib.sha256(said).hexdigest(), pairs[cuts[d] : cuts[d + 1]].tobytes(), times[cuts[d] : cuts[d + 1]].astype("<u4").tobytes()]
                if links:
                    one = Alignment(a, b, a_model.lengths, b_model.lengths)
                    i, j, _ = one.groups()
                    out[k][8:] = [said.decode(), a.tolist(), b.tolist(), one.row.tolist(), one.column.tolist(), one.shared.tolist(), i.tolist(), j.tolist()]
                at = to
            return [list(c) for c in zip(*out, strict=True)]

        return work

    return appended(docs, text, fields, start)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): how many links of all rows hold a pair of ids, and whether no pair of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, held, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            at, where = np.unique(np.concatenate([keys, *[k for k, _ in held]]), return_inverse=True)
            return at, np.bincount(where, np.concatenate([sums, *[n for _, n in held]]), len(at)).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].astype(np.int64)), pa.array(sums[i : i + 100_000])], names=["pair", "n"])

        for batch in batches:
            for pairs, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((np.frombuffer(pairs, "<u8"), np.frombuffer(times, "<u4")))
                waiting += len(held[-1][0])
                if waiting > 1 << 21:
                    keys, sums = merged()
                    held, waiting = [], 0
                    if len(keys) > 1 << 22:
                        yield from rows()
                        keys, sums = keys[:0], sums[:0]
        keys, sums = merged()
        yield from rows()

    spark = aligned.sparkSession
    ship(spark)
    bounded(spark)
    counts = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # A B id has at most as many pairs as A has ids.
    best = F.max("n").over(Window.partitionBy(F.pmod("pair", F.lit(b_size))))
    return counts.select("pair", "n", (F.col("n") == best).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds n_best and count_sum, looking the rows' pairs up in one broadcast block of the counts after another."""
    spark = aligned.sparkSession
    blocks = max(1, -(-counts.count() // block))
    zero = F.lit(0).cast("long")
    out = aligned.withColumns({"n_best": zero, "count_sum": zero})
    names = out.columns
    at = {n: names.index(n) for n in ("pairs", "times", "n_best", "count_sum")}
    for k in range(blocks):
        rows = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k).sort("pair").toArrow()
        sent = spark.sparkContext.broadcast([rows.column(c).to_numpy() for c in ("pair", "n", "best")])

        def start(sent=sent) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
            keys, n, best = sent.value
            ends = np.append(keys, -1)

            def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                pairs = [np.frombuffer(x, "<i8") for x in batch.column(at["pairs"]).to_pylist()]
                flat, times = np.concatenate([*pairs, np.zeros(0, np.int64)]), np.frombuffer(b"".join(batch.column(at["times"]).to_pylist()), "<u4").astype(np.int64)
                where = np.searchsorted(keys, flat)
                hit = ends[where] == flat
                got = np.where(hit, np.append(n, 0)[where], 0) * times
                top = np.where(hit & np.append(best, False)[where], times, 0)
                edges = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int64)
                new = {}
                for name, values in (("n_best", top), ("count_sum", got)):
                    sums = np.concatenate([[0], np.cumsum(values)])
                    new[name] = pa.array(sums[edges[1:]] - sums[edges[:-1]] + batch.column(at[name]).to_numpy(zero_copy_only=False), pa.int64())
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

            return one

        out = mapped(out, out.schema, start)
    return out


def alignment(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """The rows without their text, with their alignment and the corpus-wide counts of their links."""
    aligned = align(docs, a_path, b_path, text).drop(text)
    aligned = staged(aligned, "op12-aligned")
    counts = staged(pair_counts(aligned, len(library(a_path, b_path)[1].bytes)), "op12-pairs")
    done = with_counts(aligned, counts).drop("pairs", "times")
    discard(counts)
    return done
