"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file lists byte strings; the library works on characters. Each byte has a character of its own, and every ranked string of more than
one byte is the merge of the two parts that the lower ranks alone leave of it. Decoding maps ids back to bytes and joins them before any
character is read, so characters that tokens split come back whole.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded alike; an empty table gives no rows; a column of the
input with a result's name is replaced.
"""
from __future__ import annotations

import base64
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import PieceCache, byte_characters
from .staging import appended

_HELD: dict[tuple[str, str], tuple[PieceCache, list[bytes]]] = {}
_BYTES: dict[str, list[bytes]] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def parts_below(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging by lower ranks leaves of a token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), default=(rank, 0))
        if best[0] >= rank:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def bytes_of(path: str) -> list[bytes]:
    """The bytes of each id."""
    if path not in _BYTES:
        ranks = ranks_of(path)
        table = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            table[rank] = token
        _BYTES[path] = table
    return _BYTES[path]


def library(path: str, pattern: str) -> tuple[PieceCache, list[bytes]]:
    """The library's encoder and the bytes of each id, once per worker process."""
    if (path, pattern) not in _HELD:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = ranks_of(path), byte_characters()
        shown = lambda token: "".join(chars[b] for b in token)
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = parts_below(token, rank, ranks)
                if len(parts) == 2:
                    merges.append((shown(parts[0]), shown(parts[1])))
        tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        _HELD[path, pattern] = PieceCache(tokenizer, pattern, most=200_000), bytes_of(path)
    return _HELD[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Adds n_tokens and ids (little-endian unsigned 32-bit). With offsets, also char_from: the code point at which each token starts, as
    little-endian unsigned 64-bit integers; a token that starts inside a character has that character's position."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("char_from", T.BinaryType())] * offsets

    def start() -> Callable[[list], list[list]]:
        cache, table = library(path, pattern)
        starts = np.array([sum(b & 0xC0 != 0x80 for b in token) for token in table], np.int64)
        inside = np.array([bool(token) and token[0] & 0xC0 == 0x80 for token in table])

        def work(texts: list) -> list[list]:
            ids = cache.texts(texts)
            out: list[list] = [[len(x) // 4 for x in ids], ids]
            if offsets:
                at = [np.frombuffer(x, "<u4") for x in ids]
                out.append([(np.cumsum(starts[a]) - starts[a] - inside[a]).astype("<u8").tobytes() for a in at])
            return out

        return work

    return appended(docs, text, fields, start)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded: the bytes of the ids, whole even where a token ends inside a character."""

    def start() -> Callable[[list], list[list]]:
        table = bytes_of(path)
        return lambda values: [[b"".join(map(table.__getitem__, np.frombuffer(v or b"", "<u4").tolist())) for v in values]]

    return appended(rows, ids, [T.StructField("decoded", T.BinaryType())], start)
