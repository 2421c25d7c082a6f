"""Texts as pieces that tokenise alone, so that a piece that occurs often goes through the tokenizer library once per worker.

The byte-level split rule never lets a token run from a character that is no white space into white space. So a text may be cut before a
blank that follows such a character, and its ids are those of its pieces in order. New pieces are split by the same rule and their parts
are merged by the library's model, many in one call. A text with any other cut, and a piece with characters past Latin Extended-B (where Unicode versions of two
pattern libraries may differ), go through the library's whole pipeline.
"""
from __future__ import annotations

import re
from string import punctuation
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LATIN = re.compile("[\x00-ɏ]*")


def byte_characters() -> list[str]:
    """The character of each byte: itself where printable in Latin-1, else the next unused one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PieceCache:
    """Ids of texts as little-endian unsigned 32-bit bytes. `tokenizer`: of the tokenizers library, byte-level, splitting by `pattern`.
    About `most` pieces are kept between calls, the last ones and those of the last texts; this decides speed, not results."""

    def __init__(self, tokenizer: Any, pattern: str, most: int = 450_000, run: int = 20_000):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.split, self.most, self.run = tokenizer, regex.compile(pattern).findall, most, run
        # The same model over parts that are split already: no byte's character is white space, and byte 255, which UTF-8 never has, is the blank before a part.
        self.model, self.shown = Tokenizer(tokenizer.model), np.array([ord(c) for c in byte_characters()], "<u4")
        self.model.pre_tokenizer, self.shown[255] = WhitespaceSplit(), ord(" ")
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.complete = all(c in vocabulary for c in byte_characters())  # else the ids of a part needn't have all its bytes
        self.width = np.zeros(1 + max(vocabulary.values(), default=0), np.int64)
        self.width[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes() if text else b""

    def merged(self, stream: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
        """Ids of pieces of so many bytes, from the stream of their parts, each behind a byte 255. The bytes of the ids tell where a piece ends."""
        shown = self.shown[stream].tobytes().decode("utf-32-le")
        ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes), "right")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(4 * np.append(0, ends).astype(np.int64)), pa.py_buffer(ids)])

    def pieces(self, new: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of a blank and each piece; null for a piece that can't stand alone. A word with marks behind it is two parts; anything else is
        split by the rule."""
        words = pc.ascii_rtrim(new, characters=punctuation)
        (ends, data), letters = layout(new), np.diff(layout(words)[0])
        high = np.append(0, np.cumsum(data > 0xC8))  # first bytes of characters from U+0240
        plain = pc.utf8_is_alpha(words).to_numpy(False) & (np.diff(high[ends]) == 0) & self.complete
        ends, data = layout(new.filter(pa.array(plain)))
        sizes, letters = np.diff(ends), letters[plain]
        marked = letters < sizes
        at = np.concatenate([np.repeat(ends[:-1], 2), (ends[:-1] + letters)[marked]])
        stream = np.insert(data, at, np.append(np.tile([255, 32], len(sizes)), np.full(marked.sum(), 255)).astype(np.uint8))
        made, order = [self.merged(stream, sizes + 1)], [np.flatnonzero(plain)]

        other = np.flatnonzero(~plain)
        texts = new.take(pa.array(other)).to_pylist()
        ruled = np.array([self.complete and bool(text) and not text[-1].isspace() and bool(_LATIN.fullmatch(text)) for text in texts], bool)
        split = [[part.encode() for part in self.split(" " + text)] for text, rule in zip(texts, ruled, strict=True) if rule]
        stream = np.frombuffer(b"".join([b"\xff" + part for parts in split for part in parts]), np.uint8)
        made.append(self.merged(stream, np.array([sum(map(len, parts)) for parts in split], np.int64)))
        rest = [self.whole(" " + text) if text and not text[-1].isspace() else None for text, rule in zip(texts, ruled, strict=True) if not rule]
        made.append(pa.array(rest, pa.large_binary()))
        order += [other[ruled], other[~ruled]]
        return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(order))))

    def texts(self, values: list[bytes | None]) -> list[bytes]:
        """The pieces of all texts are one column, of which each different value is looked up once."""
        texts = [value.decode("utf-8", "replace") if value else "" for value in values]
        cut = [text.partition(" ") for text in texts]
        tails = pc.split_pattern(pa.array([tail for _, _, tail in cut], pa.large_string()), " ")
        coded = tails.values.dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy().copy()
        new = coded.dictionary.filter(pa.array(at < 0))
        at[at < 0] = len(self.known) + np.arange(len(new))
        self.ids = pa.concat_arrays([self.ids, *(self.pieces(new.slice(k, self.run)) for k in range(0, len(new), self.run))])
        self.known = pa.concat_arrays([self.known, new])
        ids = self.ids.take(pa.array(at[coded.indices.to_numpy()]))
        if len(self.known) > self.most:
            last = np.append(np.setdiff1d(np.arange(len(self.known)), at, assume_unique=True), at)[-(self.most * 3 // 4) :]
            self.known, self.ids = self.known.take(pa.array(last)), self.ids.take(pa.array(last))

        bounds, (ends, data) = tails.offsets.to_numpy(), layout(ids)
        lost = np.append(0, np.cumsum(ids.is_null().to_numpy(False)))
        out = []
        for text, (head, blank, _), start, end, holes in zip(texts, cut, ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist(), np.diff(lost[bounds]).tolist(), strict=True):
            if not blank:
                out.append(self.whole(head))
            elif holes or head[-1:].isspace():  # a piece can't stand alone
                out.append(self.whole(text))
            else:
                out.append(self.whole(head) + data[start:end].tobytes())
        return out


def layout(column: pa.LargeBinaryArray | pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where values end (and the first starts) in the bytes of all, and these bytes."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
