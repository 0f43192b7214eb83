"""Word and n-gram hashing over the raw bytes of Arrow string columns.

Everything here works on whole batches with numpy, so the cost per word is a few array
operations, and no Python string is made per word. A word's hash has 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _K2
        x = (x ^ (x >> U64(27))) * _K3
        return x ^ (x >> U64(31))


def byte_class(word: str) -> np.ndarray:
    """Which bytes belong to words. "solid": all but white space; "alnum": ASCII letters,
    digits and everything from 0x80 on."""
    table = np.zeros(256, dtype=bool)
    if word == "solid":
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif word == "alnum":
        table[0x80:] = True
        table[0x30:0x3A] = True
        table[0x41:0x5B] = True
        table[0x61:0x7B] = True
    else:
        raise ValueError(f"unknown word class {word!r}")
    return table


SOLID, ALNUM = byte_class("solid"), byte_class("alnum")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = 4_000_000, texts: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most `texts` texts of at most `most` bytes together; a longer text stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(max(j, i + 1), i + texts, n)
        yield i, j
        i = j


class Words:
    """The words of some texts: byte starts and ends, 64-bit hashes, and `off`, the n + 1
    offsets of each text's words. Texts without a word of `kind` have words of the class `other`, if
    it is given."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray, fold: bool = False, other: np.ndarray | None = None):
        n = len(data)
        padded = np.zeros(n + 16, dtype=np.uint8)
        np.take(FOLD, data, out=padded[:n]) if fold else np.copyto(padded[:n], data)
        self.bytes, self.size = padded, n
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.off = np.zeros(len(offs), np.int64)
            return
        inside = kind[padded[:n]]
        if other is not None:
            total = np.concatenate([[0], np.cumsum(inside)])
            bare = total[offs[1:]] == total[offs[:-1]]
            if bare.any():
                inside |= np.repeat(bare, np.diff(offs)) & other[padded[:n]]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offs] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.start, offs)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.bytes, self.start, self.end - self.start)


def hash_spans(padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; `padded` has 16 spare bytes at its end. Eight bytes are read at a time."""
    eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = length.astype(np.uint64) * _K1
        h = mix(h ^ (eight[start] & _MASKS[np.minimum(length, 8)]))
        more = np.flatnonzero(length > 8)
        at = 8
        while len(more):
            left = length[more] - at
            h[more] = mix(h[more] * _K1 ^ (eight[start[more] + at] & _MASKS[np.minimum(left, 8)]))
            at += 8
            more = more[left > 8]
    return h


def windows(h: np.ndarray, off: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words inside a text, and the word each begins at.

    With `short`, a text of fewer words, but not none, gives one window of all its words.
    """
    n = len(h)
    counts = np.diff(off)
    with np.errstate(over="ignore"):
        room = np.repeat(off[1:], counts) - np.arange(n)
        begin = np.flatnonzero(room >= k)
        w = np.zeros(len(begin), dtype=np.uint64)
        for j in range(k):
            w = w * _K1 + h[begin + j] * _K2
        w = mix(w)
        if short:
            few = np.flatnonzero((counts > 0) & (counts < k))
            if len(few):
                extra = np.zeros(len(few), dtype=np.uint64)
                for j in range(k - 1):
                    has = counts[few] > j
                    extra[has] = extra[has] * _K1 + h[off[few[has]] + j] * _K2
                begin, w = np.concatenate([begin, off[few]]), np.concatenate([w, mix(extra ^ counts[few].astype(np.uint64))])
                order = np.argsort(begin, kind="stable")
                begin, w = begin[order], w[order]
    return w, begin
