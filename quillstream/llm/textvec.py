"""Words of Arrow text batches as numpy arrays: spans, exact numbers and 64-bit digests, without Python strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return.
SPACES = b" \t\n\r\x0b\x0c"
GROUP_BYTES = 1 << 21

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection that scatters 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of consecutive documents.

    data: the bytes; starts, ends: of each word in data; of: word numbers where documents begin,
    one more than documents; doc: document number of each word; bounds: byte offsets of documents.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        self.bounds = bounds
        self._dictionary: pa.DictionaryArray | None = None
        n = len(data)
        word = _IS_WORD[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
            inner = bounds[1:-1]
            before[inner[inner < n]] = False
            after[inner[inner > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.of = np.searchsorted(self.starts, bounds)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(self.of))

    def _encoded(self) -> pa.DictionaryArray:
        if self._dictionary is None:
            ends = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
            packed = self.data[_IS_WORD[self.data]]
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)])
            self._dictionary = words.dictionary_encode()
        return self._dictionary

    def numbers(self) -> np.ndarray:
        """A number of each word: within these documents equal numbers mean equal bytes."""
        return self._encoded().indices.to_numpy().astype(np.int64)

    def hashes(self) -> np.ndarray:
        """The first 64 bits of each word's BLAKE2b digest, equal for equal words in any batch; one digest per distinct word."""
        digests = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in self._encoded().dictionary.to_pylist())
        return np.frombuffer(digests, "<u8").astype(np.uint64)[self._encoded().indices.to_numpy()]

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, each with a space behind it, and where each begins; one more for the end."""
        at = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])
        out, inside = np.full(at[-1], 32, np.uint8), np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        out[inside] = self.data[_IS_WORD[self.data]]
        return out.tobytes(), at

    def digests(self) -> list[bytes]:
        """SHA-256 of each document's words, joined by single spaces."""
        raw = self.data.tobytes()
        return [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    return offsets, np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """The words of all texts as one group."""
    offsets, data = _buffers(texts)
    return Words(data[offsets[0] : offsets[-1]], offsets - offsets[0], lower)


def text_groups(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, Words) of groups of rows of about two megabytes; null texts are empty."""
    offsets, data = _buffers(texts)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
        yield at, stop, Words(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], lower)
        at = stop


def row_groups(texts: pa.Array, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of consecutive groups of rows of about ``group_bytes`` of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + group_bytes, "right")))
        yield at, stop
        at = stop


def by_doc(ufunc: np.ufunc, values: np.ndarray, of: np.ndarray, empty) -> np.ndarray:
    """ufunc reduced over each document's values; ``empty`` for documents without any."""
    out = np.full(len(of) - 1, empty, values.dtype)
    some = np.flatnonzero(np.diff(of))
    if len(some):
        out[some] = ufunc.reduceat(values, of[some])
    return out
