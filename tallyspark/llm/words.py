"""Words of a whole Arrow batch at once.

Every text operator here turns a batch of texts into one flat array of word
codes plus the distinct words of the batch, so Python touches each distinct
word once and numpy does the rest.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words without punctuation: a-z after folding A-Z, digits and everything beyond ASCII.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words between ASCII white space, A-Z folded.
SPACED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words(NamedTuple):
    """Document i of the batch has the words vocab[codes[starts[i]:starts[i + 1]]]."""

    codes: np.ndarray
    starts: np.ndarray
    vocab: list[bytes]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def translated(texts: pa.Array, table: bytes | None) -> pa.LargeBinaryArray:
    """The texts with every byte mapped by table; nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = bytes(memoryview(raw)[off[0] : off[-1]]) if raw is not None and len(texts) else b""
    if table is not None:
        data = data.translate(table)
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(off - off[0])), pa.py_buffer(data)])


def split(texts: pa.Array, table: bytes | None) -> Words:
    """Words of each text after mapping its bytes by table; ASCII white space divides them."""
    mapped = translated(texts, table)
    # the bytes are only ever cut at ASCII white space, so viewing them as text is safe
    parts = pc.ascii_split_whitespace(mapped.view(pa.large_utf8()))
    off = np.asarray(parts.offsets, dtype=np.int64)
    flat = pc.dictionary_encode(parts.values.view(pa.large_binary()))
    codes, vocab = np.asarray(flat.indices, dtype=np.int64), flat.dictionary.to_pylist()
    if b"" in vocab:  # white space at an end of a text
        keep = codes != vocab.index(b"")
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        codes = codes[keep]
    return Words(codes, off - off[0] if len(off) else np.zeros(1, np.int64), vocab)


def hashes(vocab: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in vocab), np.uint64, len(vocab))


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Words of more bytes than this are hashed one at a time.
LONG = 64
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(texts: pa.Array, table: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word that split() gives, in one flat array, and where each text's begin
    in it (the last entry is the end), without a Python object or a dictionary entry of any word.

    Eight bytes at a time are mixed in by steps that can be undone, so words of one length
    up to eight bytes never share a hash."""
    parts = pc.ascii_split_whitespace(translated(texts, table).view(pa.large_utf8()))
    values, off = parts.values, np.asarray(parts.offsets, dtype=np.int64)
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    begin, size = ends[:-1], np.diff(ends)
    if (size == 0).any():  # white space at an end of a text
        keep = size > 0
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        begin, size = begin[keep], size[keep]
    starts = off - off[0] if len(off) else np.zeros(1, np.int64)
    raw = values.buffers()[2]
    data = np.zeros((raw.size if raw is not None else 0) + 8, np.uint8)
    if raw is not None:
        data[: raw.size] = np.frombuffer(raw, np.uint8)
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,))
    h = size.astype(np.uint64) * _MIX[0]
    for first in range(0, LONG, 8):
        some = np.flatnonzero(size > first) if first else slice(None)
        left = size[some] - first
        if not len(left):
            break
        k = eight[begin[some] + first] & _FIRST_BYTES[np.minimum(left, 8)]
        k *= _MIX[1]
        k ^= k >> np.uint64(32)
        k = (h[some] ^ k) * _MIX[0]
        h[some] = k ^ (k >> np.uint64(29))
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : begin[i] + size[i]].tobytes())
    return h, starts


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a run from the hashes of its first and second part; the order counts."""
    x = left * _MIX[0] + (right ^ (right >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words of a flat array, by doubling: len(h) - n + 1 values."""
    if n < 1 or len(h) < n:
        return np.empty(0, np.uint64)
    power, done, out = h, 0, None
    size = 1
    while True:
        if n & size:
            part = power[done : done + len(h) - n + 1]
            out = part if out is None else joined(out, part)
            done += size
        if done == n:
            return out
        power = joined(power[: len(power) - size], power[size:])
        size *= 2


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about most bytes of text each, at least one row, so a task's memory
    depends on neither Spark's batch size nor the lengths of the texts around a long one."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end, first = np.cumsum(size), 0
        while first < batch.num_rows:
            done = end[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(end, done + most, side="right")))
            yield batch.slice(first, stop - first)
            first = stop


def freed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work() for mapInArrow, after which what Arrow and the C library hold back for later goes back to
    the system, as Python workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not gc.get_freeze_count():
            gc.freeze()  # what a worker has loaded before its first task need not be searched after each
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not every C library has it
                pass

    return run
