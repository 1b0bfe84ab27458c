"""Vectorised word kernels over Arrow string buffers.

A word is a maximal run of bytes outside space and 0x09-0x0D, which is the regular
expression ``[^\\x20\\x09-\\x0D]+`` on code points because those bytes are ASCII and
never occur inside a UTF-8 sequence.  All kernels look at a block of whole texts laid
end to end; texts are never cut, so one text may form a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV_BASE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: everything but letters of ASCII and bytes of other code points
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public-domain murmur constants)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
LOWER_CODES = BYTE_CODES[LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (kept per process, and small on the driver, as they travel with its functions)."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n + n // 8, 1024)
        for name, base in (("up", _BASE), ("down", _INV_BASE)):
            seq = np.full(size, U64(base))
            seq[0] = 1
            _powers[name] = np.multiply.accumulate(seq)
    return _powers["up"][:n], _powers["down"][:n]


class Block:
    """Whole texts ``lo..hi`` of a batch with their bytes and word positions."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, space: np.ndarray = SPACE):
        self.data, self.offsets, self.lo = data, offsets, lo
        self.n = len(offsets) - 1
        is_word = ~space[data]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = is_word[:-1]
            before[firsts] = False
            self.starts = np.flatnonzero(is_word & ~before)
            after = np.empty(len(data), bool)
            after[-1] = False
            after[:-1] = is_word[1:]
            after[firsts[1:] - 1] = False
            self.ends = np.flatnonzero(is_word & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.is_word = is_word
        #: words of text d are ``words[d]:words[d + 1]``
        self.words = np.searchsorted(self.starts, offsets)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, LOWER_CODES if lower else BYTE_CODES)

    def window_starts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all ``width``-word windows inside one text, and each text's range of them."""
        counts = np.maximum(np.diff(self.words) - width + 1, 0)
        ptr = np.concatenate([[0], np.cumsum(counts)])
        shift = np.repeat(self.words[:-1] - ptr[:-1], counts)
        return np.arange(ptr[-1]) + shift, ptr

    def text_of(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """64-bit hash of each byte span, from one prefix sum over the block."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive word hashes from each ``first``; order matters."""
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[first + width] - total[first]) * down[first] + U64(width))


def blocks(column: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES, space: np.ndarray = SPACE) -> Iterator[Block]:
    """The texts of an Arrow string column (null counts as empty) in blocks of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, space)
        lo = hi


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
