"""Wavelet matrix over token ids: a succinct file with access, count and occurrence lookup.

Layout, little-endian: magic, version, bits, documents, tokens, blocks a plane; for each bit-plane from the highest its zeros,
its rank directory (ones before each block of BLOCK_BITS bits) and the offset of each block in the file; ids, null flags and token
counts of the documents; then the zstd-compressed blocks, plane after plane. A look-up reads the head, the directories and one
or two blocks a plane, whatever the size of the file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import zstandard

from rippleline.llm.common import opened

MAGIC, VERSION = b"RLWM", 2
BLOCK_BITS = 1 << 16
_HEAD = struct.Struct("<4sHHQQQ")


def build(values: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray | list[int], bits: int) -> bytes:
    """A file image of the ids of whole documents."""
    values = np.asarray(values, np.uint32)
    pack, step, n = zstandard.ZstdCompressor(level=1), BLOCK_BITS // 8, len(values)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    blocks = -(-n // BLOCK_BITS)
    at = _HEAD.size + bits * 8 * (1 + 2 * (blocks + 1)) + 17 * len(ids)
    directories, data = [], []
    values = values.astype(np.uint16) if bits <= 16 else values
    for b in range(bits - 1, -1, -1):
        ones = (values & values.dtype.type(1 << b)).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        made = [pack.compress(packed[i : i + step].tobytes()) for i in range(0, len(packed), step)]
        rank = np.concatenate([[0], np.cumsum([int(ones[i : i + BLOCK_BITS].sum()) for i in range(0, n, BLOCK_BITS)])])
        where = np.concatenate([[at], at + np.cumsum([len(x) for x in made])])
        at = int(where[-1])
        directories.append(np.concatenate([[n - int(ones.sum())], rank, where]).astype("<u8").tobytes())
        data += made
        values = np.concatenate([values.take(np.flatnonzero(~ones)), values.take(np.flatnonzero(ones))])
    return b"".join([_HEAD.pack(MAGIC, VERSION, bits, len(ids), n, blocks), *directories, ids.tobytes(), nulls.tobytes(), np.asarray(lengths).astype("<u8").tobytes(), *data])


class Wavelet:
    """Reads a file, or an image of one, through `read(offset, size)`; planes stay compressed."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, version, self.bits, self.n_docs, self.n, blocks = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        width = 1 + 2 * (blocks + 1)
        rows = np.frombuffer(read(_HEAD.size, self.bits * 8 * width), "<u8").astype(np.int64).reshape(self.bits, width)
        self.planes = [(int(r[0]), r[1 : blocks + 2], r[blocks + 2 :]) for r in rows]
        self._docs_at = _HEAD.size + self.bits * 8 * width
        self._open = zstandard.ZstdDecompressor()

    @classmethod
    def of(cls, image: bytes) -> Wavelet:
        return cls(lambda offset, size: image[offset : offset + size])

    @classmethod
    @contextmanager
    def open(cls, path: str) -> Iterator[Wavelet]:
        """A file by its path; a look-up reads only what it needs."""
        with opened(path, "rb") as f:
            yield cls(lambda offset, size: f.read_at(size, offset))

    @cached_property
    def _documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, n = self.read(self._docs_at, 17 * self.n_docs), self.n_docs
        return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool), np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)

    @property
    def doc_ids(self) -> np.ndarray:
        return self._documents[0]

    @property
    def doc_null(self) -> np.ndarray:
        return self._documents[1]

    @property
    def lengths(self) -> np.ndarray:
        return self._documents[2]

    def _block(self, plane: int, block: int) -> np.ndarray:
        where = self.planes[plane][2]
        raw = self._open.decompress(self.read(int(where[block]), int(where[block + 1] - where[block])))
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before position i."""
        rank = self.planes[plane][1]
        block, rest = divmod(i, BLOCK_BITS)
        return int(rank[block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, ks: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) bits of that value, for ascending k; each block is read once."""
        rank = self.planes[plane][1]
        before = rank if bit else np.minimum(np.arange(len(rank)) * BLOCK_BITS, self.n) - rank
        blocks = np.searchsorted(before, ks, "right") - 1
        out = np.empty(len(ks), np.int64)
        for block in np.unique(blocks).tolist():
            lo, hi = np.searchsorted(blocks, [block, block + 1])
            found = np.flatnonzero(self._block(plane, block)[: self.n - block * BLOCK_BITS] == bit)
            out[lo:hi] = block * BLOCK_BITS + found[ks[lo:hi] - int(before[block])]
        return out

    def access(self, i: int) -> int:
        """The id at a position; IndexError if there is none, also for a negative one."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p, (zeros, *_) in enumerate(self.planes):
            block, rest = divmod(i, BLOCK_BITS)
            bits = self._block(p, block)
            bit, ones = int(bits[rest]), int(self.planes[p][1][block]) + int(bits[:rest].sum())
            value, i = value << 1 | bit, zeros + ones if bit else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences before `end` lie in the order of the last plane."""
        lo, hi = 0, end
        for p, (zeros, *_) in enumerate(self.planes):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (zeros + a, zeros + b) if value >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, end: int | None = None) -> int:
        """Occurrences before position `end`, from 0 to n; none of a value that isn't there."""
        if end is not None and not 0 <= end <= self.n:
            raise IndexError(end)
        if value >> self.bits:
            return 0
        lo, hi = self._range(value, self.n if end is None else end)
        return hi - lo

    def _places(self, value: int, at: np.ndarray) -> np.ndarray:
        """From places in the order of the last plane to positions; both ascend."""
        for p in range(self.bits - 1, -1, -1):
            zeros = self.planes[p][0]
            bit = value >> (self.bits - 1 - p) & 1
            at = self._select(p, bit, at - zeros if bit else at)
        return at

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        lo, hi = (0, 0) if value >> self.bits else self._range(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        return int(self._places(value, np.array([lo + k]))[0])

    def occurrences(self, value: int) -> list[int]:
        """All positions of a value: one descent for all of them."""
        lo, hi = (0, 0) if value >> self.bits else self._range(value, self.n)
        return self._places(value, np.arange(lo, hi)).tolist()

    def tokens(self) -> np.ndarray:
        """All ids in order: planes are undone from the lowest up, each read in one go."""
        wide = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, wide)
        for p in range(self.bits - 1, -1, -1):
            zeros, _, where = self.planes[p]
            first = int(where[0])
            raw = self.read(first, int(where[-1]) - first)
            bits = b"".join([self._open.decompress(raw[i - first : j - first]) for i, j in zip(where[:-1].tolist(), where[1:].tolist())])
            ones = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[: self.n].astype(bool)
            before = np.empty(self.n, wide)
            before[np.flatnonzero(~ones)] = values[:zeros]
            before[np.flatnonzero(ones)] = values[zeros:] | wide(1 << (self.bits - 1 - p))
            values = before
        return values.astype("<u4")
