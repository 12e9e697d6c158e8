"""Elias-Fano coding of monotone integer sequences, with a sampled select directory.

n values up to u take about n * (2 + log2(u / n)) bits: the low bits of each value packed side by side, the
high bits in unary (value i sets bit ``(value >> low) + i``). ``select`` finds the i-th set bit by the
directory of set bits before each block of 512 and reads one value without decoding the others.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<4sBxxxQQII")   # magic, low bits, values, largest, bytes of low part, bytes of high part
_MAGIC = b"EF01"
_BLOCK = 64   # bytes of the high part for each directory entry
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Bytes of a monotone sequence of non-negative integers."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    u = int(v[-1]) if n else 0
    if n and (np.diff(v.astype(np.int64)) < 0).any():
        raise ValueError("the values must not fall")
    low = max(0, (u // max(n, 1)).bit_length() - 1)
    if low and n:
        step = 1 << 15   # a multiple of 8 values fills whole bytes
        lows = np.concatenate([
            np.packbits(((v[a:a + step, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
            for a in range(0, n, step)])
    else:
        lows = np.zeros(0, np.uint8)
    high = np.zeros(((u >> low) + n + 8) // 8, np.uint8)
    at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
    ones = _POP[high].astype(np.int64)
    directory = np.concatenate([[0], np.cumsum(ones)])[:-1][::_BLOCK].astype("<u4")
    return _HEAD.pack(_MAGIC, low, n, u, len(lows), len(high)) + lows.tobytes() + high.tobytes() + directory.tobytes()


class EliasFano:
    """Reads what ``encode`` wrote from any buffer (bytes, memory map) without copying it."""

    def __init__(self, buffer, offset: int = 0):
        magic, self.low, self.n, self.u, n_low, n_high = _HEAD.unpack_from(buffer, offset)
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano sequence")
        at = offset + _HEAD.size
        self.lows = np.frombuffer(buffer, np.uint8, n_low, at)
        self.high = np.frombuffer(buffer, np.uint8, n_high, at + n_low)
        n_dir = -(-n_high // _BLOCK)
        self.directory = np.frombuffer(buffer, "<u4", n_dir, at + n_low + n_high)
        self.end = at + n_low + n_high + 4 * n_dir

    def __len__(self) -> int:
        return self.n

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i[:, None] * self.low + np.arange(self.low)
        bits = (self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i) -> np.ndarray:
        """Values at the positions ``i``, each found by the directory."""
        i = np.atleast_1d(np.asarray(i, dtype=np.int64))
        out = np.empty(len(i), np.uint64)
        for a in range(0, len(i), 8192):
            part = i[a:a + 8192]
            block = np.searchsorted(self.directory, part, side="right") - 1
            at = block[:, None] * _BLOCK + np.arange(_BLOCK)
            ones = _POP[np.where(at < len(self.high), self.high[np.minimum(at, len(self.high) - 1)], 0)]
            upto = np.cumsum(ones, axis=1, dtype=np.int64) + self.directory[block][:, None]
            byte = (upto <= part[:, None]).sum(axis=1)
            row = np.arange(len(part))
            rest = part - np.where(byte > 0, upto[row, np.maximum(byte - 1, 0)], self.directory[block])
            where = block * _BLOCK + byte
            bits = np.unpackbits(self.high[where][:, None], axis=1, bitorder="little")
            bit = (np.cumsum(bits, axis=1) <= rest[:, None]).sum(axis=1)
            high = (where * 8 + bit - part).astype(np.uint64)
            out[a:a + 8192] = (high << np.uint64(self.low)) | self._low(part)
        return out

    def all(self) -> np.ndarray:
        """Every value, in order."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        out = np.empty(self.n, np.uint64)
        for a in range(0, self.n, 65536):
            i = np.arange(a, min(a + 65536, self.n))
            out[a:a + len(i)] = high[a:a + len(i)] | self._low(i)
        return out
