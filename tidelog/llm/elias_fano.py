"""Elias-Fano sequences over arrays that may be memory-mapped, queried in bulk."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyarrow import fs as pafs

_BLOCK = 1 << 15
_EACH = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)


def _in_byte() -> np.ndarray:
    """Place of the j-th one of each byte value, by 256 * j + value."""
    bit = np.arange(256)[:, None] >> np.arange(8) & 1
    rank = np.cumsum(bit, axis=1) - bit
    out = np.zeros((8, 256), np.uint8)
    value, place = np.nonzero(bit)
    out[rank[value, place], value] = place
    return out.ravel()


_IN_BYTE = _in_byte()


def _select_in_word(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Place of the one with ``left`` ones below it in each word: its byte by running byte counts, then a table."""
    counts = bits - (bits >> np.uint64(1) & np.uint64(0x5555555555555555))
    counts = (counts & np.uint64(0x3333333333333333)) + (counts >> np.uint64(2) & np.uint64(0x3333333333333333))
    counts = ((counts + (counts >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
    # A top bit stays where a byte's running count isn't over left.
    by = np.bitwise_count(((left * _EACH | _TOPS) - counts) & _TOPS).astype(np.uint64) << np.uint64(3)
    inner = left - ((counts << np.uint64(8)) >> by & np.uint64(0xFF))
    return (by + _IN_BYTE[inner << np.uint64(8) | (bits >> by & np.uint64(0xFF))]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, with running ranks of the unary words."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, rank: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.high, self.rank, self.low = n, low_bits, high, rank, low
        self._zeros = np.arange(len(rank), dtype=np.int64) * 64 - rank.astype(np.int64)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        """Arrays of a sequence below ``universe``; they are what is stored."""
        n = len(values)
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = n + (universe >> low_bits) + 1
        bits = np.zeros(-(-size // 64) * 64, bool)
        bits[at] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]]).astype(np.uint32)
        low = np.zeros(-(-n * low_bits // 64) + 1, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.int64) * low_bits
            word, by = bit >> 6, (bit & 63).astype(np.uint64)
            # Values that begin in one word are next to each other; their bits don't meet, so sums are unions.
            first = np.flatnonzero(np.diff(word, prepend=-1))
            if n:
                low[word[first]] = np.add.reduceat(part << by, first)
            over = np.flatnonzero((bit & 63) + low_bits > 64)
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - by[over])
        return {"meta": np.array([n, low_bits], np.int64), "high": high, "rank": rank, "low": low}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> "EliasFano":
        return cls(int(arrays["meta"][0]), int(arrays["meta"][1]), arrays["high"], arrays["rank"], arrays["low"])

    def _select(self, i: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the i-th one or zero of the unary bits."""
        out = np.empty(len(i), np.int64)
        base = self.rank if ones else self._zeros
        for at in range(0, len(i), _BLOCK):
            part = i[at : at + _BLOCK]
            word = np.searchsorted(base, part.astype(base.dtype), "right") - 1
            left = (part - base[word].astype(np.int64)).astype(np.uint64)
            bits = self.high[word] if ones else ~self.high[word]
            out[at : at + _BLOCK] = (word << 6) + _select_in_word(bits, left)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, by = bit >> 6, (bit & 63).astype(np.uint64)
        first = self.low[word] >> by
        second = np.where(by > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - by) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(i)

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places i and i + 1; the second is the next one of the unary bits, mostly in the same word."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self._select(i, True)
        rest = self.high[at >> 6] >> (at & 63).astype(np.uint64) >> np.uint64(1)
        after = at + 1 + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(rest == 0)
        after[far] = self._select(i[far] + 1, True)
        low, high = (at - i).astype(np.uint64) << np.uint64(self.low_bits), (after - i - 1).astype(np.uint64) << np.uint64(self.low_bits)
        return (low | self._low(i)).astype(np.int64), (high | self._low(i + 1)).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value that isn't below each x, whether it is x); the length where there is none."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        end = self._select(high, False) - high
        at, most = begin.copy(), end.copy()
        while (open_ := np.flatnonzero(at < most)).size:
            middle = (at[open_] + most[open_]) >> 1
            less = self._low(middle) < low[open_]
            at[open_[less]] = middle[less] + 1
            most[open_[~less]] = middle[~less]
        same = at < end
        same[same] = self._low(at[same]) == low[same]
        return at, same


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one file: a JSON head of fixed places, then the arrays on 8-byte bounds."""
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, len(a), at]
        pad = -len(raw) % 8
        body.append(raw + b"\0" * pad)
        at += len(raw) + pad
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def from_buffer(data: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a file as views of its bytes."""
    n = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for name, (kind, size, at) in json.loads(data[8 : 8 + n].tobytes()).items():
        kind = np.dtype(kind)
        out[name] = data[8 + n + at : 8 + n + at + size * kind.itemsize].view(kind)
    return out


def part(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k[len(prefix) + 1 :]: v for k, v in arrays.items() if k.startswith(prefix + ".")}


def named(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def store(folder: str, kind: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays to a file of the folder, under a name of its own, so that attempts don't meet."""
    place, base = pafs.FileSystem.from_uri(folder)
    place.create_dir(base, recursive=True)
    name = f"{kind}-{uuid.uuid4().hex}"
    with place.open_output_stream(f"{base}/{name}", compression=None) as f:
        f.write(to_bytes(arrays))
    return name


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a stored file: mapped where the folder is one of the machine's, else read."""
    place, base = pafs.FileSystem.from_uri(f"{folder}/{name}")
    if isinstance(place, pafs.LocalFileSystem):
        return from_buffer(np.memmap(base, np.uint8, "r"))
    with place.open_input_file(base) as f:
        return from_buffer(np.frombuffer(f.read(), np.uint8))
