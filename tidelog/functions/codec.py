"""Checksums and integer encodings as Spark columns, with plain-bytes twins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidelog.schema import MASK_DELTA, U32, StoreError

_POLY = 0x82F63B78


def _table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (_POLY * (c & 1))
        out.append(c)
    return out


CRC_TABLE = _table()


_LANE = 64
_STEPS: dict[int, np.ndarray] = {}


def _after(c: np.ndarray, zeros: int) -> np.ndarray:
    """Checksum states after so many zero bytes, a power of two times the lane: by tables of each state byte, made by doubling."""
    if zeros not in _STEPS:
        x = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
        if zeros == _LANE:
            table = np.array(CRC_TABLE, np.uint32)
            for _ in range(zeros):
                x = table[x & 255] ^ (x >> 8)
        else:
            x = _after(_after(x, zeros // 2), zeros // 2)
        _STEPS[zeros] = x.reshape(4, 256)
    step = _STEPS[zeros]
    return step[0][c & 255] ^ step[1][c >> 8 & 255] ^ step[2][c >> 16 & 255] ^ step[3][c >> 24]


def crc32c_bytes(data: bytes, start: int = 0) -> int:
    """CRC-32C of bytes. Long ones are cut into lanes that are summed side by side and joined pairwise."""
    c = start ^ U32
    if len(data) < 4 * _LANE:
        for b in data:
            c = CRC_TABLE[(c ^ b) & 255] ^ (c >> 8)
        return c ^ U32
    lanes = 1 << (-(-len(data) // _LANE) - 1).bit_length()
    wide = np.zeros(lanes * _LANE, np.uint8)  # zeros in front change nothing where the state is 0
    wide[-len(data) :] = np.frombuffer(data, np.uint8)
    wide[len(wide) - len(data) :][:4] ^= np.frombuffer(c.to_bytes(4, "little"), np.uint8)
    table, state, columns = np.array(CRC_TABLE, np.uint32), np.zeros(lanes, np.uint32), np.ascontiguousarray(wide.reshape(lanes, _LANE).T)
    for column in columns:
        state = table[(state ^ column) & 255] ^ (state >> 8)
    size = _LANE
    while len(state) > 1:
        state, size = _after(state[0::2], size) ^ state[1::2], 2 * size
    return int(state[0]) ^ U32


def mask_int(c: int) -> int:
    return ((c >> 15 | c << 17) + MASK_DELTA) & U32


def byte_values(x: Column) -> Column:
    """The bytes of a binary column as an array of integers."""
    digits = F.hex(x)
    n = F.octet_length(x)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))


def crc32c_rows(data: pa.Array) -> pa.Array:
    """CRC-32C of each value of a batch, null of null: short ones step side by side, byte by byte, longest first; long ones by lanes."""
    data = data.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1] or bytes(8), np.int64)[data.offset : data.offset + len(data) + 1]
    body = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    null = data.is_null().to_numpy(zero_copy_only=False)
    size, out, table = np.where(null, 0, np.diff(ends)), np.zeros(len(data), np.int64), np.array(CRC_TABLE, np.uint32)
    short = np.flatnonzero(size < 4 * _LANE)
    short = short[np.argsort(-size[short], kind="stable")]
    at, left, state = ends[short], -size[short], np.full(len(short), U32, np.uint32)
    for i in range(-left[0] if len(short) else 0):
        n = np.searchsorted(left, -i)
        state[:n] = table[(state[:n] ^ body[at[:n] + i]) & 255] ^ (state[:n] >> 8)
    out[short] = state ^ np.uint32(U32)
    for i in np.flatnonzero(size >= 4 * _LANE):
        out[i] = crc32c_bytes(body[ends[i] : ends[i + 1]].tobytes())
    return pa.array(out, mask=null)


def crc32c(x: Column) -> Column:
    """CRC-32C (Castagnoli) of a binary column, in Arrow batches; null of null."""

    def rows(data: pa.Array) -> pa.Array:
        return crc32c_rows(data)

    return F.arrow_udf(rows, LongType())(x)


def mask_crc(c: Column) -> Column:
    """Rotate right by 15 and add the mask constant, modulo 2^32."""
    turned = F.shiftright(c, 15).bitwiseOR(F.shiftleft(c, 17)).bitwiseAND(F.lit(U32))
    return (turned + F.lit(MASK_DELTA)).bitwiseAND(F.lit(U32))


def unmask_crc(m: Column) -> Column:
    turned = (m - F.lit(MASK_DELTA) + F.lit(1 << 32)).bitwiseAND(F.lit(U32))
    return F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15)).bitwiseAND(F.lit(U32))


def varint_len(x: Column) -> Column:
    """Bytes that a non-negative integer takes as a varint."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(x < F.lit(1 << (7 * n)), n).otherwise(out)
    return out


def _hex2(x: Column) -> Column:
    return F.lpad(F.hex(x.cast("bigint")), 2, "0")


def varint(x: Column) -> Column:
    """A non-negative integer as varint bytes."""
    x, n = x.cast("bigint"), varint_len(x)
    parts = []
    for i in range(9):
        low = F.shiftright(x, 7 * i).bitwiseAND(F.lit(127))
        parts.append(F.when(F.lit(i) < n, _hex2(F.when(F.lit(i) < n - 1, low + 128).otherwise(low))).otherwise(""))
    return F.unhex(F.concat(*parts))


def fixed32(x: Column) -> Column:
    return _little(x, 4)


def fixed64(x: Column) -> Column:
    return _little(x, 8)


def _little(x: Column, n: int) -> Column:
    return F.unhex(F.concat(*[_hex2(F.shiftrightunsigned(x.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))) for i in range(n)]))


def read_fixed(x: Column, n: int) -> Column:
    """Little-endian integer in the first ``n`` bytes; null if there are fewer."""
    total = F.lit(0).cast("bigint")
    for i in range(n):
        total = total + F.shiftleft(F.conv(F.hex(F.substring(x, i + 1, 1)), 16, 10).cast("bigint"), 8 * i)
    return F.when(F.octet_length(x) >= n, total)


def length_prefixed(x: Column) -> Column:
    return F.concat(varint(F.octet_length(x)), x)


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """Value and next offset; a varint that doesn't end within ten bytes or the data is corrupt."""
    n = 0
    for i in range(10):
        if at + i >= len(data):
            break
        b = data[at + i]
        n |= (b & 127) << (7 * i)
        if b < 128:
            return n, at + i + 1
    raise StoreError("Corruption", "bad varint")


def put_slice(x: bytes) -> bytes:
    return put_varint(len(x)) + x


def get_slice(data: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = get_varint(data, at)
    if at + n > len(data):
        raise StoreError("Corruption", "short slice")
    return data[at : at + n], at + n


def pack_key(key: Column, seq: Column, op: Column) -> Column:
    """The byte form of an internal key, for export only."""
    return F.concat(key, fixed64(F.shiftleft(seq.cast("bigint"), 8).bitwiseOR(op.cast("bigint"))))


def user_key(packed: Column) -> Column:
    """The user key in a packed internal key; null if the input is too short to be one."""
    n = F.octet_length(packed)
    return F.when(n >= 8, F.substr(packed, F.lit(1), n - 8))


STATUS = {
    # Result codes and their printed names.
    0: "OK",
    1: "NotFound",
    2: "Corruption",
    3: "Not implemented",
    4: "Invalid argument",
    5: "IO error",
}


def status_text(code: Column, message: Column) -> Column:
    """Printed form of a result code: its name, then the message if there is one."""
    name = F.lit("Unknown error")
    for n, text in STATUS.items():
        name = F.when(code == n, text).otherwise(name)
    said = F.when(F.length(message) > 0, message)
    return F.when(code == 0, name).otherwise(F.concat_ws(" : ", name, said))
