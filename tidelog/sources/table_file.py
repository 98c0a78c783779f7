"""The binary sorted-table file: prefix-coded blocks, index, filter, footer; as a sink and a source."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelog.functions.codec import crc32c_bytes, get_varint, mask_int, put_varint
from tidelog.functions.filters import build, encode_block, fnv1_bytes
from tidelog.schema import FILTER_RANGE, RESTART_INTERVAL, StoreError

# Fixed values of the format.
MAGIC = 0xDB4775248B80FB57
FOOTER_BYTES = 48
TRAILER_BYTES = 5
PLAIN, SNAPPY = 0, 1
BLOCK_BYTES = 4096


@dataclass(frozen=True)
class Handle:
    """Place of a block in its file."""

    offset: int
    size: int

    def encode(self) -> bytes:
        return put_varint(self.offset) + put_varint(self.size)

    @staticmethod
    def decode(data: bytes, at: int = 0) -> tuple["Handle", int]:
        offset, at = get_varint(data, at)
        size, at = get_varint(data, at)
        return Handle(offset, size), at


def encode_footer(meta: Handle, index: Handle) -> bytes:
    return (meta.encode() + index.encode()).ljust(FOOTER_BYTES - 8, b"\0") + struct.pack("<Q", MAGIC)


def decode_footer(data: bytes) -> tuple[Handle, Handle]:
    if len(data) < FOOTER_BYTES or struct.unpack("<Q", data[-8:])[0] != MAGIC:
        raise StoreError("Corruption", "not a table file")
    meta, at = Handle.decode(data, len(data) - FOOTER_BYTES)
    return meta, Handle.decode(data, at)[0]


def encode_entries(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    """A block: keys as deltas to the one before, whole at every restart, then the restarts."""
    out, restarts, before = bytearray(), [], b""
    for i, (key, value) in enumerate(entries):
        shared = 0
        if i % RESTART_INTERVAL == 0:
            restarts.append(len(out))
        else:
            shared = next((j for j, (x, y) in enumerate(zip(before, key)) if x != y), min(len(before), len(key)))
        out += put_varint(shared) + put_varint(len(key) - shared) + put_varint(len(value)) + key[shared:] + value
        before = key
    restarts = restarts or [0]
    return bytes(out) + struct.pack(f"<{len(restarts) + 1}I", *restarts, len(restarts))


def decode_entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    if len(block) < 4:
        raise StoreError("Corruption", "short block")
    end = len(block) - 4 * (1 + struct.unpack("<I", block[-4:])[0])
    at, key = 0, b""
    if end < 0:
        raise StoreError("Corruption", "bad restarts")
    while at < end:
        shared, at = get_varint(block, at)
        rest, at = get_varint(block, at)
        size, at = get_varint(block, at)
        if shared > len(key) or at + rest + size > end:
            raise StoreError("Corruption", "bad entry")
        key = key[:shared] + block[at : at + rest]
        yield key, block[at + rest : at + rest + size]
        at += rest + size


def internal_key(k: bytes, seq: int, op: int) -> bytes:
    return k + struct.pack("<Q", seq << 8 | op)


def encode_table(rows: Iterable[tuple[bytes, int, int, bytes | None]], bits_per_key: int = 10, compression: int = PLAIN, block_bytes: int = BLOCK_BYTES) -> bytes:
    """A whole file of rows in version order; rows out of order are refused."""
    out, index, filters, last = bytearray(), [], {}, None
    pending: list[tuple[bytes, bytes]] = []
    size = 0

    def write(block: bytes, kind: int) -> Handle:
        if kind == SNAPPY:
            block = pa.compress(block, codec="snappy", asbytes=True)
        handle = Handle(len(out), len(block))
        out.extend(block + bytes([kind]) + struct.pack("<I", mask_int(crc32c_bytes(block + bytes([kind])))))
        return handle

    def flush() -> None:
        if pending:
            slot = filters.setdefault(len(out) // FILTER_RANGE, [])
            slot += dict.fromkeys(key[:-8] for key, _ in pending)
            index.append((pending[-1][0], write(encode_entries(pending), compression).encode()))
            pending.clear()

    for k, seq, op, v in rows:
        order = (k, -seq, -op)
        if last is not None and order <= last:
            raise StoreError("InvalidArgument", "rows are not in version order")
        last = order
        pending.append((internal_key(k, seq, op), v or b""))
        size += len(k) + len(v or b"") + 16
        if size >= block_bytes:
            flush()
            size = 0
    flush()
    block = encode_block({slot: build([fnv1_bytes(k) for k in keys], bits_per_key) for slot, keys in filters.items()})
    meta = write(encode_entries([(b"filter.fnv1", write(block, PLAIN).encode())]), PLAIN)
    foot = encode_footer(meta, write(encode_entries(index), PLAIN))
    return bytes(out) + foot


def read_block(data: bytes, handle: Handle, verify: bool = True) -> bytes:
    """A block's contents. A checksum of zero was never written and is not held against it."""
    end = handle.offset + handle.size
    if end + TRAILER_BYTES > len(data):
        raise StoreError("Corruption", "block is cut short")
    block, kind, crc = data[handle.offset : end], data[end], struct.unpack_from("<I", data, end + 1)[0]
    if verify and crc not in (0, mask_int(crc32c_bytes(block + bytes([kind])))):
        raise StoreError("Corruption", "bad block checksum")
    if kind == SNAPPY:
        size, _ = get_varint(block)
        return pa.decompress(block, decompressed_size=size, codec="snappy", asbytes=True)
    if kind != PLAIN:
        raise StoreError("Corruption", "unknown block type")
    return block


def decode_table(data: bytes, verify: bool = True) -> Iterator[tuple[bytes, int, int, bytes | None]]:
    _, index = decode_footer(data)
    for _, place in decode_entries(read_block(data, index, verify)):
        for key, value in decode_entries(read_block(data, Handle.decode(place)[0], verify)):
            if len(key) < 8:
                raise StoreError("Corruption", "short key")
            packed = struct.unpack("<Q", key[-8:])[0]
            yield key[:-8], packed >> 8, packed & 255, value if packed & 255 else None


def read_tables(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Table files to ``(path, status, k, seq, op, v)``; a corrupt file ends with its status on each of its rows."""
    return decode_tables(spark.read.format("binaryFile").load(path).select("path", "content"), verify)


def decode_tables(files: DataFrame, verify: bool = True) -> DataFrame:
    """As ``read_tables``, of ``files(path, content)``."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows, status = [], "OK"
                try:
                    for r in decode_table(bytes(content), verify):
                        rows.append(r)
                except StoreError as e:
                    status = e.code
                    rows = rows or [(None, None, None, None)]
                out = pd.DataFrame(rows, columns=["k", "seq", "op", "v"]).astype({"seq": "Int64", "op": "Int32"})
                out.insert(0, "status", status)
                out.insert(0, "path", name)
                yield out

    return files.mapInPandas(decode, "path string, status string, k binary, seq bigint, op int, v binary")


def encode_tables(rows: DataFrame, bits_per_key: int = 10, compression: int = PLAIN) -> DataFrame:
    """``rows(path, k, seq, op, v)`` to ``(path, content)``: the rows of a path are one table file, in version order."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        versions = sorted(((bytes(k), int(s), int(o), None if v is None else bytes(v)) for k, s, o, v in zip(pdf["k"], pdf["seq"], pdf["op"], pdf["v"])), key=lambda r: (r[0], -r[1], -r[2]))
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [encode_table(versions, bits_per_key, compression)]})

    return rows.groupBy("path").applyInPandas(encode, "path string, content binary")
