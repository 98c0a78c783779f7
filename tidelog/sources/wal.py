"""The binary write-ahead log: framing of records, and batches within them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidelog.functions.codec import crc32c_bytes, get_slice, mask_int, put_slice
from tidelog.operators.batch import WriteBatch
from tidelog.schema import OP_PUT, WAL_BLOCK, WAL_HEADER, StoreError

# Fixed values of the framing.
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def fragments(record: bytes, at: int) -> Iterator[tuple[int, int, bytes]]:
    """(padding before, fragment type, payload) of a record written at file offset ``at``; none if it is empty."""
    left, begun = record, False
    while left:
        room = WAL_BLOCK - at % WAL_BLOCK
        pad = room if room < WAL_HEADER else 0
        room = (WAL_BLOCK if pad else room) - WAL_HEADER
        part, left = left[:room], left[room:]
        yield pad, (LAST if begun else FULL) if not left else MIDDLE if begun else FIRST, part
        begun, at = True, at + pad + WAL_HEADER + len(part)


def frame(records: list[bytes]) -> bytes:
    out = bytearray()
    for r in records:
        for pad, kind, part in fragments(r, len(out)):
            out += b"\0" * pad + struct.pack("<IHB", mask_int(crc32c_bytes(bytes([kind]) + part)), len(part), kind) + part
    return bytes(out)


def unframe(data: bytes, verify: bool = True) -> tuple[list[bytes], str]:
    """Records, and OK or Corruption. A torn tail ends the log cleanly; a bad checksum ends it as corrupt."""
    out, parts, at = [], None, 0
    while at < len(data):
        room = WAL_BLOCK - at % WAL_BLOCK
        if room < WAL_HEADER:
            at += room
            continue
        if at + WAL_HEADER > len(data):
            break
        crc, n, kind = struct.unpack_from("<IHB", data, at)
        body = data[at + WAL_HEADER : at + WAL_HEADER + n]
        if len(body) < n:
            break
        if verify and crc not in (mask_int(crc32c_bytes(bytes([kind]) + body)), mask_int(crc32c_bytes(body)) if kind == LAST else crc - 1):
            return out, "Corruption"
        if kind not in (FULL, FIRST, MIDDLE, LAST) or (parts is None) == (kind in (MIDDLE, LAST)):
            return out, "Corruption"
        parts = [*(parts or []), body]
        if kind in (FULL, LAST):
            out.append(b"".join(parts))
            parts = None
        at += WAL_HEADER + n
    return out, "OK"


def encode_batch(seq: int, batch: WriteBatch) -> bytes:
    out = bytearray(struct.pack("<QI", seq, len(batch)))
    for op, k, v in batch.ops:
        out += bytes([op]) + put_slice(k) + (put_slice(v) if op == OP_PUT else b"")
    return bytes(out)


def decode_batch(data: bytes) -> tuple[int, WriteBatch]:
    if len(data) < 12:
        raise StoreError("Corruption", "short batch")
    seq, count = struct.unpack_from("<QI", data)
    at, ops = 12, []
    while at < len(data):
        op, at = data[at], at + 1
        if op > OP_PUT:
            raise StoreError("Corruption", "unknown operation")
        k, at = get_slice(data, at)
        v = None
        if op == OP_PUT:
            v, at = get_slice(data, at)
        ops.append((op, k, v))
    if len(ops) != count:
        raise StoreError("Corruption", "wrong count")
    return seq, WriteBatch(ops)


def read_logs(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Log files to ``(path, status, k, seq, op, v)``, one file a task row; the status of a file is on each of its rows.

    A corrupt file without whole records gives one row of nulls with its status.
    """
    return decode_logs(spark.read.format("binaryFile").load(path).select("path", "content"), verify)


def decode_logs(files: DataFrame, verify: bool = True) -> DataFrame:
    """As ``read_logs``, of ``files(path, content)``."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                records, status = unframe(bytes(content), verify)
                rows = []
                for r in records:
                    try:
                        seq, batch = decode_batch(r)
                    except StoreError as e:
                        status = e.code
                        break
                    rows += [(k, seq + i, op, v) for i, (op, k, v) in enumerate(batch.ops)]
                if not rows and status != "OK":
                    rows = [(None, None, None, None)]
                out = pd.DataFrame(rows, columns=["k", "seq", "op", "v"]).astype({"seq": "Int64", "op": "Int32"})
                out.insert(0, "status", status)
                out.insert(0, "path", name)
                yield out

    return files.mapInPandas(decode, "path string, status string, k binary, seq bigint, op int, v binary")


def encode_logs(batches: DataFrame) -> DataFrame:
    """``batches(path, base_seq, ops)`` to ``(path, content)``: the batches of a path are one log, in order of their sequence.

    A log is as large as its writer lets it grow, so one task frames it.
    """

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        records = []
        for seq, ops in sorted(zip(pdf["base_seq"], pdf["ops"]), key=lambda r: r[0]):
            records.append(encode_batch(int(seq), WriteBatch((o["op"], bytes(o["k"]), None if o["v"] is None else bytes(o["v"])) for o in ops)))
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [frame(records)]})

    return batches.groupBy("path").applyInPandas(encode, "path string, content binary")
