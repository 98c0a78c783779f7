"""What the operators share: tables kept in the shared folder, text chunks, hashed segments."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
#: Segments of up to so many bytes are hashed block by block, longer ones all blocks at once.
_SHORT = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return data + ((data - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return (data == 0x20) | ((data - np.uint8(9)) < 5)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local session gets one here, and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.abspath("checkpoints"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tidelog-{uuid.uuid4().hex}"


def lean(spark: SparkSession, size: str = "8m") -> None:
    """Smaller Arrow batches than Spark's default: a batch lies in the executor's heap and again in each of its workers. A user's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB"):
        spark.conf.set(name, size)


def keep(df: DataFrame, *done: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and any executor can read it.

    ``done`` are kept tables that nothing needs once this one is written; their files go.
    """
    path = shared_folder(df.sparkSession)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept = path
    for table_ in done:
        forget(table_)
    return kept


def forget(kept: DataFrame) -> None:
    """Delete the files of a kept table that is no longer read."""
    jvm, path = kept.sparkSession.sparkContext._jvm, getattr(kept, "_kept", None)
    if path:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(kept.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def sent_if_few(ids: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Ids to be joined with texts: sent to every task if they are few (under 64 MB there); else the texts are shuffled to them."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> np.uint64(32))
    for _ in range(2):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, and what it holds is its executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A view of a text column's bytes and the offsets of its rows in it; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, raw = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``limit`` bytes of text: (rows, bytes of all texts end to end, their offsets).

    The bytes are a view of the batch. A null text counts as empty. A text
    longer than the limit is a slice of its own.
    """
    for batch in batches:
        data, total = _bytes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data[total[at] : total[end]], total[at : end + 1] - total[at]
            at = end
        del data
        give_back()


def _loads(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    word, by = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
    # Shifting by 64 is undefined: the rest is shifted in two steps.
    return words[word] >> by | (words[word + 1] << np.uint64(1)) << (np.uint64(63) - by)


def _keyed(words: np.ndarray, at: np.ndarray, left: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """Mixed blocks of up to eight bytes, each keyed with its number in its segment."""
    block = _loads(words, at)
    part = left < 8
    if part.any():
        block &= np.where(part, (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) << np.uint64(3))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
    return mix(block + (np.atleast_1d(number).astype(np.uint64) + np.uint64(1)) * _STEP)


def hash_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte segments.

    Blocks of eight bytes are mixed with their number before they are added
    up, so no structure inside a segment carries over to the sum: two segments
    meet with probability 2^-64, however alike or regular they are.
    """
    words = np.zeros((len(data) >> 3) + 2, np.uint64)
    words.view(np.uint8)[: len(data)] = data
    starts, size = np.asarray(starts, np.int64), np.asarray(ends - starts, np.int64)
    out = size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mine = np.flatnonzero(size > 0)
    for k in range(_SHORT // 8):
        if not len(mine):
            break
        out[mine] += _keyed(words, starts[mine] + 8 * k, size[mine] - 8 * k, k)
        mine = mine[size[mine] > 8 * (k + 1)]
    for at in range(0, len(mine), 1 << 16):
        long_ = mine[at : at + (1 << 16)]
        count = (size[long_] - _SHORT + 7) >> 3
        first = np.cumsum(count) - count
        number = np.arange(int(count.sum())) - np.repeat(first, count) + _SHORT // 8
        begin, left = np.repeat(starts[long_], count) + 8 * number, np.repeat(size[long_], count) - 8 * number
        out[long_] += np.add.reduceat(_keyed(words, begin, left, number), first)
    return mix(out)


def word_bounds(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, given which bytes belong to one, and the number of words before each text; a text's end also ends a word."""
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(word))]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the number of words before each text."""
    starts, ends, before = word_bounds(~is_space(data), offsets)
    return hash_segments(lowered(data), starts, ends), before


def shingles(word: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts (shorter texts: all words as one) and the number before each text; repeats stay."""
    n = np.diff(before)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_before = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    at = before[text] + (np.arange(out_before[-1]) - out_before[text])
    out = np.zeros(len(at), np.uint64)
    size = np.minimum(n, width)[text]
    for i in range(width):
        here = i < size
        out[here] = mix(out[here] * np.uint64(31) + word[at[here] + i] + np.uint64(i + 1))
    return out, out_before


def distinct_per_text(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and the number before each text."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((values, text)) if len(before) > 2 else np.argsort(values, kind="stable")
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return v[new], np.searchsorted(t[new], np.arange(len(before)))
