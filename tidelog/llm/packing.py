"""Packing of token sequences by the sum-of-squares rule.

A document's ids are cut into full windows and one remainder. Remainders go
into open windows online: each is placed into the fill level that least
increases the sum of squared counts of partially filled windows, which a level
array keeps. Windows left open at the end of a task are items of a next round,
on fewer tasks, so what stays partly filled does not grow with the tasks.
A window whose fill is a power of two needs no padding and counts as whole.
What no item fills in the end is cut anew to fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, give_back, is_space, keep

WINDOW = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"
#: Hashes of open windows' texts that may be sent to every task (16 bytes each); beyond, texts are shuffled to them.
SENT_PIECES = 200_000


#: Bytes that begin a unit after a space: all but white space, ``<`` and what may lead a wider space.
_BEGINS = ~(is_space(np.arange(256, dtype=np.uint8)) | np.isin(np.arange(256), (ord("<"), 0xC2, 0xE1, 0xE2, 0xE3)))


@lru_cache(maxsize=2)
def tokenizer(name: str):
    """The vocabulary's encoder.

    It is run from the rank file that comes with the ``tokenizers`` file: a
    call on a single unit is several times as fast there, and the ids are the
    same, which a test holds to that library on any text.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {SPECIAL: len(ranks)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of units that tokenize alone as they do in their text.

    A space before a character that is neither white space nor ``<`` always
    begins a pre-token. Characters led by C2 and E1-E3 may be white space, so
    none is assumed there. Text starts count as well.
    """
    cut = np.zeros(len(data) + 1, bool)
    spot = np.flatnonzero(data[:-1] == 0x20)
    cut[spot] = _BEGINS[data[spot + 1]]
    cut[np.maximum(offsets - 1, 0)] = False  # a text's last character has nothing after it
    cut[offsets] = True
    cut[-1] = False
    return np.flatnonzero(cut)


def distinct_units(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(distinct byte strings between the starts, which of them each is); the bytes themselves are compared."""
    ends = np.append(starts, len(data)).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


class Encoder:
    """Token ids of many texts: the distinct units of a chunk are encoded in one call, end to end.

    What a unit tokenizes to doesn't depend on its neighbours if it begins
    with a space and a character that isn't white space, so all such units may
    follow each other, and token lengths tell them apart again. Others, and
    those with the special token's text, are encoded one by one.
    """

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self._encoder = tokenizer(name)
        self._size = np.array([len(self._encoder.decode_single_token_bytes(i)) for i in range(self._encoder.n_vocab)], np.int64)

    def _alone(self, unit: bytes) -> np.ndarray:
        return np.array(self._encoder.encode(unit.decode("utf-8", "replace"), allowed_special="all"), np.uint32)

    def _ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of distinct units end to end, where each one's begin, their number)."""
        end = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
        raw = np.frombuffer(units.buffers()[2], np.uint8)
        plain = (np.diff(end) > 1) & (raw[end[:-1]] == 0x20)
        plain[plain] = _BEGINS[raw[end[:-1][plain] + 1]]
        plain &= ~pc.match_substring(units, SPECIAL).to_numpy(zero_copy_only=False)
        joined = units.filter(pa.array(plain)) if not plain.all() else units
        size, parts = np.zeros(len(units), np.int64), []
        if len(joined):
            at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
            try:
                text = bytes(memoryview(joined.buffers()[2])[at[0] : at[-1]]).decode()
            except UnicodeDecodeError:  # bytes that are no text: lengths would not be kept
                plain[:] = False
            else:
                parts.append(self._encoder.encode_to_numpy(text, disallowed_special=()))
                last = np.searchsorted(np.cumsum(self._size[parts[0]]), at[1:] - at[0]) + 1
                size[plain] = np.diff(last, prepend=0)
        rest = np.flatnonzero(~plain)
        alone = [self._alone(u) for u in units.take(pa.array(rest)).to_pylist()]
        size[rest] = [len(x) for x in alone]
        begin = np.empty(len(units), np.int64)
        begin[plain] = np.cumsum(size[plain]) - size[plain]
        begin[rest] = size[plain].sum() + np.cumsum(size[rest]) - size[rest]
        return np.concatenate([*parts, *alone] or [np.zeros(0, np.uint32)]), begin, size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids before each text)."""
        starts = unit_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        units, unit = distinct_units(data, starts)
        pool, begin, size = self._ids(units)
        n = size[unit]
        end = np.cumsum(n)
        ids = pool[np.repeat(begin[unit] - (end - n), n) + np.arange(end[-1])]
        return ids, np.concatenate([[0], end])[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=1)
def encoder_of(name: str) -> Encoder:
    """A worker's encoder, which its tasks share."""
    return Encoder(name)


#: Two hashes of a text, 96 bits, by which pieces find it again.
_SAME = ("h1", "h2")


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("h1", F.xxhash64(text)).withColumn("h2", F.crc32(F.encode(text, "UTF-8")))


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Every document's ids plus the end id, cut into full windows and a remainder: one row a piece, ids as checksums, texts as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for rows, data, offsets in chunks(batches):
            ids, before = encoder.encode(data, offsets)
            doc, start, length, crc, total = [], [], [], [], []
            end_id = np.array([END_ID], np.uint32).tobytes()
            for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
                raw = ids[a:b].astype("<u4").tobytes() + end_id
                n = b - a + 1
                for s in range(0, n, window):
                    doc.append(i)
                    start.append(s)
                    length.append(min(window, n - s))
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + window)]))
                    total.append(n)
            of = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c).take(of) for c in ("doc_id", *_SAME)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                ["doc_id", *_SAME, "start", "length", "ids_crc32", "doc_tokens"],
            )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _hashed(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, h1 bigint, h2 bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


class SumOfSquares:
    """Online packing into windows of one size; open windows wait by fill level."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.free = np.ones(window + 1, np.int64)  # 0 where a fill costs nothing
        for level in (0, window, *(1 << i for i in range(window.bit_length()))):
            if level <= window:
                self.free[level] = 0
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window number, offset) of an item of 1 to ``window`` tokens."""
        top = self.window - size
        was, now = self.count[: top + 1] * self.free[: top + 1], self.count[size:] * self.free[size:]
        cost = (2 * now + 1) * self.free[size:] - (2 * was - 1) * self.free[: top + 1]
        usable = self.count[: top + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        # Of equal costs the fullest window wins.
        level = top - int(np.argmin(cost[::-1]))
        if level:
            bin_ = self.open[level].pop()
            self.count[level] -= 1
        else:
            bin_, self.bins = self.bins, self.bins + 1
        if level + size < self.window:
            self.open[level + size].append(bin_)
            self.count[level + size] += 1
        return bin_, level


def pack_items(items: DataFrame, tasks: int, window: int = WINDOW, round_: int = 0) -> DataFrame:
    """``items(item, length)``: one row each with ``bin`` (round, task, number) and ``offset``; each task packs its own.

    Items are in a fixed order in their task, so a task that runs again places them alike.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, task = SumOfSquares(window), TaskContext.get().partitionId()
        for batch in batches:
            spots = [packer.place(n) for n in batch.column("length").to_pylist()]
            number = np.array([b for b, _ in spots], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("length"), pa.array((round_ << 58) + (task << 36) + number, pa.int64()), pa.array([o for _, o in spots], pa.int64())], ["item", "length", "bin", "offset"]
            )

    dealt = items.select("item", "length").repartition(tasks, F.xxhash64("item")).sortWithinPartitions("item")
    return dealt.mapInArrow(run, "item bigint, length bigint, bin bigint, offset bigint")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = "byte_bpe_50k.json", items_per_task: int = 20_000, rounds: int = 2) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. An empty or null text is its end id alone; repeated
    rows, and rows without an id, are packed each; texts of any length are
    whole; an empty table gives an empty one. ``rounds`` more
    passes join windows that stayed partly filled, and the last ones are cut
    anew, so that only documents there have a second cut.
    """
    cut = keep(pieces(docs, window, vocabulary).withColumn("item", F.monotonically_increasing_id()))
    rest = cut.where(F.col("length") < window).select("item", "length")
    n = rest.count()
    placed = keep(pack_items(rest, max(1, -(-n // items_per_task)), window))
    for i in range(rounds):
        fill = placed.groupBy("bin").agg(F.sum("length").cast("bigint").alias("length"))
        open_ = fill.where((F.col("length") < window) & (F.bit_count("length") > 1)).withColumnRenamed("bin", "item")
        left = open_.count()
        if left < 2:
            break
        again = pack_items(open_, max(1, -(-left // items_per_task)), window, i + 1).select(F.col("item").alias("bin"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
        moved = placed.join(again, "bin", "left")
        placed = keep(moved.select("item", "length", F.coalesce("_to", "bin").alias("bin"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset")), placed)
    fill = placed.groupBy("bin").agg(F.sum("length").cast("bigint").alias("length"))
    open_ = keep(fill.where((F.col("length") < window) & (F.bit_count("length") > 1)).select("bin"))
    closed = keep(_closed(docs, cut, placed, open_, window, vocabulary))
    spot = placed.join(open_.withColumn("open", F.lit(True)), "bin", "left").select("item", "bin", "offset", "open")
    joined = cut.join(spot, "item", "left").where("open IS NULL")
    full = F.col("bin").isNull()
    sequence = F.when(full, F.col("item") * 2).otherwise(F.col("bin") * 2 + 1)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    whole = joined.withColumn("sequence_id", sequence).withColumn("offset", F.when(full, F.lit(0)).otherwise(F.col("offset")).cast("bigint"))
    return whole.select(*columns).unionByName(closed.select(*columns))


def _spans(begin: int, end: int, total: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, window number, offset in it) of a piece of a stream of ``total`` ids cut into full windows and then powers of two."""
    full = total // window * window
    while begin < end:
        if begin < full:
            number, first = begin // window, begin // window * window
            last = first + window
        else:
            number, first, left = full // window, full, total - full
            size = 1 << left.bit_length() - 1
            while begin >= first + size:
                first, left, number = first + size, left - size, number + 1
                size = 1 << left.bit_length() - 1
            last = first + size
        to = min(end, last)
        yield begin, to, number, begin - first
        begin = to


def _closed(docs: DataFrame, cut: DataFrame, placed: DataFrame, open_: DataFrame, window: int, vocabulary: str) -> DataFrame:
    """Pieces of windows that no item has filled, cut again so that nothing is padded.

    Their number doesn't grow with the documents but with the tasks of the
    last round: beside a large corpus they are few, in a small one they may be
    most of it. In groups of some 4,000 their pieces are a stream, cut into
    full windows and what remains into powers of two. Their texts, each
    distinct one once, are tokenized again for the new pieces' checksums.
    """
    n = open_.count()
    groups = max(1, -(-n // 4096))
    here = placed.join(open_, "bin", "left_semi").join(cut.select("item", "doc_id", *_SAME, "start", "doc_tokens"), "item").withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups)))
    run = Window.partitionBy("g").orderBy("bin", "offset")
    stream = keep(here.withColumn("end", F.sum("length").over(run)).withColumn("total", F.sum("length").over(Window.partitionBy("g"))))
    wanted = stream.select(*_SAME).distinct()
    wanted = F.broadcast(wanted) if stream.count() <= SENT_PIECES else wanted
    texts = _hashed(docs.select(F.coalesce("text", F.lit("")).alias("text"))).join(wanted, list(_SAME), "left_semi").groupBy(*_SAME).agg(F.first("text").alias("text"))
    names = ["g", "start", "length", "doc_tokens", "end", "total"]
    found = stream.join(texts, list(_SAME)).select("doc_id", "text", *names)

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        end_id = np.array([END_ID], np.uint32)
        for rows, data, offsets in chunks(batches):
            ids, before = encoder.encode(data, offsets)
            out = []
            for i, (g, start, length, tokens, end, total) in enumerate(zip(*(rows.column(c).to_pylist() for c in names))):
                own = np.concatenate([ids[before[i] : before[i + 1]], end_id]).astype("<u4")
                if len(own) != tokens:
                    raise ValueError("two texts share their hashes")
                for a, b, number, offset in _spans(end - length, end, total, window):
                    s = start + a - (end - length)
                    out.append((i, s, b - a, zlib.crc32(own[s : s + b - a].tobytes()), tokens, -1 - ((g << 36) + number), offset))
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run_, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
