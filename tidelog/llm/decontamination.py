"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact similarity.

Windows of the items' sizes slide over each document. A window's fingerprint
is the sign of its shingles' summed random signs; sums come from packed running
totals. Multi-index tables on blocks of the fingerprint give, by the pigeonhole
principle, every item within the radius; the exact weighted similarity of the
shingle multisets decides. Windows at the end of the words are as short as
what is left there. The items are indexed by tasks, in parts that are files of
the shared folder; the documents are read once, whatever the number of items.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import chunks, give_back, hash_segments, keep, lowered, mix, shared_folder, word_bounds
from tidelog.llm.elias_fano import load, store

WIDTH = 5
THRESHOLD = 0.8
BITS = 128
#: Bits in which a fingerprint may differ; shingle sets at the threshold differ in 20 on average, those of other texts in 64 +- 6.
RADIUS = 38
BLOCKS = 8
#: Sizes of windows differ by this factor, and windows begin every size / STRIDE words.
RATIO = 1.2
STRIDE = 6

#: Text bytes at a time.
CHUNK = 2 << 20

def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, and the number before each text; ASCII characters that are neither letters nor digits separate them."""
    low = lowered(data)
    starts, ends, before = word_bounds((low >= 128) | ((low - np.uint8(97)) < 26) | ((low - np.uint8(48)) < 10), offsets)
    return hash_segments(low, starts, ends), before


def running_shingles(word: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The shingle that begins at each word; there are width - 1 fewer than words."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(31) + word[i : i + n] + np.uint64(i + 1))
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of shingle multisets."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def _spread(lane: int) -> np.ndarray:
    """The eight bits of each byte value in lanes of a 64-bit word (the low ones where lanes are wider)."""
    per = 64 // lane
    out = np.zeros((256, -(-8 // per)), np.uint64)
    for v in range(256):
        for b in range(8):
            if v >> b & 1:
                out[v, b // per] |= np.uint64(1 << (lane * (b % per)))
    return out


def _votes(shingle: np.ndarray, lane: int) -> Iterator[np.ndarray]:
    """Running totals of the shingles' bits, packed in lanes, eight bits at a time."""
    table = _spread(lane)
    for half in range(BITS // 64):
        sign = mix(shingle + np.uint64((half + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            for j in range(table.shape[1]):
                total = np.zeros(len(shingle) + 1, np.uint64)
                np.cumsum(table[:, j][sign[:, byte]], out=total[1:])
                yield total


def fingerprints(shingle: np.ndarray, windows: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each (size in shingles, stride): fingerprints of the windows, as two 64-bit words each; the last ones end with the shingles."""
    lane = next(x for x in (8, 16, 32) if max((w for w, _ in windows), default=1) < 1 << (x - 1))
    per = 64 // lane
    out = [np.zeros((BITS // 64, -(-len(shingle) // s)), np.uint64) for _, s in windows]
    top = np.uint64(sum(1 << (lane * i + lane - 1) for i in range(per)))
    each = np.uint64(sum(1 << (lane * i) for i in range(per)))
    ends, bias = [], []
    for (w, s), got in zip(windows, out):
        start = np.arange(got.shape[1]) * s
        ends.append(np.minimum(start + w, len(shingle)))
        bias.append((np.uint64(1 << (lane - 1)) - ((ends[-1] - start) // 2 + 1).astype(np.uint64)) * each)
    space = np.empty((2, max((g.shape[1] for g in out), default=0)), np.uint64)
    step = min(8, per)
    # Multiplied by this, top bits of eight-bit lanes come together in the highest byte.
    gather = np.uint64(0x0002040810204081)
    for k, total in enumerate(_votes(shingle, lane)):
        word, base = divmod(k * step, 64)
        for (w, s), got, end, half in zip(windows, out, ends, bias):
            m = got.shape[1]
            if not m:
                continue
            # A lane's top bit is set where ones are over half of the window.
            high = np.subtract(total.take(end), total[:-1:s], out=space[0, :m])
            high += half
            high &= top
            if lane == 8:
                high *= gather
                high >>= np.uint64(56)
                high <<= np.uint64(base)
                got[word] |= high
            else:
                for i in range(per):
                    bit = np.right_shift(high, np.uint64(lane * i + lane - 1), out=space[1, :m])
                    bit &= np.uint64(1)
                    got[word] |= bit << np.uint64(base + i)
    return out


class HammingIndex:
    """All of some fingerprints within a radius, by tables of blocks.

    If two fingerprints differ in at most r bits, then in one of b blocks they
    differ in at most r // b. For each block a table says which items are that
    near to each of its values, as a bit set.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS, tables: np.ndarray | None = None):
        self.prints, self.radius = prints, radius
        width = BITS // blocks
        self.shift = [(b * width // 64, np.uint64(b * width % 64)) for b in range(blocks)]
        self.mask = np.uint64((1 << width) - 1)
        sets = -(-prints.shape[1] // 64)
        if tables is not None:
            self.tables = tables.reshape(blocks, sets, 1 << width)
            return
        value = np.arange(1 << width, dtype=np.uint64)
        self.tables = np.zeros((blocks, sets, 1 << width), np.uint64)
        for b, (word, by) in enumerate(self.shift):
            for i, p in enumerate(prints[word] >> by & self.mask):
                near = np.bitwise_count(value ^ p) <= radius // blocks
                self.tables[b, i // 64] |= near.astype(np.uint64) << np.uint64(i % 64)

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs within the radius."""
        found_q, found_i = [], []
        keys = [(query[word] >> by & self.mask).astype(np.int64) for word, by in self.shift]
        for g in range(self.tables.shape[1]):
            near = self.tables[0, g].take(keys[0])
            for b in range(1, len(keys)):
                near |= self.tables[b, g].take(keys[b])
            for i in range(64 * g, min(64 * g + 64, self.prints.shape[1])):
                q = np.flatnonzero(near & np.uint64(1 << (i - 64 * g)))
                apart = sum(np.bitwise_count(query[w].take(q) ^ self.prints[w, i]) for w in range(BITS // 64))
                q = q[apart <= self.radius]
                found_q.append(q)
                found_i.append(np.full(len(q), i))
        return np.concatenate(found_q or [np.zeros(0, np.int64)]), np.concatenate(found_i or [np.zeros(0, np.int64)])


def similarities(bag: Counter, run: list[int], n: int) -> Iterator[float]:
    """Weighted similarity of a bag with each window of ``n`` shingles of a run (the whole run if it is shorter), by what enters and leaves."""
    size, seen, both = sum(bag.values()), Counter(), 0
    for i, new in enumerate(run):
        both += seen[new] < bag.get(new, 0)
        seen[new] += 1
        if i >= n:
            old = run[i - n]
            seen[old] -= 1
            both -= seen[old] < bag.get(old, 0)
        if i >= min(n, len(run)) - 1:
            yield both / (size + min(n, len(run)) - both)


class Items:
    """Benchmark items by window size, with their fingerprint index; kept as plain arrays, which may be mapped."""

    def __init__(self, items: list[tuple[object, str | None]]):
        ids, words = [], []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            word, _ = plain_words(raw, np.array([0, len(raw)]))
            if len(word):
                ids.append(item)
                words.append(word)
        size = {i: len(w) - WIDTH + 1 for i, w in enumerate(words) if len(w) >= WIDTH}
        steps = {i: round(math.log(n) / math.log(RATIO)) for i, n in size.items()}
        arrays = {"ids": np.frombuffer(pickle.dumps(ids), np.uint8), "words": np.concatenate(words or [np.zeros(0, np.uint64)]), "ends": np.cumsum([0, *map(len, words)])}
        for k in sorted(set(steps.values())):
            mine = [i for i in steps if steps[i] == k]
            prints = np.concatenate([fingerprints(running_shingles(words[i]), [(size[i], size[i])])[0] for i in mine], axis=1)
            w = max(1, round(RATIO**k))
            arrays |= {f"{w}.items": np.array(mine), f"{w}.prints": prints.ravel(), f"{w}.tables": HammingIndex(prints).tables.ravel()}
        self._use(arrays)

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> "Items":
        out = cls.__new__(cls)
        out._use(arrays)
        return out

    def _use(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays, self.ids, self._bags = arrays, pickle.loads(arrays["ids"].tobytes()), {}
        ends = arrays["ends"].tolist()
        self.words = [arrays["words"][a:b] for a, b in zip(ends[:-1], ends[1:])]
        self.short = [i for i, w in enumerate(self.words) if len(w) < WIDTH]
        self.groups = []
        for name in arrays:
            if name.endswith(".items"):
                w = name.split(".")[0]
                index = HammingIndex(arrays[f"{w}.prints"].reshape(BITS // 64, -1), tables=arrays[f"{w}.tables"])
                self.groups.append((int(w), stride_of(int(w)), arrays[name], index))

    def bag(self, item: int) -> Counter:
        if item not in self._bags:
            self._bags[item] = Counter(_shingles_of(self.words[item]))
        return self._bags[item]

    def verify(self, item: int, shingle: list[int], slack: int, threshold: float) -> tuple[float, int]:
        """(best similarity, its place) of item-sized windows in a run of shingles of one text."""
        bag, n = self.bag(item), len(self.words[item]) - WIDTH + 1
        best = (0.0, -1)
        if sum(x in bag for x in shingle) < threshold * n / (1 + slack):
            return best
        for at, got in enumerate(similarities(bag, shingle, n)):
            if got > best[0]:
                best = (got, at)
        return best


def stride_of(w: int) -> int:
    return max(1, round(w / STRIDE))


def _shingles_of(word: np.ndarray) -> list[int]:
    if len(word) >= WIDTH:
        return running_shingles(word).tolist()
    h = np.zeros(1, np.uint64)
    for i, w in enumerate(word):
        h = mix(h * np.uint64(37) + w + np.uint64(i + 1))
    return h.tolist()


def windows_of(word: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The shingles of a chunk of texts, and the fingerprints of its windows of each size."""
    shingle = running_shingles(word)
    return shingle, dict(zip(sizes, fingerprints(shingle, [(w, stride_of(w)) for w in sizes]))) if sizes else {}


def matches(items: Items, word: np.ndarray, before: np.ndarray, threshold: float = THRESHOLD, made: tuple | None = None) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) of the best window of each text and item at or over the threshold."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    shingle, prints = made or windows_of(word, [w for w, *_ in items.groups])
    for w, stride, mine, index in items.groups:
        query = prints[w]
        spots, which = index.search(query)
        first, last = spots * stride, np.minimum(spots * stride + w + WIDTH - 2, len(word) - 1)
        text = {k: np.searchsorted(before, p, "right") - 1 for k, p in (("a", first), ("b", (first + last) // 2), ("c", last))}
        for at, i, *texts in zip(first.tolist(), mine[which].tolist(), *(t.tolist() for t in text.values())):
            n = len(items.words[i]) - WIDTH + 1
            slack = stride + n // 8 + 1
            guess = at + (w - n) // 2
            for t in set(texts):
                # The shingles of this text alone that windows beginning near the guess may have.
                low, high = int(before[t]), int(before[t + 1]) - WIDTH + 1
                lo = max(low, min(guess - slack, high - n))
                hi = min(high, max(guess + slack, low) + n)
                if hi > lo and best.get((t, i), (0.0, 0))[0] < 1:
                    got, spot = items.verify(i, shingle[lo:hi].tolist(), 0.25, threshold)
                    if got >= threshold and got > best.get((t, i), (0.0, 0))[0]:
                        best[t, i] = (got, lo + spot)
    for i in items.short:  # an item of fewer words than a shingle is found as it stands
        n = len(items.words[i])
        same = np.ones(max(0, len(word) - n + 1), bool)
        for k in range(n):
            same &= word[k : k + len(same)] == items.words[i][k]
        for at in np.flatnonzero(same).tolist():
            t = int(np.searchsorted(before, at, "right")) - 1
            if at + n <= before[t + 1]:
                best.setdefault((t, i), (1.0, at))
    return [(t, i, s, at - int(before[t]), len(items.words[i])) for (t, i), (s, at) in sorted(best.items())]


#: Parts of an index that a worker keeps open.
_OPEN: OrderedDict[str, Items] = OrderedDict()
_MOST_OPEN = 4


class Index:
    """The parts of a benchmark's index, files of the shared folder; travels to tasks as their names."""

    def __init__(self, folder: str, names: list[str], sizes: list[int]):
        self.folder, self.names, self.sizes = folder, names, sizes

    @classmethod
    def build(cls, benchmark: DataFrame, items_per_part: int = 1000) -> "Index":
        """Index all items, each part in a task. Of the benchmark, only part names and window sizes reach the driver."""
        folder = shared_folder(benchmark.sparkSession) + "-items"
        rows = benchmark.select("item_id", "text")
        parts = max(1, -(-rows.count() // items_per_part))

        def write(table: pa.Table) -> pa.Table:
            items = Items(list(zip(*(table.column(c).to_pylist() for c in ("item_id", "text")))))
            return pa.table({"name": [store(folder, "items", items.arrays)], "sizes": pa.array([[w for w, *_ in items.groups]], pa.list_(pa.int64()))})

        made = keep(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))).groupBy("part").applyInArrow(write, "name string, sizes array<bigint>")).collect()
        return cls(folder, sorted(r.name for r in made), sorted({w for r in made for w in r.sizes}))

    def parts(self) -> Iterator[Items]:
        for name in self.names:
            if name not in _OPEN:
                _OPEN[name] = Items.of(load(self.folder, name))
                while len(_OPEN) > _MOST_OPEN:
                    _OPEN.popitem(last=False)
            else:
                _OPEN.move_to_end(name)
            yield _OPEN[name]

    def search(self, batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[Items, list]]]]:
        """Slices of rows with the matches of each part of the index in them; their windows are made once."""
        for rows, data, offsets in chunks(batches, limit=CHUNK):
            word, before = plain_words(data, offsets)
            made = windows_of(word, self.sizes)
            yield rows, ((items, matches(items, word, before, threshold, made)) for items in self.parts())
        give_back()


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, items_per_pass: int = 1000) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words``: one row for each document and item that it contains.

    Words are lower-cased, without ASCII punctuation, so that marks around a
    passage hide nothing. The documents are read once; a worker maps the
    benchmark's index (64 KB an item) in parts of ``items_per_pass`` items and
    goes through all parts for each chunk of text. Null and empty texts and
    items match nothing; an item of fewer than five words must occur whole.
    Texts and items of any length are whole. Repeated rows, and rows without
    an id, give results each. An empty table of either kind gives an empty one.
    """
    index = Index.build(benchmark, items_per_pass)
    doc_type, item_type = (df.schema[c].dataType for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    arrow = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, by_items in index.search(batches, threshold):
            for items, found in by_items:
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())),
                        pa.array([items.ids[x[1]] for x in found], arrow),
                        *(pa.array([x[k] for x in found], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))),
                    ],
                    ["doc_id", "item_id", "similarity", "start_word", "n_words"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, similarity double, start_word bigint, n_words bigint")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, items_per_pass: int = 1000) -> DataFrame:
    """Rows of ``docs`` without a benchmark item in them; columns stay, whatever their names. Each row is judged alone, whatever its id."""
    index = Index.build(benchmark, items_per_pass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, by_items in index.search(batches, threshold):
            left = np.ones(part.num_rows, bool)
            for _, found in by_items:
                left[[x[0] for x in found]] = False
            yield part.filter(pa.array(left))

    return docs.mapInArrow(run, docs.schema)
