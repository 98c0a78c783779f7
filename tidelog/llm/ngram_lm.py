"""An interpolated n-gram model in Elias-Fano tries, learned and applied by shards.

Words are numbered by the order of their hashes. A node's successors are a
range of the next level, found by monotone pointers; inside a range, values
are relative to the context: words for bigrams, and for trigrams the place of
the last word among the successors of the middle one. Levels are files in the
shared folder, one a shard of first words, that scoring tasks map into memory.

P(w | u v) = a(u v w) + l(u v) (a(v w) + l(v) P(w)), where a is the discounted
share of a kept n-gram, l what is left of its context's mass, and P(w) the
add-0.1 unigram estimate; a and l are kept as 16-bit codes that round down.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, give_back, keep, mix, shared_folder, words
from tidelog.llm.elias_fano import EliasFano, load, named, part, store

ADD = 0.1
DISCOUNT = 0.75
#: Unless told otherwise, bigrams and trigrams of fewer training occurrences are left to the lower order; their mass goes there.
MIN_COUNT = 2
#: Text bytes of a shard, and the least number of shards.
SHARD_BYTES = 64 << 20
LEAST_SHARDS = 32
CHUNK = 8 << 20
#: Keys that a task gathers before it hands them on.
GATHER = 2_000_000
END = mix(np.array([0xE4D], np.uint64))[0]
_SCALE = 2048


def encode_share(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.ceil(-np.log2(np.clip(x, 1e-300, 1)) * _SCALE), 0, 65535).astype(np.uint16)


_SHARE = np.exp2(-np.arange(65536) / _SCALE)


def _planes(x: np.ndarray) -> bytes:
    """Sorted integers as byte planes of their differences, which the shuffle's codec makes small."""
    return np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel(), dtype=kind)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


class Shards:
    """Files of one kind by shard, opened when asked for."""

    def __init__(self, folder: str, names: dict[int, str], first: np.ndarray):
        self.folder, self.names, self.first = folder, names, first
        self._open: OrderedDict[int, dict] = OrderedDict()

    def arrays(self, shard: int) -> dict[str, np.ndarray] | None:
        if shard not in self.names:
            return None
        if shard not in self._open:
            arrays = load(self.folder, self.names[shard])
            sequences = {k.split(".")[0] for k in arrays if "." in k}
            self._open[shard] = {**arrays, **{s: EliasFano.of(part(arrays, s)) for s in sequences}}
            if len(self._open) > 256:
                self._open.popitem(last=False)
        else:
            self._open.move_to_end(shard)
        return self._open[shard]

    def split(self, ids: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Runs of sorted numbers by the shard that holds them."""
        at = np.searchsorted(ids, self.first)
        for shard, (a, b) in enumerate(zip(at.tolist(), [*at[1:].tolist(), len(ids)])):
            if b > a:
                yield shard, slice(a, b)

    def __getstate__(self):
        return {"folder": self.folder, "names": self.names, "first": self.first, "_open": OrderedDict()}


class Model:
    """The levels of a trained model; travels to tasks as names and counts alone."""

    def __init__(self, bits: int, unigrams: Shards, tokens: int, types: int):
        self.bits, self.unigrams, self.tokens, self.types = bits, unigrams, tokens, types
        self.bigrams: Shards | None = None
        self.trigrams: Shards | None = None
        #: Bits of a place among the successors of a word, one value of which is free.
        self.rel = 1

    def numbers(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, training count) of sorted distinct word hashes."""
        number, count = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64)
        shard = (word >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.searchsorted(shard, np.arange((1 << self.bits) + 1))
        for s in np.unique(shard).tolist():
            level = self.unigrams.arrays(s)
            if level is not None:
                run = slice(at[s], at[s + 1])
                place, known = level["words"].successor(word[run] & np.uint64((1 << 64 - self.bits) - 1))
                number[run][known] = self.unigrams.first[s] + place[known]
                count[run][known] = level["count"][place[known]]
        return number, count

    def chances(self, number: np.ndarray) -> np.ndarray:
        """Unigram estimates of word numbers; -1 is a word that isn't known."""
        first, back = distinct(np.maximum(number, -1) + 1)
        own = number[first].astype(np.int64)
        count, skip = np.zeros(len(own), np.int64), int(len(own) > 0 and own[0] < 0)
        for shard, run in self.unigrams.split(own[skip:]):
            count[skip:][run] = self.unigrams.arrays(shard)["count"][own[skip:][run] - self.unigrams.first[shard]]
        return ((count + ADD) / (self.tokens + ADD * (self.types + 1)))[back]

    def successors(self, shards: Shards, starts: np.ndarray, context: np.ndarray, value: np.ndarray):
        """For pairs sorted by context: (place in its level or -1, place in its context, share, what the context leaves).

        ``starts`` are the first contexts of the shards.
        """
        n = len(context)
        node, relative = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        share, rest = np.zeros(n), np.ones(n)
        at = np.searchsorted(context, starts)
        for s, (a, b) in enumerate(zip(at.tolist(), [*at[1:].tolist(), n])):
            level = shards.arrays(s) if b > a else None
            if level is None:
                continue
            run = np.diff(context[a:b], prepend=-1) != 0
            own, inverse = context[a:b][run] - starts[s], np.cumsum(run) - 1
            inside = own < level["pointer"].n - 1
            own = np.where(inside, own, 0)
            low, high = level["pointer"].ranges(own)
            high = np.where(inside, high, low)
            base = np.zeros(len(own), np.uint64)
            base[low > 0] = level["next"].access(low[low > 0] - 1)
            some = np.flatnonzero((high > low)[inverse])
            where = inverse[some]
            target = base[where] + value[a:b][some].astype(np.uint64) + np.uint64(1)
            place, known = level["next"].successor(np.minimum(target, np.uint64(int(level["span"][0]) - 1)))
            known &= (place >= low[where]) & (place < high[where]) & (target < np.uint64(int(level["span"][0])))
            rest[a + some] = _SHARE[level["rest"][own[where]]]
            hit, place = a + some[known], place[known]
            node[hit] = shards.first[s] + place
            relative[hit] = place - low[where[known]]
            share[hit] = _SHARE[level["share"][place]]
        return node, relative, share, rest

    def bigram(self, context: np.ndarray, word: np.ndarray):
        return self.successors(self.bigrams, self.unigrams.first, context, word)

    def trigram(self, node: np.ndarray, relative: np.ndarray):
        return self.successors(self.trigrams, self.bigrams.first, node, relative)


def tokens(rows_data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and the number before each text."""
    word, before = words(rows_data, offsets)
    out_before = before + np.arange(len(before))
    out = np.full(out_before[-1], END, np.uint64)
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    out[np.arange(len(word)) + text] = word
    return out, out_before


def _pairs(number: np.ndarray, before: np.ndarray, start: int) -> np.ndarray:
    """The number before each token; ``start`` at the head of a text."""
    left = np.empty(len(number), np.int64)
    left[1:] = number[:-1]
    left[before[:-1]] = start
    return left


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of one of each distinct key in order, the way back); keys must not be negative."""
    order = np.argsort(keys)
    line = keys[order]
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    back = np.empty(len(line), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def numbered(docs: DataFrame, model: Model, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of each row with its tokens' numbers (32-bit, or 64 if there are too many words), ``n_known`` and ``base_score``.

    Texts are read for the last time here; bigrams, trigrams and scores come from the numbers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _number_type(model)
        for rows, data, offsets in chunks(batches, limit=CHUNK):
            token, before = tokens(data, offsets)
            first, back = distinct(token)
            number, count = model.numbers(token[first])
            known, base = (count > 0)[back], np.log10((count + ADD) / (model.tokens + ADD * (model.types + 1)))[back]
            raw = pa.py_buffer(number[back].astype(kind).tobytes())
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows.num_rows, [None, pa.py_buffer((before * kind.itemsize).astype(np.int64).tobytes()), raw])
            text = np.repeat(np.arange(rows.num_rows), np.diff(before))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in columns), blobs.cast(pa.binary()), pa.array(np.bincount(text, known, rows.num_rows).astype(np.int64)), pa.array(np.bincount(text, base, rows.num_rows))], [*columns, "numbers", "n_known", "base_score"]
            )

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return docs.select("text", *columns).mapInArrow(run, f"{kinds}numbers binary, n_known bigint, base_score double")


def _number_type(model: Model) -> np.dtype:
    return np.dtype("<i4" if model.types < (1 << 31) - 1 else "<i8")


def _numbers(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of numbered rows: (rows, numbers end to end, numbers before each row)."""
    kind = _number_type(model)
    for rows, data, offsets in chunks(batches, "numbers", CHUNK):
        yield rows, data.view(kind) if len(data) % kind.itemsize == 0 and data.flags.c_contiguous else np.frombuffer(data.tobytes(), kind), offsets // kind.itemsize


def _bigrams_of(model: Model, left: np.ndarray, number: np.ndarray):
    """(first of each distinct pair of a token and its left neighbour, the way back, node, relative place, share, rest of each pair); unknown ones have none."""
    # An unknown word under a known context has a number that no level holds; so has an unknown context.
    wide = np.uint64(model.types + 2).item().bit_length()
    value = np.where(number >= 0, number, model.types + 1).astype(np.uint64)
    context = np.where(left >= 0, left, model.types + 1).astype(np.uint64)
    first, back = distinct(context << np.uint64(wide) | value)
    node, relative, share, rest = model.bigram(context[first].astype(np.int64), value[first])
    return first, back, node, relative, share, rest


def _emit(pending_keys, pending_counts, cut) -> Iterator[pa.RecordBatch]:
    keys, counts = merge(pending_keys, pending_counts)
    pending_keys.clear()
    pending_counts.clear()
    rows = [(s, _planes(keys[a:b]), _planes(np.cumsum(counts[a:b], dtype=np.uint64))) for s, a, b in cut(keys)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def _count(parts: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]], rows: DataFrame, cut) -> DataFrame:
    """Keys with counts of all rows, summed in tasks and handed on by shard as blobs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, n = [], [], 0
        for part_ in parts(batches):
            k, c = _counts(part_)
            keys.append(k)
            counts.append(c)
            n += len(k)
            if n >= GATHER:
                yield from _emit(keys, counts, cut)
                n = 0
        yield from _emit(keys, counts, cut)
        give_back()

    return rows.mapInArrow(run, "shard int, keys binary, counts binary")


def _gathered(batches: Iterable[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray]:
    """(shard, keys, counts) of a shard's blobs, merged as they come: what is held grows with the distinct keys, not with the blobs."""
    keys, counts, pending, shard = [], [], 0, -1
    for batch in batches:
        for s, k, c in zip(*(batch.column(n).to_pylist() for n in ("shard", "keys", "counts"))):
            shard = s
            keys.append(_unplanes(k, np.uint64))
            counts.append(np.diff(_unplanes(c, np.uint64), prepend=np.uint64(0)).astype(np.int64))
            pending += len(keys[-1])
            if pending >= max(GATHER, len(keys[0])) and len(keys) > 1:
                k, c = merge(keys, counts)
                keys, counts, pending = [k], [c], 0
    return (shard, *merge(keys, counts))


def _level(context: np.ndarray, value: np.ndarray, count: np.ndarray, total: np.ndarray, contexts: int) -> dict[str, np.ndarray]:
    """Arrays of a level from sorted n-grams: pointers, successors relative to their context, shares and rests.

    ``total`` is each n-gram's context total; only n-grams that are kept are given.
    """
    share = encode_share((count - DISCOUNT) / total)
    left = 1 - np.bincount(context, _SHARE[share], contexts)
    pointer = np.searchsorted(context, np.arange(contexts + 1))
    value = value.astype(np.uint64) + np.uint64(1)
    # Each range goes on from the last value of the range before.
    last = np.zeros(contexts, np.uint64)
    full = np.flatnonzero(np.diff(pointer))
    last[full] = value[pointer[full + 1] - 1]
    base = np.cumsum(last) - last
    following = base[context] + value
    span = int(following[-1]) + 1 if len(following) else 1
    out = {"span": np.array([span], np.int64), "share": share, "rest": encode_share(np.maximum(left, 1e-9))}
    return out | named(EliasFano.build(pointer, int(pointer[-1]) + 1), "pointer") | named(EliasFano.build(following, span), "next")


def _small_counts(count: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, with a list of those that don't fit: most n-grams occur a few times."""
    large = np.flatnonzero(count >= 255)
    return {"count": np.minimum(count, 255).astype(np.uint8), "large": large, "large_count": count[large].astype(np.int64)}


def _counts_of(level: dict) -> np.ndarray:
    out = level["count"].astype(np.int64)
    out[level["large"]] = level["large_count"]
    return out


def _narrow(count: np.ndarray) -> np.ndarray:
    return count.astype(np.uint32 if count.max(initial=0) < 1 << 32 else np.uint64)


def train(docs: DataFrame, min_count: int = MIN_COUNT) -> Model:
    """Learn from all whole texts of ``docs(text)``; null texts count as empty, an empty table gives a model without words.

    Bigrams and trigrams from ``min_count`` occurrences on are kept; 1 keeps all.
    Counts are 64-bit. Word numbers are 32-bit up to 2^31 words, else 64-bit;
    a bigram's key has the bits of two word numbers, and a trigram's those of
    a bigram's number and of the most successors of one word. ValueError is
    raised if either is over 64 bits, before anything is counted for it.
    """
    model = _unigrams(docs, min_count)
    _grow(model, numbered(docs, model, ()), min_count)
    return model


def _unigrams(docs: DataFrame, min_count: int) -> Model:
    """The model's words: counted in tasks, sent to their shard once and written there as a level."""
    spark = docs.sparkSession
    folder = shared_folder(spark) + "-lm"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_SHARDS, -(-size // SHARD_BYTES)) - 1
    bits = int(bits).bit_length()
    shards = 1 << bits

    def by_hash(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        at = np.searchsorted((keys >> np.uint64(64 - bits)).astype(np.int64), np.arange(shards + 1))
        return ((s, int(at[s]), int(at[s + 1])) for s in range(shards) if at[s + 1] > at[s])

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = _gathered(batches)
        words_ = EliasFano.build(keys & np.uint64((1 << 64 - bits) - 1), 1 << 64 - bits)
        name = store(folder, "words", {"count": _narrow(counts)} | named(words_, "words"))
        yield _told(shard, name, len(keys), int(counts.sum()))

    hashes = lambda batches: (tokens(d, o)[0] for _, d, o in chunks(batches, limit=CHUNK))
    made = keep(_count(hashes, docs.select("text"), by_hash).groupBy("shard").applyInArrow(write_words, _TOLD)).collect()
    unigrams, types = _shards(folder, made, shards)
    return Model(bits, unigrams, sum(r.total for r in made), types)


def _grow(model: Model, rows: DataFrame, min_count: int) -> None:
    """Add the bigram and trigram levels of numbered ``rows``; each is counted in tasks, goes to its shard once, and is written there."""
    folder, unigrams, start = model.unigrams.folder, model.unigrams, model.types  # a text's head is a context with a number after all words
    rows, shards = rows.select("numbers"), 1 << model.bits
    wide = (model.types + 2).bit_length()
    if 2 * wide > 64:
        raise ValueError("too many words for one model; raise the widths of the keys")

    def by_context(first: np.ndarray, low: int):
        def cut(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
            at = np.searchsorted(keys, first.astype(np.uint64) << np.uint64(low))
            return ((s, a, b) for s, (a, b) in enumerate(zip(at.tolist(), [*at[1:].tolist(), len(keys)])) if b > a)

        return cut

    def bigram_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, number, before in _numbers(batches, model):
            yield _pairs(number, before, start).astype(np.uint64) << np.uint64(wide) | number.astype(np.uint64)

    def write_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = _gathered(batches)
        lo = int(unigrams.first[shard])
        context, value = (keys >> np.uint64(wide)).astype(np.int64) - lo, keys & np.uint64((1 << wide) - 1)
        contexts = int(context[-1]) + 1
        total = np.bincount(context, counts, contexts)
        kept = counts >= min_count
        level = _level(context[kept], value[kept], counts[kept], total[context[kept]], contexts) | _small_counts(counts[kept])
        yield _told(shard, store(folder, "bigrams", level), int(kept.sum()), int(np.bincount(context[kept]).max(initial=0)))

    made = keep(_count(bigram_keys, rows, by_context(unigrams.first, wide)).groupBy("shard").applyInArrow(write_bigrams, _TOLD)).collect()
    model.bigrams, nodes = _shards(folder, made, shards)
    model.rel = rel = max(1, max((r.total for r in made), default=0).bit_length())
    if nodes.bit_length() + rel > 64:
        raise ValueError("too many bigrams for one model; raise the widths of the keys")

    def trigram_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, number, before in _numbers(batches, model):
            _, back, node, relative, _, _ = _bigrams_of(model, _pairs(number, before, start), number)
            context, node = _pairs(node[back], before, -1), node[back]
            # Fewer occurrences than those of both its bigrams can't be kept either.
            some = np.flatnonzero((context >= 0) & (node >= 0))
            yield context[some].astype(np.uint64) << np.uint64(rel) | relative[back[some]].astype(np.uint64)

    def write_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = _gathered(batches)
        lo = int(model.bigrams.first[shard])
        context, value = (keys >> np.uint64(rel)).astype(np.int64) - lo, keys & np.uint64((1 << rel) - 1)
        kept = counts >= min_count
        context, value, counts = context[kept], value[kept], counts[kept]
        bigrams = _counts_of(model.bigrams.arrays(shard))
        level = _level(context, value, counts, bigrams[context], len(bigrams))
        yield _told(shard, store(folder, "trigrams", level), len(counts), 0)

    made = keep(_count(trigram_keys, rows, by_context(model.bigrams.first, rel)).groupBy("shard").applyInArrow(write_trigrams, _TOLD)).collect()
    model.trigrams, _ = _shards(folder, made, shards)


_TOLD = "shard int, name string, n bigint, total bigint"


def _told(shard: int, name: str, n: int, total: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": pa.array([name]), "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})


def _shards(folder: str, made: list, shards: int) -> tuple[Shards, int]:
    size = np.zeros(shards, np.int64)
    for r in made:
        size[r.shard] = r.n
    return Shards(folder, {r.shard: r.name for r in made}, np.cumsum(size) - size), int(size.sum())


def scored(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of each row of ``docs`` with ``n_tokens, n_known, train_tokens, base_score, score``."""
    return _scored(numbered(docs, model, columns), model, columns)


def _scored(rows: DataFrame, model: Model, columns: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part_, number, before in _numbers(batches, model):
            n = np.diff(before)
            text = np.repeat(np.arange(part_.num_rows), n)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part_.column(c) for c in columns),
                    pa.array(n, pa.int64()),
                    part_.column("n_known"),
                    pa.array(np.full(part_.num_rows, model.tokens), pa.int64()),
                    part_.column("base_score"),
                    pa.array(np.bincount(text, _log_scores(model, number, before), part_.num_rows)),
                ],
                [*columns, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
        give_back()

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in columns)
    return rows.mapInArrow(run, f"{kinds}n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _log_scores(model: Model, number: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 probability of each token; what is the same for equal pairs and triples is computed once for each."""
    if not len(number):
        return np.zeros(0)
    if model.bigrams is None or not model.types:
        return np.log10(model.chances(number))
    first, back, node, relative, share, rest = _bigrams_of(model, _pairs(number, before, model.types), number)
    p = share + rest * model.chances(number[first])
    # A context that is kept takes its part even from tokens it hasn't seen; a token that
    # doesn't follow its left neighbour in the model can't follow both.
    value = np.where(node >= 0, relative, (1 << model.rel) - 1)
    context, some = _pairs(node[back], before, -1), back
    under = np.flatnonzero(context >= 0)
    triple, to = distinct(context[under].astype(np.uint64) << np.uint64(model.rel) | value[back[under]].astype(np.uint64))
    one = under[triple]
    _, _, share, rest = model.trigram(context[one], value[back[one]])
    # Unseen last words of a context share a key but not their lower-order chance.
    out = p[some]
    out[under] = share[to] + rest[to] * out[under]
    return np.log10(out)


def held_out() -> "F.Column":
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def score_documents(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, learning from those not held out.

    The model keeps n-grams from ``min_count`` occurrences on; 1 cuts nothing.
    A null or empty text is its end alone. Rows without an id are learned from.
    Repeated rows count and are scored each.
    """
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out())
    model = _unigrams(rows.where(~F.col("held_out")), min_count)
    columns = ("doc_id", "held_out")
    known = keep(numbered(rows, model, columns), compression="zstd")
    _grow(model, known.where(~F.col("held_out")), min_count)
    return _scored(known, model, columns)
