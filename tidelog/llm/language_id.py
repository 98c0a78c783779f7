"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is the product
of its letters' vectors, rotated by their position; a text or a language is the
sum of its trigrams' vectors, and they are compared by cosine. Sums being
linear, a text's bundle is a row of counts times its trigrams' vectors: a
sparse product for the texts of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import chunks, give_back, mix

DIM = 1024
UNKNOWN = "und"
_FIXED = 1 << 20
_BLOCK = 4096
#: Texts that are bundled at a time, and trigram vectors that a task keeps.
_TEXTS = 256
_KEPT = 20_000
#: Trigrams of a language whose weights a task sums up before it makes their vectors.
_HELD = 200_000
#: Text bytes at a time: some 200 bytes of work space each.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter by code point, 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(code: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Random sign vectors of code points, the same in every task."""
    bits = mix(code.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(-(-dim // 64), dtype=np.uint64)[None, :] + np.uint64(7))
    signs = np.unpackbits(bits.view(np.uint8).reshape(len(code), -1), axis=1)[:, :dim]
    return signs.astype(np.int8) * 2 - 1


def gram_vectors(gram: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Vectors of packed trigrams: letters rotated by two, one and none, multiplied."""
    code, where = np.unique(np.stack([gram >> np.uint64(42), gram >> np.uint64(21) & np.uint64(0x1FFFFF), gram & np.uint64(0x1FFFFF)]), return_inverse=True)
    base, where = letter_vectors(code, dim), where.reshape(3, -1)
    return np.roll(base, 2, axis=1)[where[0]] * np.roll(base, 1, axis=1)[where[1]] * base[where[2]]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct letter trigrams of each text: (text, trigram, count, whether each text has a letter).

    Words stand between blanks, runs of other characters being one blank.
    """
    text = data.tobytes()
    letters = [np.frombuffer(text[a:b].decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    size = np.array([len(x) + 1 for x in letters])
    flat = np.zeros(int(size.sum()) + 1, np.uint64)
    begin = np.concatenate([[1], 1 + np.cumsum(size)])
    known = _letters()
    for b, x in zip(begin.tolist(), letters):
        flat[b : b + len(x)] = known[x]
    owner = np.concatenate([[0], np.repeat(np.arange(len(size)), size)])
    stay = np.ones(len(flat), bool)
    stay[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    stay[begin[:-1] - 1] = True  # each text has its own first blank
    c, owner = flat[stay], owner[stay]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(size), bool)
    gram = c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]
    own = owner[1:-1]
    real = c[1:-1] != 0
    gram, own = gram[real], own[real]
    code, small = np.unique(gram, return_inverse=True)
    both, count = np.unique(own.astype(np.int64) * len(code) + small, return_counts=True)
    who = both // max(1, len(code))
    has = np.zeros(len(size), bool)
    has[who] = True
    return who, code[both % max(1, len(code))], count, has


def _norms(who: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the texts' count vectors."""
    return np.sqrt(np.bincount(who, count.astype(float) ** 2, n))


class _Vectors:
    """Trigram vectors that a task has made, a bounded number of them."""

    def __init__(self, dim: int):
        self.code, self.made = np.zeros(0, np.uint64), np.zeros((0, dim), np.int8)

    def of(self, gram: np.ndarray) -> np.ndarray:
        """Vectors of sorted, distinct trigrams."""
        if len(self.code) > _KEPT:
            self.code, self.made = self.code[:0], self.made[:0]
        new = np.setdiff1d(gram, self.code, assume_unique=True)
        if len(new):
            code = np.append(self.code, new)
            order = np.argsort(code)
            self.code, self.made = code[order], np.concatenate([self.made, gram_vectors(new, self.made.shape[1])])[order]
        return self.made[np.searchsorted(self.code, gram)]


def bundles(who: np.ndarray, gram: np.ndarray, count: np.ndarray, texts: int, vectors: _Vectors) -> Iterator[tuple[slice, np.ndarray]]:
    """Summed vectors of texts given by (text, trigram, count) in order of texts, a few hundred texts at a time; sums are exact."""
    at = np.searchsorted(who, np.arange(0, texts + _TEXTS, _TEXTS))
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        rows = slice(i * _TEXTS, min(texts, (i + 1) * _TEXTS))
        code, column = np.unique(gram[a:b], return_inverse=True)
        kind = np.float32 if count[a:b].sum() < 1 << 24 else np.float64
        out = np.zeros((rows.stop - rows.start, vectors.made.shape[1]), kind)
        for c in range(0, len(code), _BLOCK):
            here = (column >= c) & (column < c + _BLOCK) if len(code) > _BLOCK else slice(None)
            counts = np.zeros((len(out), min(_BLOCK, len(code) - c)), kind)
            counts[who[a:b][here] - rows.start, column[here] - c] = count[a:b][here]
            out += counts @ vectors.of(code[c : c + _BLOCK]).astype(kind)
        yield rows, out


def learn(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """A unit prototype of each language from ``docs(text, lang)``; rows without text or language teach nothing.

    Each text weighs one by the length of its counts, in fixed point, so that
    sums don't depend on their order. Tasks give one vector a language, added up by component; what
    reaches the driver is languages x dimensions numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}

        def summed(name: str) -> pa.RecordBatch:
            grams = total.pop(name)
            gram, weight = np.array(list(grams), np.uint64), np.array(list(grams.values()), np.int64)
            out = np.zeros(dim, np.int64)
            for at in range(0, len(gram), _BLOCK):
                out += weight[at : at + _BLOCK] @ gram_vectors(gram[at : at + _BLOCK], dim).astype(np.int64)
            return pa.RecordBatch.from_pydict({"lang": pa.array([name]), "v": pa.array([out.tolist()], pa.list_(pa.int64()))})

        for rows, data, offsets in chunks(batches, limit=CHUNK):
            who, gram, count, _ = trigrams(data, offsets)
            norm = _norms(who, count, rows.num_rows)
            weight = np.rint(_FIXED * count / norm[who]).astype(np.int64)
            names, lang = np.unique(np.array(rows.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            for i, name in enumerate(names.tolist()):
                mine = lang[who] == i
                code, inverse = np.unique(gram[mine], return_inverse=True)
                own = total.setdefault(name, {})
                for g, w in zip(code.tolist(), np.bincount(inverse, weight[mine]).astype(np.int64).tolist() if len(code) else ()):
                    own[g] = own.get(g, 0) + w
                if len(own) > _HELD:
                    yield summed(name)
        for name in sorted(total):
            yield summed(name)

    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    parts = taught.mapInArrow(run, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r.lang, np.zeros(dim))[r.at] = r.x
    return {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), dim: int = DIM) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, the cosine with that language (0 to 1).

    Only the text decides. Null texts and texts without a letter, and all texts
    where nothing was learned, are ``und`` with score 0. Of equal scores the
    first language by name wins.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _Vectors(dim)
        for rows, data, offsets in chunks(batches, limit=CHUNK):
            who, gram, count, has = trigrams(data, offsets)
            cosine = np.zeros((rows.num_rows, max(1, len(names))))
            if names:
                for part, bundle in bundles(who, gram, count, rows.num_rows, vectors):
                    bundle = bundle.astype(float)
                    cosine[part] = bundle @ matrix.T / np.maximum(np.linalg.norm(bundle, axis=1), 1e-9)[:, None]
            best = cosine.argmax(axis=1)
            known = has & bool(names)
            score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
            lang = [names[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])
        give_back()

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select("text", *[c for c in keep if c != "text"]).mapInArrow(run, f"{kinds}lang_pred string, score double")


def held_out() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, learning from those that aren't held out.

    A null text, an empty one and one without a letter are ``und`` with score
    0; of equal scores the first language by name wins. Repeated rows teach
    and are judged each; rows without an id are never held out. Texts of any
    length are whole. An empty table gives an empty one.
    """
    taught = docs.select("doc_id", "text", "lang").where(~F.coalesce(held_out(), F.lit(False)))
    marked = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return predict(marked, learn(taught), ("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float = 0.0) -> DataFrame:
    """Rows of ``docs`` whose language is told with a score of ``min_score`` or more; columns stay as they are, whatever their names.

    Where nothing was learned, there is nothing to reject by: rows with a
    letter stay. Rows whose text is null, empty or without a letter go.
    """
    if not prototypes:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = tuple(docs.columns)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}" if c != "text" else "text") for i, c in enumerate(names)])
    judged = predict(plain, prototypes, tuple(plain.columns))
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*[F.col(p).alias(c) for p, c in zip(plain.columns, names)])
