"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Under a unigram model the best segmentation of a prefix is the same in every
pre-token that has it. Distinct pre-tokens of a chunk are sorted, which makes
them a trie: a node is owned by the first pre-token that reaches it. Nodes get
their best score and its token count depth by depth, and terminals give each
pre-token its count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import chunks, give_back, mix
from tidelog.llm.packing import distinct_units, unit_starts

#: Pre-tokens over this many bytes don't share prefixes; they are run alone, by the pieces found in them.
LONG = 48
#: Pre-tokens that a task remembers.
KNOWN = 300_000
_SLOTS = 1 << 20


class Vocabulary:
    """Pieces and scores of a byte vocabulary, found by hash. A piece of rank r has the Zipf score -log((r + 2) H)."""

    def __init__(self, name: str):
        import base64

        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as f:
            self.pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        total = math.log(sum(1 / (r + 2) for r in self.pieces.values()))
        self.score = {p: -math.log(r + 2) - total for p, r in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        # Keys of all prefixes; those that are no piece have no score.
        parts = sorted({p[:k] for p in self.pieces for k in range(1, len(p) + 1)})
        self.keys = np.empty(len(parts), np.uint64)
        size = np.array([len(p) for p in parts])
        for n in np.unique(size).tolist():
            mine = np.flatnonzero(size == n)
            self.keys[mine] = hash_piece(np.frombuffer(b"".join(parts[i] for i in mine.tolist()), np.uint8).reshape(-1, n))
        assert len(np.unique(self.keys)) == len(parts), "two pieces share a hash"
        value = np.array([self.score.get(p, np.nan) for p in parts])
        order = np.argsort(self.keys)
        self.keys, self.value = self.keys[order], value[order]
        # A slot holds the place of the first key of its top bits; the keys of one are few and adjacent.
        top = (self.keys >> np.uint64(44)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange(_SLOTS + 1))
        self.most = int(np.diff(self.first).max())

    def find(self, key: np.ndarray) -> np.ndarray:
        """Score of each key; minus infinity for what no piece begins with, not a number for what only begins one."""
        at = self.first[(key >> np.uint64(44)).astype(np.int64)]
        out = np.full(len(key), -np.inf)
        for i in range(self.most):
            near = np.minimum(at + i, len(self.keys) - 1)
            hit = self.keys[near] == key
            out[hit] = self.value[near[hit]]
        return out


def hash_piece(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of bytes; equal lengths only meet equal lengths."""
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for i in range(rows.shape[1]):
        h = h * np.uint64(0x100000001B3) + rows[:, i] + np.uint64(1)
    return mix(h)


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def segment_one(piece: bytes, vocab: Vocabulary) -> tuple[int, float]:
    """(tokens, score) of the best segmentation of one pre-token: fewest tokens among equal scores."""
    best, n = [0.0] + [-math.inf] * len(piece), [0] * (len(piece) + 1)
    for end in range(1, len(piece) + 1):
        for k in range(1, min(end, vocab.longest) + 1):
            s = vocab.score.get(piece[end - k : end])
            if s is not None and (best[end - k] + s, -n[end - k] - 1) > (best[end], -n[end]):
                best[end], n[end] = best[end - k] + s, n[end - k] + 1
    return n[-1], best[-1]


def segment_long(piece: bytes, vocab: Vocabulary) -> tuple[int, float]:
    """As segment_one, for a long pre-token: pieces are looked up from all places at once, longer ones only where a piece still begins so."""
    data = np.frombuffer(piece, np.uint8).astype(np.uint64)
    begin, state, power = np.arange(len(data)), np.zeros(len(data), np.uint64), 1
    from_, to, gain = [], [], []
    for k in range(1, vocab.longest + 1):
        inside = begin + k <= len(data)
        begin, state = begin[inside], state[inside]
        if not len(begin):
            break
        power = power * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        state = state * np.uint64(0x100000001B3) + data[begin + k - 1] + np.uint64(1)
        found = vocab.find(mix(state + np.uint64(k * power & 0xFFFFFFFFFFFFFFFF)))
        whole = np.flatnonzero(found > -np.inf)
        from_.append(begin[whole])
        to.append(begin[whole] + k)
        gain.append(found[whole])
        on = found != -np.inf
        begin, state = begin[on], state[on]
    from_, to, gain = np.concatenate(from_), np.concatenate(to), np.concatenate(gain)
    order = np.argsort(to, kind="stable")
    best, n = [0.0] + [-math.inf] * len(piece), [0] * (len(piece) + 1)
    for a, b, s in zip(from_[order].tolist(), to[order].tolist(), gain[order].tolist()):
        score = best[a] + s
        if score > best[b] or (score == best[b] and n[a] + 1 < n[b]):
            best[b], n[b] = score, n[a] + 1
    return n[-1], best[-1]


def segment_trie(pieces: np.ndarray, size: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, score) of sorted, distinct, zero-padded rows of bytes of the given lengths."""
    n, wide = pieces.shape
    row = np.arange(n)
    same = np.zeros((n, wide), bool)
    if n > 1:
        same[1:] = np.logical_and.accumulate(pieces[1:] == pieces[:-1], axis=1)
    at = np.arange(wide)
    inside = at[None, :] < size[:, None]
    # The first row that has a prefix owns its node.
    same[1:] &= at[None, :] < size[:-1, None] if n > 1 else True
    owner = np.maximum.accumulate(np.where(same, 0, row[:, None]), axis=0)
    score, count = np.zeros((n, wide + 1)), np.zeros((n, wide + 1), np.int32)
    for depth in range(1, wide + 1):
        own = np.flatnonzero(inside[:, depth - 1] & ~same[:, depth - 1])
        if not len(own):
            continue
        best, tokens = np.full(len(own), -np.inf), np.zeros(len(own), np.int32)
        state = np.zeros(len(own), np.uint64)
        power = np.uint64(1)
        for k in range(1, min(depth, vocab.longest) + 1):
            # The hash polynomial of the last k bytes, extended to the left.
            state = state + (pieces[own, depth - k].astype(np.uint64) + np.uint64(1)) * power
            power = np.uint64((int(power) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF)
            found = vocab.find(mix(state + np.uint64(k * int(power) & 0xFFFFFFFFFFFFFFFF)))
            use = np.flatnonzero(found > -np.inf)
            back = owner[own[use], depth - k - 1] if k < depth else own[use]
            total = score[back, depth - k] + found[use] if k < depth else found[use]
            more = (count[back, depth - k] if k < depth else np.zeros(len(use), np.int32)) + 1
            better = (total > best[use]) | ((total == best[use]) & (more < tokens[use]))
            use, total, more = use[better], total[better], more[better]
            best[use] = total
            tokens[use] = more
        score[own, depth], count[own, depth] = best, tokens
    last = owner[row, np.maximum(size, 1) - 1]
    return count[last, size], score[last, size]


def count_units(units: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, score) of distinct pre-tokens."""
    size = np.array([len(u) for u in units], np.int64)
    tokens, score = np.zeros(len(size), np.int64), np.zeros(len(size))
    short = np.flatnonzero(size <= LONG)
    if len(short):
        order = sorted(short.tolist(), key=units.__getitem__)
        wide = int(size[short].max())
        table = np.frombuffer(b"".join(units[i].ljust(wide, b"\0") for i in order), np.uint8).reshape(-1, wide)
        tokens[order], score[order] = segment_trie(table, size[order], vocab)
    for i in np.flatnonzero(size > LONG).tolist():
        tokens[i], score[i] = segment_long(units[i], vocab)
    return tokens, score


def count_known(units: list[bytes], vocab: Vocabulary, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """As count_units, with what earlier chunks of the task had taken from ``known``, whose size is bounded."""
    if len(known) > KNOWN:
        known.clear()
    new = [u for u in units if u not in known]
    if new:
        known.update(zip(new, zip(*(x.tolist() for x in count_units(new, vocab)))))
    got = np.array([known[u] for u in units]).reshape(-1, 2)
    for u in new:
        if len(u) > LONG:
            del known[u]
    return got[:, 0].astype(np.int64), got[:, 1]


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, n_bytes, n_pretokens, n_tokens, score`` of every whole text.

    Pre-tokens begin at text starts and at spaces before other characters. Null
    and empty texts have no tokens and score 0. Repeated rows and rows without
    an id are counted each; an empty table gives an empty one. Rows are only
    mapped: nothing is shuffled, and a task holds one chunk of text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = vocabulary(name), {}
        for rows, data, offsets in chunks(batches):
            starts = unit_starts(data, offsets)
            before = np.searchsorted(starts, offsets)
            units, unit = distinct_units(data, starts)
            tokens, score = count_known(units.to_pylist(), vocab, known)
            who = np.repeat(np.arange(rows.num_rows), np.diff(before))
            total = np.bincount(who, tokens[unit], rows.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (np.diff(offsets), np.diff(before), total)), pa.array(np.bincount(who, score[unit], rows.num_rows))],
                ["doc_id", "n_bytes", "n_pretokens", "n_tokens", "score"],
            )
        known.clear()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_pretokens bigint, n_tokens bigint, score double")
