"""URL rules by a bit-parallel wildcard automaton.

Every rule becomes glob patterns over ``host + path``; the positions of all
patterns lie side by side in 64-bit words, and one Shift-And step advances all
of them on all URLs of a batch. A ``*`` is a position that keeps its bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The rules of the contract: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"
_STAR = -1
#: A byte that no URL text in UTF-8 holds; it stands between host and path.
_MARK = 0xFF


def compile_rules(rules=RULES):
    """Masks of the automaton: byte masks (256 x words), start, first positions, self loops, finals by rule, positions from a mark to before the last, length of the longest host."""
    bits: list[tuple[int, int]] = []  # rule, symbol of each position
    begins, ends, after = [], [], []
    for r, (host, path, _) in enumerate(rules):
        for prefix in ([], [_STAR, ord(".")]):
            glob = [*prefix, *host.encode(), _MARK, *path.encode()]
            begins.append(len(bits))
            bits += [(r, c) for c in glob]
            ends.append(len(bits) - 1)
            after += range(begins[-1] + glob.index(_MARK), ends[-1])
    n = -(-len(bits) // 64)
    one = lambda p: np.array([1 << (p - 64 * w) if 0 <= p - 64 * w < 64 else 0 for w in range(n)], np.uint64)
    masks, start, heads, loop = np.zeros((256, n), np.uint64), *(np.zeros(n, np.uint64) for _ in range(3))
    finals = np.zeros((len(rules), n), np.uint64)
    for p, (_, c) in enumerate(bits):
        if c == _STAR:
            masks[:, :] |= one(p)
            loop |= one(p)
        else:
            masks[c] |= one(p)
    for b in begins:
        heads |= one(b)
        start |= one(b)
        if bits[b][1] == _STAR:
            start |= one(b + 1)
    for e in ends:
        finals[bits[e][0]] |= one(e)
    tails = np.bitwise_or.reduce([np.zeros(n, np.uint64), *(one(p) for p in after)])
    return masks, start, heads, loop, finals, tails, max((len(h.encode()) for h, _, _ in rules), default=0)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[cut:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    host = rest[:cut].encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).decode()
    return host, tail[:stop]


def _shifted(state: np.ndarray) -> np.ndarray:
    out = state << np.uint64(1)
    out[:, 1:] |= state[:, :-1] >> np.uint64(63)
    return out


def match(urls: list[bytes], automaton) -> np.ndarray:
    """Whether each rule fits each URL, given as host, mark and path: URLs x rules. A pattern's last position stays set.

    Of a host that is longer than any pattern's, only a star can take the
    beginning, so the automaton starts where the longest one may begin; a path
    is read until no pattern can go on. So long URLs cost no more than others.
    """
    masks, start, heads, loop, finals, tails, longest = automaton
    ends = [u.index(_MARK) for u in urls]
    texts = [u[max(0, e - longest - 2) :] for u, e in zip(urls, ends)]
    passed = np.array([min(e, longest + 2) + 1 for e in ends], np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    size, passed = size[order], passed[order]
    data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    state = np.zeros((len(texts), len(start)), np.uint64)
    hits = np.zeros((len(texts), len(finals)), bool)
    last = np.bitwise_or.reduce(finals, axis=0)
    for at in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -at, "left"))  # texts longer than at
        if at % 32 == 31:
            # A text whose mark has passed is decided when no position between a mark and a last one is alive.
            size[:n][(passed[:n] <= at) & ~((state[:n] & tails) != 0).any(axis=1)] = at
            again = np.argsort(-size, kind="stable")
            order, size, begin, state, passed = order[again], size[again], begin[again], state[again], passed[again]
            n = int(np.searchsorted(-size, -at, "left"))
            if not n:
                break
        step = (_shifted(state[:n]) & ~heads) | (state[:n] & loop)
        if at == 0:
            step |= start
        step &= masks[data[begin[:n] + at]]
        step |= _shifted(step) & loop & ~heads  # a star may also take nothing
        state[:n] = step | (state[:n] & last)
    for r, f in enumerate(finals):
        hits[order, r] = ((state & f) != 0).any(axis=1)
    return hits


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages(page_id, url)``.

    The longest fitting rule decides (host and path together; of equal ones the
    first); without one, ``rule`` is null and the verdict is ``default``. A
    null or empty URL, or one without ``://``, has an empty host and path.
    Rows are judged each, repeated ones and those without an id too; URLs of
    any length are whole in the result; an empty table gives an empty one.
    """
    names = [h + p for h, p, _ in rules]
    rank = sorted(range(len(rules)), key=lambda r: (-len(names[r].encode()), r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compile_rules(rules)
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            hits = match([h.encode() + bytes([_MARK]) + p.encode() for h, p in parts], automaton)
            best = np.full(len(parts), -1)
            for r in reversed(rank):
                best[hits[:, r]] = r
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id"),
                    "host": pa.array([h for h, _ in parts], pa.string()),
                    "path": pa.array([p for _, p in parts], pa.string()),
                    "rule": pa.array([names[b] if b >= 0 else None for b in best], pa.string()),
                    "verdict": pa.array([rules[b][2] if b >= 0 else default for b in best], pa.string()),
                }
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
