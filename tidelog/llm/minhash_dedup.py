"""Near-duplicate documents by SetSketch registers, likelihood and exact checks.

A document's distinct shingles are sketched into registers: each keeps the
least of exponential variables of the shingles on an exponentially spaced
scale, truncated to a byte. Registers of a union are the larger ones, and equal
registers are the likelier the more alike two sets are. Bands of registers
give candidates, the joint likelihood of a pair's register comparisons drops
hopeless ones, and the rest is decided on the full sets. Only likely pairs
make sets a family, so texts meet no others than those that may be alike.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidelog.llm.common import chunks, distinct_per_text, keep, mix, sent_if_few, shingles, words
from tidelog.llm.components import components, to_least

REGISTERS = 256  # a power of two
#: Most registers of a band, and the most likely that a pair at the threshold shares no band.
BAND = 8
MISS = 2e-5
BASE = 1.1
#: Values from here on share register 0; a byte reaches down to 5e-10 of it.
LARGEST = 20.0
#: Log-likelihood by which the threshold may fall short of the best estimate.
SLACK = 20.0
#: Text bytes that are sketched at a time.
CHUNK = 2 << 20
#: Most sets of a family whose pairs one task compares, and sets of a block of larger ones.
BLOCK = 128
#: Most sets of a bucket whose sketches one task compares, and sets of a block of larger ones.
CROWD = 1024
#: Shingles that a task is to hold, if a family doesn't have more.
HELD = 1 << 21


def sketch(values: np.ndarray, before: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers (texts x registers bytes) of sets of hashes given one after another.

    A shingle's variables are the points of a Poisson process that fall to each
    register in turn; only those under a bound that all registers reach almost
    surely are made, and texts where one didn't are done again with twice that.
    """
    n = np.diff(before)
    least = np.full((len(n), registers), np.inf)
    todo, reach = np.flatnonzero(n > 0), math.log(registers) + 8
    while len(todo):
        for part in _groups(n[todo], reach * registers):
            _points(values, before, n, todo[part], reach, least)
        missed = ~(least[todo] <= (reach / n[todo])[:, None]).all(axis=1)
        least[todo[missed]] = np.inf
        todo, reach = todo[missed], reach * 2
    with np.errstate(divide="ignore"):
        level = np.floor((math.log(LARGEST) - np.log(least)) / math.log(BASE))
    return np.clip(np.nan_to_num(level, neginf=0, posinf=255), 0, 255).astype(np.uint8)


def _groups(n: np.ndarray, points: float) -> Iterator[np.ndarray]:
    """Texts with many points a shingle, in groups of some 300,000 points; then all others."""
    many = n < points / 48
    small = np.flatnonzero(many)
    for at in range(0, len(small), max(1, int(300_000 / points))):
        yield small[at : at + max(1, int(300_000 / points))]
    if (~many).any():
        yield np.flatnonzero(~many)


def _draw(value: np.ndarray, step: np.ndarray | int, registers: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(value + np.asarray(step).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / registers
    return gap, (h & np.uint64(registers - 1)).astype(np.int64)


def _points(values, before, n, texts, reach, least) -> None:
    registers = least.shape[1]
    size = n[texts]
    owner = np.repeat(texts, size)
    at = np.repeat(before[texts] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    value, bound, flat = values[at], reach / n[owner], least.reshape(-1)
    mean = reach * registers / size.max()
    if mean > 32:
        count = np.repeat(np.ceil(reach * registers / size + 6 * np.sqrt(reach * registers / size) + 12).astype(np.int64), size)
        last = np.cumsum(count)
        step = np.arange(last[-1]) - np.repeat(last - count, count)
        gap, spot = _draw(np.repeat(value, count), step, registers)
        total = np.cumsum(gap)
        total -= np.repeat(total[last - count] - gap[last - count], count)
        np.minimum.at(flat, np.repeat(owner, count) * registers + spot, total)
        return
    time, step = np.zeros(len(value)), 0
    while len(value):
        gap, spot = _draw(value, step, registers)
        time = time + gap
        on = time <= bound
        value, bound, time, owner, step = value[on], bound[on], time[on], owner[on], step + 1
        np.minimum.at(flat, owner * registers + spot[on], time)


def likelihood(up: np.ndarray, down: np.ndarray, equal: np.ndarray, u: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Log-likelihood of a Jaccard similarity, given register comparisons and the sets' shares u + v = 1."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    a, b = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return up * np.log(a + tiny) + down * np.log(b + tiny) + equal * np.log(np.maximum(1 - a - b, tiny))


def odds(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, threshold: float) -> np.ndarray:
    """Most likely similarity of pairs of sketches; minus infinity where size or likelihood ratio excludes the threshold."""
    out = np.full(len(left), -np.inf)
    equal, registers = (left == right).sum(axis=1), left.shape[1]
    # Most pairs are far too unlike; so few equal registers have a probability under 1e-10 at the threshold.
    least = _equal(threshold) * registers
    sized = np.minimum(n_left, n_right) >= (threshold - 1e-9) * np.maximum(n_left, n_right)
    some = np.flatnonzero(sized & (equal >= least - 6.5 * math.sqrt(least * (1 - least / registers))))
    left, right, n_left, n_right, equal = left[some], right[some], n_left[some], n_right[some], equal[some]
    if not len(some):
        return out
    up = (left > right).sum(axis=1)
    down = registers - up - equal
    u = n_left / (n_left + n_right)
    grid = [likelihood(up, down, equal, u, 1 - u, j) for j in np.linspace(0, 1, 41)]
    at = likelihood(up, down, equal, u, 1 - u, threshold)
    best = np.argmax(grid, axis=0) / 40
    out[some] = np.where((best >= threshold) | (np.max(grid, axis=0) - at <= SLACK), best, -np.inf)
    return out


def _equal(similarity: float) -> float:
    """Least probability that a register of two sets of that similarity is equal: where one set holds the other."""
    return 1 + math.log1p(-(1 - similarity) * (BASE - 1) / BASE) / math.log(BASE)


def sketched(docs: DataFrame, width: int = 5, registers: int = REGISTERS) -> DataFrame:
    """``doc_id, n_shingles, digest, sketch`` of each row; a set without shingles has neither digest nor sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches, limit=CHUNK):
            values, before = distinct_per_text(*shingles(*words(data, offsets), width))
            n = np.diff(before)
            made = sketch(values, before, registers)
            digest = _digests(values, before)
            bytes_ = [made[i].tobytes() if n[i] else None for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bytes_, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, digest binary, sketch binary")


def band_of(percent: int, registers: int = REGISTERS) -> int:
    """The longest band that keeps to MISS, or a single register."""
    same = _equal(percent / 100)
    return next((b for b in range(BAND, 1, -1) if (1 - same**b) ** (registers // b) <= MISS), 1)


def _dealt(rows: DataFrame, group: str, item: str, most: int, weight: str | None = None) -> DataFrame:
    """``rows`` with ``cell`` and ``side``: groups of up to ``most`` items lie several in a cell; blocks of larger ones meet pairwise, one pair a cell.

    ``rows`` has the group's number of items in ``size``.
    """
    small = rows.where(F.col("size") <= most)
    have = small.agg(F.count(F.lit(1)), F.sum(weight) if weight else F.lit(0)).first()
    cells = max(1, -(-have[0] // (2 * most)), -(-int(have[1] or 0) // HELD))
    together = small.withColumn("cell", F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64(group), F.lit(cells)))).withColumn("side", F.lit(0))
    blocks = F.ceil(F.col("size") / most).cast("int")
    large = rows.where(F.col("size") > most).withColumn("m", F.pmod(F.xxhash64(item), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    meet = large.withColumn("cell", F.concat_ws(":", F.lit("l"), group, F.least("m", "o"), F.greatest("m", "o"))).withColumn("side", (F.col("m") > F.col("o")).cast("int"))
    return together.unionByName(meet.drop("m", "o"))


class _Forest:
    """Links that join what isn't joined yet."""

    def __init__(self, n: int, roots: np.ndarray | None = None):
        self.parent, self.links = list(range(n)), []
        if roots is not None:
            first: dict = {}
            self.parent = [first.setdefault(r, i) for i, r in enumerate(roots.tolist())]

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def joined(self, x: int, y: int) -> bool:
        return self.find(x) == self.find(y)

    def join(self, x: int, y: int) -> None:
        p, q = self.find(x), self.find(y)
        if p != q:
            self.parent[max(p, q)] = min(p, q)
            self.links.append((x, y))


def _links(forest: _Forest, node: np.ndarray) -> pa.Table:
    return pa.table({c: pa.array([int(node[link[i]]) for link in forest.links], pa.int64()) for i, c in enumerate("ab")})


def _scores(made: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    parts = [slice(i, i + 4096) for i in range(0, len(a), 4096)]
    return np.concatenate([odds(made[a[p]], made[b[p]], n[a[p]], n[b[p]], threshold) for p in parts] or [np.zeros(0)])


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def likely(sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes that connect all likely pairs of them: pairs that share a band and whose joint likelihood doesn't exclude the threshold.

    A bucket's sketches are compared in a task, those of a large one in
    blocks; each task gives back a spanning forest of its likely pairs.
    """
    registers = F.octet_length("sketch")
    width = band_of(percent)
    keys = F.transform(F.sequence(F.lit(0), F.floor(registers / width).cast("int") - 1), lambda i: F.xxhash64(i, F.substr(F.col("sketch"), i * width + 1, F.lit(width))))
    rows = sets.select("cls", F.explode(keys).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = keep(rows.join(shared, "bucket"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("side", "ascending"), ("cls", "ascending")])
        bucket, cls, side = (table.column(c).to_numpy() for c in ("bucket", "cls", "side"))
        made, n = _sketches(table), table.column("n").to_numpy().astype(float)
        distinct, node = np.unique(cls, return_inverse=True)
        forest = _Forest(len(distinct))
        two = bool(side.any())
        for step in range(1, len(bucket)):
            a = np.flatnonzero(bucket[:-step] == bucket[step:])
            if not len(a):
                break
            b = a + step
            if two:
                a, b = a[side[a] != side[b]], b[side[a] != side[b]]
            good = _scores(made, n, a, b, percent / 100) > -np.inf
            # What comes first is linked first, so the links of many buckets are the same ones.
            for x, y in zip(node[a[good]].tolist(), node[b[good]].tolist()):
                forest.join(x, y)
        return _links(forest, distinct)

    dealt = _dealt(members, "bucket", "cls", CROWD).join(sets.select("cls", "n", "sketch"), "cls")
    found = keep(dealt.groupBy("cell").applyInArrow(compare, "a bigint, b bigint").distinct(), members)
    return found


def _candidates(made: np.ndarray, family: np.ndarray, side: np.ndarray, size: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one cell that share a family and a band of ``size`` registers; of two blocks, only pairs across them."""
    bands = made.shape[1] // size
    keys = np.zeros((len(made), bands, 8), np.uint8)
    keys[:, :, :size] = made[:, : bands * size].reshape(len(made), bands, size)
    keys = keys.view(np.uint64)[:, :, 0]
    near = np.zeros((len(made), len(made)), bool)
    for band in range(keys.shape[1]):
        key = mix(keys[:, band] ^ mix(family.astype(np.uint64)))
        order = np.argsort(key)
        at = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            if y - x > 1:
                near[np.ix_(order[x:y], order[x:y])] = True
    if side.any():
        near &= side[:, None] != side[None, :]
    return np.nonzero(np.triu(near, 1))


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(one) + len(two) - both)


def _full(table: pa.Table, width: int) -> list[np.ndarray]:
    return [v for _, data, offsets in chunks(table.select(["text"]).combine_chunks().to_batches()) for v in _sets(data, offsets, width)]


def linked(members: DataFrame, percent: int, width: int = 5) -> DataFrame:
    """Links ``(a, b)`` that join what full shingle sets with ``100 * intersection >= percent * union`` join, as a forest of each cell.

    ``members`` has ``cls, family, size, root, n, sketch, text``; classes of one
    root are joined already. Pairs that share a band are tried in order of
    likelihood, those joined in the cell aren't tried again: what a task gives
    back is linear in its rows, and no link between parts is lost.
    """

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("cls", "ascending")])
        cls, family, side, root = (table.column(c).to_numpy() for c in ("cls", "family", "side", "root"))
        made, n = _sketches(table), table.column("n").to_numpy().astype(float)
        a, b = _candidates(made, family, side, band_of(percent, made.shape[1]))
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        score = _scores(made, n, a, b, percent / 100)
        forest = _Forest(len(cls), root)
        if (score > -np.inf).any():
            full = _full(table, width)
            for i in np.argsort(-score, kind="stable").tolist():
                if score[i] == -np.inf:
                    break
                x, y = int(a[i]), int(b[i])
                if not forest.joined(x, y) and _alike(full[x], full[y], percent):
                    forest.join(x, y)
        return _links(forest, cls)

    return _dealt(members, "family", "cls", BLOCK, "n").groupBy("cell").applyInArrow(compare, "a bigint, b bigint")


def confirmed(edges: DataFrame, texts: DataFrame, percent: int, width: int = 5) -> DataFrame:
    """Those of ``edges(a, b)`` that hold on the full sets; a task takes some 64 edges and the texts they need."""
    cells = max(1, -(-edges.count() // 64))
    placed = edges.withColumn("cell", F.pmod(F.xxhash64("a", "b"), F.lit(cells)))
    ends = placed.select("cell", F.col("a").alias("cls")).unionByName(placed.select("cell", F.col("b").alias("cls"))).distinct().join(texts, "cls")
    rows = ends.select("cell", "cls", "text", F.lit(None).cast("bigint").alias("b")).unionByName(placed.select("cell", F.col("a").alias("cls"), F.lit(None).cast("string").alias("text"), "b"))

    def check(table: pa.Table) -> pa.Table:
        edge = table.column("b").is_valid()
        own = table.filter(pc.invert(edge))
        full = dict(zip(own.column("cls").to_pylist(), _full(own, width)))
        pairs = zip(*(table.filter(edge).column(c).to_pylist() for c in ("cls", "b")))
        good = [(x, y) for x, y in pairs if _alike(full[x], full[y], percent)]
        return pa.table({c: pa.array([g[i] for g in good], pa.int64()) for i, c in enumerate("ab")})

    return rows.groupBy("cell").applyInArrow(check, "a bigint, b bigint")


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    values, before = distinct_per_text(*shingles(*words(data, offsets), width))
    return np.split(values, before[1:-1])


def _digests(values: np.ndarray, before: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(before[:-1].tolist(), before[1:].tolist())]


def with_digest(rows: DataFrame, width: int = 5) -> DataFrame:
    """``rows`` with ``digest``, the 128-bit digest of the row's shingle set; null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, limit=CHUNK):
            digest = _digests(*distinct_per_text(*shingles(*words(data, offsets), width)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digest, pa.binary())], [*part.schema.names, "digest"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("digest", BinaryType())]))


def classes(docs: DataFrame, percent: int = 85, width: int = 5, registers: int = REGISTERS) -> DataFrame:
    """``doc_id, n_shingles, digest, component`` of every row; rows without a set or an id have no component."""
    base = keep(sketched(docs, width, registers))
    firsts = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    sets = keep(firsts.withColumn("cls", F.monotonically_increasing_id()))
    edges = likely(sets, percent)
    family = components(edges).select(F.col("node").alias("cls"), F.col("component").alias("family"))
    size = family.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    member = keep(family.join(size, "family").join(sets, "cls").withColumn("root", F.col("cls")))
    wanted = docs.select("doc_id", "text").join(sent_if_few(member.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    found = with_digest(wanted.select("text"), width).groupBy("digest").agg(F.first("text").alias("text"))
    texts = keep(member.select("cls", "digest").join(found, "digest").select("cls", "text"))
    small, large = member.where(F.col("size") <= BLOCK), keep(member.where(F.col("size") > BLOCK))
    links = linked(small.join(texts, "cls"), percent, width)
    if not large.isEmpty():
        # The links that made a large family come first; only where they leave it in parts do its blocks meet.
        tried = edges.join(large.select(F.col("cls").alias("a")), "a", "left_semi")
        sure = keep(confirmed(tried, texts, percent, width))
        roots = components(sure).select(F.col("node").alias("cls"), F.col("component").alias("to"))
        rooted = keep(large.drop("root").join(roots, "cls", "left").withColumn("root", F.coalesce("to", "cls")).drop("to"))
        parted = rooted.groupBy("family").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("family")
        left = keep(rooted.join(parted, "family", "left_semi"))
        links = links.unionByName(sure)
        if not left.isEmpty():
            links = links.unionByName(linked(left.join(texts, "cls"), percent, width))
    joined = keep(components(keep(links, edges)), texts, large)
    least = sets.select("cls", "rep").join(joined.select(F.col("node").alias("cls"), F.col("component").alias("whole")), "cls")
    whole = least.groupBy("whole").agg(F.min("rep").alias("component"))
    placed = to_least(least.select(F.col("whole").alias("u"), F.col("cls").alias("v")), whole.select(F.col("whole").alias("u"), F.col("component").alias("m")))
    ends = sets.select("digest", "cls", "rep", "copies").join(placed.select(F.col("v").alias("cls"), F.col("m").alias("component")), "cls", "left")
    # A set of one row without links is its own component; only the others are looked up, copies of one set by several tasks.
    shared = ends.where("copies > 1 OR component IS NOT NULL").select(F.col("digest").alias("u"), F.coalesce("component", "rep").alias("m"))
    rows = base.select("doc_id", "n_shingles", "digest")
    able = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    found = to_least(rows.where(able).select(F.col("digest").alias("u"), F.col("doc_id").alias("v"), "n_shingles"), shared, "left")
    own = found.select(F.col("v").alias("doc_id"), "n_shingles", F.col("u").alias("digest"), F.coalesce("m", "v").alias("component"))
    return own.unionByName(rows.where(~able).withColumn("component", F.lit(None).cast(docs.schema["doc_id"].dataType)))


def deduplicate(docs: DataFrame, percent: int = 85, width: int = 5, registers: int = REGISTERS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text)``.

    Rows with equal sets are one class. Classes that share a bucket and are
    likely to be alike form families; a small family is compared in one task,
    a large one by the links that made it and, where these leave it in parts,
    in blocks. Tasks give back spanning forests, so no link found by the bands
    is left out and groups aren't expanded into rows of pairs. Rows are linked
    by their texts alone: rows that share an id but not a set are classes of
    their own. Null and empty texts are linked with nothing; so are rows
    without an id, whose component is null and which are not kept. Texts of
    any length are whole. An empty table gives an empty one.
    """
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return classes(docs, percent, width, registers).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85, width: int = 5, registers: int = REGISTERS) -> DataFrame:
    """Rows of ``docs`` with one document of each group of near-duplicates; columns stay, whatever their names.

    The row of the least id stays; of rows with equal ids and equal sets, one
    does. Rows that share an id but not a set are judged each. Rows without
    an id or without words all stay.
    """
    judged = keep(classes(docs, percent, width, registers).where("doc_id IS NOT NULL").withColumn("kept", F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True))))
    per_id = judged.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    odd = keep(per_id.where("NOT kept OR rows > 1").select(F.col("doc_id").alias("id"), "kept", "rows"))
    rows = docs.select(F.struct("*").alias("row"))
    single = rows.join(sent_if_few(odd.select("id")), F.col("row.doc_id") == F.col("id"), "left_anti")
    repeated = odd.where("kept AND rows > 1").select("id")
    if not repeated.isEmpty():
        several = rows.join(sent_if_few(repeated), F.col("row.doc_id") == F.col("id"), "left_semi")
        dealt = with_digest(several.select("row", F.col("row.text").alias("text")), width).withColumn("doc_id", F.col("row.doc_id"))
        worded = dealt.where("digest IS NOT NULL").join(judged.where("kept").select("doc_id", "digest").distinct(), ["doc_id", "digest"], "left_semi")
        single = single.unionByName(dealt.where("digest IS NULL").select("row")).unionByName(worded.dropDuplicates(["doc_id", "digest"]).select("row"))
    return single.select("row.*")
