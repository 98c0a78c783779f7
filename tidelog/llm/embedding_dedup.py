"""Near-duplicate vectors by collision counting over one-dimensional projections.

Vectors of a label are sorted along each of many random directions. A pair
collides on a direction if one lies in the window around the other. A pair at
the threshold collides on so many directions that a count can be set which all
but a stated share of such pairs reach; pairs that reach it are verified in
double precision. The first direction also says which strips of a label's
sorted vectors meet at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import keep
from tidelog.llm.components import components, to_least

DIRECTIONS = 48
#: Window half-width in distances of a pair at the threshold.
REACH = 1.6
#: Share of pairs at the threshold that may fail the count, and the strip test.
MISS = 1e-6
STRIP = 4096


def directions(dim: int, count: int = DIRECTIONS) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, count))


def distance_at(cosine: float) -> float:
    """Distance of unit vectors with that cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def calibrated_count(count: int = DIRECTIONS, reach: float = REACH, miss: float = MISS) -> int:
    """Collisions that a pair at the threshold has but with probability ``miss``: its difference on a direction is normal with its distance as deviation."""
    p = math.erf(reach / math.sqrt(2))
    total = 0.0
    for k in range(count + 1):
        total += math.comb(count, k) * p**k * (1 - p) ** (count - k)
        if total > miss:
            return k
    return count


def collisions(one: np.ndarray, two: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sets of projections whose windows hold each other on ``least`` directions or more.

    Projections are put on a grid of 1/4096, windows being widened by a step,
    so that a block's windows on a direction are one comparison of 16-bit
    integers: what lies below a window wraps around. Rows are taken in order of
    their first projection, so that blocks far apart on it aren't compared:
    windows of the share MISS leave out no more pairs than the count does.
    """
    found = []
    rows, columns = np.argsort(one[:, 0], kind="stable"), np.argsort(two[:, 0], kind="stable")
    span = half / REACH * math.sqrt(2) * _erfinv(1 - MISS)
    grid = lambda x: np.rint(np.clip(x, -7.9, 7.9) * 4096).astype(np.int16).T.copy()
    a, b, step = grid(one[rows]), grid(two[columns]), math.ceil(half * 4096) + 1
    low, line = b - np.int16(step), two[columns, 0]
    for r in range(0, len(rows), 256):
        r_end = min(r + 256, len(rows))
        begin = int(np.searchsorted(line, one[rows[r], 0] - span, "left"))
        end = int(np.searchsorted(line, one[rows[r_end - 1], 0] + span, "right"))
        for c in range(begin, end, 2048):
            c_end = min(c + 2048, end)
            count = np.zeros((r_end - r, c_end - c), np.uint8)
            apart = np.empty(count.shape, np.int16)
            for j in range(len(a)):
                np.subtract(a[j, r:r_end, None], low[j, None, c:c_end], out=apart)
                count += (apart.view(np.uint16) <= 2 * step).view(np.uint8)
            x, y = np.nonzero(count >= least)
            found.append((rows[r + x], columns[c + y]))
    return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(2))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: as many links as join anything."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _unit(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, whether each row has one); rows of another length than the first usable row's have none."""
    rows = batch_column.to_pylist()
    size = next((len(r) for r in rows if r), 0)
    good = np.array([bool(r) and len(r) == size and None not in r for r in rows], bool)
    out = np.zeros((len(rows), size))
    if good.any():
        out[good] = np.array([rows[i] for i in np.flatnonzero(good)], float)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        finite = np.isfinite(out).all(axis=1)
        out[~finite] = 0
        most = np.abs(out).max(axis=1, initial=0)
        good &= finite & (most > 0)
        out[good] /= most[good, None]
        out[good] /= np.sqrt((out[good] ** 2).sum(axis=1))[:, None]
    return out, good


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, dim, key, spot, unit`` of vectors that can be linked: ``key`` is the same for equal directions, ``spot`` the first projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) if x is not None else 0 for x in batch.column("embedding").to_pylist()])
            for d in np.unique(size[size > 0]):
                part = batch.filter(pa.array(size == d))
                unit, good = _unit(part.column("embedding"))
                part, unit = part.filter(pa.array(good)), unit[good]
                if len(unit):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id"), part.column("label"), pa.array(np.full(len(unit), d), pa.int32()), pa.array(unit @ directions(int(d), 1)[:, 0]), pa.array([u.tobytes() for u in unit], pa.binary())],
                        ["vec_id", "label", "dim", "spot", "unit"],
                    )

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    usable = vectors.select("vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return usable.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, spot double, unit binary")


def linked(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``.

    Vectors of equal non-null labels and equal lengths are linked at a cosine of
    the threshold or more in double precision. Equal unit vectors are one class
    and count as often as they occur. Null or zero vectors, vectors with null or
    non-finite components and rows without a label are linked with nothing; a
    row without an id has a null component and isn't kept. Rows that
    share an id and a label share the larger of their counts and the least
    component. Tasks compare two strips of a label and give back counts
    and a spanning forest, so a group of any size gives linear results.
    """
    rows = keep(prepared(vectors))
    # Classes are numbered: an id may stand in several of them.
    classes = keep(rows.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("spot").alias("spot")).withColumn("cls", F.monotonically_increasing_id()))
    # Strips of about STRIP classes: ranges of the first projection, cut where a label's counts say.
    cells = classes.withColumn("cell", F.floor(F.col("spot") * 256).cast("int"))
    per_cell = cells.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("spot").alias("lo"), F.max("spot").alias("hi"))
    run = Window.partitionBy("label", "dim").orderBy("cell")
    ranges = keep(per_cell.withColumn("strip", F.floor((F.sum("n").over(run) - F.col("n")) / STRIP).cast("int")))
    strips = ranges.groupBy("label", "dim", "strip").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    half = distance_at(threshold)
    span = half * math.sqrt(2) * _erfinv(1 - MISS)
    # A strip that one crowded cell fills is dealt into parts, each of which meets all parts.
    parts = strips.withColumn("p", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / (2 * STRIP)) - 1).cast("int"))))
    numbered = parts.select("label", "dim", "strip", "lo", "hi", "p", (F.col("strip") * F.lit(1 << 20) + F.col("p")).cast("bigint").alias("id"))
    one, two = numbered.alias("x"), numbered.alias("y")
    near = (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.id") <= F.col("y.id")) & (F.col("y.lo") - F.col("x.hi") <= span) & (F.col("x.lo") - F.col("y.hi") <= span)
    meetings = keep(one.join(two, near).select(F.col("x.label").alias("label"), F.col("x.dim").alias("dim"), F.col("x.id").alias("xi"), F.col("y.id").alias("yi")))
    placed = cells.join(ranges.select("label", "dim", "cell", "strip"), ["label", "dim", "cell"]).join(strips.select("label", "dim", "strip", "n"), ["label", "dim", "strip"])
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / (2 * STRIP))).cast("int")
    member = placed.select("label", "dim", "cls", "copies", "unit", (F.col("strip") * F.lit(1 << 20) + part).cast("bigint").alias("id"))
    left = meetings.select("label", "dim", "xi", "yi", F.col("xi").alias("id"), F.lit(0).alias("side"))
    right = meetings.where("xi < yi").select("label", "dim", "xi", "yi", F.col("yi").alias("id"), F.lit(1).alias("side"))
    dealt = member.join(left.unionByName(right), ["label", "dim", "id"]).select("label", "dim", "xi", "yi", "side", "cls", "copies", "unit")
    least = calibrated_count()

    def compare(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        side = table.column("side").to_numpy()
        cls, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), float).reshape(-1, dim)
        order = np.lexsort((cls, side))
        side, cls, copies, unit = side[order], cls[order], copies[order], unit[order]
        cut = int((side == 0).sum())
        spots = (unit @ directions(dim)).astype(np.float32)
        same = cut == len(side)
        two = slice(0, cut) if same else slice(cut, None)
        a, b = collisions(spots[:cut], spots[two], REACH * half + 1e-5, least)
        b = b + (0 if same else cut)
        use = (a < b) if same else np.ones(len(a), bool)
        a, b = a[use], b[use]
        good = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        a, b = a[good], b[good]
        links = np.bincount(a, copies[b], len(cls)) + np.bincount(b, copies[a], len(cls))
        tree = _forest(a, b, len(cls))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.array([*cls[some].tolist(), *(int(cls[x]) for x, _ in tree)], pa.int64()),
                "b": pa.array([*([None] * len(some)), *(int(cls[y]) for _, y in tree)], pa.int64()),
                "n": pa.array([*links[some].astype(np.int64).tolist(), *([None] * len(tree))], pa.int64()),
            }
        )

    found = keep(dealt.groupBy("label", "dim", "xi", "yi").applyInArrow(compare, "a bigint, b bigint, n bigint"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    roots = keep(classes.select(F.col("cls").alias("v"), "rep").join(joined.select(F.col("node").alias("v"), F.col("component").alias("u")), "v"))
    placed = to_least(roots.select("u", "v"), roots.groupBy("u").agg(F.min("rep").alias("m"))).select(F.col("v").alias("cls"), F.col("m").alias("component"))
    ends = classes.join(counts, "cls", "left").join(placed, "cls", "left")
    by_class = ends.select("label", "dim", "unit", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    known = rows.join(by_class, ["label", "dim", "unit"]).groupBy("vec_id", "label").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    all_rows = vectors.select("vec_id", "label")
    out = all_rows.join(known, ["vec_id", "label"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _erfinv(y: float) -> float:
    low, high = 0.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid) < y else (low, mid)
    return high
