"""Filling containers of fixed capacity with items of varying size.

Only the histogram of sizes is planned, never the items: it has at most ``capacity`` sizes, so the plan's
cost does not depend on the corpus. Patterns of few documents that fill a container exactly are
enumerated, repeat counts are fitted to the histogram by non-negative least squares and rounded, and what
is left is packed best fit first, size by size. Items then find their container by their rank within
their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut

#: Ranks within a size are counted in at least so many independent parts, and in two for each core of the cluster: a size
#: shared by a third of all items is no one task's.
SALTS = 64
#: Steps of the capacity at which threes are looked for: above it the two larger ones are multiples of a step.
GRID = 2048


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Items: whole documents, or those above the capacity cut into full pieces and a rest."""
    last = F.greatest(F.ceil(F.col(size) / F.lit(capacity)), F.lit(1)).cast("int") - 1
    one = F.posexplode(F.sequence(F.lit(0), last)).alias("piece", "_p")
    return (
        sizes.select(key, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size))
        .select(key, size, one)
        .select(key, "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("start"), F.least(F.lit(capacity), F.col(size) - F.col("piece") * capacity).cast("int").alias("size"))
    )


def patterns(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Patterns ``((size, times), ...)`` that fill a container exactly with sizes that occur.

    Up to three documents, those of an eighth of the capacity or more, and repeats of one size with at
    most one other. Sums are looked up in the histogram, and beyond a capacity of GRID the two larger of three documents
    are taken in steps, so there are at most GRID * GRID / 2 threes whatever the capacity.
    """
    there = np.flatnonzero(hist[: capacity + 1])
    there = there[there > 0]
    out: set[tuple[tuple[int, int], ...]] = set()
    most = capacity // there if len(there) else there
    size, times = np.repeat(there, most), np.concatenate([np.arange(1, m + 1) for m in most]) if len(there) else there
    rest = capacity - size * times
    for s, k in zip(size[rest == 0].tolist(), times[rest == 0].tolist()):
        out.add(((s, k),))
    good = (rest > 0) & (hist[rest] > 0) & (size * times >= capacity // 8)
    for s, k, r in zip(size[good].tolist(), times[good].tolist(), rest[good].tolist()):
        out.add(((s, k + 1),) if s == r else tuple(sorted(((s, k), (r, 1)), reverse=True)))
    step = -(-capacity // GRID)
    large = there[(there >= capacity // 8) & (there % step == 0)]
    for a in large.tolist():
        b = large[(large <= a) & (2 * large >= capacity - a) & (large < capacity - a)]
        for y, z in zip(b.tolist(), (capacity - a - b).tolist()):
            if hist[z] > 0:
                n: dict[int, int] = {}
                for s in (a, y, z):
                    n[s] = n.get(s, 0) + 1
                out.add(tuple(sorted(n.items(), reverse=True)))
    return sorted(out)


def nnls(pats: list[tuple[tuple[int, int], ...]], hist: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with A x close to the histogram: accelerated projected gradient on scaled columns."""
    col = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    row = np.array([s for p in pats for s, _ in p])
    val = np.array([k for p in pats for _, k in p], dtype=float)
    weight = np.sqrt(np.arange(len(hist)) / max(1, len(hist) - 1))  # what is left of long items costs most
    val *= weight[row]
    norm = np.sqrt(np.bincount(col, val * val, minlength=len(pats)))
    val /= norm[col]
    h = hist * weight
    forward = lambda x: np.bincount(row, val * x[col], minlength=len(hist))
    back = lambda r: np.bincount(col, val * r[row], minlength=len(pats))
    v = np.ones(len(pats))
    for _ in range(30):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    lip = float(v @ back(forward(v))) * 1.05
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - h) / lip)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x / norm


def plan(hist: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Containers as ``({size: times}, repeats)``; every item of the histogram is in one, none above the capacity.

    Few items, or sizes that hardly ever add up, can leave so much after rounding that best fit alone needs
    fewer containers; the smaller plan is taken.
    """
    fitted, alone = fit_patterns(hist, capacity), best_fit(hist.astype(np.int64).copy(), capacity)
    return min((fitted, alone), key=lambda p: sum(n for _, n in p))


def fit_patterns(hist: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fitted and rounded patterns, then best fit for what is left."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    pats = patterns(left, capacity)
    if pats:
        x = nnls(pats, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            n = min(int(np.rint(x[i])), *(int(left[s]) // k for s, k in pats[i]))
            if n > 0:
                for s, k in pats[i]:
                    left[s] -= n * k
                out.append((dict(pats[i]), n))
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing over sizes, many equal containers at a time."""
    room: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    for s in range(min(capacity, len(left) - 1), 0, -1):
        n = int(left[s])
        space = s
        while n > 0:
            while space <= capacity and not room[space]:
                space += 1
            if space > capacity:
                k = capacity // s
                if n >= k:
                    room[capacity - k * s].append(({s: k}, n // k))
                    n %= k
                if n:
                    room[capacity - n * s].append(({s: n}, 1))
                    n = 0
                break
            held, many = room[space].pop()
            k = space // s
            take = min(many, n // k)
            if take == 0:
                k, take = n, 1
            if take < many:
                room[space].append((held, many - take))
            room[space - k * s].append((held | {s: held.get(s, 0) + k}, take))
            n -= k * take
    return [x for r in room for x in r]


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``(key, piece, start, size, container, place)``: every item with its container and its place in it.

    A document above the capacity is cut into full pieces and a rest; no other is split. Items of size 0
    need no room: their container and place are null. Null sizes count as 0. Repeated keys are separate
    items.
    """
    spark = sizes.sparkSession
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    salts = max(SALTS, 2 * spark.sparkContext.defaultParallelism)
    salt = F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int")
    items = cut(pieces(sizes, key, size, capacity).withColumn("_salt", salt))
    # At most capacity x salts rows, however many items there are.
    counted = items.filter("size > 0").groupBy("size", "_salt").count().toPandas().sort_values(["size", "_salt"])
    hist = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(hist, counted["size"].to_numpy(dtype=int), counted["count"].to_numpy(dtype=np.int64))
    offset = np.zeros((capacity + 1, salts), dtype=np.int64)
    offset[counted["size"].to_numpy(dtype=int), counted["_salt"].to_numpy(dtype=int)] = counted["count"].to_numpy(dtype=np.int64)
    offset = np.cumsum(offset, axis=1) - offset
    runs: list[tuple[int, int, int, int, int]] = []  # size, first rank, first container, items a container, place of the first
    used, base = np.zeros(capacity + 1, dtype=np.int64), 0
    for held, many in plan(hist, capacity):
        place = 0
        for s, k in sorted(held.items(), reverse=True):
            runs.append((s, int(used[s]), base, k, place))
            used[s] += many * k
            place += s * k
        base += many
    r = np.array(sorted(runs) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    shared = spark.sparkContext.broadcast((r, offset))
    rank = F.row_number().over(W.partitionBy("size", "_salt").orderBy(key, "piece")) - 1
    kind = sizes.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, offset = shared.value
        starts = (r[:, 0] << 44) + r[:, 1]
        for b in batches:
            s = b.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
            n = offset[s, b.column("_salt").to_numpy(zero_copy_only=False)] + b.column("_rank").to_numpy(zero_copy_only=False)
            at = np.maximum(np.searchsorted(starts, (s << 44) + n, side="right") - 1, 0)
            n = n - r[at, 1]
            none = s == 0
            container, place = r[at, 2] + n // r[at, 3], r[at, 4] + n % r[at, 3] * s
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("piece"), b.column("start"), b.column("size"), pa.array(container, pa.int64(), mask=none), pa.array(place, pa.int32(), mask=none)],
                names=[key, "piece", "start", "size", "container", "place"],
            )

    return items.withColumn("_rank", rank).mapInArrow(work, f"`{key}` {kind}, piece int, start bigint, size int, container bigint, place int")
