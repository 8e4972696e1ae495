"""Approximate nearest neighbours on shifted Hilbert curves."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import bounded_batches, cut

#: Curves, projected dimensions and bits of each on a curve, and the seed of projections and shifts.
CURVES, DIMENSIONS, BITS, SEED = 8, 3, 16, 6007
#: Share of the true nearest that the windows are made for, queries on which that is measured, and quantiles of a curve.
RECALL, SAMPLE, QUANTILES = 0.93, 128, 4096
#: Blocks in half a window, the least number of blocks on a curve, and rows of a task's group.
BLOCKS_OF_WINDOW, LEAST_BLOCKS, GROUP_ROWS = 4, 16, 8192
#: Queries that meet a group at once.
GROUP_QUERIES = 8192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows x dimensions) with coordinates of ``bits`` bits."""
    axes = cells.astype(np.uint64).T.copy()
    top = np.uint64(1 << (bits - 1))
    mask = top
    while mask > 1:  # undo rotations and reflections from the largest cells down
        low = mask - np.uint64(1)
        for axis in axes:
            swapped = np.where(axis & mask, np.uint64(0), (axes[0] ^ axis) & low)
            axes[0] ^= np.where(axis & mask, low, swapped)
            axis ^= swapped
        mask >>= np.uint64(1)
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flip, mask = np.zeros(axes.shape[1], np.uint64), top
    while mask > 1:
        flip ^= np.where(axes[-1] & mask, mask - np.uint64(1), np.uint64(0))
        mask >>= np.uint64(1)
    axes ^= flip
    key = np.zeros(axes.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << np.uint64(1) | axis >> np.uint64(bit) & np.uint64(1)
    return key.astype(np.int64)


class Curves:
    """Random projections of ``width`` components, each with a shift; fitted to the spread of the data."""

    def __init__(self, width: int, curves: int, dimensions: int, seed: int) -> None:
        random = np.random.default_rng(seed)
        k = min(dimensions, width)
        self.axes = np.stack([np.linalg.qr(random.normal(size=(width, k)))[0] for _ in range(curves)])
        self.shifts = random.uniform(0, 1, (curves, k))
        self.mean, self.spread = np.zeros((curves, k)), np.ones((curves, k))

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nw,cwk->nck", x, self.axes, optimize=True)

    def fit(self, n: int, total: np.ndarray, squares: np.ndarray) -> None:
        self.mean = total / max(1, n)
        self.spread = np.sqrt(np.maximum(squares / max(1, n) - self.mean**2, 1e-24))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Rows x curves: even in each dimension for normal data, shifted, then placed on the curve."""
        even = 1 / (1 + np.exp(-1.702 * np.clip((self.project(x) - self.mean) / self.spread, -12, 12)))
        cells = ((even + self.shifts) / 2 * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
        return np.stack([hilbert_keys(cells[:, c], BITS) for c in range(cells.shape[1])], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """If a vector takes part: not null, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _spread(ids: np.ndarray) -> np.ndarray:
    """A hash of ids, which may all be multiples of something."""
    mixed = np.asarray(ids, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(33)).astype(np.int64)


def _keys(column: pa.Array, curves: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), curves)


class CurveIndex:
    """Curves cut into blocks of about equal size, and which blocks a query of each block looks into.

    ``half_window`` is the share of all points on either side of a query's place that it looks at, but at least
    ``least`` points. What it holds has at most QUANTILES entries for each curve.
    """

    def __init__(self, place: Curves, quantiles: list[np.ndarray], half_window: float) -> None:
        self.place, self.half_window, self.curves = place, half_window, len(quantiles)
        blocks = int(min(QUANTILES, max(LEAST_BLOCKS, BLOCKS_OF_WINDOW / max(half_window, 1e-9))))
        at = np.unique((np.arange(1, blocks) * QUANTILES // blocks).clip(1, QUANTILES - 1)) - 1
        self.cuts = [np.unique(q[at[at < len(q)]]) for q in quantiles]
        self.held: dict[tuple[int, int], int] = {}
        self.windows: dict[tuple[int, int], list[int]] = {}
        self.deals: dict[tuple[int, int], int] = {}

    def blocks(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, keys[:, c], side="right") for c, cuts in enumerate(self.cuts)], axis=1).astype(np.int32)

    def open_windows(self, held: dict[tuple[int, int], int], n_points: int, least: int) -> None:
        """``held`` is the number of points of each (curve, block)."""
        self.held, reach = held, max(least, ceil(self.half_window * n_points))
        self.deals = {at: ceil(n / GROUP_ROWS) for at, n in held.items()}
        for c, b in {(c, b) for c in range(self.curves) for b in range(len(self.cuts[c]) + 1)}:
            wanted = [b]
            for step in (-1, 1):
                at, seen = b + step, 0
                while 0 <= at <= len(self.cuts[c]) and seen < reach:
                    wanted.append(at)
                    seen += held.get((c, at), 0)
                    at += step
            self.windows[c, b] = [at for at in wanted if (c, at) in held]

    def distances(self) -> float:
        """Distances that a query computes, on average over all points, as a share of their number."""
        total = sum(n for (c, _), n in self.held.items() if c == 0)
        met = sum(n * sum(self.held[c, other] for other in self.windows[c, b]) for (c, b), n in self.held.items())
        return met / max(1, total) ** 2


def _half_window(points: DataFrame, asking: DataFrame, place: Curves, quantiles: list[np.ndarray], k: int, recall: float) -> float:
    """The half window in which ``recall`` of the true ``k`` nearest of a sample of queries lie on some curve.

    The sample is the SAMPLE queries first by a hash of their ids; each is compared with all points, which takes a
    bounded time for each point. A place on a curve is known to a quantile.
    """
    rows = asking.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not rows:
        return 0.0
    asked = np.array([r["vector"] for r in rows], np.float64)

    def nearest_of_part(batches):
        best = [(np.empty(0), np.empty((0, len(quantiles)), np.int64))] * len(asked)  # distances and keys
        for batch in batches:
            if len(batch):
                x, keys = np.stack(batch["vector"]).astype(np.float64), np.stack(batch["keys"])
                squares = np.maximum((asked**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * asked @ x.T, 0)
                for i, row in enumerate(squares):
                    row[(x == asked[i]).all(axis=1)] = np.inf
                    near = np.argpartition(row, min(k, len(row) - 1))[:k]
                    near = near[np.isfinite(row[near])]
                    away, at = np.concatenate([best[i][0], row[near]]), np.concatenate([best[i][1], keys[near]])
                    first = np.argsort(away, kind="stable")[:k]
                    best[i] = (away[first], at[first])
        for i, (away, at) in enumerate(best):
            if len(away):
                yield pd.DataFrame({"i": i, "away": away, "places": at.tolist()})

    found = points.select("vector", "keys").mapInPandas(nearest_of_part, "i int, away double, places array<long>")
    first = F.row_number().over(Window.partitionBy("i").orderBy("away", "places"))
    true = found.withColumn("nth", first).where(F.col("nth") <= k).select("i", "places").collect()  # SAMPLE x k rows
    if not true:
        return 0.0
    share = lambda keys: np.stack([np.searchsorted(q, keys[:, c], side="right") / (len(q) + 1) for c, q in enumerate(quantiles)], axis=1)
    own = share(place.keys(asked))[[r["i"] for r in true]]
    needed = np.abs(own - share(np.array([r["places"] for r in true], np.int64))).min(axis=1)
    return float(np.quantile(needed, recall)) + 1 / QUANTILES


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    curves: int = CURVES,
    dimensions: int = DIMENSIONS,
    recall: float = RECALL,
    half_window: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id and score: up to ``k`` near rows of each row where ``is_query`` is true.

    Every usable vector is projected for each curve, shifted and placed on a Hilbert curve. Each curve is
    range-partitioned into blocks of about equal size. A query goes to the blocks around its place that hold
    ``half_window`` of all points on either side, ``k`` + 1 at least; each block returns the nearest of its rows, by
    distances in double precision on the original vectors, and the curves' answers merge. Ties go to the smaller
    vec_id, and a query is no answer to itself. Where ``half_window`` isn't given it is measured: a bounded sample of
    queries is compared with all points, and the windows are as wide as ``recall`` of their neighbours need. So
    vectors that lie in clusters have narrow windows, and vectors that fill the space evenly, which no ordering keeps
    together, have wide ones; ``CurveIndex.distances`` tells how much of a scan that is.

    Equal vectors are one point with their ``k`` + 1 smallest ids, which are all that can be answers, so copies
    fill no window. Large blocks are dealt into groups of bounded size, and queries into chunks, so no group
    grows with the data; what is broadcast is the blocks' bounds, at most QUANTILES for each curve. Vectors that are
    null, zero, hold null or non-finite components, or have another width than most take no part, neither as queries
    nor as answers. A null vec_id takes no part. A repeated vec_id counts once with each vector it has. With no
    usable vector the result is empty.
    """
    spark = vectors.sparkSession
    whole = bounded_batches(vectors).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).where(usable(F.col("vector")) & F.col("id").isNotNull())
    sizes = whole.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    whole = whole.where(F.size("vector") == sizes["width"])
    index, points = build(whole, k, sizes["width"], curves, dimensions, recall, half_window, seed)
    return search(index, points, whole.where("asks").select("id", "vector").distinct(), k)


def build(whole: DataFrame, k: int, width: int, curves: int, dimensions: int, recall: float, half_window: float | None, seed: int) -> tuple[CurveIndex, DataFrame]:
    """The index of the usable vectors ``whole`` (id, vector, asks), and its points: vector, ids, point and keys."""
    place = Curves(width, curves, dimensions, seed)

    def moments(batches):
        n, total, squares = 0, 0, 0
        for batch in batches:
            y = place.project(np.stack(batch["vector"]).astype(np.float64)) if len(batch) else np.zeros((0, 1, 1))
            n, total, squares = n + len(y), total + y.sum(axis=0), squares + (y**2).sum(axis=0)
        if n:
            both = np.stack([total, squares]).ravel()
            yield pd.DataFrame({"n": n, "at": np.arange(len(both)), "value": both})

    summed = whole.select("vector").mapInPandas(moments, "n long, at int, value double").groupBy("at").agg(F.sum("n"), F.sum("value")).orderBy("at").collect()
    total, squares = np.array([r[2] for r in summed]).reshape(2, curves, -1)
    place.fit(summed[0][1], total, squares)

    smallest = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    points = (
        whole.select("vector", "id")
        .withColumn("n", smallest)
        .where(F.col("n") <= k + 1)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )
    points = cut(points.withColumn("keys", _on_curves(place, curves)(F.col("vector"))).withColumn("point", F.col("ids")[0]))
    n_points = points.count()
    marks = [i / QUANTILES for i in range(1, QUANTILES)]
    by_curve = points.select(F.posexplode("keys").alias("curve", "key")).groupBy("curve").agg(F.percentile_approx("key", marks, 4 * QUANTILES).alias("q"))
    quantiles = [np.array(row["q"], np.int64) for row in by_curve.orderBy("curve").collect()]
    if half_window is None:
        half_window = _half_window(points, whole.where("asks").select("id", "vector"), place, quantiles, k, recall)
    index = CurveIndex(place, quantiles, half_window)

    @F.arrow_udf("array<int>")
    def blocks_of(column: pa.Array) -> pa.Array:
        found = index.blocks(_keys(column, curves))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * curves, pa.int32()), pa.array(found.ravel()))

    points = points.withColumn("blocks", blocks_of(F.col("keys")))
    counted = points.select(F.posexplode("blocks").alias("curve", "block")).groupBy("curve", "block").count().collect()  # a row for each block
    index.open_windows({(row["curve"], row["block"]): row["count"] for row in counted}, n_points, k + 1)
    return index, points


def _on_curves(place: Curves, curves: int):
    @F.arrow_udf("array<long>")
    def on_curves(column: pa.Array) -> pa.Array:
        found = place.keys(_matrix(column)) if len(column) else np.empty((0, curves), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * curves, pa.int32()), pa.array(found.ravel()))

    return on_curves


def search(index: CurveIndex, points: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the queries ``asking`` (id, vector)."""
    curves = index.curves
    widest = max((sum(index.deals[c, other] for other in at) / max(1, sum(index.deals[x] for x in index.deals if x[0] == c)) for (c, _), at in index.windows.items()), default=0.0)
    chunks = max(1, ceil(asking.count() * widest / GROUP_QUERIES))
    group_type = pa.list_(pa.struct([("curve", pa.int32()), ("block", pa.int32()), ("deal", pa.int32()), ("chunk", pa.int32())]))
    group_kind = "array<struct<curve:int,block:int,deal:int,chunk:int>>"

    @F.arrow_udf(group_kind)
    def homes(ids: pa.Array, column: pa.Array) -> pa.Array:
        drawn = _spread(ids.to_numpy(zero_copy_only=False)).tolist()
        rows = zip(drawn, _keys(column, curves).tolist())
        return pa.array(
            [[{"curve": c, "block": b, "deal": i % index.deals[c, b], "chunk": x} for c, b in enumerate(at) for x in range(chunks)] for i, at in rows], group_type
        )

    @F.arrow_udf(group_kind)
    def visits(ids: pa.Array, column: pa.Array) -> pa.Array:
        drawn = _spread(ids.to_numpy(zero_copy_only=False)).tolist()
        found = []
        for i, row in zip(drawn, index.blocks(_keys(column, curves)).tolist()):
            found.append(
                [
                    {"curve": c, "block": other, "deal": d, "chunk": i % chunks}
                    for c, b in enumerate(row)
                    for other in index.windows.get((c, b), [])
                    for d in range(index.deals[c, other])
                ]
            )
        return pa.array(found, group_type)

    spread = points.select("point", "ids", "vector", F.explode(homes("point", "blocks")).alias("g")).select("point", "ids", "vector", "g.*")
    asked = (
        asking.withColumn("keys", _on_curves(index.place, curves)(F.col("vector")))
        .select("id", "vector", F.explode(visits("id", "keys")).alias("g"))
        .select("id", "vector", "g.*")
    )

    def best_here(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = {"query_id": [], "point": [], "ids": [], "score": []}
        if len(left) and len(right):
            x = np.stack(left["vector"]).astype(np.float64)
            q = np.stack(right["vector"]).astype(np.float64)
            point, ids, asker = left["point"].to_numpy(), left["ids"].to_numpy(), right["id"].to_numpy()
            norms = (x**2).sum(axis=1)
            last = min(k, len(x) - 1)
            for start in range(0, len(q), 256):
                part = q[start : start + 256]
                near = norms - 2 * (part @ x.T)  # all up to the last that counts, with what rounding may hide; then exactly
                bound = np.partition(near, last, axis=1)[:, last] + 1e-10 * (norms.max() + (part**2).sum(axis=1))
                for i in range(len(near)):
                    row = np.nonzero(near[i] <= bound[i])[0]
                    exact = np.sqrt(((x[row] - q[start + i]) ** 2).sum(axis=1))
                    order = np.lexsort((point[row], exact))[: k + 1]
                    columns["query_id"] += [asker[start + i]] * len(order)
                    columns["point"] += point[row[order]].tolist()
                    columns["ids"] += [list(ids[j]) for j in row[order]]
                    columns["score"] += exact[order].tolist()
        columns["ids"] = pd.Series(columns["ids"], dtype=object)  # also where a group has no queries
        return pd.DataFrame(columns)

    group = ["curve", "block", "deal", "chunk"]
    found = spread.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(best_here, "query_id long, point long, ids array<long>, score double")
    merged = found.dropDuplicates(["query_id", "point", "score"])
    answers = merged.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
