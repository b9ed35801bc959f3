"""Neighbour graphs as edge tables (src, dst, …) and what is computed on them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.model import div0
from cellgrid.operators.stats import digamma, lgamma

#: Points in a block of the exact neighbour search.
BLOCK = 1024


def exact_knn(points: DataFrame, queries: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """(src, dst, d, rank): the k nearest points of each query other than itself, by Euclidean distance; ties by id.

    Both sides are dealt into blocks and each query block meets each point block once, in numpy;
    only the k best of a block pair leave it, and a window keeps the k best of all. This is the
    exact, quadratic search for queries that are a stated set or for tables of modest size.
    """
    n = blocks or max(1, points.count() // BLOCK)
    pack = lambda df, name, prefix: df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(prefix)).agg(F.collect_list(F.struct("id", "v")).alias(name))
    left = pack(queries, "q", "bq")
    right = pack(points, "p", "bp")
    # Blocks are repeated, not pairs of points: each block of queries is sent once to each block of points.
    met = left.withColumn("bp", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(right, "bp").select("q", "p")

    return _closest(met, k)


def _closest(met: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query from rows (q, p) of a block of queries and a block of points."""

    def nearest(frames):
        for frame in frames:
            out = []
            for q, p in zip(frame["q"], frame["p"], strict=True):
                qi, pi = np.array([x["id"] for x in q]), np.array([x["id"] for x in p])
                qv, pv = np.array([x["v"] for x in q], float), np.array([x["v"] for x in p], float)
                square = np.maximum((qv**2).sum(1)[:, None] + (pv**2).sum(1)[None, :] - 2 * qv @ pv.T, 0)
                square[qi[:, None] == pi[None, :]] = np.inf
                near = np.argsort(square, axis=1, kind="stable")[:, : k + 8]
                for at in range(0, len(near), 128):
                    own = near[at : at + 128]
                    exact = np.sqrt(((pv[own] - qv[at : at + 128, None, :]) ** 2).sum(2))
                    other = np.isfinite(np.take_along_axis(square[at : at + 128], own, 1))
                    src = np.repeat(qi[at : at + 128], own.shape[1]).reshape(own.shape)
                    out.append(pd.DataFrame({"src": src[other], "dst": pi[own][other], "d": exact[other]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    found = met.mapInPandas(nearest, "src long, dst long, d double")
    order = Window.partitionBy("src").orderBy(F.round("d", 9), "dst")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Points that a cell of the approximate search is meant to hold, its most cells, and how many cells a query looks into at least.
CELL_POINTS, MOST_CELLS, PROBES = 256, 4096, 16
#: Queries, the first by hash, whose true neighbours say how many cells it takes, and the share of them that must lie in those.
MEASURED, RECALL = 256, 0.95


def cell_centres(points: DataFrame, n: int, cells: int, rounds: int = 4) -> np.ndarray:
    """Centres of a sample of at most 32 points a cell, chosen by hash, after a few rounds of means."""
    some = points.orderBy(F.xxhash64("id"), "id").limit(min(n, 32 * cells)).select("v").toPandas()
    return cell_centres_of(np.array(some["v"].tolist(), float), cells, rounds)


def cell_centres_of(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    centres = sample[:cells].copy()
    for _ in range(rounds):
        own = nearest_centres(sample, centres, 1)[:, 0]
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(0)
    return centres


def nearest_centres(values: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(values), k), np.int64)
    step = max(1, 4_000_000 // len(centres))
    for at in range(0, len(values), step):
        part = values[at : at + step]
        square = (centres**2).sum(1)[None, :] - 2 * part @ centres.T
        out[at : at + step] = square.argmin(1)[:, None] if k == 1 else np.argsort(square, axis=1, kind="stable")[:, :k]
    return out


def needed_probes(placed: DataFrame, queries: DataFrame, centres: np.ndarray, k: int) -> int:
    """How many of the nearest cells hold the share ``RECALL`` of the true neighbours of ``MEASURED`` queries.

    Those queries, a bounded set, meet all points in one pass; each task leaves its k nearest of each.
    """
    some = queries.orderBy(F.xxhash64("id"), "id").limit(MEASURED).select("id", F.col("v").cast("array<double>").alias("v")).toPandas()
    if not len(some):
        return PROBES
    ids, values = some["id"].to_numpy(), np.array(some["v"].tolist(), float)
    sent = placed.sparkSession.sparkContext.broadcast((ids, values))

    def best(frames):
        ids, values = sent.value
        for frame in frames:
            if len(frame):
                pi, cell, pv = frame["id"].to_numpy(), frame["cell"].to_numpy(), np.array(frame["v"].tolist(), float)
                square = (values**2).sum(1)[:, None] + (pv**2).sum(1)[None, :] - 2 * values @ pv.T
                square[ids[:, None] == pi[None, :]] = np.inf
                near = np.argsort(square, axis=1, kind="stable")[:, :k]
                at = np.repeat(np.arange(len(ids)), near.shape[1])
                own = square[at, near.ravel()]
                found = pd.DataFrame({"q": at, "dst": pi[near.ravel()], "cell": cell[near.ravel()], "d": own})
                yield found[np.isfinite(own)]

    order = Window.partitionBy("q").orderBy("d", "dst")
    found = placed.mapInPandas(best, "q long, dst long, cell long, d double").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = found.select("q", "cell").toPandas()  # at most MEASURED times k rows
    if not len(found):
        return PROBES
    places = np.argsort(nearest_centres(values, centres, len(centres)), axis=1)
    ranks = np.sort(places[found["q"], found["cell"]])
    return int(ranks[math.ceil(RECALL * len(ranks)) - 1]) + 1


def approximate_knn(points: DataFrame, queries: DataFrame, k: int, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """(src, dst, d, rank): k near points of each query, found in the ``probes`` cells whose centres are nearest to it.

    Points are dealt to the nearest of a bounded number of centres. A cell that holds many points
    is dealt on into blocks, so a dense spot is no large task. With as many probes as cells the
    search is exact; its cost grows with the points times the points of the probed cells.

    Without ``probes`` their number is measured (``needed_probes``), as vectors of many independent
    dimensions have near ones in most cells. Where it takes more than ``PROBES``, near cells are put
    together into groups of about ``BLOCK`` points, and a query is sent once to each group that has
    a cell of its: it then meets more points than those of its cells, and no more rows are moved
    than by the exact search.
    """
    n = points.count()
    cells = cells or int(min(MOST_CELLS, max(1, n // CELL_POINTS)))
    found = cell_centres(points, n, cells)
    cells = len(found)
    centres = points.sparkSession.sparkContext.broadcast(found)  # at most MOST_CELLS vectors

    def assigned(df: DataFrame, count: int, group: np.ndarray) -> DataFrame:
        def run(frames):
            for frame in frames:
                if len(frame):
                    near = group[nearest_centres(np.array(frame["v"].tolist(), float), centres.value, count)]
                    yield frame.assign(cells=[np.unique(x) for x in near])

        return df.select("id", F.col("v").cast("array<double>").alias("v")).mapInPandas(run, "id long, v array<double>, cells array<long>")

    group = np.arange(cells)
    place = lambda: assigned(points, 1, group).select("id", "v", F.col("cells")[0].alias("cell"))
    if probes is None:
        probes = max(PROBES, needed_probes(place(), queries, found, k) if PROBES < cells else 0)
        if PROBES < probes:
            group = nearest_centres(found, cell_centres_of(found, max(1, n // BLOCK)), 1)[:, 0]
    probes = min(probes, cells)
    placed = place()
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # one row a cell
    right = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")))
    right = right.groupBy("cell", "block").agg(F.collect_list(F.struct("id", "v")).alias("p"))
    asked = assigned(queries, probes, group).select("id", "v", F.explode("cells").alias("cell"))
    parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    left = asked.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit(6)), F.col("parts")))
    left = left.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v")).alias("q"))
    return _closest(left.join(right, "cell").select("q", "p"), k)


#: Points in a block of the pruned search, its most leaves, and queries times neighbours that one group of its tasks holds.
RANGE_BLOCK, MOST_LEAVES, GROUP_VALUES = 2048, 4096, 4_000_000
#: Blocks of points that a task meets at a time.
CHUNK_BLOCKS = 128


def cut_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and places of the cuts of a tree of ``depth`` levels, in the order of a heap: each halves the different points of its part along the axis on which they differ most."""
    axis, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
    parts = {0: np.unique(sample, axis=0)}
    for node in range(len(axis)):
        part = parts.pop(node)
        if len(part) > 1:
            axis[node] = part.var(0).argmax()
            x = part[:, axis[node]]
            cut[node] = np.median(x)
            if cut[node] == x.max():  # else nothing would lie beyond it
                cut[node] = x[x < cut[node]].max(initial=x.min())
        over = part[:, axis[node]] > cut[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[~over], part[over]
    return axis, cut


def leaves(values: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node = np.zeros(len(values), np.int64)
    for _ in range(int(len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (values[np.arange(len(values)), axis[node]] > cut[node])
    return node - len(axis)


class Nearest:
    """The ``k`` nearest of some queries, of the blocks of points met so far: all at distances, to nine digits, up to the k-th."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, values: np.ndarray, k: int):
        # One place more than asked for, as a query meets itself.
        self.ids, self.first, self.values, self.k = ids, first, values, k + 1
        self.norm, self.low, self.high = (values**2).sum(1), values.min(0), values.max(0)
        self.narrow = np.column_stack([values, np.ones(len(values))]).astype(np.float32)
        self.bound = np.full(len(values), np.inf)
        self.found, self.fresh = [(np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, np.int64))], 0

    def meet(self, blocks: list[tuple], low: np.ndarray, high: np.ndarray) -> None:
        """Blocks (ids, first, values, their narrow form, largest norm), the nearest first."""
        gap = (np.maximum(np.maximum(low - self.high, self.low - high), 0) ** 2).sum(1)
        for b in np.argsort(gap, kind="stable"):
            if np.sqrt(gap[b]) > self.bound.max() + 1e-8:
                break
            ids, first, values, narrow, most = blocks[b]
            away = np.sqrt((np.maximum(np.maximum(low[b] - self.values, self.values - high[b]), 0) ** 2).sum(1))
            rows = np.flatnonzero(away <= self.bound + 1e-8)
            if not len(rows):
                continue
            # Squared distances less the query's own norm; in short numbers, so with a margin for what they lack.
            square = self.narrow[rows] @ narrow
            margin = 1e-5 * (self.norm[rows] + most) + 1e-12
            limit = (self.bound[rows] + 1e-8) ** 2
            new = np.flatnonzero(np.isinf(limit))
            if len(new) and len(values) >= self.k:
                limit[new] = np.partition(square[new], self.k - 1, axis=1)[:, self.k - 1] + self.norm[rows[new]] + 2 * margin[new]
            r, c = divmod(np.flatnonzero(square <= (limit - self.norm[rows] + margin).astype(np.float32)[:, None]), len(values))
            r = rows[r]
            for at in range(0, len(r), 500_000):
                q, p = r[at : at + 500_000], c[at : at + 500_000]
                d = np.sqrt(((self.values[q] - values[p]) ** 2).sum(1))
                good = np.round(d, 9) <= self.bound[q]
                q, p, d = q[good], p[good], d[good]
                many = np.minimum(first[p + 1] - first[p], self.k)  # of equal points the first by id
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first[p], many)
                self.found.append((np.repeat(q, many).astype(np.uint16), np.repeat(d, many), ids[place]))
                self.fresh += len(place)
                if self.fresh > max(len(self.values) * self.k, 50_000):
                    self.settle()

    def settle(self) -> None:
        row, d, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.argsort(row, kind="stable")
        row, d, ids = row[order], d[order], ids[order]
        many = np.bincount(row, minlength=len(self.values))
        if many.max(initial=0) >= self.k:
            table = np.full((len(many), many.max()), np.inf)
            table[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = np.round(d, 9)
            self.bound = np.minimum(self.bound, np.partition(table, self.k - 1, axis=1)[:, self.k - 1])
            good = np.round(d, 9) <= self.bound[row]
            row, d, ids = row[good], d[good], ids[good]
        self.found, self.fresh = [(row, d, ids)], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, and a row for each of its neighbours' ids and distances in order, ties by id; infinite where there are fewer."""
        self.settle()
        row, d, ids = self.found[0]
        order = np.lexsort((ids, np.round(d, 9), row))
        row, d, ids = row[order], d[order], ids[order]
        many = np.bincount(row, minlength=len(self.values))
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        kept = place < self.k
        near, far = np.full((len(many), self.k), np.iinfo(np.int64).min), np.full((len(many), self.k), np.inf)
        near[row[kept], place[kept]], far[row[kept], place[kept]] = ids[kept], d[kept]
        own = np.repeat(np.arange(len(self.values)), np.diff(self.first))
        near, far = near[own], far[own]
        # Leave each query itself out, or the last where it is not among its nearest.
        itself = (near == self.ids[:, None]) & np.isfinite(far)
        itself[:, -1] |= ~itself.any(1)
        shape = len(self.ids), self.k - 1
        return self.ids, near[~itself].reshape(shape), far[~itself].reshape(shape)


def neighbour_rows(ids: np.ndarray, near: np.ndarray, far: np.ndarray) -> pd.DataFrame:
    q, rank = np.nonzero(np.isfinite(far))
    return pd.DataFrame({"src": ids[q], "dst": near[q, rank], "d": far[q, rank], "rank": rank + 1})


def different(points: DataFrame, name: str) -> DataFrame:
    """(v, ids): the different vectors of points (id, v), and who has each."""
    from cellgrid.sources.tables import staged

    return staged(points.select("id", F.col("v").cast("array<double>").alias("v")).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), name)


def packed_blocks(points: DataFrame, tree: tuple[np.ndarray, np.ndarray], name: str) -> DataFrame:
    """Blocks of about ``RANGE_BLOCK`` different vectors (v, ids) of one leaf: the vectors, their ids, and where the ids of each begin."""
    from cellgrid.sources.tables import staged

    def placed(frames):
        for frame in frames:
            if len(frame):
                yield frame.assign(leaf=leaves(np.stack(frame["v"].to_numpy()), *tree))

    rows = staged(points.select("v", "ids").mapInPandas(placed, "v array<double>, ids array<long>, leaf long"), f"{name}-placed")
    blocks = rows.groupBy("leaf").agg(F.ceil(F.count("*") / RANGE_BLOCK).alias("blocks"))  # one row a leaf

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        values, many = np.stack(frame["v"].to_numpy()), frame["ids"].map(len).to_numpy()
        first = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        head = {"leaf": [frame["leaf"].iloc[0]], "block": [frame["block"].iloc[0]], "n": [int(first[-1])]}
        return pd.DataFrame(head | {"ids": [np.concatenate(list(frame["ids"])).astype(np.int64).tobytes()], "first": [first.tobytes()], "v": [values.tobytes()], "low": [values.min(0)], "high": [values.max(0)]})

    dealt = rows.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks"))).drop("blocks")
    return staged(dealt.groupBy("leaf", "block").applyInPandas(pack, "leaf long, block long, n long, ids binary, first binary, v binary, low array<double>, high array<double>"), name)


def ranged_knn(points: DataFrame, queries: DataFrame, k: int, made: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame] = neighbour_rows, schema: str = "src long, dst long, d double, rank long") -> DataFrame:
    """(src, dst, d, rank) as ``exact_knn``, or what ``made`` makes of queries, neighbours and distances: the exact search for large tables of few dimensions.

    A tree cuts space by a sample, and blocks of points of one leaf keep the box that they fill.
    Tasks hold a group of query blocks of adjoining leaves; the blocks of points go through them, the
    nearest first, and a query meets those whose box is not beyond its k-th distance so far. What a
    task holds does not grow with the points. Equal points are met once, and equal queries ask once.
    The result of a query leaves its task whole, so no window is needed.
    """
    spark = points.sparkSession
    each = different(points, "points-each")
    depth = max(0, math.ceil(math.log2(max(1, min(each.count() / RANGE_BLOCK, MOST_LEAVES)))))
    some = each.orderBy(F.xxhash64("v"), "v").limit(32 * 2**depth).select("v").toPandas()
    if not len(some):
        return spark.createDataFrame([], schema)
    tree = cut_tree(np.stack(some["v"].to_numpy()), depth)
    right = packed_blocks(each, tree, "points")
    left = right if queries is points else packed_blocks(different(queries, "queries-each"), tree, "queries")
    about = lambda df: df.select("leaf", "block", "n", "low", "high").orderBy("leaf", "block").toPandas()  # noqa: E731  # one row a block
    asked, held = about(left), about(right)
    if not len(asked):
        return spark.createDataFrame([], schema)
    total, least = int(asked["n"].sum()), 2 * spark.sparkContext.defaultParallelism
    size = max(1, min(GROUP_VALUES // (k + 1), math.ceil(total / least)))
    asked["group"] = (asked["n"].cumsum() - asked["n"]) // size
    asked["group"] = asked["group"].rank(method="dense").astype(int) - 1
    low, high = np.stack(held["low"].to_numpy()), np.stack(held["high"].to_numpy())
    order = []
    for group, part in asked.groupby("group"):
        box = np.stack(part["low"].to_numpy()).min(0), np.stack(part["high"].to_numpy()).max(0)
        gap = (np.maximum(np.maximum(low - box[1], box[0] - high), 0) ** 2).sum(1)
        order.append(held[["leaf", "block"]].assign(group=group, gap=gap))
    groups = len(order)
    meets = spark.createDataFrame(pd.concat(order, ignore_index=True), "leaf long, block long, group int, gap double")
    own = spark.createDataFrame(asked[["leaf", "block", "group"]], "leaf long, block long, group int").withColumn("gap", F.lit(-1.0))
    rows = right.join(meets, ["leaf", "block"]).unionByName(left.join(own, ["leaf", "block"])).select("group", "gap", "ids", "first", "v")
    rows = rows.repartitionById(groups, "group").sortWithinPartitions("group", "gap")

    def run(frames):
        own, blocks, group = [], [], None

        def meet():
            if blocks:
                low, high = np.stack([b[2].min(0) for b in blocks]), np.stack([b[2].max(0) for b in blocks])
                for q in own:
                    q.meet(blocks, low, high)
                blocks.clear()

        def done():
            meet()
            for q in own:
                found = q.result()
                for at in range(0, len(found[0]), 1024):
                    yield made(*(x[at : at + 1024] for x in found))
            own.clear()

        for frame in frames:
            for g, gap, ids, first, v in zip(frame["group"], frame["gap"], frame["ids"], frame["first"], frame["v"], strict=True):
                if g != group:
                    yield from done()
                    group = g
                ids, first = np.frombuffer(ids, np.int64), np.frombuffer(first, np.int64)
                values = np.frombuffer(v, float).reshape(len(first) - 1, -1)
                if gap < 0:
                    own += [Nearest(ids[first[at] : first[min(at + 30_000, len(values))]], first[at : min(at + 30_000, len(values)) + 1] - first[at], values[at : at + 30_000], k) for at in range(0, len(values), 30_000)]
                    continue
                norm = (values**2).sum(1)
                blocks.append((ids, first, values, np.vstack([-2 * values.T, norm[None, :]]).astype(np.float32), norm.max()))
                if len(blocks) == CHUNK_BLOCKS:
                    meet()
        yield from done()

    return rows.mapInPandas(run, schema)


#: Points up to which neighbours are sought exactly.
EXACT_UP_TO = 200_000


def near_neighbours(points: DataFrame, k: int, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """The k nearest points of each point: exactly on tables up to ``exact_up_to``, in blocks that all meet up to a few thousand points; else by the approximate search."""
    n = points.count()
    if n <= 4 * BLOCK:
        return exact_knn(points, points, k)
    return ranged_knn(points, points, k) if n <= exact_up_to else approximate_knn(points, points, k)


def js_neighbours(points: DataFrame, k: int, wider: int = 3) -> DataFrame:
    """(src, dst, d, rank): near points by Jensen-Shannon distance of share vectors.

    The roots of shares have Euclidean distances that bound it closely, so ``wider`` times as many
    are searched by those and ranked by the distance itself.
    """
    n = points.count()
    roots = points.select("id", F.transform("v", F.sqrt).alias("v"))
    near = near_neighbours(roots, max(1, min(wider * k, n - 1))).select("src", "dst")
    side = lambda e, v: points.select(F.col("id").alias(e), F.col("v").alias(v))
    met = near.join(side("src", "p"), "src").join(side("dst", "q"), "dst").select("src", "dst", F.sqrt(F.greatest(jensen_shannon("p", "q"), F.lit(0.0))).alias("d"))
    order = Window.partitionBy("src").orderBy(F.round("d", 9), "dst")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mutual(edges: DataFrame, value: str = "d") -> DataFrame:
    """Edges that exist both ways, with the lesser value."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col(value).alias("back"))
    return edges.join(back, ["src", "dst"]).select("src", "dst", F.least(value, "back").alias(value))


def similarities(edges: DataFrame) -> DataFrame:
    """Adds sim = (largest distance - distance) / largest distance."""
    return edges.crossJoin(F.broadcast(edges.agg(F.max("d").alias("max_d")))).withColumn("sim", (F.col("max_d") - F.col("d")) / F.col("max_d"))


def radius_graph(knn: DataFrame, percent: float = 0.9) -> DataFrame:
    """Mutual edges whose similarity is above 1 - radius; the radius is a percentile of 1 - sim over the whole graph."""
    sim = similarities(knn)
    radius = sim.agg(F.percentile(1 - F.col("sim"), percent).alias("radius"), F.first("max_d").alias("max_d"))
    both = mutual(knn).crossJoin(F.broadcast(radius)).withColumn("sim", (F.col("max_d") - F.col("d")) / F.col("max_d"))
    return both.filter((F.col("sim") > 1 - F.col("radius")) & (F.col("src") != F.col("dst"))).select("src", "dst", "sim")


def labelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with the labels of their ends, c1 and c2."""
    side = lambda e, c: labels.select(F.col("id").alias(e), F.col("label").alias(c))
    return edges.join(side("src", "c1"), "src").join(side("dst", "c2"), "dst")


def skeleton(edges: DataFrame, labels: DataFrame, min_percent: float = 2.0) -> DataFrame:
    """Weighted graph of labels: observed share of edges between two labels over that expected from their sizes."""
    n = labelled(edges, labels).groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).agg(F.count("*").alias("n"))
    own = n.filter("a = b").select(F.col("a").alias("c"), F.col("n").alias("own"))
    size = labels.groupBy(F.col("label").alias("c")).agg(F.count("*").alias("size"))
    info = size.join(own, "c", "left").fillna(0, ["own"])
    side = lambda s: info.select(F.col("c").alias(s), F.col("own").alias(f"own_{s}"), F.col("size").alias(f"size_{s}"))
    e = n.filter("a < b").join(side("a"), "a").join(side("b"), "b")
    observed = F.col("n") / (F.col("own_a") + F.col("own_b") + F.col("n"))
    f = F.col("size_a") / (F.col("size_a") + F.col("size_b"))
    return e.withColumn("observed", observed).filter(F.col("observed") * 100 > min_percent).select("a", "b", (F.col("observed") / (2 * f - 2 * f * f)).alias("w"))


def symmetric_skeleton(edges: DataFrame, groups: DataFrame, min_percent: float = 2.0) -> DataFrame:
    """The skeleton over any groups (id, label) as a full matrix: (a, b, w) both ways, 0 on the diagonal and where there are too few edges."""
    names = groups.select("label").distinct()
    once = skeleton(edges, groups, min_percent)
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    # As many rows as the matrix that is asked for has cells.
    cells = names.select(F.col("label").alias("a")).crossJoin(names.select(F.col("label").alias("b")))
    return cells.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("w", F.lit(0.0)).alias("w"))


def coverage(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of the undirected edges whose ends have one label."""
    once = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return labelled(once, labels).agg((F.count_if(F.col("c1") == F.col("c2")) / F.count("*")).alias("coverage"))


def induced(edges: DataFrame, labels: DataFrame, weight: str) -> DataFrame:
    """Sum of weights between labels, undirected."""
    return labelled(edges, labels).groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).agg(F.sum(weight).alias("w"))


def neighborhood(edges: DataFrame, radius: float) -> DataFrame:
    """Of each node: nearest and farthest neighbour and the share of edges beyond a radius."""
    return edges.groupBy("src").agg(F.min("d").alias("nearest"), F.max("d").alias("farthest"), (F.count_if(F.col("d") > radius) / F.count("*")).alias("outside"))


def vote(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Most common label among each node's neighbours; the least of several."""
    n = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("src").orderBy(F.col("n").desc(), "label")
    return n.withColumn("k", F.row_number().over(w)).filter("k = 1").select("src", "label", "n")


def row_normalized(edges: DataFrame, weight: str) -> DataFrame:
    return edges.withColumn(weight, div0(F.col(weight), F.sum(weight).over(Window.partitionBy("src"))))


def pool_counts(edges: DataFrame, entries: DataFrame, cells: DataFrame) -> DataFrame:
    """Each cell's counts summed with its neighbours'."""
    near = edges.select("src", "dst").unionByName(cells.select(F.col("cell").alias("src"), F.col("cell").alias("dst"))).distinct()
    return near.join(entries.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell"), "gene").agg(F.sum("x").alias("x"))


def poisson_pooled(points: DataFrame, entries: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Each cell's counts summed with those of its ``k`` - 1 nearest cells in a latent space (id, v).

    Distances become similarities, so the farthest edge of the whole graph has none and drops out.
    """
    near = near_neighbours(points, max(k - 1, 1))
    kept = similarities(near).filter(F.round(F.col("max_d") - F.col("d"), 9) > 0)
    return pool_counts(kept, entries, cells)


def smooth(edges: DataFrame, entries: DataFrame, cells: DataFrame, only_increase: bool = False) -> DataFrame:
    """Weighted mean of each cell and its neighbours, weights equal and summing to 1; optionally not below the own value."""
    near = edges.select("src", "dst").unionByName(cells.select(F.col("cell").alias("src"), F.col("cell").alias("dst"))).distinct().withColumn("w", F.lit(1.0))
    out = row_normalized(near, "w").join(entries.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell"), "gene").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    if only_increase:
        out = out.join(entries.select("cell", "gene", F.col("x").alias("own")), ["cell", "gene"], "left").withColumn("x", F.greatest("x", "own")).drop("own")
    return out


def components(edges: DataFrame, nodes: DataFrame, folder: str, most_rounds: int = 100) -> DataFrame:
    """(id, comp): least id reachable, by rounds of least neighbours and pointer jumping, each written to ``folder``.

    Jumps double the distance in each round, so ``most_rounds`` bounds no real graph; passing it is an error.
    """
    spark = nodes.sparkSession
    around = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()

    def kept(df: DataFrame) -> DataFrame:
        path = f"{folder}/components-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    around, now = kept(around), kept(nodes.select("id", F.col("id").alias("comp")))
    for _ in range(most_rounds):
        least = around.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("comp").alias("near"))
        hooked = now.join(least, "id", "left").select("id", F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = hooked.join(hooked.select(F.col("id").alias("comp"), F.col("comp").alias("up")), "comp").select("id", F.col("up").alias("comp"))
        after = kept(jump)
        changed = not after.exceptAll(now).isEmpty()
        now = after
        if not changed:
            return now
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def renumbered(labels: DataFrame) -> DataFrame:
    """Singletons become -1; others get compact numbers in order."""
    sized = labels.withColumn("n", F.count("*").over(Window.partitionBy("comp")))
    ids = sized.filter("n > 1").select("comp").distinct().withColumn("new", F.row_number().over(Window.orderBy("comp")) - 1)
    return sized.join(ids, "comp", "left").select("id", F.coalesce("new", F.lit(-1)).cast("long").alias("comp"))


# Distances between two array columns.


def _sum(a: str, b: str, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def shares(a: str) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x: x / total)


def kullback_leibler(p: str, q: str) -> Column:
    """In bits, of normalized arrays; infinite where q is 0 and p is not."""
    term = lambda x, y: F.when(x == 0, 0.0).when(y == 0, float("inf")).otherwise(x * F.log2(x / F.when(y == 0, 1.0).otherwise(y)))
    return _sum(p, q, term)


def jensen_shannon(p: str, q: str) -> Column:
    """Divergence in bits of normalized arrays."""

    def term(x, y):
        m = (x + y) / 2
        part = lambda v: F.when(v == 0, 0.0).otherwise(v * F.log2(v / F.when(m == 0, 1.0).otherwise(m)))
        return (part(x) + part(y)) / 2

    return _sum(p, q, term)


def minkowski(p: str, q: str, power: float) -> Column:
    return F.pow(_sum(p, q, lambda x, y: F.pow(F.abs(x - y), F.lit(power))), F.lit(1.0 / power))


def stabilized(a: str, scale: float = 5000.0) -> Column:
    """Counts scaled to a sum and brought to a stable variance."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x: (F.sqrt(x / total * scale) + 0.8 * F.sqrt(x / total * scale + 1)) / 1.8)


def multinomial(p: str, q: str, subspace: bool = False) -> Column:
    """1 / (1 + e^-x) of the log Bayes factor x that two count vectors have one origin or two; ``subspace`` leaves out coordinates where both are 0."""
    use = lambda x, y: F.when((x > 0) | (y > 0), 1.0).otherwise(0.0) if subspace else F.lit(1.0)
    n = _sum(p, q, use)
    sp, sq = (F.aggregate(c, F.lit(0.0), lambda s, x: s + x) for c in (p, q))
    terms = _sum(p, q, lambda x, y: lgamma(x + 1) + lgamma(y + 1) - lgamma(x + y + 1))
    x = lgamma(n) + lgamma(sp + sq + n) - lgamma(sp + n) - lgamma(sq + n) + terms
    return 1 / (1 + F.exp(-x))


def correlation_distance(p: str, q: str) -> Column:
    """1 less Pearson's correlation; 1 if a side does not vary."""
    n = F.size(p)
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / n
    cov = _sum(p, q, lambda x, y: x * y) / n - mean(p) * mean(q)
    var = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / n - mean(c) * mean(c)
    both = F.sqrt(var(p) * var(q))
    return F.when(both <= 0, 1.0).otherwise(1 - cov / both)


#: Distances by name, as builders of a column from the names of two array columns.
METRICS = {
    "euclidean": lambda p, q: minkowski(p, q, 2.0),
    "manhattan": lambda p, q: minkowski(p, q, 1.0),
    "js": lambda p, q: F.sqrt(F.greatest(jensen_shannon(p, q), F.lit(0.0))),
    "kl": kullback_leibler,
    "correlation": correlation_distance,
    "multinomial": multinomial,
}


def distance(metric: str | Callable[[str, str], Column], p: str, q: str) -> Column:
    """The distance of two array columns by a metric's name, or by a function that builds the column."""
    if callable(metric):
        return metric(p, q)
    if metric not in METRICS:
        raise ValueError(f"no metric {metric!r}; there are {', '.join(sorted(METRICS))}")
    return METRICS[metric](p, q)


def mad_outliers(df: DataFrame, group: str, columns: list[str], threshold: float = 3.5) -> DataFrame:
    """Adds ``outlier``: 0.6745 * distance to the group's median point / median distance above the threshold."""
    mids = df.groupBy(group).agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    d = df.join(mids, group).withColumn("_d", F.sqrt(sum((F.pow(F.col(c) - F.col(f"_m_{c}"), F.lit(2.0)) for c in columns), F.lit(0.0))))
    mad = d.groupBy(group).agg(F.median("_d").alias("_mad"))
    out = d.join(mad, group)
    score = F.when(F.col("_mad") == 0, 0.0).otherwise(0.6745 * F.col("_d") / F.col("_mad"))
    return out.withColumn("outlier", score > threshold).drop("_d", "_mad", *[f"_m_{c}" for c in columns])


def poisson_proximity(p: str, q: str, a: float, b: float) -> Column:
    """Log Bayes factor that two count vectors have one profile, under a gamma prior (a, b) on each rate."""
    n = F.size(p).cast("double")
    sx, sy = (F.aggregate(c, F.lit(0.0), lambda s, x: s + x) for c in (p, q))
    c = sy / sx
    both, own_x, own_y = b + b * c + 1, b * c + 1, b + 1
    prior = n * (math.lgamma(a) + a * F.log(own_x * own_y / both))
    sums = sx * (F.log(c) + F.log(b / both) - F.log(b * c / own_x)) + sy * (F.log(b / both) - math.log(b / own_y))
    return prior + sums + _sum(p, q, lambda x, y: lgamma(x + y + a) - lgamma(x + a) - lgamma(y + a))


def gamma_divergence(p_shape: Column, p_rate: Column, q_shape: Column, q_rate: Column) -> Column:
    """Kullback-Leibler divergence in bits between two gamma distributions."""
    nats = (p_shape - q_shape) * digamma(p_shape) - lgamma(p_shape) + lgamma(q_shape) + q_shape * (F.log(p_rate) - F.log(q_rate)) + p_shape * (q_rate - p_rate) / p_rate
    return nats / math.log(2)


def correlation_knn(points: DataFrame, k: int) -> DataFrame:
    """Nearest neighbours by correlation distance: half the squared distance of centred vectors of length 1."""
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    centred = points.withColumn("_m", mean).withColumn("v", F.transform("v", lambda x: x - F.col("_m")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = centred.withColumn("_n", norm).select("id", F.transform("v", lambda x: F.when(F.col("_n") == 0, 0.0).otherwise(x / F.col("_n"))).alias("v"))
    return exact_knn(unit, unit, k).withColumn("d", F.col("d") * F.col("d") / 2)
