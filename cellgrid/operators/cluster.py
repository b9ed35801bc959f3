"""Clusterings: communities, density, trees, and the clean-up after them.

Distributed parts work on edge and point tables; the sequential kernels take graphs and tables
that were reduced to clusters, or one group of points, and run in numpy.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def louvain(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 0) -> np.ndarray:
    """Communities of an undirected weighted graph by local moves and aggregation, until modularity stops growing."""
    member = np.arange(n)
    rng = np.random.default_rng(seed)
    while True:
        size = int(member.max()) + 1 if len(member) else 0
        a, b = member[src], member[dst]
        weights: list[dict[int, float]] = [{} for _ in range(size)]
        for i, j, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            weights[i][j] = weights[i].get(j, 0.0) + x
            weights[j][i] = weights[j].get(i, 0.0) + x
        degree = np.array([sum(d.values()) for d in weights])
        total = degree.sum()
        if not total:
            return member
        label, mass = np.arange(size), degree.copy()
        moved, ever = True, False
        while moved:
            moved = False
            for i in rng.permutation(size).tolist():
                near: dict[int, float] = {}
                for j, x in weights[i].items():
                    if j != i:
                        near[label[j]] = near.get(label[j], 0.0) + x
                mass[label[i]] -= degree[i]
                gain = lambda c: near.get(c, 0.0) - resolution * degree[i] * mass[c] / total  # noqa: B023, E731
                best = max(sorted(near), key=gain, default=label[i])
                if gain(best) <= gain(label[i]) + 1e-12:
                    best = label[i]
                else:
                    moved = ever = True
                mass[best] += degree[i]
                label[i] = best
        if not ever:
            return member
        member = np.unique(label, return_inverse=True)[1][member]


def leiden(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 0, most_levels: int = 20) -> np.ndarray:
    """Communities by local moves, each then refined from single nodes inside it, so that what is aggregated, and every community at the end, is connected.

    A level moves the nodes of the aggregate graph, refines every community by merging single nodes
    with parts of the same community that they gain from, and aggregates the parts; the moves of the
    next level start from the communities found.
    """
    member, label = np.arange(n), np.arange(n)  # the part of each node, and the community of each part
    rng = np.random.default_rng(seed)
    for _ in range(most_levels):
        size = int(member.max()) + 1 if n else 0
        near: list[dict[int, float]] = [{} for _ in range(size)]
        for i, j, x in zip(member[src].tolist(), member[dst].tolist(), w.tolist(), strict=True):
            near[i][j] = near[i].get(j, 0.0) + x
            near[j][i] = near[j].get(i, 0.0) + x
        degree = np.array([sum(d.values()) for d in near])
        total = degree.sum()
        if not total:
            break

        def moved(start: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
            """Local moves from ``start``; with ``inside``, single nodes only, and only to parts of their own community."""
            at, mass, count = start.copy(), np.bincount(start, degree, size), np.bincount(start, minlength=size)  # noqa: B023
            changed = True
            while changed:
                changed = False
                for i in rng.permutation(size).tolist():  # noqa: B023
                    if inside is not None and count[at[i]] > 1:
                        continue
                    to: dict[int, float] = {}
                    for j, x in near[i].items():  # noqa: B023
                        if j != i and (inside is None or inside[j] == inside[i]):
                            to[at[j]] = to.get(at[j], 0.0) + x
                    own = at[i]
                    mass[own] -= degree[i]  # noqa: B023
                    gain = lambda c: to.get(c, 0.0) - resolution * degree[i] * mass[c] / total  # noqa: B023, E731
                    best = max(sorted(to), key=gain, default=own)
                    if gain(best) <= gain(own) + 1e-12:
                        best = own
                    else:
                        changed = True
                        count[own] -= 1
                        count[best] += 1
                    mass[best] += degree[i]  # noqa: B023
                    at[i] = best
                if inside is not None:
                    break
            return at

        label = np.unique(moved(label, None), return_inverse=True)[1]
        parts = np.unique(moved(np.arange(size), label), return_inverse=True)[1]
        if len(np.unique(label)) == size:
            break
        first = np.zeros(int(parts.max()) + 1, int)
        first[parts] = label  # a part lies in one community
        member = parts[member]
        if int(parts.max()) + 1 == size:
            label = first
            break
        label = first
    return np.unique(label[member], return_inverse=True)[1] if n else member


def modularity(labels: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> float:
    total = 2 * w.sum()
    degree = np.bincount(src, w, len(labels)) + np.bincount(dst, w, len(labels))
    inside = 2 * w[labels[src] == labels[dst]].sum() / total
    return float(inside - ((np.bincount(labels, degree) / total) ** 2).sum())


def surprise_of(inside: float, edges: float, pairs_inside: float, pairs: float) -> float:
    """Asymptotic surprise: edges times the divergence of the share of inner edges from the share of inner pairs."""
    q, e = inside / edges, pairs_inside / pairs
    part = lambda x, y: 0.0 if x <= 0 else (np.inf if y <= 0 else x * np.log(x / y))
    return edges * (part(q, e) + part(1 - q, 1 - e))


def surprise_communities(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, seed: int = 0) -> np.ndarray:
    """Communities of greatest surprise by moves of single nodes from singletons, until none gains."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, x in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + x
            near[j][i] = near[j].get(i, 0.0) + x
    edges, pairs = sum(sum(d.values()) for d in near) / 2, n * (n - 1) / 2
    label, size = list(range(n)), [1] * n
    if not edges:
        return np.arange(n)
    inside, inner_pairs, rng, moved = 0.0, 0.0, np.random.default_rng(seed), True
    while moved:
        moved = False
        for i in rng.permutation(n).tolist():
            to: dict[int, float] = {}
            for j, x in near[i].items():
                to[label[j]] = to.get(label[j], 0.0) + x
            own = label[i]
            base_in, base_pairs = inside - to.get(own, 0.0), inner_pairs - (size[own] - 1)
            value = lambda c: surprise_of(base_in + to.get(c, 0.0), edges, base_pairs + (size[c] - (c == own)), pairs)  # noqa: B023, E731
            sign = lambda c: value(c) if (base_in + to.get(c, 0.0)) / edges >= (base_pairs + size[c] - (c == own)) / pairs else -value(c)  # noqa: B023, E731
            best = max(sorted(to), key=sign, default=own)
            if sign(best) > sign(own) + 1e-9:
                size[own] -= 1
                size[best] += 1
                inside, inner_pairs = base_in + to[best], base_pairs + size[best] - 1
                label[i], moved = best, True
    return np.unique(label, return_inverse=True)[1]


def local_moves(edges: DataFrame, degrees: DataFrame, resolution: float, rounds: int, seed: int) -> DataFrame:
    """(id, label) after rounds in which nodes move, all at once, to the neighbouring community of greatest modularity gain.

    ``edges`` (src, dst, w) both ways, without loops; ``degrees`` (id, degree) with loops. In each
    round a hashed half of the nodes may move, and only to a community of a lower number on even
    rounds and of a higher one on odd rounds, so that two nodes never swap.
    """
    from cellgrid.sources.tables import staged

    total = degrees.agg(F.sum("degree")).first()[0] or 0.0
    now = staged(degrees.select("id", F.col("id").alias("label")), "moves")
    for step in range(rounds):
        mass = now.join(degrees, "id").groupBy("label").agg(F.sum("degree").alias("mass"))
        near = edges.join(now.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
        own = now.select("id", F.col("label").alias("own"))
        turn = F.pmod(F.xxhash64("id", F.lit(seed + step)), F.lit(2)) == 0
        side = F.col("label") < F.col("own") if step % 2 == 0 else F.col("label") > F.col("own")
        cost = lambda m: F.lit(resolution) * F.col("degree") * m / F.lit(max(total, 1e-300))
        scored = near.join(own, "id").join(degrees, "id").join(mass, "label")
        stay = F.col("label") == F.col("own")
        scored = scored.withColumn("gain", F.col("w") - cost(F.when(stay, F.col("mass") - F.col("degree")).otherwise(F.col("mass"))))
        home = scored.filter(stay).select("id", F.col("gain").alias("home"))
        # A node without a neighbour in its own community compares with leaving that community's mass behind.
        best = scored.filter(side & turn).groupBy("id").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("label")).alias("to"))).alias("best"))
        alone = own.join(degrees, "id").join(mass.withColumnRenamed("label", "own"), "own").select("id", (-cost(F.col("mass") - F.col("degree"))).alias("base"))
        moved = best.join(alone, "id").join(home, "id", "left").filter(F.col("best.gain") > F.coalesce("home", "base") + 1e-9).select("id", (-F.col("best.to")).alias("to"))
        now = staged(now.join(moved, "id", "left").select("id", F.coalesce("to", "label").alias("label")), "moves")
    return now


#: Edges of a graph up to which a community search runs in one task; larger graphs are contracted first.
SEARCH_EDGES = 2_000_000


def communities(nodes: DataFrame, edges: DataFrame, weight: str = "w", resolution: float = 1.0, min_cells: int = 10, folder: str = "", method: str = "louvain", search_edges: int = SEARCH_EDGES) -> DataFrame:
    """(id, label) by community search; connected components of at most ``min_cells`` nodes get -1. Compact numbers by least id.

    A graph of more than ``search_edges`` edges is contracted, level by level, by moves of all nodes
    at once; what is left, a graph of communities, is searched in one task. A level that no longer
    halves the edges ends the contraction, and its communities stand.
    """
    from cellgrid.operators.graph import components
    from cellgrid.sources.tables import staged

    comp = staged(components(edges, nodes, folder), "comp")
    big = comp.join(comp.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") > min_cells).select("comp"), "comp", "left_semi").select("id")
    once = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max(weight).alias("w")).filter("src <> dst")
    level = staged(once.join(big.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", F.col("w").cast("double").alias("w")), "level")
    member = staged(big.select("id", F.col("id").alias("label")), "member")
    size = level.count()
    while size > search_edges:
        loops = level.filter("src = dst").select(F.col("src").alias("id"), (2 * F.col("w")).alias("w"))
        both = level.filter("src <> dst").select("src", "dst", "w")
        both = staged(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "both")
        degrees = staged(both.select(F.col("src").alias("id"), "w").unionByName(loops).groupBy("id").agg(F.sum("w").alias("degree")), "degrees")
        moved = local_moves(both, degrees, resolution, 8, seed=size % 997)
        ends = level.join(moved.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(moved.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
        level = staged(ends.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w")), "level")
        member = staged(member.join(moved.select(F.col("id").alias("label"), F.col("label").alias("to")), "label").select("id", F.col("to").alias("label")), "member")
        size, before = level.count(), size
        if size > before / 2:
            break

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        ids, flat = np.unique(np.concatenate([frame["src"], frame["dst"]]), return_inverse=True)
        half = len(frame)
        ends = flat[:half], flat[half:], frame["w"].to_numpy()
        label = surprise_communities(len(ids), *ends) if method == "surprise" else (leiden if method == "leiden" else louvain)(len(ids), *ends, resolution)
        return pd.DataFrame({"label": ids, "to": ids[np.unique(label, return_inverse=True)[1]]})

    if size <= search_edges:  # one task, of a bounded graph
        found = level.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(search, "label long, to long")
        member = staged(member.join(found, "label").select("id", F.col("to").alias("label")), "member")
    names = member.groupBy("label").agg(F.min("id").alias("least")).withColumn("new", F.row_number().over(_order("least")) - 1).select("label", "new")
    return nodes.select("id").join(member.join(names, "label").select("id", F.col("new").cast("long").alias("label")), "id", "left").fillna(-1, ["label"])


def _order(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def dbscan(points: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Labels from 0, outliers -1. Neighbours are sought anew when needed, so that memory grows with the points only; equal points are met once."""
    _, first, of, many = np.unique(points, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)  # as they come, so that labels have the same numbers
    points, many, of = points[first[order]], many[order], np.argsort(order)[of.ravel()]
    near = lambda i: np.flatnonzero(((points - points[i]) ** 2).sum(1) <= eps * eps)
    core = np.array([many[near(i)].sum() >= min_points for i in range(len(points))], bool)
    label, count = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [int(i)]
        label[i] = count
        while todo:
            for j in near(todo.pop()):
                if label[j] < 0:
                    label[j] = count
                    if core[j]:
                        todo.append(int(j))
        count += 1
    return label[of]


def neighbour_radius(points: np.ndarray, k: int) -> np.ndarray:
    """Distance of each point to its ``k``-th neighbour other than itself."""
    each, of = np.unique(points, axis=0, return_inverse=True)
    return np.array([np.sqrt(np.partition(((points - x) ** 2).sum(1), k)[k]) for x in each])[of.ravel()]


def mark_outliers(points: DataFrame, min_points: int = 10, percent: float = 80.0) -> DataFrame:
    """(id, label, outlier): density outliers of each cluster in a plane, eps the given percentile of the radius to ``min_points`` neighbours."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        xy = frame[["x", "y"]].to_numpy(float)
        if len(xy) <= min_points:
            return frame[["id", "label"]].assign(outlier=False)
        eps = np.percentile(neighbour_radius(xy, min_points), percent)
        return frame[["id", "label"]].assign(outlier=dbscan(xy, eps, min_points) < 0)

    return points.select("id", "label", "x", "y").groupBy("label").applyInPandas(one, "id long, label long, outlier boolean")


def far_off(values: np.ndarray, most: float = 3.5) -> np.ndarray:
    """Whether the modified z-score, by the median absolute deviation, is above ``most``."""
    gap = np.abs(values - np.median(values))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 0.6745 * gap / np.median(gap) > most


def broken(points: np.ndarray) -> np.ndarray:
    """Parts of one cluster in a plane, from 0, outliers -1; all 0 if it has few outliers and is not dispersed."""
    n = len(points)
    centred = points - points.mean(0)
    xy = centred @ np.linalg.svd(centred, full_matrices=False)[2].T
    spread = xy.std(0)
    xy = xy / np.where(spread > 0, spread, 1)
    out = np.zeros(n, bool)
    for _ in range(5):
        for values in xy.T:
            out[~out] = far_off(values[~out])
    min_points = min(50, n - 1, max(5, round(0.1 * n)))
    eps = np.percentile(neighbour_radius(xy, min_points), 70)
    if out.sum() <= 3 and (np.sqrt((xy**2).sum(1)) < eps).sum() >= min_points * 0.5:
        return np.zeros(n, int)
    return dbscan(xy, eps, round(min_points * 0.5))


def break_clusters(points: DataFrame, least: int = 10) -> DataFrame:
    """(id, label) of points (id, label, x, y): dispersed clusters of ``least`` points or more are split by density, and their outliers lose their label; compact numbers."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        part = broken(frame[["x", "y"]].to_numpy(float)) if len(frame) >= least and frame["label"].iloc[0] >= 0 else np.zeros(len(frame), int)
        return frame[["id", "label"]].assign(part=part)

    parts = points.select("id", "label", "x", "y").groupBy("label").applyInPandas(one, "id long, label long, part long")
    names = parts.filter("label >= 0 AND part >= 0").select("label", "part").distinct().withColumn("new", F.row_number().over(_order("label", "part")) - 1)
    return parts.join(names, ["label", "part"], "left").select("id", F.coalesce("new", F.lit(-1)).cast("long").alias("label"))


def polish(labels: DataFrame, edges: DataFrame, min_cells: int, least_agree: float = 0.2, plane: DataFrame | None = None, folder: str = "") -> DataFrame:
    """Labels after: with a ``plane`` (id, x, y), density outliers lose theirs; nodes that few neighbours agree with lose theirs; with a plane, dispersed clusters break; majority vote; tiny clusters dissolve; lost nodes take their neighbours' label; compact numbers."""
    from cellgrid.operators.graph import labelled, vote

    def stage(df: DataFrame) -> DataFrame:
        if not folder:
            return df
        path = f"{folder}/polish-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    labels, edges = stage(labels), stage(edges)
    if plane is not None:
        plane = stage(plane)
        marked = mark_outliers(labels.filter("label >= 0").join(plane, "id"))
        labels = stage(labels.join(marked.select("id", "outlier"), "id", "left").select("id", F.when(F.col("outlier"), -1).otherwise(F.col("label")).alias("label")))
    agree = labelled(edges, labels).groupBy(F.col("src").alias("id")).agg(F.avg((F.col("c1") == F.col("c2")).cast("int")).alias("agree"))
    now = labels.join(agree, "id", "left").select("id", F.when(F.coalesce("agree", F.lit(0.0)) >= least_agree, F.col("label")).otherwise(-1).alias("label"))
    if plane is not None:
        now = stage(now)
        now = stage(now.filter("label < 0").unionByName(break_clusters(now.filter("label >= 0").join(plane, "id"))))
    voted = vote(edges, now.filter("label >= 0")).select(F.col("src").alias("id"), F.col("label").alias("voted"))
    now = now.join(voted, "id", "left").select("id", F.coalesce("voted", "label").alias("label"))
    sizes = now.groupBy("label").agg(F.count("*").alias("n"))
    now = now.join(sizes, "label").select("id", F.when(F.col("n") < min_cells, -1).otherwise(F.col("label")).alias("label"))
    again = vote(edges, now.filter("label >= 0")).select(F.col("src").alias("id"), F.col("label").alias("voted"))
    now = now.join(again, "id", "left").select("id", F.when(F.col("label") < 0, F.coalesce("voted", F.lit(-1))).otherwise(F.col("label")).alias("label"))
    ids = now.filter("label >= 0").select("label").distinct().withColumn("new", F.row_number().over(_order("label")) - 1)
    return now.join(ids, "label", "left").select("id", F.coalesce("new", F.lit(-1)).cast("long").alias("label"))


def linkage(distance: np.ndarray) -> np.ndarray:
    """Complete linkage: rows (left, right, distance, size) as trees are usually given; ties by number."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(n)), [1] * n, []
    alive = list(range(n))
    for step in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        p, q = sorted((alive[i], alive[j]), key=lambda x: name[x])
        out.append((name[p], name[q], d[p, q], size[p] + size[q]))
        d[p] = np.maximum(d[p], d[q])
        d[:, p] = d[p]
        d[p, p] = np.inf
        name[p], size[p] = n + step, size[p] + size[q]
        alive.remove(q)
    return np.array(out).reshape(-1, 4)


def leaf_order(tree: np.ndarray, distance: np.ndarray) -> list[int]:
    """Leaves from left to right, each join turned so that the nearest ends touch."""
    n = len(tree) + 1
    order: dict[int, list[int]] = {i: [i] for i in range(n)}
    for k, (a, b, _, _) in enumerate(tree):
        x, y = order.pop(int(a)), order.pop(int(b))
        turns = [(x, y), (x, y[::-1]), (x[::-1], y), (x[::-1], y[::-1])]
        order[n + k] = sum(min(turns, key=lambda t: distance[t[0][-1], t[1][0]]), [])
    return order[max(order)]


def cut_tree(tree: np.ndarray, groups: int) -> np.ndarray:
    """Labels of the leaves after all but ``groups`` - 1 joins, numbered by first leaf."""
    n = len(tree) + 1
    member = {i: [i] for i in range(n)}
    for k in range(max(0, n - groups)):
        a, b = int(tree[k][0]), int(tree[k][1])
        member[n + k] = member.pop(a) + member.pop(b)
    out = np.zeros(n, int)
    for label, leaves in enumerate(sorted(member.values(), key=min)):
        out[leaves] = label
    return out


def correlation_tree(means: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Clusters, correlation distances of ln(mean + 1), and their tree. The pairs are computed on the executors, the tree of some hundred clusters here."""
    v = means.select("cluster", "gene", F.log1p("mean").alias("v"))
    pairs = v.select(F.col("cluster").alias("a"), "gene", F.col("v").alias("va")).join(v.select(F.col("cluster").alias("b"), "gene", F.col("v").alias("vb")), "gene").filter("a < b")
    # A cluster without any of the genes does not vary: no correlation, and none is divided by.
    vary = (F.min("va") < F.max("va")) & (F.min("vb") < F.max("vb"))
    sums = pairs.groupBy("a", "b").agg(vary.alias("vary"), F.covar_pop("va", "vb").alias("cov"), F.stddev_pop("va").alias("sa"), F.stddev_pop("vb").alias("sb"))
    r = sums.select("a", "b", F.when(F.col("vary") & (F.col("sa") * F.col("sb") > 0), F.try_divide("cov", F.col("sa") * F.col("sb"))).alias("r")).collect()
    names = sorted(x[0] for x in means.select("cluster").distinct().collect())
    at = {c: i for i, c in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for a, b, x in r:
        d[at[a], at[b]] = d[at[b], at[a]] = 1 - (x if x is not None else 0.0)
    return names, d, linkage(d)


def paris(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hierarchy of a weighted graph by nearest-neighbour chains on the distance p_i p_j / p_ij; joins in order of distance."""
    total = 2 * w.sum()
    near: dict[int, dict[int, float]] = {i: {} for i in range(n)}
    mass = dict.fromkeys(range(n), 0.0)
    for i, j, x in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
        mass[i] += x / total
        mass[j] += x / total
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + x / total
            near[j][i] = near[j].get(i, 0.0) + x / total
    size, joins, chain, parts, top = dict.fromkeys(range(n), 1), [], [], [], n
    while near:
        if not chain:
            chain = [min(near)]
        a = chain.pop()
        if not near[a]:
            parts.append(a)
            del near[a]
            continue
        gap = lambda x: mass[a] * mass[x] / near[a][x]  # noqa: B023, E731
        b = min(near[a], key=lambda x: (gap(x), x))
        if chain and (chain[-1] == b or gap(chain[-1]) <= gap(b) and chain[-1] in near[a]):
            b = chain.pop()
            joins.append((a, b, gap(b), size[a] + size[b]))
            merged = {}
            for x in (a, b):
                for y, v in near.pop(x).items():
                    if y not in (a, b):
                        merged[y] = merged.get(y, 0.0) + v
                        near[y].pop(x)
            for y, v in merged.items():
                near[y][top] = v
            near[top], mass[top], size[top] = merged, mass[a] + mass[b], size[a] + size[b]
            top += 1
        else:
            chain += [a, b]
    while len(parts) > 1:
        a, b = parts.pop(0), parts.pop(0)
        joins.append((a, b, np.inf, size[a] + size[b]))
        size[top] = size[a] + size[b]
        parts.append(top)
        top += 1
    order = sorted(range(len(joins)), key=lambda k: (joins[k][2], k))
    new = {n + old: n + k for k, old in enumerate(order)}
    return np.array([(new.get(joins[o][0], joins[o][0]), new.get(joins[o][1], joins[o][1]), *joins[o][2:]) for o in order], float).reshape(-1, 4)


def split_by_coverage(labels: np.ndarray, src: np.ndarray, dst: np.ndarray, tree: np.ndarray, threshold: float, most: int = 10) -> np.ndarray | None:
    """The cut of a cluster tree into the most groups, up to ``most``, whose coverage is above the threshold; None if there is none."""
    found = None
    for groups in range(2, min(most, len(tree) + 1) + 1):
        of = cut_tree(tree, groups)[labels]
        if (of[src] == of[dst]).mean() > threshold:
            found = cut_tree(tree, groups)
    return found


def merge_rounds(scores: dict[int, int], centre: dict[int, tuple[float, float]], threshold: int, rescore) -> dict[int, int]:
    """Merge the cluster with the least score into its nearest, until every score reaches the threshold; maps old labels to compact new ones."""
    to = {c: c for c in scores}
    while len(scores) > 1 and min(scores.values()) < threshold:
        weak = min(scores, key=lambda c: (scores[c], c))
        x, y = centre[weak]
        near = min((c for c in scores if c != weak), key=lambda c: ((centre[c][0] - x) ** 2 + (centre[c][1] - y) ** 2, c))
        to = {c: near if t == weak else t for c, t in to.items()}
        scores, centre = rescore(to)
    compact = {t: k for k, t in enumerate(sorted(set(to.values())))}
    return {c: compact[t] for c, t in to.items()}


def reassigned(labels: DataFrame, points: DataFrame, min_cells: int) -> DataFrame:
    """(id, label): clusters of fewer than ``min_cells`` dissolve, the others get compact numbers in order, and each freed point takes the label of the nearest labelled one in (id, v)."""
    from cellgrid.operators.graph import exact_knn

    sizes = labels.filter("label >= 0").groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cells)
    names = sizes.withColumn("new", F.row_number().over(_order("label")) - 1).select("label", "new")
    now = labels.join(names, "label", "left").select("id", F.coalesce("new", F.lit(-1)).cast("long").alias("label"))
    fixed, free = now.filter("label >= 0"), now.filter("label < 0")
    near = exact_knn(points.join(fixed, "id", "left_semi"), points.join(free, "id", "left_semi"), 1)
    taken = near.join(fixed.select(F.col("id").alias("dst"), F.col("label").alias("taken")), "dst").select(F.col("src").alias("id"), "taken")
    return now.join(taken, "id", "left").select("id", F.coalesce("taken", "label").alias("label"))


def unpolished(points: DataFrame, edges: DataFrame, min_cells: int = 10, folder: str = "", **options) -> DataFrame:
    """Communities without the clean-up: tiny ones dissolve, and their points go with their nearest neighbours."""
    from cellgrid.sources.tables import staged

    return reassigned(staged(communities(points.select("id"), edges, folder=folder, **options), "communities"), points, min_cells)


#: Least cells of a part, and the thresholds of coverage that each way of splitting takes by itself.
LEAST_PART, THRESHOLDS = 25, {"coverage": 0.98, "paris": 0.999}


def separable(edges: DataFrame, parts: DataFrame, threshold: float, least: int = LEAST_PART) -> tuple[bool, float, int]:
    """Whether a partition (id, label) may be made, its coverage of the graph, and its smallest part."""
    from cellgrid.operators.graph import coverage

    smallest = parts.groupBy("label").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    share = coverage(edges, parts).first()[0] or 0.0
    return bool(smallest >= least and share >= threshold), float(share), int(smallest)


def split(labels: DataFrame, edges: DataFrame, method: str, tree: tuple[list, np.ndarray] | None = None, threshold: float | None = None) -> DataFrame | None:
    """(id, label) of a clustering's parts by ``method``, None if it is not to be split.

    ``cluster`` makes each cluster a part. ``dendrogram`` cuts the clusters' tree (names, linkage) in
    two; ``coverage`` does so if the two parts are large and separate enough. ``paris`` takes the
    finest cut of the induced graph's hierarchy that keeps enough edges inside.
    """
    from cellgrid.operators.graph import coverage, induced

    threshold = THRESHOLDS.get(method) if threshold is None else threshold
    names = sorted(r[0] for r in labels.filter("label >= 0").select("label").distinct().collect())
    if len(names) < 2:
        return None

    def parted(of: dict) -> DataFrame:
        table = labels.sparkSession.createDataFrame([(int(k), int(v)) for k, v in of.items()], "label long, part long")
        return labels.filter("label >= 0").join(table, "label").select("id", F.col("part").alias("label"))

    if method == "cluster":
        return parted({c: c for c in names})
    if method in ("dendrogram", "coverage"):
        if tree is None:
            raise ValueError(f"{method} needs the clusters' tree")
        found = parted(dict(zip(tree[0], cut_tree(tree[1], 2), strict=True)))
        return found if method == "dendrogram" or separable(edges, found, threshold)[0] else None
    if method != "paris":
        raise ValueError(f"no method {method!r}")
    place = {c: k for k, c in enumerate(names)}
    pairs = induced(edges.withColumn("_one", F.lit(1.0)), labels.filter("label >= 0"), "_one").collect()  # pairs of clusters
    src, dst, w = (np.array(x) for x in zip(*[(place[r["a"]], place[r["b"]], r["w"]) for r in pairs], strict=True))
    hierarchy = paris(len(names), src, dst, w)
    for groups in range(min(10, len(names)), 1, -1):
        found = parted(dict(zip(names, cut_tree(hierarchy, groups), strict=True)))
        if (coverage(edges, found).first()[0] or 0.0) > threshold:
            return found
    return None


def merge_scores(m, label: str, most_q: float = 1e-5, least_enrichment: float = 5.0) -> dict:
    """Genes of each cluster that are enriched and whose q-value is low."""
    from cellgrid.operators.stats import enrichment_test

    found = enrichment_test(m, label)
    hit = (F.round("q", 9) < most_q) & (F.col("e") > least_enrichment)
    return {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.count_if(hit).alias("n")).collect()}


def next_merge(m, label: str, places: DataFrame, threshold: int = 1, **limits) -> tuple | None:
    """(weak, into, score): the cluster with the fewest enriched genes and its nearest by median place (cluster, x, y); None if all have enough."""
    scores = merge_scores(m, label, **limits)
    if len(scores) < 2 or min(scores.values()) >= threshold:
        return None
    weak = min(scores, key=lambda c: (scores[c], c))
    centre = {r["cluster"]: (r["x"], r["y"]) for r in places.groupBy("cluster").agg(F.median("x").alias("x"), F.median("y").alias("y")).collect()}
    x, y = centre[weak]
    return weak, min((c for c in scores if c != weak), key=lambda c: ((centre[c][0] - x) ** 2 + (centre[c][1] - y) ** 2, c)), int(scores[weak])


def merged(m, labels: DataFrame, plane: DataFrame, threshold: int = 1, **limits) -> DataFrame:
    """(id, label) after merging weak clusters, round by round, into their nearest in a plane (id, x, y); compact numbers. Each round tests all clusters anew."""
    from cellgrid.model import CellMatrix

    now, to = labels.filter("label >= 0"), {}
    while True:
        table = labels.sparkSession.createDataFrame([(int(k), int(v)) for k, v in to.items()], "label long, new long")
        own = now.join(table, "label", "left").select("id", F.coalesce("new", "label").alias("label"))
        cells = m.cells.drop("clusters").join(own.select(F.col("id").alias("cell"), F.col("label").alias("clusters")), "cell")
        found = next_merge(CellMatrix(cells, m.genes, m.entries), "clusters", own.join(plane, "id").withColumnRenamed("label", "cluster"), threshold, **limits)
        if found is None:
            break
        weak, near, _ = found
        to = {k: near if v == weak else v for k, v in to.items()} | {weak: near}
    ids = own.select("label").distinct().withColumn("new", F.row_number().over(_order("label")) - 1)
    return own.join(ids, "label").select("id", F.col("new").cast("long").alias("label"))


def balance(candidates: np.ndarray, distances: np.ndarray, k: int, most: int, degree: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Balanced neighbours: nodes in order of falling in-degree (ties: higher number first) take up to ``k`` candidates that have fewer than ``most`` takers; the rest are the node itself."""
    n, sight = candidates.shape
    degree = np.bincount(candidates.ravel(), minlength=n) if degree is None else degree
    order = np.argsort(degree, kind="stable")[::-1]
    taken = np.zeros(n, int)
    index, dist = np.repeat(np.arange(n)[:, None], k, axis=1), np.zeros((n, k))
    for i in order:
        p = 0
        for j in range(sight):
            c = candidates[i, j]
            if p < k and c != i and taken[c] < most:
                index[i, p], dist[i, p] = c, distances[i, j]
                taken[c] += 1
                p += 1
        dist[i, p:] = distances[i, 0]
    return index, dist


#: Candidates up to which the balancing pass runs in one task, as the plain loop that it is.
BALANCE_ROWS = 2_000_000


def balanced_knn(spark: SparkSession, sight: DataFrame, k: int, most: int, rows_in_one: int = BALANCE_ROWS) -> DataFrame:
    """(src, dst, d) from a sight graph (src, dst, d, rank): in order of falling in-degree (ties: higher id first) nodes take up to ``k`` candidates that have fewer than ``most`` takers.

    The order is one for all, so the outcome is that of proposals with deferred acceptance: each node
    asks its first ``k`` candidates that haven't refused it, each candidate keeps the ``most`` first
    nodes that ask, and refusals are final. Large tables are balanced by rounds of that, small ones
    by the loop itself, with the same result.
    """
    from cellgrid.sources.tables import staged

    sight = staged(sight.select("src", "dst", "d", F.col("rank").cast("long").alias("rank")), "sight")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["src", "rank"])
        ids, counts = np.unique(np.concatenate([frame["src"], frame["dst"]]), return_counts=True)
        width = int(frame.groupby("src").size().max())
        c, d = np.repeat(np.arange(len(ids))[:, None], width, axis=1), np.zeros((len(ids), width))
        row, col = np.searchsorted(ids, frame["src"]), frame.groupby("src").cumcount().to_numpy()
        c[row, col], d[row, col] = np.searchsorted(ids, frame["dst"]), frame["d"]
        degree = np.bincount(np.searchsorted(ids, frame["dst"]), minlength=len(ids))
        index, dist = balance(c, d, k, most, degree)
        return pd.DataFrame({"src": np.repeat(ids, k), "dst": ids[index.ravel()], "d": dist.ravel()})

    if sight.count() <= rows_in_one:
        return sight.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(one, "src long, dst long, d double").filter("src <> dst")
    from pyspark.sql import Window

    degree = sight.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("degree"))
    asked = staged(sight.filter("src <> dst").join(degree, "src", "left").fillna(0, ["degree"]), "asked")
    while True:
        own = Window.partitionBy("src").orderBy("rank")
        takers = Window.partitionBy("dst").orderBy(F.col("degree").desc(), F.col("src").desc())
        proposals = asked.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= k)
        refused = staged(proposals.withColumn("_p", F.row_number().over(takers)).filter(F.col("_p") > most).select("src", "dst"), "refused")
        if refused.isEmpty():
            return proposals.select("src", "dst", "d")
        asked = staged(asked.join(refused, ["src", "dst"], "left_anti"), "asked")
