"""Random forests grown in numpy, level by level, with the rows to judge going down beside the training rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows times features (or classes, if there are more) up to which a task holds all rows of a forest.
FOREST_VALUES = 10_000_000
#: Tasks that the trees are dealt to.
PARTS = 24


def best_cuts(x: np.ndarray, rank: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, counts: np.ndarray, tried: np.ndarray, found: tuple) -> None:
    """Enter into ``found`` (score, feature, cut of each node) the least impure cuts at the features that each node tries."""
    score, feature, cut = found
    for f in np.flatnonzero(tried.any(axis=0)):
        own = np.flatnonzero(tried[node, f])
        own = own[np.argsort(node[own] * (rank[:, f].max() + 1) + rank[own, f], kind="stable")]
        at, value = node[own], rank[own, f]
        inner = (at[1:] == at[:-1]) & (value[1:] != value[:-1])
        if not inner.any():
            continue
        left = np.zeros((len(own), counts.shape[1]))
        left[np.arange(len(own)), y[own]] = w[own]
        left = left.cumsum(axis=0)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        before = np.vstack([np.zeros(left.shape[1]), left])[first]
        place = np.flatnonzero(inner)
        segment = np.searchsorted(first, place, side="right") - 1
        left = left[place] - before[segment]
        right = counts[at[place]] - left
        gain = (left**2).sum(1) / left.sum(1) + (right**2).sum(1) / right.sum(1)
        start = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        top = np.maximum.reduceat(gain, start)
        which = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[start, len(gain)])))
        which = which[np.unique(segment[which], return_index=True)[1]]
        nodes = at[place[which]]
        better = top > score[nodes]
        nodes, which = nodes[better], place[which[better]]
        score[nodes], feature[nodes] = top[better], f
        cut[nodes] = value[which]


def tree_chances(x: np.ndarray, y: np.ndarray, held: np.ndarray, classes: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Chances of the classes that one tree, grown on drawn rows of those not ``held``, gives to the held rows (in their order)."""
    k = x.shape[1]
    rank = np.column_stack([np.unique(x[:, f], return_inverse=True)[1] for f in range(k)]) if k else np.zeros((len(x), 0), np.int64)
    train, judged = np.flatnonzero(~held), np.flatnonzero(held)
    out = np.zeros((len(judged), classes))
    weight = np.bincount(rng.integers(0, len(train), len(train)), minlength=len(train)).astype(float)
    train, weight = train[weight > 0], weight[weight > 0]
    node, below, waiting = np.zeros(len(train), np.int64), np.zeros(len(judged), np.int64), np.arange(len(judged))
    for level in range(depth + 1):
        n = int(node.max()) + 1
        counts = np.bincount(node * classes + y[train], weight, n * classes).reshape(n, classes)
        total = counts.sum(1)
        open_ = (counts.max(1) < total) & (level < depth)
        found = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        tried = np.zeros((n, k), bool)
        np.put_along_axis(tried, rng.random((n, k)).argsort(axis=1)[:, : max(1, int(math.sqrt(k)))], True, axis=1)
        for mask in (tried, ~tried):  # the others only where the drawn ones are constant
            best_cuts(x, rank[train], y[train], weight, node, counts, mask & (open_ & np.isinf(found[0]))[:, None], found)
        _, feature, cut = found
        goes_on = np.isfinite(found[0])
        ends = ~goes_on[below]
        out[waiting[ends]] = counts[below[ends]] / total[below[ends], None]
        place = np.cumsum(goes_on) - 1
        stays, going = goes_on[node], ~ends
        train, weight, node = train[stays], weight[stays], node[stays]
        waiting, below = waiting[going], below[going]
        if not len(train) or not len(waiting):
            break
        down = lambda rows, at: 2 * place[at] + (rank[rows, feature[at]] > cut[at])
        node, below = down(train, node), down(judged[waiting], below)
    return out


def held_out_chances(rows: DataFrame, classes: int, trees: int, depth: int, seed: int = 1) -> DataFrame:
    """(label, class, p): mean chance of each class for the held rows of each label, from ``rows`` (id, label, v, held).

    Each task holds all rows and grows some of the trees; only sums by label and class leave it.
    """
    parts = min(PARTS, trees)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        part = int(frame["part"].iloc[0])
        x, y, held = np.array(frame["v"].tolist(), float), frame["label"].to_numpy(np.int64), frame["held"].to_numpy(bool)
        if held.all() or not held.any():
            return pd.DataFrame({"label": [], "class": [], "p": []})
        total = sum(tree_chances(x, y, held, classes, depth, np.random.default_rng((seed, tree))) for tree in range(part, trees, parts))
        labels, at, sizes = np.unique(y[held], return_inverse=True, return_counts=True)
        sums = np.zeros((len(labels), classes))
        np.add.at(sums, at, total)
        return pd.DataFrame({"label": np.repeat(labels, classes), "class": np.tile(np.arange(classes), len(labels)), "p": (sums / sizes[:, None] / trees).ravel()})

    dealt = rows.select("id", "label", "v", "held").crossJoin(rows.sparkSession.range(parts).select(F.col("id").alias("part")))
    found = dealt.groupBy("part").applyInPandas(run, "label long, class int, p double")
    return found.groupBy("label", "class").agg(F.sum("p").alias("p"))
