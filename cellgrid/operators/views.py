"""The tables behind drawings: sizes, positions, colours' codes and segments. Pixels are left to others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.model import CellMatrix
from cellgrid.operators import graph

#: A marker's size for a plane of this width, and the percentile of the neighbour radius that it follows.
WIDTH, PERCENT, MOST_NEIGHBOURS = 2500, 0.6, 50


def marker_size(points: DataFrame) -> float:
    """A size for markers in a plane (id, x, y) by local density: a percentile of the radius that holds up to 50 neighbours."""
    n, low, high = points.agg(F.count("*"), F.least(F.min("x"), F.min("y")), F.greatest(F.max("x"), F.max("y"))).first()
    k = min(n // 3, MOST_NEIGHBOURS)
    if k < 1 or high <= low:
        return 0.0
    near = graph.near_neighbours(points.select("id", F.array("x", "y").alias("v")), k)
    radius = near.groupBy("src").agg(F.max("d").alias("d")).agg(F.percentile("d", PERCENT)).first()[0]
    return float(WIDTH / (high - low) * radius)


def overview(m: CellMatrix, label: str, region: str, flags: dict[str, Column], genes: list[int]) -> DataFrame:
    """(cluster, what, value): mean total, share of each flag, share of each region, and log10 of the listed genes' mean, scaled to the median cluster's total."""
    from cellgrid.operators.qc import cell_totals

    own = m.cells.join(cell_totals(m.entries).select("cell", "total"), "cell", "left").fillna(0.0, ["total"]).withColumn("cluster", F.col(label))
    totals = own.groupBy("cluster").agg(F.avg("total").alias("mean_total"), F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(n) for n, c in flags.items()])
    long = lambda c: totals.select("cluster", F.lit(c).alias("what"), F.col(c).alias("value"))
    share = own.groupBy("cluster", region).agg(F.count("*").alias("n")).withColumn("value", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))
    out = share.select("cluster", F.concat(F.lit("region "), F.col(region).cast("string")).alias("what"), "value")
    for c in ("mean_total", *flags):
        out = out.unionByName(long(c))
    listed = m.entries.filter(F.col("gene").isin(genes)).join(own.select("cell", "cluster"), "cell").groupBy("cluster", "gene").agg(F.sum("x").alias("s"))
    grid = totals.select("cluster", "mean_total", "n", F.explode(F.array(*map(F.lit, genes))).alias("gene")).crossJoin(F.broadcast(totals.agg(F.median("mean_total").alias("level"))))
    scaled = F.coalesce("s", F.lit(0.0)) / F.col("n") / F.col("mean_total") * F.col("level")
    shown = grid.join(listed, ["cluster", "gene"], "left").select("cluster", F.concat(F.lit("gene "), F.col("gene").cast("string")).alias("what"), F.log10(scaled + 0.001).alias("value"))
    return out.unionByName(shown)


def segments(tree: np.ndarray, places: np.ndarray | None = None) -> list[tuple[float, float, float, float, float, float]]:
    """For each join of a linkage (left x, left y, right x, right y, height of the bar): where its bracket stands; leaves stand at 0, 1, … or at ``places``."""
    n = len(tree) + 1
    x = list(map(float, np.arange(n) if places is None else np.sort(places)))
    y = [0.0] * n
    out = []
    for a, b, height, _ in tree:
        a, b = int(a), int(b)
        out.append((x[a], y[a], x[b], y[b], float(height)))
        x.append(x[a] + (x[b] - x[a]) / 2)
        y.append(float(height))
    return out


def metro_map(skeleton: DataFrame, points: DataFrame, folder: str) -> DataFrame:
    """(cluster, line, x, y): each cluster's component in the skeleton (a, b), singletons -1, and its median place."""
    nodes = points.select(F.col("label").alias("id")).distinct()
    lines = graph.renumbered(graph.components(skeleton.select(F.col("a").alias("src"), F.col("b").alias("dst")), nodes, folder))
    middle = points.groupBy(F.col("label").alias("id")).agg(F.median("x").alias("x"), F.median("y").alias("y"))
    return lines.join(middle, "id").select(F.col("id").alias("cluster"), F.col("comp").alias("line"), "x", "y")


def codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ``name``: the place of the column's value among its sorted values, from 0; ranks are taken over the values only."""
    ids = df.select(column).distinct().withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
    return df.join(ids, df[column].eqNullSafe(ids[column]), "left").drop(ids[column])


def covariates(m: CellMatrix, attributes: dict[str, str], genes: dict[str, int]) -> DataFrame:
    """(cell, …): the code of each named attribute, and each named gene's count."""
    out = m.cells
    for name, column in attributes.items():
        out = codes(out.withColumn("_own", F.col(column)).drop(*({name} - {column})) if name != column else out.withColumn("_own", F.col(column)).drop(column), "_own", name).drop("_own")
    for name, gene in genes.items():
        own = m.entries.filter(F.col("gene") == gene).groupBy("cell").agg(F.sum("x").alias(name))
        out = out.join(own, "cell", "left").fillna(0.0, [name])
    return out.select("cell", *attributes, *genes)


def volcano(tested: DataFrame, least_change: float = 1.0, most_p: float = 0.05) -> DataFrame:
    """Adds ``height``, -log10 of the adjusted chance, a chance of 0 standing at the least one above it, and ``side``: up, down or none."""
    least = tested.filter("padj > 0").agg(F.min("padj").alias("_least"))
    shown = tested.crossJoin(F.broadcast(least)).withColumn("height", -F.log10(F.when(F.col("padj") == 0, F.coalesce("_least", F.lit(1.0))).otherwise(F.col("padj"))))
    far = (F.abs("change") >= least_change) & (F.col("padj") < most_p)
    return shown.drop("_least").withColumn("side", F.when(~far, "none").when(F.col("change") > 0, "up").otherwise("down"))


def midpoint_scaled(value: Column, low: float, middle: float, high: float) -> Column:
    """A value on a scale from 0 to 1 that has its middle where it is wanted."""
    below = 0.5 * (value - low) / (middle - low) if middle > low else F.lit(0.5)
    above = 0.5 + 0.5 * (value - middle) / (high - middle) if high > middle else F.lit(0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(value < middle, below).otherwise(above)))
