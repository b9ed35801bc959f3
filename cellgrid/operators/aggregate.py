"""Aggregations of the matrix and of cell attributes by label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.model import CellMatrix, div0


def label_sizes(m: CellMatrix, label: str) -> DataFrame:
    return m.cells.groupBy(F.col(label).alias("cluster")).agg(F.count("*").alias("n_cells"))


def by_label(m: CellMatrix, label: str, value: str = "x") -> DataFrame:
    """(gene, cluster, s, nnz, n_cells) for every gene that has an entry and every label: zeros filled on that grid only."""
    sizes = label_sizes(m, label)
    sums = m.with_label(label).groupBy("gene", "cluster").agg(F.sum(value).alias("s"), F.count_if(F.col(value) > 0).alias("nnz"))
    # One row per gene with an array over labels, exploded: the grid without a join of genes by labels.
    labels = sizes.agg(F.sort_array(F.collect_list("cluster")).alias("labels"))
    genes = sums.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.struct("s", "nnz")))).alias("found"))
    grid = genes.crossJoin(F.broadcast(labels)).select("gene", "found", F.explode("labels").alias("cluster"))
    at = F.col("found")[F.col("cluster")]
    filled = grid.select("gene", "cluster", F.coalesce(at["s"], F.lit(0.0)).alias("s"), F.coalesce(at["nnz"], F.lit(0)).cast("long").alias("nnz"))
    return filled.join(sizes, "cluster")


def label_means(m: CellMatrix, label: str) -> DataFrame:
    """Mean of each gene in each label, zeros included."""
    return by_label(m, label).withColumn("mean", F.col("s") / F.col("n_cells"))


def others(df: DataFrame, value: str) -> Column:
    """Total over all labels of the gene less the own: a window sum, not a self join."""
    return F.sum(value).over(Window.partitionBy("gene")) - F.col(value)


def enrichment(m: CellMatrix, label: str) -> DataFrame:
    """(f + .1) / (f_other + .1) * (m + .01) / (m_other + .01): f the share of nonzero cells, m the mean, others weighted by size."""
    g = by_label(m, label)
    for c in ("s", "nnz", "n_cells"):
        g = g.withColumn(f"{c}_o", others(g, c))
    f, fo = F.col("nnz") / F.col("n_cells"), F.col("nnz_o") / F.col("n_cells_o")
    mean, mean_o = F.col("s") / F.col("n_cells"), F.col("s_o") / F.col("n_cells_o")
    return g.withColumn("mean", mean).withColumn("nonzeros", f).withColumn("enrichment", (f + 0.1) / (fo + 0.1) * ((mean + 0.01) / (mean_o + 0.01)))


def top_by(df: DataFrame, group: str, by: Column, n: int, tie: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(by.desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


#: Aggregators by name, as builders of a column from a value's name and the name of an order.
AGGREGATORS = {
    "sum": lambda v, _: F.sum(v),
    "mean": lambda v, _: F.avg(v),
    "count": lambda v, _: F.count(v),
    "count_nonzero": lambda v, _: F.count_if(F.col(v) != 0),
    "median": lambda v, _: F.median(v),
    "std": lambda v, _: F.stddev_pop(v),
    "min": lambda v, _: F.min(v),
    "max": lambda v, _: F.max(v),
    "first": lambda v, by: F.min_by(v, by),
    "mode": lambda v, _: F.mode(v, True),
}


def aggregated(df: DataFrame, group: str, spec: dict[str, str | Callable], order: str) -> DataFrame:
    """One column for each entry of ``spec``: value name to an aggregator's name, or to a function that builds the column (of any aggregate, a grouped pandas UDF too)."""
    columns = []
    for value, how in spec.items():
        if not callable(how) and how not in AGGREGATORS:
            raise ValueError(f"no aggregator {how!r}; there are {', '.join(sorted(AGGREGATORS))}")
        columns.append((how(value) if callable(how) else AGGREGATORS[how](value, order)).alias(value))
    return df.groupBy(group).agg(*columns)


def mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most common value of each group, the least one of several."""
    counted = df.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), value)
    return counted.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def composition(df: DataFrame, group: str, part: str, min_cells: int = 0) -> DataFrame:
    """Share of each part in each group of at least ``min_cells`` rows; shares of a group sum to 1."""
    n = df.groupBy(group, part).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(group)))
    return n.filter(F.col("total") >= min_cells).withColumn("share", F.col("n") / F.col("total"))


def double_normalized(df: DataFrame, label: str, of: str) -> DataFrame:
    """Counts divided by the class's total, then by the label's total of those."""
    n = df.groupBy(label, of).agg(F.count("*").alias("n"))
    a = n.withColumn("a", F.col("n") / F.sum("n").over(Window.partitionBy(of)))
    return a.withColumn("share", F.col("a") / F.sum("a").over(Window.partitionBy(label)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins from ``low`` to ``high``, the last one closed; values outside are not counted."""
    v = F.col(value)
    inside = df.filter(v.between(low, high))
    k = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    return inside.groupBy(k.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def genotype(calls: DataFrame, threshold: float) -> DataFrame:
    """Positions with depth and positions that look like the reference, of each cell; 0/0 counts for neither."""
    ratio = div0(F.col("ad"), F.col("dp"))
    return calls.groupBy("cell").agg(F.count_if(F.col("dp") > 0).alias("depth"), F.count_if((F.col("dp") > 0) & (ratio <= threshold)).alias("n_ref"))


def share_expressing(entries: DataFrame, genes: list[int], threshold: float, n_cells: DataFrame) -> DataFrame:
    """Share of cells in which all given genes are above the threshold, and for each of them alone."""
    hit = entries.filter(F.col("gene").isin(genes) & (F.col("x") > threshold))
    one = hit.groupBy(F.col("gene").cast("string").alias("what")).agg(F.count("*").alias("n"))
    all_ = hit.groupBy("cell").agg(F.count("*").alias("k")).filter(F.col("k") == len(genes)).agg(F.lit("all").alias("what"), F.count("*").alias("n"))
    return one.unionByName(all_).crossJoin(F.broadcast(n_cells)).withColumn("share", F.col("n") / F.col("n_cells"))
