"""Statistics of genes by label: tests, permutations, scores."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.model import CellMatrix


def lgamma(x: Column) -> Column:
    """ln Γ(x) for x > 0 inside codegen: shifted up by 8, then Stirling's series."""
    shift = reduce(lambda a, k: a * (x + k), range(1, 8), x)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(shift)


def digamma(x: Column) -> Column:
    """ψ(x) for x > 0 inside codegen, by the same shift and its asymptotic series."""
    shift = reduce(lambda a, k: a + 1 / (x + k), range(1, 8), 1 / x)
    y = x + 8
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4.0))) - 1 / (252 * F.pow(y, F.lit(6.0))) - shift


def beta_cdf(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """Regularized incomplete beta function by its continued fraction (modified Lentz)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    swap = x >= (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    ln = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(ln(p + q) - ln(p) - ln(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(p), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        for up in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + up / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            out *= c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    value = front * out
    return np.where(swap, 1 - value, value)


def trinarize(counts: DataFrame, f: float = 0.2, a: float = 1.5, b: float = 2.0) -> DataFrame:
    """Adds ``trinary``: the posterior chance that the share of nonzero cells is above ``f``, from ``nnz`` of ``n_cells``.

    The special function runs once for each distinct (nnz, n_cells).
    """

    @F.pandas_udf("double")
    def posterior(k: pd.Series, n: pd.Series) -> pd.Series:
        low = beta_cdf(a + k.to_numpy(float), b - k.to_numpy(float) + n.to_numpy(float), f)
        return pd.Series(np.where(low == 0, 1.0, 1 - low))

    pairs = counts.select("nnz", "n_cells").distinct().withColumn("trinary", posterior("nnz", "n_cells"))
    return counts.join(pairs, ["nnz", "n_cells"])


def mid_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """Adds ``rank``: the mean rank among equal values, within each group."""
    w = Window.partitionBy(group).orderBy(value)
    ties = Window.partitionBy(group, value)
    return df.withColumn("rank", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)


def rank_sum(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mann-Whitney U and z of label A against label B for each gene, zeros included.

    ``values(gene, side, x)`` holds nonzero values; ``sizes(n_a, n_b)`` is one row. The zeros of
    a gene are one group of ties below all its values, so they need no rows.
    """
    counted = values.groupBy("gene", "x").agg(F.count_if(F.col("side") == "A").alias("a"), F.count("*").alias("t"))
    up = Window.partitionBy("gene").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("gene")
    seen = counted.crossJoin(F.broadcast(sizes)).withColumn("zeros", F.col("n_a") + F.col("n_b") - F.sum("t").over(all_)).withColumn("za", F.col("n_a") - F.sum("a").over(all_))
    ranked = seen.withColumn("rank", F.col("zeros") + F.coalesce(F.sum("t").over(up), F.lit(0)) + (F.col("t") + 1) / 2.0)
    per = ranked.groupBy("gene").agg(
        F.sum(F.col("a") * F.col("rank")).alias("ra"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"), F.first("zeros").alias("zeros"), F.first("za").alias("za"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")
    )
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    u = F.col("ra") + F.col("za") * (F.col("zeros") + 1) / 2.0 - F.col("n_a") * (F.col("n_a") + 1) / 2.0
    ties = F.col("ties") + F.pow("zeros", F.lit(3.0)) - F.col("zeros")
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12.0 * (n + 1 - ties / (n * (n - 1))))
    return per.select("gene", u.alias("u"), F.when(sd == 0, 0.0).otherwise((u - F.col("n_a") * F.col("n_b") / 2.0) / sd).alias("z"))


def ks_distance(df: DataFrame, group: str, side: str, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between side A and side B of each group; null if a side is empty."""
    n = df.groupBy(group, value).agg(F.count_if(F.col(side) == "A").alias("a"), F.count_if(F.col(side) == "B").alias("b"))
    up, all_ = Window.partitionBy(group).orderBy(value), Window.partitionBy(group)
    share = lambda s: F.try_divide(F.sum(s).over(up), F.sum(s).over(all_))
    gap = F.abs(share("a") - share("b"))
    return n.withColumn("gap", gap).groupBy(group).agg(F.max("gap").alias("d"))


def permutation_p(scores: DataFrame, null: DataFrame, group: str, value: str) -> DataFrame:
    """Adds ``p``: the share of the group's null values that are at least the score (left insertion)."""
    both = scores.withColumn("_null", F.lit(0)).unionByName(null.select(group, value).withColumn("_null", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy(group, value)
    below = F.sum("_null").over(w) - F.sum("_null").over(own)
    total = F.sum("_null").over(Window.partitionBy(group))
    return both.withColumn("p", 1 - below / total).filter("_null = 0").drop("_null")


def benjamini_hochberg(df: DataFrame, group: str, p: str, tie: str) -> DataFrame:
    """Adds ``q``: the running least of p * m / rank from the top."""
    up = Window.partitionBy(group).orderBy(p, tie)
    down = Window.partitionBy(group).orderBy(F.col(p).desc(), F.col(tie).desc())
    raw = df.withColumn("_q", F.col(p) * F.count("*").over(Window.partitionBy(group)) / F.row_number().over(up))
    return raw.withColumn("q", F.least(F.min("_q").over(down), F.lit(1.0))).drop("_q")


def shuffled_labels(cells: DataFrame, label: str, seed: int = 21) -> DataFrame:
    """(cell, label): the labels dealt to the cells anew, each as often as before, by two hash orders."""
    from cellgrid.operators.qc import hashed, numbered

    order = lambda s: numbered(cells.select("cell", label), hashed(F.col("cell"), s), "cell", "_place")
    return order(seed).select("cell", "_place").join(order(seed + 1).select(label, "_place"), "_place").select("cell", label)


def enrichment_test(m: CellMatrix, label: str, seed: int = 21) -> DataFrame:
    """Enrichment of each gene in each cluster, with p, the share of the cluster's scores under dealt labels that are at least as high, and q."""
    from cellgrid.operators.aggregate import enrichment

    score = lambda x: enrichment(x, label).select("cluster", "gene", F.round("enrichment", 9).alias("e"))
    dealt = m.cells.drop(label).join(shuffled_labels(m.cells, label, seed), "cell")
    found = permutation_p(score(m), score(CellMatrix(dealt, m.genes, m.entries)), "cluster", "e")
    return benjamini_hochberg(found, "cluster", "p", "gene")


def t_test_p(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """Two-sided chance of a t statistic at least as far from 0; 1 where there is none."""
    t, n = np.asarray(t, float), np.asarray(freedom, float)
    out, ok = np.ones(len(t)), np.isfinite(t) & (n > 0) & (t != 0)
    if ok.any():
        n, square = n[ok], t[ok] ** 2
        out[ok] = beta_cdf(n / 2, np.full(len(n), 0.5), np.minimum(n / (n + square), 1 - 1e-15))
    return out


def welch(m: CellMatrix, label: str) -> DataFrame:
    """(gene, cluster) moments of the normalized values for tests, and mean and share of the counts; zeros included."""
    from cellgrid.operators.aggregate import by_label
    from cellgrid.operators.qc import normalized

    v = normalized(m).join(m.cells.select("cell", F.col(label).alias("cluster")), "cell")
    sums = v.groupBy("gene", "cluster").agg(F.sum("v").alias("sv"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    g = by_label(m, label).join(sums, ["gene", "cluster"], "left").fillna(0.0, ["sv", "ss"])
    mean, n = F.col("sv") / F.col("n_cells"), F.col("n_cells")
    var = F.greatest((F.col("ss") / n - mean * mean) * n / (n - 1), F.lit(0.0))
    return g.select("gene", "cluster", mean.alias("level"), var.alias("var"), (F.col("s") / n).alias("mean"), (F.col("nnz") / n).alias("f"), n.alias("n"))


def pairwise_de(stats: DataFrame, fold: float = 2.0, least_f: float = 0.3, least_gap: float = 0.7, most_q: float = 0.001) -> DataFrame:
    """For each pair of labels a < b the number of genes that tell them apart.

    A gene does if Welch's t-test on normalized values has q below ``most_q`` (q-values within the
    pair), the means differ ``fold`` times, and more than ``least_f`` of the higher label's cells
    have it, the other's share being less by ``least_gap`` of the greater one.
    """

    @F.pandas_udf("double")
    def chance(t: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series(t_test_p(t.to_numpy(), freedom.to_numpy()))

    # One array of labels a gene: pairs are made inside the row, not by joining a gene's rows with each other.
    columns = ("cluster", "level", "var", "mean", "f", "n")
    rows = stats.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("all")).select("gene", "all", F.posexplode("all").alias("k", "x"))
    pairs = rows.select("gene", F.col("x").alias("a"), F.explode(F.expr("slice(all, k + 2, size(all))")).alias("b"))
    pa, pb = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    freedom = (pa + pb) * (pa + pb) / (pa * pa / (F.col("a.n") - 1) + pb * pb / (F.col("b.n") - 1))
    high, low = F.greatest("a.mean", "b.mean"), F.least("a.mean", "b.mean")
    up = F.when(F.col("a.mean") >= F.col("b.mean"), F.col("a.f")).otherwise(F.col("b.f"))
    down = F.when(F.col("a.mean") >= F.col("b.mean"), F.col("b.f")).otherwise(F.col("a.f"))
    hit = (high >= fold * low) & (up > least_f) & ((up - down) / F.greatest(up, down) > least_gap)
    tested = pairs.select(
        "gene", F.col("a.cluster").alias("a"), F.col("b.cluster").alias("b"), hit.alias("hit"), F.concat_ws("\t", "a.cluster", "b.cluster").alias("pair"),
        F.when(pa + pb > 0, (F.col("a.level") - F.col("b.level")) / F.sqrt(pa + pb)).alias("t"), F.when(pa + pb > 0, freedom).alias("freedom"),
    ).withColumn("p", chance(F.coalesce("t", F.lit(0.0)), F.coalesce("freedom", F.lit(1.0))))
    found = benjamini_hochberg(tested, "pair", "p", "gene")
    return found.groupBy("a", "b").agg(F.count_if(F.col("hit") & (F.col("q") < most_q)).alias("n"))


def gsea(scores: DataFrame, members: DataFrame, permutations: int = 1000, seed: int = 1000) -> DataFrame:
    """(cluster, set, score, p) from scores (cluster, gene, score) and members (set, gene).

    A score is the greatest lead, along the genes in their stored order, of the hits' share of the
    set's score over the share of misses; it is met right at a hit. p is the share of permuted sets
    that reach it: permutation r has the genes of least hash under seed + r, as many as the set.
    Sets are gene lists of a file, broadcast; a task holds one cluster's column of scores.
    """
    from cellgrid.operators.qc import hashes

    sets = members.groupBy("set").agg(F.sort_array(F.collect_set("gene")).alias("genes")).orderBy("set").collect()
    listed = [(r["set"], np.array(r["genes"], np.int64)) for r in sets]

    def lead(score: np.ndarray, at: np.ndarray, misses: int) -> float:
        own = score[at]
        total = own.sum()
        return float((own.cumsum() / total - (at - np.arange(len(at))) / misses).max()) if total and misses else 0.0

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("gene")
        genes, score = frame["gene"].to_numpy(np.int64), frame["score"].to_numpy(float)
        found = [(name, at) for name, of in listed if len(at := np.flatnonzero(np.isin(genes, of)))]
        own = np.array([lead(score, at, len(genes) - len(at)) for _, at in found])
        below = np.zeros(len(found))
        sizes = {len(at) for _, at in found}
        for r in range(permutations):
            order = np.lexsort((genes, hashes(genes, seed + r)))
            null = {n: lead(score, np.sort(order[:n]), len(genes) - n) for n in sizes}
            below += np.array([null[len(at)] for _, at in found]) < own - 1e-12
        return pd.DataFrame({"cluster": frame["cluster"].iloc[0], "set": [name for name, _ in found], "score": own, "p": 1 - below / max(permutations, 1)})

    kind = scores.schema["cluster"].dataType.simpleString()
    return scores.select("cluster", "gene", "score").groupBy("cluster").applyInPandas(one, f"cluster {kind}, set string, score double, p double")


def neighborhood_enrichment(edges: DataFrame, entries: DataFrame, n_cells: DataFrame, k: float, eps: float = 0.1) -> DataFrame:
    """For each (cell, gene): neighbours' nonzero rate and mean against those of all other cells."""
    near = edges.join(entries.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell"), "gene").agg(F.sum("x").alias("s"), F.count_if(F.col("x") > 0).alias("z"))
    total = entries.groupBy("gene").agg(F.sum("x").alias("ts"), F.count_if(F.col("x") > 0).alias("tz"))
    e = near.join(total, "gene").crossJoin(F.broadcast(n_cells))
    rest = F.col("n_cells") - k
    ratio = lambda a, t: (F.col(a) / k + eps) / ((F.col(t) - F.col(a)) / rest + eps)
    return e.select("cell", "gene", (ratio("z", "tz") * ratio("s", "ts")).alias("enrichment"))


def laplacian_score(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """1 - L'/D' of each gene over a symmetric weighted graph."""
    degree = edges.groupBy(F.col("src").alias("cell")).agg(F.sum("w").alias("d"))
    total = degree.agg(F.sum("d").alias("sd"))
    own = entries.join(degree, "cell").groupBy("gene").agg(F.sum(F.col("d") * F.col("x")).alias("t"), F.sum(F.col("d") * F.col("x") * F.col("x")).alias("q"))
    a = edges.join(entries.select(F.col("cell").alias("src"), "gene", F.col("x").alias("xa")), "src")
    cross = a.join(entries.select(F.col("cell").alias("dst"), "gene", F.col("x").alias("xb")), ["dst", "gene"]).groupBy("gene").agg(F.sum(F.col("w") * F.col("xa") * F.col("xb")).alias("c"))
    s = own.join(cross, "gene", "left").fillna(0.0, ["c"]).crossJoin(F.broadcast(total))
    mid = F.col("t") * F.col("t") / F.col("sd")
    d = F.col("q") - mid
    return s.select("gene", (1 - (F.col("c") - mid) / F.when(d < 1e-12, 10000.0).otherwise(d)).alias("score"))


def tag_posteriors(definitions: DataFrame, trinaries: DataFrame) -> DataFrame:
    """Chance of each tag in each cluster: product of the positive genes' posteriors and the negative ones' complements."""
    p = F.when(F.col("sign") > 0, F.col("trinary")).otherwise(1 - F.col("trinary"))
    rows = trinaries.join(F.broadcast(definitions), "gene").groupBy("cluster", "tag").agg(F.collect_list(F.struct("gene", p.alias("p"))).alias("all"))
    return rows.select("cluster", "tag", F.aggregate(F.array_sort("all"), F.lit(1.0), lambda a, x: a * x["p"]).alias("posterior"))
