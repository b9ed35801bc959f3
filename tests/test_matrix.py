import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.model import CellMatrix, div0
from cellgrid.operators import aggregate, qc, stats
from cellgrid.sources.tables import combine, open_matrix, write_matrix

X = np.array([[3, 0, 1, 0], [0, 0, 2, 0], [5, 1, 0, 0], [1, 1, 1, 0], [0, 0, 0, 0]], float)  # cells x genes, with an empty cell and an empty gene
LABELS = ["a", "a", "b", "b", "b"]


@pytest.fixture(scope="module")
def m(spark):
    cells = spark.createDataFrame([(i, c, i % 2) for i, c in enumerate(LABELS)], "cell long, cluster string, sample int")
    genes = spark.createDataFrame([(j, f"g{j}", "MT" if j == 1 else "1") for j in range(4)], "gene long, name string, chromosome string")
    entries = spark.createDataFrame([(int(i), int(j), float(X[i, j]), float(X[i, j] // 2)) for i, j in zip(*np.nonzero(X), strict=True)], "cell long, gene long, x double, unspliced double")
    return CellMatrix(cells, genes, entries)


def test_valid_genes_counts_empty_ones(m):
    got = {r.gene: (r.nnz, r.valid) for r in qc.valid_genes(m, 1, 0.6).collect()}
    assert got == {0: (3, False), 1: (2, True), 2: (3, False), 3: (0, False)}


def test_normalized_moments_equal_the_dense_ones(m):
    total = X.sum(1, keepdims=True)
    level = np.median(total[total > 0])
    dense = np.log2(np.divide(X, total, out=np.zeros_like(X), where=total > 0) * level + 1)
    got = {r.gene: (r["mean"], r.sd) for r in qc.gene_moments(qc.normalized(m), "v", m.n_cells()).collect()}
    for j in range(3):
        assert got[j] == pytest.approx((dense[:, j].mean(), dense[:, j].std()))


def test_deviance_equals_the_dense_formula(m):
    e = X.sum(1, keepdims=True) * X.sum(0) / X.sum()
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num((X - e) / np.sqrt(e + e**2 / 100))
    got = {x.gene: x.deviance for x in qc.deviance(m).collect()}
    for j in range(3):
        assert got[j] == pytest.approx(r[:, j].var())


def test_enrichment_equals_the_dense_formula(m):
    got = {(r.gene, r.cluster): r.enrichment for r in aggregate.enrichment(m, "cluster").collect()}
    for j in range(3):
        for c in "ab":
            own = np.array([x == c for x in LABELS])
            f, fo, mean, mo = (X[own, j] > 0).mean(), (X[~own, j] > 0).mean(), X[own, j].mean(), X[~own, j].mean()
            assert got[j, c] == pytest.approx((f + 0.1) / (fo + 0.1) * (mean + 0.01) / (mo + 0.01))


def test_category_ratio_takes_the_first_name_that_exists(m):
    got = {r.cell: r.ratio for r in qc.category_ratio(m, ("chrM", "MT")).collect()}
    assert got == pytest.approx({0: 0.0, 1: 0.0, 2: 1 / 6, 3: 1 / 3})


def test_div0(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (float("nan"), 1.0), (float("inf"), 1.0), (0.0, 0.0)]
    assert [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(div0(F.col("a"), F.col("b"))).collect()] == [0.5, 0, 0, 0, 0]


def test_combine_keeps_common_genes_and_columns(spark, m):
    a = CellMatrix(m.cells, m.genes.filter("gene <> 0"), m.entries)
    b = CellMatrix(m.cells.withColumn("extra", F.lit(1)).withColumn("sample", F.col("sample").cast("string")), m.genes, m.entries)
    both = combine([(a, F.col("cell") < 2), (b, F.col("cluster") == "b")])
    assert both.cells.columns == ["cell", "cluster"] and sorted(r.gene for r in both.genes.collect()) == [1, 2, 3]
    assert both.entries.agg(F.sum("x")).first()[0] == X[:, 1:].sum()


def test_matrix_round_trip(spark, m, tmp_path):
    write_matrix(m, str(tmp_path))
    back = open_matrix(spark, str(tmp_path))
    assert sorted(map(tuple, back.entries.collect())) == sorted(map(tuple, m.entries.collect()))


def test_rank_sum_counts_zeros_as_ties(m):
    side = m.cells.select("cell", F.when(F.col("cluster") == "a", "A").otherwise("B").alias("side"))
    sizes = side.agg(F.count_if(F.col("side") == "A").alias("n_a"), F.count_if(F.col("side") == "B").alias("n_b"))
    got = {r.gene: r.u for r in stats.rank_sum(m.entries.join(side, "cell"), sizes).collect()}
    for j in range(3):
        a, b = X[:2, j], X[2:, j]
        assert got[j] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_special_functions(spark):
    xs = [0.1, 0.5, 1.0, 1.5, 7.0, 123.4, 1e5]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, got in zip(xs, frame.select(stats.lgamma(F.col("x"))).collect(), strict=True):
        assert got[0] == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-9)
    for x, got in zip(xs, frame.select(stats.digamma(F.col("x"))).collect(), strict=True):
        h = 1e-5 * x
        assert got[0] == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-4, abs=1e-4)


def test_beta_cdf_equals_the_integral():
    for a, b, x in ((1.5, 2.0, 0.2), (4.5, 100.0, 0.2), (30.5, 3.0, 0.2), (2.0, 2.0, 0.9)):
        t = np.linspace(0, x, 400_001)
        density = t ** (a - 1) * (1 - t) ** (b - 1)
        area = np.trapezoid(density, t) / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        assert stats.beta_cdf(np.array([a]), np.array([b]), x)[0] == pytest.approx(area, abs=1e-6)


def test_trinaries_grow_with_the_count(spark):
    frame = spark.createDataFrame([(k, 50) for k in range(51)], "nnz long, n_cells long")
    p = [r.trinary for r in stats.trinarize(frame).orderBy("nnz").collect()]
    assert all(0 <= x <= 1 for x in p) and all(a <= b + 1e-12 for a, b in zip(p, p[1:], strict=False))


def test_q_values_are_monotone_and_above_p(spark):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(rng.random(40) ** 2)], "cluster string, gene long, p double")
    rows = stats.benjamini_hochberg(frame, "cluster", "p", "gene").orderBy("p").collect()
    assert all(r.q >= r.p for r in rows) and all(a.q <= b.q for a, b in zip(rows, rows[1:], strict=False))
