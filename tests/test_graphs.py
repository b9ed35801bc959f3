import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellgrid.operators import cluster, embed, factor, graph


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 0.3, size=(25, 3)) for c in (0, 4, 9)])


@pytest.fixture(scope="module")
def knn(spark, blobs):
    return graph.exact_knn(points(spark, blobs), points(spark, blobs), 5, blocks=3).persist()


def test_exact_knn(knn, blobs):
    got = {}
    for r in knn.collect():
        got.setdefault(r.src, {})[r.rank] = r.dst
    d = np.sqrt(((blobs[:, None] - blobs[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i, row in enumerate(d):
        assert [got[i][k] for k in range(1, 6)] == np.argsort(row)[:5].tolist()


def test_graphs_are_nested_and_symmetric(knn):
    pair = lambda df: {(r.src, r.dst) for r in df.collect()}
    both, near = pair(graph.mutual(knn)), pair(graph.radius_graph(knn))
    assert near <= both <= pair(knn) and both == {(b, a) for a, b in both}


def test_components_and_numbers(spark, tmp_path):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in [*range(21), 30, 31, 40]], "id long")
    found = {r.id: r.comp for r in graph.renumbered(graph.components(edges, nodes, str(tmp_path))).collect()}
    assert {found[k] for k in range(21)} == {0} and found[30] == found[31] == 1 and found[40] == -1


def test_divergences(spark):
    p = spark.createDataFrame([([0.5, 0.5, 0.0], [0.25, 0.25, 0.5]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.2, 0.3, 0.5], [0.2, 0.3, 0.5])], "p array<double>, q array<double>")
    rows = p.select(graph.jensen_shannon("p", "q").alias("a"), graph.jensen_shannon("q", "p").alias("b"), graph.kullback_leibler("p", "q").alias("k")).collect()
    assert all(0 <= r.a <= 1 + 1e-12 and r.a == pytest.approx(r.b) for r in rows)
    assert rows[1].a == pytest.approx(1) and rows[2].a == 0 and rows[1].k == float("inf") and rows[0].k == pytest.approx(1.0)


def test_multinomial_is_a_chance(spark):
    p = spark.createDataFrame([([5.0, 0.0, 1.0], [5.0, 0.0, 1.0]), ([50.0, 0.0, 1.0], [0.0, 50.0, 1.0])], "p array<double>, q array<double>")
    rows = p.select(graph.multinomial("p", "q").alias("d"), graph.multinomial("p", "q", True).alias("s")).collect()
    assert 0 < rows[0].d < 0.5 < rows[1].d <= 1 and rows[0].s != rows[0].d


@settings(max_examples=30, deadline=None)
@given(st.integers(4, 30), st.integers(1, 4), st.integers(0, 1000))
def test_balanced_neighbours(n, k, seed):
    rng = np.random.default_rng(seed)
    sight = min(2 * k, n - 1)
    order = np.array([[i, *rng.permutation([j for j in range(n) if j != i])[:sight]] for i in range(n)])
    index, _ = cluster.balance(order, rng.random(order.shape), k, 2 * k)
    others = index[index != np.arange(n)[:, None]]
    assert index.shape == (n, k) and np.bincount(others, minlength=n).max(initial=0) <= 2 * k


def test_louvain_finds_cliques():
    edges = [(a + o, b + o) for o in (0, 6, 12) for a, b in itertools.combinations(range(6), 2)] + [(5, 6), (11, 12)]
    src, dst = np.array(edges).T
    w = np.ones(len(src))
    labels = cluster.louvain(18, src, dst, w)
    assert len(set(labels)) == 3 and all(len(set(labels[o : o + 6])) == 1 for o in (0, 6, 12))
    assert cluster.modularity(labels, src, dst, w) > cluster.modularity(np.arange(18), src, dst, w)


def test_communities_and_polish(spark, knn, blobs, tmp_path):
    nodes = points(spark, blobs).select("id")
    labels = cluster.communities(nodes, knn.withColumn("w", F.lit(1.0)), min_cells=3, folder=str(tmp_path))
    clean = {r.id: r.label for r in cluster.polish(labels, knn.select("src", "dst"), 3).collect()}
    groups = [{clean[i] for i in range(o, o + 25)} for o in (0, 25, 50)]
    assert not groups[0] & groups[1] and not groups[1] & groups[2]
    assert set(clean.values()) == set(range(len(set(clean.values()))))


def test_dispersed_clusters_break():
    rng = np.random.default_rng(4)
    one, two = rng.normal(0, 0.2, (60, 2)), rng.normal(8, 0.2, (60, 2))
    assert set(cluster.broken(rng.uniform(-1, 1, (300, 2)))) == {0}
    parts = cluster.broken(np.concatenate([one, two]))
    assert {*parts[:60]} - {-1} != {*parts[60:]} - {-1} and len(set(parts) - {-1}) == 2
    assert set(cluster.broken(np.zeros((20, 2)))) == {0}


def test_polish_breaks_and_marks_on_the_plane(spark, tmp_path):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(0, 0.2, (60, 2)), rng.normal(8, 0.2, (60, 2))])
    plane = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    edges = graph.exact_knn(points(spark, xy), points(spark, xy), 5, blocks=2).select("src", "dst")
    labels = plane.select("id", F.lit(0).alias("label"))
    assert {r.label for r in cluster.polish(labels, edges, 5).collect()} == {0}
    got = {r.id: r.label for r in cluster.polish(labels, edges, 5, plane=plane, folder=str(tmp_path)).collect()}
    assert len(got) == 120 and set(got.values()) - {-1} == {0, 1}
    assert not {got[i] for i in range(60)} & {got[i] for i in range(60, 120)} - {-1}


def test_complete_linkage():
    x = np.array([0.0, 1.0, 5.0, 6.5, 20.0])
    d = np.abs(x[:, None] - x[None])
    tree = cluster.linkage(d)
    assert tree[:, 2].tolist() == [1.0, 1.5, 6.5, 20.0] and tree[:, 3].tolist() == [2, 2, 4, 5]
    assert cluster.cut_tree(tree, 3).tolist() == [0, 0, 1, 1, 2]
    order = cluster.leaf_order(tree, d)
    assert sorted(order) == list(range(5)) and {tuple(order), tuple(order[::-1])} & {(0, 1, 2, 3, 4)}


def test_paris_splits_the_bridge():
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    src, dst = np.array(edges).T
    tree = cluster.paris(6, src, dst, np.array([5.0] * 6 + [0.5]))
    assert cluster.cut_tree(tree, 2).tolist() == [0, 0, 0, 1, 1, 1]
    labels = np.arange(6)
    assert cluster.split_by_coverage(labels, src, dst, tree, 0.8).tolist() == [0, 0, 0, 1, 1, 1]
    assert cluster.split_by_coverage(labels, src, dst, tree, 0.99) is None


def test_dbscan(blobs):
    labels = cluster.dbscan(np.vstack([blobs, [[100, 100, 100]]]), 1.2, 4)
    assert labels[-1] == -1 and len(set(labels[:-1]) - {-1}) == 3


def test_merge_until_all_score():
    centre = {0: (0.0, 0.0), 1: (1.0, 0.0), 2: (9.0, 0.0)}
    base = {0: 0, 1: 3, 2: 4}

    def rescore(to):
        alive = sorted(set(to.values()))
        return {c: sum(base[o] for o in to if to[o] == c) for c in alive}, {c: centre[c] for c in alive}

    assert cluster.merge_rounds(dict(base), dict(centre), 1, rescore) == {0: 0, 1: 0, 2: 1}


def test_pca_equals_the_dense_one(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(1.0, size=(40, 6)).astype(float) * [5, 3, 1, 1, 1, 1]
    x[7] = 0
    values = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "cell long, gene long, v double")
    cells = spark.createDataFrame([(i,) for i in range(40)], "cell long")
    parts = factor.pca(values, 40, 3)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:3]
    assert parts.variance == pytest.approx(want)
    y = np.array([r.pca for r in factor.project(values, cells, parts).orderBy("cell").collect()])
    assert y == pytest.approx((x - x.mean(0)) @ parts.loadings)
    assert factor.significant(factor.project(values, cells, parts), 3)[0] == 0


def test_hpf_likelihood_grows(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.poisson(rng.gamma(1, 1, (30, 2)) @ rng.gamma(1, 1, (2, 12)))
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "cell long, gene long, x double")
    found = factor.hpf(entries, 2, str(tmp_path), max_iter=6, interval=1, min_iter=6)
    assert len(found.likelihood) == 6 and all(b >= a - 0.01 * abs(a) for a, b in itertools.pairwise(found.likelihood)) and found.likelihood[-1] > found.likelihood[0]


def test_redundant_components():
    rng = np.random.default_rng(5)
    a = rng.random((50, 2))
    twin = np.column_stack([a, a[:, 0] * 1.01])
    assert factor.redundant(twin, twin, 0.95) == [2] and factor.redundant(a, a, 0.95) == []


def test_tsne_keeps_groups_apart(blobs):
    y = embed.tsne(blobs, 10, 60, 120)
    centre = [y[o : o + 25].mean(0) for o in (0, 25, 50)]
    spread = max(np.linalg.norm(y[o : o + 25] - c, axis=1).mean() for o, c in zip((0, 25, 50), centre, strict=True))
    assert min(np.linalg.norm(a - b) for a, b in itertools.combinations(centre, 2)) > 2 * spread


def test_gridded_forces_equal_those_of_all_pairs(blobs):
    y = np.random.default_rng(1).normal(size=(300, 2)) * 3
    gap = y[:, None] - y[None]
    q = 1 / (1 + (gap**2).sum(2))
    np.fill_diagonal(q, 0)
    total, push = embed.repulsion(y)
    want = (gap * (q**2)[:, :, None]).sum(1)
    assert total == pytest.approx(q.sum(), rel=1e-3) and np.abs(push - want).max() < 0.02 * np.abs(want).max()
    y = y[: len(blobs)]
    a, b = embed.Exact(blobs, 10).slope(y, 12), embed.Gridded(blobs, 74 / 3).slope(y, 12)
    assert a.shape == b.shape and np.isfinite(b).all()
    a = embed.Exact(blobs, 74 / 3).slope(y, 12)
    assert np.abs(a - b).max() < 0.05 * np.abs(a).max()


@pytest.mark.parametrize(("spread", "reach"), [([60] * 2000, 8), ([20] * 2000, 2), ([4] * 1500 + [100] * 40, 0)])
def test_wide_layouts_take_a_small_grid_and_lose_no_force(spread, reach):
    y = np.random.default_rng(1).normal(size=(len(spread), 2)) * np.array(spread)[:, None]
    gap = y[:, None] - y[None]
    q = 1 / (1 + (gap**2).sum(2))
    np.fill_diagonal(q, 0)
    total, push = embed.repulsion(y)
    want = (gap * (q**2)[:, :, None]).sum(1)
    assert total == pytest.approx(q.sum(), rel=1e-3) and np.abs(push - want).max() < 0.01 * np.abs(want).max()
    if reach:
        i, j = embed.near_pairs(y, reach)
        met = np.zeros(q.shape, int)
        np.add.at(met, (i, j), 1)
        inside = np.triu((gap**2).sum(2) < reach**2, 1)
        assert ((met + met.T)[inside] == 1).all() and (met + met.T).max() == 1


@pytest.mark.parametrize("most", [100_000, 100])
def test_large_tables_are_embedded_by_tsne(spark, most, monkeypatch):
    monkeypatch.setattr(embed, "SHARE", 1)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.column_stack([rng.normal(0, 1, (2000, 2)), rng.normal(c, 0.3, (2000, 3))]) for c in (0, 20, 40)])
    got = embed.embed(points(spark, x), 10, 60, 120, most=most).toPandas().sort_values("id")
    assert got["id"].tolist() == list(range(6000))
    y = got[["x", "y"]].to_numpy()
    assert not np.allclose(y, x[:, :2])
    near, _ = embed.nearest(y, y, 5, itself=True)
    assert (near // 2000 == np.repeat([0, 1, 2], 2000)[:, None]).mean() > 0.95


def test_surprise_finds_cliques():
    edges = [(a + o, b + o) for o in (0, 6, 12) for a, b in itertools.combinations(range(6), 2)] + [(5, 6), (11, 12)]
    src, dst = np.array(edges).T
    labels = cluster.surprise_communities(18, src, dst, np.ones(len(src)))
    assert all(len(set(labels[o : o + 6])) == 1 for o in (0, 6, 12)) and len(set(labels)) == 3


def test_harmonized_batches_meet(spark):
    rng = np.random.default_rng(6)
    base = np.concatenate([rng.normal(0, 0.2, (60, 2)), rng.normal(5, 0.2, (60, 2))])
    rows = [(i, "ab"[i % 2], [float(x) for x in v + (1.0 if i % 2 else 0.0)]) for i, v in enumerate(base)]
    out = factor.harmonized(spark.createDataFrame(rows, "id long, batch string, v array<double>"), clusters=4)
    got = {r.id: np.array(r.v) for r in out.collect()}
    gap = lambda s: np.linalg.norm(np.mean([s(i) for i in range(0, 60, 2)], axis=0) - np.mean([s(i) for i in range(1, 60, 2)], axis=0))
    assert gap(lambda i: got[i]) < 0.4 * gap(lambda i: np.array(rows[i][2]))
    assert np.linalg.norm(got[0] - got[100]) > 3


def test_variance_trend_ranks_noisy_genes(spark):
    rows = [(k, 1.0 + k / 10, (1.0 + k / 10) ** 0.5 * (3.0 if k == 50 else 1.0)) for k in range(200)] + [(500, 0.0, 0.0)]
    scored = factor.variance_trend(spark.createDataFrame(rows, "gene long, mean double, sd double"))
    assert scored.count() == 200 and scored.orderBy(F.col("score").desc()).first().gene == 50


def test_gamma_divergence_equals_the_integral(spark):
    import math

    t = np.linspace(1e-6, 60, 600_001)
    density = lambda a, r: r**a / math.gamma(a) * t ** (a - 1) * np.exp(-r * t)
    p, q = density(2.5, 1.2), density(3.0, 0.7)
    want = np.trapezoid(p * np.log2(p / q), t)
    got = spark.range(1).select(graph.gamma_divergence(F.lit(2.5), F.lit(1.2), F.lit(3.0), F.lit(0.7))).first()[0]
    assert got == pytest.approx(want, abs=1e-4)


def test_equal_points_are_laid_out_once():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(50, 3))
    points = base[np.r_[np.arange(50), rng.integers(0, 50, 400), np.zeros(150, int)]]
    each, of, many = np.unique(points, axis=0, return_inverse=True, return_counts=True)
    y = rng.normal(size=(len(each), 2))
    one, all_pairs = embed.Counted(each, many, 20.0), embed.Exact(points, 20.0)
    assert np.allclose(one.slope(y, 3)[of.ravel()], all_pairs.slope(y[of.ravel()], 3), atol=1e-12)
    index, square = embed.nearest(points, points, 12, itself=True)
    table = ((points[:, None] - points[None]) ** 2).sum(2)
    assert np.allclose(np.take_along_axis(table, index, 1), square) and not (index == np.arange(600)[:, None]).any()
    np.fill_diagonal(table, np.inf)
    assert np.allclose(np.sort(square, 1), np.sort(table, 1)[:, :12]) and all(len(set(r)) == 12 for r in index.tolist())
    assert np.bincount(index.ravel()).max() < 100  # no equal point is the neighbour of all


def test_clusters_that_do_not_vary_have_a_tree(spark):
    rows = [(c, g, 0.0 if c == 2 else float((c + 1) * g % 5)) for c in range(4) for g in range(1, 8)]
    names, distance, tree = cluster.correlation_tree(spark.createDataFrame(rows, "cluster long, gene long, mean double"))
    v = {c: np.log1p([x for k, _, x in rows if k == c]) for c in range(4)}
    assert names == [0, 1, 2, 3] and (distance[2][[0, 1, 3]] == 1).all() and len(tree) == 3
    assert np.isclose(distance[0, 1], 1 - np.corrcoef(v[0], v[1])[0, 1])
