import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.model import CellMatrix
from cellgrid.operators import aggregate, cluster, doublets, embed, factor, graph, qc, stats, views
from cellgrid.operators.deck import Deck
from cellgrid.plans import engines
from cellgrid.plans.analysis import checked
from cellgrid.plans.config import DEFAULTS, merged
from cellgrid.plans.workflow import Build
from cellgrid.sources.tables import write_matrix


def frame(spark, points, kind="long"):
    return spark.createDataFrame([(int(i), [float(x) for x in p]) for i, p in enumerate(points)], f"id {kind}, v array<double>")


def blobs(n=240, groups=4, width=8, seed=1):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % groups
    return rng.normal(size=(n, width)) + 7 * rng.normal(size=(groups, width))[label], label


def test_hashes_agree_and_spread(spark):
    keys = np.arange(-50, 5000)
    got = spark.createDataFrame([(int(k),) for k in keys], "k long").select("k", qc.hashed(F.col("k"), 7).alias("h")).orderBy("k").toPandas()["h"].to_numpy()
    assert (got == qc.hashes(keys, 7)).all()
    assert abs(np.corrcoef(keys, got)[0, 1]) < 0.05 and abs(np.corrcoef(qc.hashes(keys, 7), qc.hashes(keys, 8))[0, 1]) < 0.05
    counts = np.histogram(got, 10, (0, qc.HASH_RANGE))[0]
    assert counts.min() > 400


def test_numbered_over_slices(spark):
    df = spark.range(1000)
    got = qc.numbered(df, qc.hashed(F.col("id"), 3), "id", "place", slice_rows=90).orderBy("place").collect()
    want = sorted(range(1000), key=lambda k: (qc.hashes(np.array([k]), 3)[0], k))
    assert [r.place for r in got] == list(range(1, 1001)) and [r.id for r in got] == want


def test_dealt_labels_keep_their_numbers(spark):
    cells = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(300)], "cell long, cluster string")
    dealt = {r.cell: r.cluster for r in stats.shuffled_labels(cells, "cluster").collect()}
    assert len(dealt) == 300 and sum(v == "b" for v in dealt.values()) == 100
    assert 60 < sum(dealt[i] == "b" and i % 3 != 0 for i in range(300)) < 75 + 20


def test_t_test_chances():
    p = stats.t_test_p(np.array([2.0, 1.0, 0.0, np.nan, -4.0, 2.5]), np.array([10.0, 1.0, 5.0, 5.0, 500.0, 7.3]))
    assert np.allclose(p[:4], [0.07338803, 0.5, 1, 1], atol=1e-7)
    x = np.linspace(4, 400, 4_000_001)
    density = np.exp(math.lgamma(250.5) - math.lgamma(250) - 0.5 * math.log(500 * math.pi) - 250.5 * np.log1p(x * x / 500))
    assert abs(p[4] - (2 * density.sum() - density[0]) * (x[1] - x[0])) < 1e-10


@pytest.mark.parametrize("rows_in_one", [10**9, 0])
def test_balancing_by_rounds_equals_the_loop(spark, rows_in_one):
    rng = np.random.default_rng(4)
    points = frame(spark, rng.normal(size=(150, 5)) * np.r_[np.ones(140), np.full(10, 0.05)][:, None])
    sight = graph.exact_knn(points, points, 12)
    found = cluster.balanced_knn(spark, sight, 5, 6, rows_in_one)
    got = {(r.src, r.dst) for r in found.collect()}
    near = sight.toPandas().sort_values(["src", "rank"])
    c = near["dst"].to_numpy().reshape(150, 12)
    index, _ = cluster.balance(c, near["d"].to_numpy().reshape(150, 12), 5, 6, np.bincount(c.ravel(), minlength=150))
    assert got == {(i, int(j)) for i, row in enumerate(index) for j in row if i != j}
    assert max(np.bincount([b for _, b in got])) <= 6


def test_contraction_keeps_communities(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(g * 40 + int(a), g * 40 + int(b), 1.0) for g in range(6) for a, b in rng.integers(0, 40, (300, 2)) if a != b] + [(int(a), int(b), 1.0) for a, b in rng.integers(0, 240, (60, 2)) if a != b]
    edges, nodes = spark.createDataFrame(rows, "src long, dst long, w double"), spark.range(240)
    flat = [np.array(x) for x in zip(*[(a, b) for a, b, _ in rows])]
    found = {}
    for limit in (10**6, 300):
        label = {r.id: r.label for r in cluster.communities(nodes, edges, folder=str(tmp_path), search_edges=limit).collect()}
        found[limit] = cluster.modularity(np.array([label[i] for i in range(240)]), *flat, np.ones(len(rows)))
    assert found[10**6] > 0.6 and found[300] > 0.95 * found[10**6]


def test_approximate_neighbours(spark):
    points, _ = blobs(3000, 12, 16)
    df = frame(spark, points)
    exact = {(r.src, r.dst) for r in graph.exact_knn(df, df.filter("id % 10 = 0"), 10).collect()}
    some = {(r.src, r.dst) for r in graph.approximate_knn(df, df.filter("id % 10 = 0"), 10, cells=40, probes=8).collect()}
    assert len(some) == len(exact) == 3000 and len(some & exact) >= 0.9 * len(exact)
    every = {(r.src, r.dst) for r in graph.approximate_knn(df, df.filter("id % 10 = 0"), 10, cells=20, probes=20).collect()}
    assert every == exact


def test_neighbours_of_vectors_without_structure(spark):
    df = frame(spark, np.random.default_rng(6).normal(size=(2000, 64)))
    exact = {(r.src, r.dst) for r in graph.exact_knn(df, df, 10).collect()}
    some = {(r.src, r.dst) for r in graph.approximate_knn(df, df, 10, cells=31).collect()}
    assert len(some) == len(exact) == 20_000 and len(some & exact) >= 0.9 * len(exact)


def test_divergence_neighbours(spark):
    rng = np.random.default_rng(3)
    shares = rng.dirichlet(np.ones(6) * 0.5, 60)
    found = {(r.src, r.dst) for r in graph.js_neighbours(frame(spark, shares), 4).collect()}
    middle = (shares[:, None] + shares[None]) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda p, q: np.where(p > 0, p * np.log2(p / q), 0).sum(-1)
        js = (kl(shares[:, None], middle) + kl(shares[None], middle)) / 2
    np.fill_diagonal(js, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(js[i])[:4]}
    assert len(found & want) >= 0.97 * len(want)


def test_subspace_equals_gram(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 40)) @ np.diag(np.linspace(5, 0.1, 40)) * (rng.random((80, 40)) < 0.6)
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    values = spark.createDataFrame(rows, "cell long, gene long, v double")
    gram, walk = factor.pca(values, 80, 4), factor.pca(values, 80, 4, gram_genes=10)
    assert np.allclose(gram.variance, walk.variance, rtol=1e-5) and np.allclose(np.abs((gram.loadings * walk.loadings).sum(0)), 1, atol=1e-3)


def test_residual_components_equal_the_dense_ones(spark):
    rng = np.random.default_rng(6)
    x = rng.poisson(1.0, size=(50, 12)).astype(float)
    x[7] = 0
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell long, gene long, x double")
    totals = spark.createDataFrame([(i, float(t)) for i, t in enumerate(x.sum(1))], "cell long, total double")
    mean = np.outer(x.sum(1), x.sum(0)) / x.sum()
    with np.errstate(invalid="ignore"):
        r = np.nan_to_num((x - mean) / np.sqrt(mean + mean**2 / 100))
    r = np.clip(r, -math.sqrt(50), math.sqrt(50))
    r -= r.mean(0)
    want = np.sort(np.linalg.eigvalsh(r.T @ r / 50))[::-1]
    for limit in (4000, 5):
        parts, points = factor.residual_pca(entries, totals, 3, gram_genes=limit)
        assert np.allclose(parts.variance, want[:3], rtol=1e-4)
        got = {p.cell: p.pca for p in points.collect()}
        assert len(got) == 50 and np.allclose([np.dot(got[i], got[i]) for i in range(50)], ((r @ parts.loadings) ** 2).sum(1), atol=1e-8)


def test_umap_and_starts(spark):
    points, label = blobs(300, 5)
    for dims in (2, 3):
        y = embed.umap(points, dims, epochs=150)
        near, _ = embed.nearest(y, y, 8, itself=True)
        assert y.shape == (300, dims) and (label[near] == label[:, None]).mean() > 0.95
    assert np.allclose(embed.curve(0.1), (1.577, 0.895), atol=2e-3)
    seen = []
    embed.tsne(points, early=2, late=2, init=lambda v: seen.append(len(v)) or v[:, :2])
    assert seen == [300]
    far = embed.umap_embed(frame(spark, points), 2, most=100).collect()
    assert len(far) == 300 and len({r.id for r in far}) == 300


def test_two_modes_are_told_from_one():
    rng = np.random.default_rng(1)
    assert not doublets.is_bimodal(rng.normal(size=300)) and not doublets.is_bimodal(rng.random(300))
    two = np.r_[rng.normal(size=150), rng.normal(size=150) + 5]
    assert doublets.is_bimodal(two) and abs(two[doublets.two_means(two)].min() - 2.5) < 2
    assert doublets.dip(np.r_[np.zeros(5), np.ones(5)]) == 0.25 and doublets.dip(np.ones(9)) <= 1 / 9


def test_forest_judges_held_out_cells(spark):
    from cellgrid.operators import forest

    points, label = blobs(600, 3, 4)
    rows = [(i, int(label[i]), [float(x) for x in v], i % 5 == 0) for i, v in enumerate(points)]
    found = {(r.label, r["class"]): r.p for r in forest.held_out_chances(spark.createDataFrame(rows, "id long, label long, v array<double>, held boolean"), 3, 20, 30).collect()}
    assert len(found) == 9 and all(found[c, c] > 0.9 for c in range(3)) and all(abs(sum(found[c, d] for d in range(3)) - 1) < 1e-9 for c in range(3))
    rng = np.random.default_rng(2)
    x, y, held = rng.normal(size=(400, 4)), rng.integers(0, 2, 400), np.arange(400) % 4 == 0
    alone = forest.tree_chances(x, y, held, 2, 30, np.random.default_rng(1))
    assert set(np.unique(alone)) == {0.0, 1.0}  # grown to the end, every leaf is of one class
    stump = forest.tree_chances(x, (x[:, 0] > 0.3).astype(int), held, 2, 30, np.random.default_rng(1))
    assert (stump.argmax(1) == (x[held, 0] > 0.3)).mean() > 0.9


def test_the_ranged_search_is_exact_with_many_equal_points(spark, monkeypatch):
    monkeypatch.setattr(graph, "RANGE_BLOCK", 100)
    monkeypatch.setattr(graph, "GROUP_VALUES", 2_000)
    v = np.random.default_rng(5).normal(size=(900, 4))
    v[500:700], v[700:] = v[:200], 0.25
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").persist()
    rows = lambda found: {(r.src, r.dst, r.rank, round(r.d, 8)) for r in found.collect()}
    for points, queries, k in ((df, df, 12), (df, df.filter("id % 3 = 0"), 5), (df.filter("id < 4"), df, 5)):
        assert rows(graph.ranged_knn(points, queries, k)) == rows(graph.exact_knn(points, queries, k))


def test_doublets_are_found(spark):
    rng = np.random.default_rng(7)
    base = rng.gamma(0.5, 1, size=(3, 40))
    kinds = np.arange(240) % 3
    x = rng.poisson(base[kinds] * 6)
    x[:12] = x[:12] + x[120 + (np.arange(12) + 1) % 12 * 3 + 1]
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell long, gene long, x double")
    made = doublets.artificial(entries, entries.select("cell").distinct(), 0.25)
    assert made.select("cell").distinct().count() == 80 and made.agg(F.max("cell")).first()[0] == -1
    real, fake = doublets.scores_of(entries, entries.select("cell").distinct(), k_components=5)
    assert real.count() == 240 and fake.count() == 80
    assert 0 < doublets.flag_threshold(real, fake, 240) <= 0.4 and doublets.flag_threshold(real, fake, 240, fixed=0.7) == 0.7


def matrix(spark, n=120, genes=60, seed=0):
    rng = np.random.default_rng(seed)
    kind = np.arange(n) % 3
    mu = rng.gamma(1.0, 0.4, size=(3, genes))
    for k in range(3):
        mu[k, k * 15 : (k + 1) * 15] += 4
    x = rng.poisson(mu[kind] * 0.6)
    cells = spark.createDataFrame([(i, "left" if kind[i] < 2 else "right", i % 3, int(kind[i])) for i in range(n)], "cell long, cluster string, sample int, kind int")
    names = spark.createDataFrame([(j, f"g{j}") for j in range(genes)], "gene long, name string")
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell long, gene long, x double")
    return CellMatrix(cells, names, entries)


SMALL = {"params": {"min_umis": 5, "n_genes": 30, "n_factors": 8, "k": 8, "k_pooling": 4, "max_doubletFinder_th": 1.0}}


def test_a_deck_is_built_to_the_pool(spark, tmp_path):
    write_matrix(matrix(spark), str(tmp_path / "samples"))
    deck = Deck({"Root.yaml": "L: {include: [left], steps: [poisson_pooling, nn, clustering, aggregate, export, skeletonize], params: {features: variance}}\nR: {include: [right], steps: [nn]}\n", "L.yaml": "A: {include: [], onlyif: kind == 0, steps: [nn]}\nB: {include: [], steps: [nn]}\n"})
    build = Build(spark, deck, str(tmp_path / "samples"), str(tmp_path / "out"), merged(DEFAULTS, SMALL))
    assert build.run() == ["L", "R", "L_A", "L_B", "Pool"] and build.plan() == []
    pool = {r.cell: r.source for r in build.read("Pool").collect()}
    assert pool == {i: ("L_A", "L_B", "R")[i % 3] for i in range(120)}
    cells = build.read("L").toPandas()
    assert len(cells) == 80 and set(cells["outliers"]) <= {0, 1}
    own = cells[cells["clusters"] >= 0]
    purity = own.groupby("clusters")["kind"].agg(lambda x: x.value_counts().max()).sum() / len(own)
    assert own["clusters"].nunique() >= 2 and purity > 0.9
    assert build.read("L", "markers").groupBy("cluster").count().agg(F.max("count")).first()[0] <= 10
    assert build.read("L", "gene_order").count() == build.read("L", "aggregate").select("gene").distinct().count()
    for name in ("knn", "rnn", "tsne", "umap3d", "skeleton", "export/positions", "export/heatmap"):
        assert not build.read("L", name).isEmpty(), name
    assert build.split("L", "cluster").startswith("A:") and "split" in build.read("L").columns
    assert build.merge("L", threshold=0) == own["clusters"].nunique()


def test_settings_are_checked():
    checked(DEFAULTS)
    for over in ({"params": {"clusterer": "kmeans"}}, {"steps": ["nn", "fly"]}, {"params": {"nn_space": "HPF"}}):
        with pytest.raises(ValueError):
            checked(merged(DEFAULTS, over))
    with pytest.raises(KeyError):
        merged(DEFAULTS, {"params": {"unheard": 1}})


def test_splits(spark):
    points, label = blobs(160, 4)
    df = frame(spark, points)
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id long, label long")
    edges = graph.exact_knn(df, df, 6)
    tree = (list(range(4)), cluster.linkage(np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]], float)))
    two = {r.id: r.label for r in cluster.split(labels, edges, "coverage", tree, 0.5).collect()}
    assert {two[i] for i in range(160) if label[i] < 2} == {0} and {two[i] for i in range(160) if label[i] > 1} == {1}
    assert cluster.split(labels, edges, "coverage", tree, 1.1) is None and cluster.separable(edges, labels, 0.5, least=41)[0] is False
    assert cluster.split(labels, edges, "paris", threshold=0.5).select("label").distinct().count() == 4
    assert cluster.split(labels, edges, "cluster").count() == 160
    with pytest.raises(ValueError):
        cluster.split(labels, edges, "dendrogram")


def test_weak_clusters_merge(spark):
    m = matrix(spark)
    labels = m.cells.select(F.col("cell").alias("id"), F.when(F.col("kind") == 0, F.col("cell") % 2).otherwise(F.col("kind") + 1).cast("long").alias("label"))
    plane = m.cells.select(F.col("cell").alias("id"), (F.col("kind") * 10 + F.rand(1)).alias("x"), F.lit(0.0).alias("y"))
    assert cluster.merged(m, labels, plane, threshold=1, most_q=1.1, least_enrichment=0.0).select("label").distinct().count() == 4
    left = cluster.merged(m, labels, plane, threshold=10, most_q=0.2, least_enrichment=10.0).toPandas()
    kinds = {r.cell: r.kind for r in m.cells.collect()}
    left["kind"] = left["id"].map(kinds)
    assert left["label"].nunique() == 3 and left.groupby("label")["kind"].nunique().max() == 1


def test_names_of_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "p array<double>, q array<double>")
    got = df.select(*[graph.distance(m, "p", "q").alias(m) for m in ("euclidean", "manhattan", "js", "correlation")]).first()
    assert np.allclose(got, [math.sqrt(2), 2, 1, 2])
    with pytest.raises(ValueError):
        graph.distance("unheard", "p", "q")
    with pytest.raises(ValueError):
        aggregate.aggregated(df, "p", {"q": "unheard"}, "p")


def test_views():
    scaled = views.midpoint_scaled
    assert callable(scaled)
    assert views.segments(np.array([[0, 1, 2.0, 2], [2, 3, 5.0, 3]])) == [(0.0, 0.0, 1.0, 0.0, 2.0), (2.0, 0.0, 0.5, 2.0, 5.0)]


def test_processors():
    assert engines.cpus_of_mask("Cpus_allowed:\tff,0000000f\n") == 12 and engines.cpus_of_mask("none") is None
    assert engines.available_cpus() >= 1 and engines.available_cpus("/no/such/file") >= 1


def test_command_line(spark, tmp_path, capsys):
    from cellgrid.__main__ import main

    (tmp_path / "deck").mkdir()
    (tmp_path / "deck" / "Root.yaml").write_text("A: {include: [x]}\nB: {include: []}\n")
    main(["tasks", str(tmp_path / "deck")])
    assert "Pool: A B" in capsys.readouterr().out
    main(["build", str(tmp_path / "deck"), "s", str(tmp_path / "out"), "--engine", "condor"])
    assert (tmp_path / "out" / "condor" / "_dag.condor").read_text().count("JOB") == 3
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 3 3\n1 1 4\n2 1 1\n2 3 7\n")
    (tmp_path / "c.tsv").write_text("cell\tsample\n0\ta\n1\ta\n2\tb\n")
    (tmp_path / "g.tsv").write_text("gene\tname\n0\tx\n1\ty\n")
    main(["make", str(tmp_path / "m.mtx"), str(tmp_path / "c.tsv"), str(tmp_path / "g.tsv"), str(tmp_path / "bundle")])
    main(["qc", str(tmp_path / "bundle"), str(tmp_path / "out")])
    report = {r["sample"]: (r["n"], r["mean_umi"], r["passed"]) for r in spark.read.parquet(str(tmp_path / "out" / "qc")).collect()}
    assert report == {"a": (2, 2.5, False), "b": (1, 7.0, False)}


def test_queries_live_without_a_library(monkeypatch):
    import __spark_entry__ as entry

    whole = len(entry.queries())
    for name in [n for n in sys.modules if n.startswith("cellgrid.llm") or n in ("tiktoken", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    rest = entry.queries()
    assert 150 < len(rest) <= whole and not any(n.startswith("op") and n[2].isdigit() for n in rest)


def test_factors_in_one_task_equal_the_rounds(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.poisson(rng.gamma(1, 1, (25, 3)) @ rng.gamma(1, 1, (3, 14)))
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell long, gene long, x double")
    one, rounds = (factor.hpf(entries, 3, str(tmp_path), max_iter=4, min_iter=4, interval=2, one_task=n) for n in (10**6, 0))
    assert np.allclose(one.likelihood, rounds.likelihood, rtol=1e-9)
    rows = lambda t: {r.id: (*r["shape"], *r["rate"]) for r in t.collect()}
    for a, b in ((one.theta, rounds.theta), (one.beta, rounds.beta)):
        a, b = rows(a), rows(b)
        assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], rtol=1e-8) for i in a)
    fixed = factor.hpf(entries, 3, str(tmp_path), max_iter=2, min_iter=2, beta=one.beta)
    assert rows(fixed.beta) == rows(one.beta)
    order = factor.explained(one, 3)
    assert sorted(order) == [0, 1, 2] and factor.explained(factor.ordered(one, 3), 3) == [0, 1, 2]


def test_factors_of_many_cells_go_by_blocks_without_joins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(factor, "BLOCK_VALUES", 60)
    rng = np.random.default_rng(9)
    x = rng.poisson(rng.gamma(1, 1, (40, 3)) @ rng.gamma(1, 1, (3, 14)))
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "cell long, gene long, x double")
    rows = lambda t: {r.id: (*r["shape"], *r["rate"], r["cap"]) for r in t.collect()}

    def same(how: dict) -> None:
        one, blocks = (factor.hpf(entries, 3, str(tmp_path), interval=2, one_task=n, gene_values=g, **how) for n, g in ((10**6, 0), (0, other)))
        assert len(one.likelihood) == len(blocks.likelihood) and np.allclose(one.likelihood, blocks.likelihood, rtol=1e-9)
        for a, b in ((one.theta, blocks.theta), (one.beta, blocks.beta)):
            a, b = rows(a), rows(b)
            assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], rtol=1e-8) for i in a)

    other = 0
    same({"max_iter": 2, "min_iter": 1})
    other = 10**6
    same({"max_iter": 3, "min_iter": 1})
    same({"max_iter": 40, "min_iter": 4, "epsilon": 0.05})  # ends by the likelihood
    same({"max_iter": 2, "min_iter": 2, "beta": factor.hpf(entries, 3, str(tmp_path), max_iter=1).beta.filter("id < 9")})


def test_leiden_communities_are_connected():
    rng = np.random.default_rng(1)
    src, dst = [], []
    for g in range(8):
        for a in range(10):
            for b in range(a):
                if rng.random() < 0.7:
                    src.append(g * 10 + a), dst.append(g * 10 + b)
    src += list(rng.integers(0, 80, 25))
    dst += list(rng.integers(0, 80, 25))
    src, dst = np.array(src), np.array(dst)
    keep = src != dst
    src, dst, w = src[keep], dst[keep], np.ones(keep.sum())
    label = cluster.leiden(80, src, dst, w)
    assert cluster.modularity(label, src, dst, w) >= 0.98 * cluster.modularity(cluster.louvain(80, src, dst, w), src, dst, w)
    for c in np.unique(label):
        own = set(np.flatnonzero(label == c).tolist())
        seen, todo = set(), [min(own)]
        while todo:
            k = todo.pop()
            if k in seen:
                continue
            seen.add(k)
            todo += [j for j in (*dst[src == k].tolist(), *src[dst == k].tolist()) if j in own]
        assert seen == own


def test_labels_are_transferred(spark):
    from cellgrid.operators import transfer

    rng = np.random.default_rng(3)
    label = np.arange(200) % 4
    rates = rng.gamma(1, 3, (4, 12))
    x = rng.poisson(rates[label] * rng.uniform(0.5, 3, 200)[:, None])
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(label[i])) for i in range(200)], "cell long, x array<double>, label long")
    found = transfer.transferred(rows.filter("cell < 150"), rows.filter("cell >= 150"), trees=20).toPandas()
    assert len(found) == 50 and (found["label"] == found["predicted"]).mean() > 0.9
    figures = transfer.normalizer(rows.filter("cell < 150")).first()
    assert figures["level"] == np.median(x[:150].sum(1))


def test_support_vectors_follow_a_curve():
    x = np.linspace(-3, 3, 60)
    y = np.sin(x) + np.where(np.arange(60) % 15 == 7, 4.0, 0.0)
    beta = factor.support_vector_regression(x, y, np.ones(60), 0.5, cost=1.0, tube=0.05)
    fit = (np.exp(-0.5 * (x[:, None] - x[None]) ** 2) + 1) @ beta
    plain = np.arange(60) % 15 != 7
    assert np.abs(fit - np.sin(x))[plain].mean() < 0.15 and np.abs(beta).max() <= 1 + 1e-9
    # At the end no coefficient can be moved with gain: inside the tube it is 0, beyond it is at its limit.
    off = y - fit
    assert (np.abs(beta[np.abs(off) < 0.049]) < 1e-3).all() and (np.abs(beta[np.abs(off) > 0.051]) > 1 - 1e-3).all()
