"""Queries that fit models or run streams; where SQL cannot follow, tests check invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.model import r6
from cellgrid.operators import aggregate as ag
from cellgrid.operators import cluster, doublets, embed, factor, graph, qc, transfer
from cellgrid.plans.analysis import predictive_power
from cellgrid.plans.q_aggregates import GRID
from cellgrid.plans.q_graphs import KNN, digamma_sql, folder, knn, vectors
from cellgrid.plans.registry import query
from cellgrid.sources.tables import order_matrix, staged, table


def brand_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by brands: normalized counts of few genes."""
    # One sum over lines: a first one by part would have nearly as many rows as there are lines.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("cell"))
    brands = table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("gene"))
    met = lines.join(brands, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    e = met.groupBy("cell", "gene").agg(F.sum("l_quantity").alias("x"))
    return e.withColumn("v", F.log2(F.col("x") + 1))


@query("pca_variance", "D01")
def pca_variance(spark, sf_dir):
    values = brand_matrix(spark, sf_dir)
    parts = factor.pca(values, table(spark, sf_dir, "customer").count(), 10)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(parts.variance)], "component int, variance double")


BRAND_SQL = """be AS (SELECT cell, regexp_extract(category, '(\\d+)', 1)::BIGINT AS gene, sum(x) AS x FROM entries JOIN genes USING (gene) GROUP BY ALL), bg AS (SELECT DISTINCT gene FROM be),
    bt AS (SELECT cells.cell, coalesce(sum(x), 0e0) AS total FROM cells LEFT JOIN entries USING (cell) GROUP BY 1),
    bd AS (SELECT bt.cell, bg.gene, total, coalesce(x, 0e0) AS x FROM bt CROSS JOIN bg LEFT JOIN be ON be.cell = bt.cell AND be.gene = bg.gene)"""


@query(
    "pca_lengths", "D01",
    f"""WITH {BRAND_SQL}, v AS (SELECT cell, gene, log2(x + 1) AS v FROM bd), m AS (SELECT gene, avg(v) AS m FROM v GROUP BY gene)
    SELECT cell, round(sum((v - m) * (v - m)), 5) AS square FROM v JOIN m USING (gene) GROUP BY cell""", matrix=True,
)
def pca_lengths(spark, sf_dir):
    """Squared length of each cell's coordinates on all components: that of its centred values, however they are turned."""
    values, cells = brand_matrix(spark, sf_dir), order_matrix(spark, sf_dir).cells
    projected = factor.project(values, cells, factor.pca(values, cells.count(), 25))
    return projected.select("cell", r6(F.aggregate("pca", F.lit(0.0), lambda s, x: s + x * x), 5).alias("square"))


@query(
    "residual_pca_lengths", "D04 F22",
    f"""WITH {BRAND_SQL}, g AS (SELECT gene, sum(x) AS s FROM bd GROUP BY gene), a AS (SELECT sum(total) AS grand, sqrt(count(*)) AS lim FROM bt),
    e AS (SELECT cell, gene, x, total * s / grand AS e, lim FROM bd JOIN g USING (gene), a), r AS (SELECT cell, gene, CASE WHEN e > 0 THEN greatest(-lim, least(lim, (x - e) / sqrt(e + e * e / 100))) ELSE 0e0 END AS r FROM e),
    m AS (SELECT gene, avg(r) AS m FROM r GROUP BY gene)
    SELECT cell, round(sum((r - m) * (r - m)), 5) AS square FROM r JOIN m USING (gene) GROUP BY cell""", matrix=True,
)
def residual_pca_lengths(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    totals = m.cells.select("cell").join(qc.cell_totals(m.entries).select("cell", "total"), "cell", "left").fillna(0.0)
    _, projected = factor.residual_pca(brand_matrix(spark, sf_dir).select("cell", "gene", "x"), totals, 25)
    return projected.select("cell", r6(F.aggregate("pca", F.lit(0.0), lambda s, x: s + x * x), 5).alias("square"))


@query(
    "poisson_pooling", "G06",
    f"""WITH {BRAND_SQL}, lv AS (SELECT median(total) AS level FROM (SELECT sum(x) AS total FROM be GROUP BY cell)), vc AS (SELECT cell, list(CASE WHEN total = 0 THEN 0e0 ELSE log2(x / total * level + 1) END ORDER BY gene) AS v FROM bd, lv GROUP BY cell),
    pr AS (SELECT a.cell AS src, b.cell AS dst, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) ** 2))) AS d FROM vc a JOIN vc b ON a.cell <> b.cell),
    nn AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) <= 4), mx AS (SELECT max(d) AS md FROM nn),
    nb AS (SELECT src, dst FROM nn, mx WHERE round(md - d, 9) > 0 UNION SELECT cell, cell FROM cells)
    SELECT src AS cell, gene, round(sum(x), 4) AS x FROM nb JOIN be ON be.cell = dst GROUP BY ALL""", matrix=True,
)
def poisson_pooling(spark, sf_dir):
    """Counts pooled over the five nearest cells in the space of all principal components, where distances are those of the values."""
    m = order_matrix(spark, sf_dir)
    brands = type(m)(m.cells, m.genes, brand_matrix(spark, sf_dir).select("cell", "gene", "x"))
    values = qc.normalized(brands)
    points = factor.project(values, m.cells, factor.pca(values, m.cells.count(), 25)).select(F.col("cell").alias("id"), F.col("pca").alias("v"))
    return graph.poisson_pooled(staged(points, "points"), brands.entries, m.cells, 5).select("cell", "gene", r6(F.col("x"), 4).alias("x"))


REDUNDANT_SQL = """u AS (SELECT vec_id, label < 5 AS own, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)),
    r AS (SELECT a.own, a.i, b.i AS j, corr(a.x, b.x) AS r FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i <> b.i GROUP BY ALL),
    rc AS (SELECT own, i, i AS reach FROM (SELECT DISTINCT own, i FROM u) UNION SELECT rc.own, rc.i, r.j FROM rc JOIN r ON r.own = rc.own AND r.i = rc.reach AND r.r > 0.13e0),
    later AS (SELECT own, i FROM rc GROUP BY own, i HAVING min(reach) < i)"""


@query("redundant_components", "D08", f"WITH RECURSIVE {REDUNDANT_SQL} SELECT (i - 1)::BIGINT AS component FROM later WHERE own INTERSECT SELECT (i - 1)::BIGINT FROM later WHERE NOT own")
def redundant_components(spark, sf_dir):
    """Vectors of half the labels and of the other half as the two factors of 64 components."""
    v = vectors(spark, sf_dir)
    near = {side: factor.component_correlations(v.filter(where).select("v"), 64) for side, where in (("beta", "label < 5"), ("theta", "label >= 5"))}
    return spark.createDataFrame([(c,) for c in factor.redundant_by(near["beta"], near["theta"], 0.13)], "component long")


@query("pca_significant", "D01 D02")
def pca_significant(spark, sf_dir):
    values, cells = brand_matrix(spark, sf_dir), order_matrix(spark, sf_dir).cells
    projected = factor.project(values, cells, factor.pca(values, cells.count(), 8))
    return spark.createDataFrame([(c,) for c in factor.significant(projected, 8)], "component int")


@query("permuted_pca", "E16")
def permuted_pca(spark, sf_dir):
    """Variances of the components over those of the permuted matrix."""
    values, cells = brand_matrix(spark, sf_dir), order_matrix(spark, sf_dir).cells
    n = cells.count()
    a, b = factor.pca(values, n, 10).variance, factor.pca(factor.permuted(values, cells), n, 10).variance
    return spark.createDataFrame([(k, round(float(x / y), 6)) for k, (x, y) in enumerate(zip(a, b, strict=True))], "component int, ratio double")


@query(
    "permuted_lengths", "E16",
    f"""WITH {BRAND_SQL}, v AS (SELECT cell, gene, log2(x + 1) AS v FROM bd), pl AS (SELECT cell, row_number() OVER (ORDER BY {qc.hash_sql('cell', 31)}, cell) AS place, count(*) OVER () AS n FROM cells),
    mv AS (SELECT gene, v, (place - 1 + {qc.hash_sql('gene', 32)}) % n + 1 AS place FROM v JOIN pl USING (cell)), pv AS (SELECT cell, gene, v FROM mv JOIN pl USING (place)), m AS (SELECT gene, avg(v) AS m FROM pv GROUP BY gene)
    SELECT cell, round(sum((v - m) * (v - m)), 5) AS square FROM pv JOIN m USING (gene) GROUP BY cell""", matrix=True,
)
def permuted_lengths(spark, sf_dir):
    """Squared length of each cell's coordinates on all components of the permuted matrix."""
    cells = order_matrix(spark, sf_dir).cells
    values = staged(factor.permuted(brand_matrix(spark, sf_dir), cells), "permuted")
    projected = factor.project(values, cells, factor.pca(values, cells.count(), 25))
    return projected.select("cell", r6(F.aggregate("pca", F.lit(0.0), lambda s, x: s + x * x), 5).alias("square"))


@query(
    "significant_dimensions", "D02",
    """WITH u AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)), n AS (SELECT count(*) AS n FROM embeddings),
    e AS (SELECT p, x, count(*) FILTER (a) AS ca, count(*) FILTER (NOT a) AS cb FROM (SELECT i - 1 AS p, x, true AS a FROM u WHERE i < 64 UNION ALL SELECT i - 2, x, false FROM u WHERE i > 1) GROUP BY ALL),
    g AS (SELECT p, max(abs(ua / n - ub / n)) AS d FROM (SELECT p, sum(ca) OVER w AS ua, sum(cb) OVER w AS ub FROM e WINDOW w AS (PARTITION BY p ORDER BY x)), n GROUP BY p),
    s AS (SELECT p + 1 AS c, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * d * d * n / 2))) AS chance FROM g, n)
    SELECT c::INT AS component FROM s WHERE chance < 0.1e0 UNION SELECT 0 UNION SELECT 1 WHERE (SELECT count(*) FROM s WHERE chance < 0.1e0) = 0""",
)
def significant_dimensions(spark, sf_dir):
    """The filter of components by successive tests, on the vectors' dimensions."""
    points = vectors(spark, sf_dir).select(F.col("id").alias("cell"), F.col("v").alias("pca"))
    return spark.createDataFrame([(c,) for c in factor.significant(points, 64)], "component int")


def hpf_round_sql() -> str:
    """One round of two factors from the same starting values."""
    u = lambda key, seed, j, s: f"({qc.hash_sql(f'{key} * 128 + {2 * j + s}', seed)} / {qc.HASH_RANGE}e0 + 0.5e0)"
    start = lambda key, seed: ", ".join(f"{u(key, seed, j, 1)} * 0.3e0 AS s{j}, {u(key, seed, j, 2)} * 0.3e0 AS r{j}" for j in (0, 1))
    logs = ", ".join(f"{digamma_sql(f't.s{j}')} - ln(t.r{j}) + {digamma_sql(f'b.s{j}')} - ln(b.r{j}) AS l{j}" for j in (0, 1))
    rate = "0.9e0"  # b + k a, both of .3, two factors
    return f"""{BRAND_SQL}, pr AS (SELECT (SELECT 0.3e0 * avg(s) / var_pop(s) FROM (SELECT sum(x) AS s FROM be GROUP BY cell)) AS bp, (SELECT 0.3e0 * avg(s) / var_pop(s) FROM (SELECT sum(x) AS s FROM be GROUP BY gene)) AS dp),
    t0 AS (SELECT cell, {start('cell', 1)} FROM (SELECT DISTINCT cell FROM be)), b0 AS (SELECT gene, {start('gene', 2)} FROM (SELECT DISTINCT gene FROM be)),
    l AS (SELECT be.cell, be.gene, x, {logs} FROM be JOIN t0 t ON t.cell = be.cell JOIN b0 b ON b.gene = be.gene),
    y AS (SELECT cell, gene, x / (1 + exp(l1 - l0)) AS y0, x / (1 + exp(l0 - l1)) AS y1 FROM l),
    ts AS (SELECT cell, 0.3e0 + sum(y0) AS s0, 0.3e0 + sum(y1) AS s1 FROM y GROUP BY cell), bs AS (SELECT gene, 0.3e0 + sum(y0) AS s0, 0.3e0 + sum(y1) AS s1 FROM y GROUP BY gene),
    bm AS (SELECT sum(s0 / r0) AS m0, sum(s1 / r1) AS m1 FROM b0), t1 AS (SELECT cell, s0 / ({rate} / bp + m0) AS m0, s1 / ({rate} / bp + m1) AS m1 FROM ts, bm, pr),
    tm AS (SELECT sum(m0) AS m0, sum(m1) AS m1 FROM t1), b1 AS (SELECT gene, s0 / ({rate} / dp + tm.m0) AS m0, s1 / ({rate} / dp + tm.m1) AS m1 FROM bs, tm, pr)
    SELECT 'cell' AS side, cell AS id, round(m0, 6) AS m0, round(m1, 6) AS m1 FROM t1 UNION ALL SELECT 'gene', gene, round(m0, 6), round(m1, 6) FROM b1"""


@query("hpf_round", "D05 D06 D07", f"WITH {hpf_round_sql()}", matrix=True)
def hpf_round(spark, sf_dir):
    """Expected factors of cells and genes after one round."""
    found = factor.hpf(staged(brand_matrix(spark, sf_dir).select("cell", "gene", "x"), "hpf-entries"), 2, folder(spark), max_iter=1)
    side = lambda t, name: t.select(F.lit(name).alias("side"), "id", *[r6(F.col("shape")[j] / F.col("rate")[j]).alias(f"m{j}") for j in (0, 1)])
    return side(found.theta, "cell").unionByName(side(found.beta, "gene"))


@query(
    "artificial_doublets", "B01",
    f"""WITH n AS (SELECT count(*) AS n FROM cells), p AS (SELECT cell AS p, row_number() OVER (ORDER BY {qc.hash_sql('cell', 3)}, cell) AS k FROM cells), q AS (SELECT cell AS q, row_number() OVER (ORDER BY {qc.hash_sql('cell', 4)}, cell) AS k FROM cells),
    b AS (SELECT -k AS made, unnest([p, q]) AS cell FROM p JOIN q USING (k), n WHERE k <= floor(n / 0.75e0 - n)) SELECT made AS cell, gene, sum(x) AS x FROM b JOIN entries USING (cell) GROUP BY ALL""",
    matrix=True,
)
def artificial_doublets(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    return doublets.artificial(m.entries.select("cell", "gene", "x"), m.cells, 0.25)


@query(
    "transfer_features", "N06",
    f"""WITH {BRAND_SQL}, tr AS (SELECT DISTINCT cell FROM be WHERE cell % 5 <> 0), tt AS (SELECT cell, sum(x) AS total FROM be GROUP BY cell), lv AS (SELECT median(total) AS level FROM tt JOIN tr USING (cell)),
    s AS (SELECT cell, gene, ln(x / total * level + 1) AS v FROM be JOIN tt USING (cell), lv), tp AS (SELECT gene, 0.9e0 * max(v) AS top FROM s JOIN tr USING (cell) GROUP BY gene)
    SELECT cell, round(sum(v / top * gene), 5) AS weighed FROM s JOIN tp USING (gene) GROUP BY cell""", matrix=True,
)
def transfer_features(spark, sf_dir):
    """The classifier's inputs, summed with the brands' numbers as weights; figures come from four fifths of the cells."""
    wide = brand_matrix(spark, sf_dir).groupBy("cell").pivot("gene", list(range(1, 26))).sum("x").fillna(0.0)
    rows = wide.select("cell", F.array(*[F.col(str(k)).cast("double") for k in range(1, 26)]).alias("x"))
    found = transfer.features(rows, transfer.normalizer(rows.filter("cell % 5 <> 0")))
    weighed = F.aggregate(F.zip_with("v", F.sequence(F.lit(1), F.lit(25)), lambda v, k: v * k), F.lit(0.0), lambda s, x: s + x)
    return found.select("cell", r6(weighed, 5).alias("weighed"))


@query("hpf", "D05 D06 D07")
def hpf(spark, sf_dir):
    """Factors of brands, run until the likelihood settles, the component that explains most first."""
    e = brand_matrix(spark, sf_dir).select("cell", "gene", "x")
    found = factor.ordered(factor.hpf(staged(e, "hpf-entries"), 4, folder(spark)), 4)
    return found.beta.select(F.col("id").alias("gene"), *[r6(F.col("shape")[j] / F.col("rate")[j], 4).alias(f"f{j}") for j in range(4)])


@query("balanced_knn", "G01")
def balanced_knn(spark, sf_dir):
    return cluster.balanced_knn(spark, knn(spark, sf_dir), 4, 8).select("src", "dst", r6(F.col("d"), 5).alias("d"))


@query("louvain", "C01 C02 C03")
def louvain(spark, sf_dir):
    v = vectors(spark, sf_dir)
    edges = knn(spark, sf_dir).withColumn("w", 1 / (1 + F.col("d")))
    labels = cluster.communities(v, edges, folder=folder(spark))
    return cluster.polish(labels, edges.select("src", "dst"), 5, plane=embed.principal_plane(v), folder=folder(spark))


@query("density_outliers", "C02")
def density_outliers(spark, sf_dir):
    """On the plane of the first two principal components of all dimensions."""
    v = vectors(spark, sf_dir)
    return cluster.mark_outliers(v.select("id", "label").join(embed.principal_plane(v), "id"))


@query("dendrogram_order", "C08 C12")
def dendrogram_order(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    names, d, tree = cluster.correlation_tree(ag.label_means(m, "cluster"))
    cuts = cluster.cut_tree(tree, 2)
    return spark.createDataFrame([(names[i], k, int(cuts[i])) for k, i in enumerate(cluster.leaf_order(tree, d))], "cluster string, ord int, half int")


def linkage_sql(steps: int) -> str:
    """Complete linkage: in each step the two groups whose farthest members are nearest join, under the lesser name."""
    out = ["m0 AS (SELECT cluster, cluster AS g FROM (SELECT DISTINCT cluster FROM cells))"]
    for k in range(steps):
        out.append(f"d{k} AS (SELECT x.g AS a, y.g AS b, max(d) AS d FROM ds JOIN m{k} x ON x.cluster = ds.a JOIN m{k} y ON y.cluster = ds.b WHERE x.g < y.g GROUP BY ALL ORDER BY d, 1, 2 LIMIT 1)")
        out.append(f"m{k + 1} AS (SELECT cluster, CASE WHEN g = d{k}.b THEN d{k}.a ELSE g END AS g FROM m{k}, d{k})")
    rows = " UNION ALL ".join(f"SELECT {k} AS step, round(d, 6) AS distance, (SELECT count(*) FROM m{k + 1} WHERE g = d{k}.a) AS size FROM d{k}" for k in range(steps))
    return ", ".join(out) + f" SELECT step, distance, size::BIGINT AS size FROM ({rows})"


@query(
    "linkage_steps", "C08",
    f"""WITH {GRID}, lm AS (SELECT gene, cluster, ln(s / n + 1) AS v FROM gr), ds AS (SELECT a.cluster AS a, b.cluster AS b, 1 - corr(a.v, b.v) AS d FROM lm a JOIN lm b ON a.gene = b.gene AND a.cluster <> b.cluster GROUP BY ALL), {linkage_sql(4)}""",
    matrix=True,
)
def linkage_steps(spark, sf_dir):
    _, _, tree = cluster.correlation_tree(ag.label_means(order_matrix(spark, sf_dir), "cluster"))
    return spark.createDataFrame([(k, round(float(t[2]), 6), int(t[3])) for k, t in enumerate(tree)], "step int, distance double, size long")


@query(
    "doublet_threshold", "B02",
    f"""WITH s AS (SELECT cell, {qc.hash_sql('cell', 61)} / {qc.HASH_RANGE}e0 * 0.3e0 AS score FROM cells), n AS (SELECT count(*) AS n FROM cells), k AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k FROM s), ps AS (SELECT greatest(0, 100 - 5e-4 * n) / 100 * (n - 1) AS pos FROM n),
    r AS (SELECT least(0.4e0, round(sum(score * greatest(0, 1 - abs(k - pos))), 3)) AS by_rate FROM k, ps)
    SELECT CASE WHEN 0 > (SELECT count(*) FROM s WHERE score >= by_rate) THEN by_rate ELSE 0.4e0 END AS threshold, by_rate FROM r""",
    matrix=True,
)
def doublet_threshold(spark, sf_dir):
    """The threshold on scores without a second mode: artificial ones have a single peak, so only the rate and the limit count."""
    cells = order_matrix(spark, sf_dir).cells
    u = lambda seed: qc.hashed(F.col("cell"), seed) / qc.HASH_RANGE
    scores = cells.select("cell", (u(61) * 0.3).alias("score"))
    made = cells.select((-F.col("cell") - 1).alias("cell"), ((u(62) + u(63)) / 2).alias("score"))
    n = cells.count()
    rate = scores.agg(F.percentile("score", max(0.0, 100 - 5e-4 * n) / 100)).first()[0]
    return spark.createDataFrame([(float(doublets.flag_threshold(scores, made, n)), min(0.4, round(rate, 3)))], "threshold double, by_rate double")


@query("multilevel_markers", "E04")
def multilevel_markers(spark, sf_dir):
    from cellgrid.operators.annotate import greedy_unique

    m = order_matrix(spark, sf_dir)
    m = type(m)(m.cells.withColumn("cluster", F.col("sample").cast("string")), m.genes, m.entries)
    names, _, tree = cluster.correlation_tree(ag.label_means(m, "cluster"))
    out = None
    for groups in [g for g in (25, 10, 5, 2) if g == 25 or g < len(names) // 2]:
        to = spark.createDataFrame([(n, str(int(c))) for n, c in zip(names, cluster.cut_tree(tree, min(groups, len(names))), strict=True)], "cluster string, part string")
        level = type(m)(m.cells.join(F.broadcast(to), "cluster").withColumn("cluster", F.col("part")), m.genes, m.entries)
        found = greedy_unique(ag.enrichment(level, "cluster"), "cluster", "gene", "enrichment", 5).select(F.lit(groups).alias("groups"), "cluster", "gene")
        out = found if out is None else out.unionByName(found)
    return out


@query("leiden", "C01")
def leiden(spark, sf_dir):
    edges = knn(spark, sf_dir).withColumn("w", 1 / (1 + F.col("d")))
    return cluster.communities(vectors(spark, sf_dir), edges, folder=folder(spark), method="leiden")


@query("paris_split", "C09 C10")
def paris_split(spark, sf_dir):
    """Parts of the communities by the hierarchy of their induced graph; one part if none is separate enough."""
    edges = staged(knn(spark, sf_dir), "knn")
    labels = staged(cluster.communities(vectors(spark, sf_dir), edges.withColumn("w", F.lit(1.0)), folder=folder(spark)), "labels")
    found = cluster.split(labels, edges, "paris", threshold=0.3)
    return labels.filter("label >= 0").select("id", F.lit(0).cast("long").alias("label")) if found is None else found


@query("doublets", "B01 B02")
def doublet_query(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    e = staged(brand_matrix(spark, sf_dir).select("cell", "gene", "x"), "doublet-counts")
    scores, made = doublets.scores_of(e, staged(e.select("cell").distinct(), "doublet-cells"))
    flag = doublets.flag_threshold(scores, made, m.cells.count())
    return scores.select("cell", r6(F.col("score"), 4).alias("score"), (F.col("score") >= flag).cast("int").alias("flag"))


@query("tsne", "X01")
def tsne(spark, sf_dir):
    return embed.embed(vectors(spark, sf_dir))


@query("umap", "X02")
def umap(spark, sf_dir):
    found = embed.umap_embed(vectors(spark, sf_dir), 3)
    return found.select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"))


@query("variance_selection", "E05")
def variance_selection(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    scored = factor.variance_trend(qc.gene_moments(m.entries, "x", m.n_cells()))
    return scored.withColumn("by", F.round("score", 6)).orderBy(F.col("by").desc(), "gene").limit(200).select("gene", F.col("by").alias("score"))


@query("surprise", "C07")
def surprise(spark, sf_dir):
    edges = knn(spark, sf_dir).withColumn("w", F.lit(1.0))
    labels = cluster.communities(vectors(spark, sf_dir), edges, folder=folder(spark), method="surprise")
    return cluster.polish(labels, edges.select("src", "dst"), 5)


@query("harmony", "D03")
def harmony(spark, sf_dir):
    p = vectors(spark, sf_dir).select("id", F.col("label").cast("string").alias("batch"), "v")
    out = factor.harmonized(p)
    return out.groupBy("batch").agg(*[r6(F.avg(F.col("v")[j]), 5).alias(f"m{j}") for j in range(64)])


@query("rf_transfer", "N06")
def rf_transfer(spark, sf_dir):
    """A label for every cell from forests that did not see it (five folds by hash), on counts that the training cells' figures normalize; uncertain where no class reaches .6."""
    m = order_matrix(spark, sf_dir)
    wide = brand_matrix(spark, sf_dir).groupBy("cell").pivot("gene", list(range(1, 26))).sum("x").fillna(0.0)
    rows = wide.select("cell", F.array(*[F.col(str(k)).cast("double") for k in range(1, 26)]).alias("x"))
    rows = staged(rows.join(m.cells.select("cell", F.col("region").cast("long").alias("label")), "cell").withColumn("fold", F.pmod(F.xxhash64("cell"), F.lit(5))), "transfer")
    out = None
    for fold in range(5):
        found = transfer.transferred(rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold))
        out = found if out is None else out.unionByName(found)
    return out


@query("cluster_validation", "N08")
def cluster_validation(spark, sf_dir):
    """Mean chance of each class for the held-out cells of every cluster, from their Poisson factors."""
    m = order_matrix(spark, sf_dir)
    e = staged(brand_matrix(spark, sf_dir).select("cell", "gene", "x"), "validation-entries")
    found = factor.hpf(e, 4, folder(spark))
    theta = found.theta.select("id", factor.expected(found.theta).alias("v")).select("id", graph.shares("v").alias("v"))
    labels = m.cells.select(F.col("cell").alias("id"), F.col("region").cast("long").alias("label"))
    return predictive_power(staged(theta, "theta"), labels).select("label", "class", r6(F.col("p"), 4).alias("p"))


@query("lda_topics", "X04")
def lda_topics(spark, sf_dir):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    wide = brand_matrix(spark, sf_dir).groupBy("cell").pivot("gene", list(range(1, 26))).sum("x").fillna(0.0)
    rows = wide.select("cell", array_to_vector(F.array(*[F.col(str(k)).cast("double") for k in range(1, 26)])).alias("features"))
    model = LDA(k=3, maxIter=50, seed=1, featuresCol="features").fit(rows)
    return model.transform(rows).select("cell", F.transform(vector_to_array("topicDistribution"), lambda x: F.round(x, 4)).alias("topics"))


@query(
    "pull_to_levels", "X03",
    "SELECT vec_id, round(x + (mx - x) * f, 6) AS x, round(y + (my - y) * f, 6) AS y FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, 0.1e0 + 0.8e0 * " + qc.hash_sql("vec_id", 2) + " / 2147483647e0 AS f, avg(embedding[1]::DOUBLE) OVER (PARTITION BY label) AS mx, avg(embedding[2]::DOUBLE) OVER (PARTITION BY label) AS my FROM embeddings)",
)
def pull_to_levels(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "label", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    p = v.join(F.broadcast(v.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))), "label")
    force = 0.1 + 0.8 * qc.hashed(F.col("id"), 2) / 2147483647.0
    x, y = embed.pulled(F.col("x"), F.col("y"), F.col("mx"), F.col("my"), force)
    return p.select(F.col("id").alias("vec_id"), r6(x).alias("x"), r6(y).alias("y"))


@query(
    "second_pass_doublets", "B03",
    f"WITH {KNN}, fl AS (SELECT vec_id AS id, (label = 3)::INT AS flag FROM embeddings), s AS (SELECT src AS id, avg(flag) AS share FROM knn JOIN fl ON id = dst GROUP BY src) SELECT fl.id, CASE WHEN flag = 0 AND share >= 0.15e0 THEN 2 ELSE flag END AS flag FROM fl LEFT JOIN s USING (id)",
)
def second_pass_doublets(spark, sf_dir):
    flags = vectors(spark, sf_dir).select("id", (F.col("label") == 3).cast("int").alias("flag"))
    return doublets.second_pass(knn(spark, sf_dir), flags, 0.3)
