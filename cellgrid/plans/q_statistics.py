"""Queries on gene statistics and annotation."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellgrid.model import r6
from cellgrid.operators import aggregate as ag
from cellgrid.operators import qc, stats
from cellgrid.plans.q_aggregates import ENRICH, GRID
from cellgrid.plans.q_matrix import NORMAL_SQL
from cellgrid.plans.registry import query
from cellgrid.sources.tables import order_matrix

TWO = "('BUILDING', 'MACHINERY')"


#: The views of ENRICH over other names: of the cells with dealt labels.
def dealt(text: str) -> str:
    for name in ("sz", "st", "gr", "tt", "en"):
        text = re.sub(rf"\b{name}\b", f"{name}0", text)
    return text.replace("cells", "dealt")


PERMUTED = f"""pl AS (SELECT cell, row_number() OVER (ORDER BY {qc.hash_sql('cell', 21)}, cell) AS place FROM cells), lc AS (SELECT cluster, row_number() OVER (ORDER BY {qc.hash_sql('cell', 22)}, cell) AS place FROM cells),
    dealt AS (SELECT cell, cluster FROM pl JOIN lc USING (place)), {dealt(ENRICH)},
    sc AS (SELECT cluster, gene, round(e, 9) AS e, 0 AS nul FROM en UNION ALL SELECT cluster, gene, round(e, 9) AS e, 1 AS nul FROM en0),
    p AS (SELECT cluster, gene, e, nul, 1 - (sum(nul) OVER u - sum(nul) OVER (PARTITION BY cluster, e))::DOUBLE / sum(nul) OVER (PARTITION BY cluster) AS p FROM sc WINDOW u AS (PARTITION BY cluster ORDER BY e RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    r AS (SELECT cluster, gene, e, p, p * count(*) OVER (PARTITION BY cluster) / row_number() OVER (PARTITION BY cluster ORDER BY p, gene) AS raw FROM p WHERE nul = 0),
    qv AS (SELECT cluster, gene, e, p, least(min(raw) OVER (PARTITION BY cluster ORDER BY p DESC, gene DESC), 1) AS q FROM r)"""


@query("perm_pvalue_bh", "E03", f"WITH {ENRICH}, {PERMUTED} SELECT cluster, gene, round(p, 6) AS p, round(q, 6) AS q FROM qv", matrix=True)
def perm_pvalue_bh(spark, sf_dir):
    """Each score against the cluster's scores under dealt labels, then q-values within each cluster."""
    found = stats.enrichment_test(order_matrix(spark, sf_dir), "cluster")
    return found.select("cluster", "gene", r6(F.col("p")).alias("p"), r6(F.col("q")).alias("q"))


@query("enrichment_score", "E02", f"WITH {ENRICH} SELECT cluster, gene, round(e, 5) AS score FROM (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(e, 9) DESC, gene) <= 50)", matrix=True)
def enrichment_score(spark, sf_dir):
    e = ag.enrichment(order_matrix(spark, sf_dir), "cluster")
    return ag.top_by(e, "cluster", F.round("enrichment", 9), 50, "gene").select("cluster", "gene", r6(F.col("enrichment"), 5).alias("score"))


DENSE = f"""c2 AS (SELECT cell, cluster FROM cells WHERE cluster IN {TWO}),
    d AS (SELECT g.gene, c2.cell, c2.cluster, coalesce(x, 0e0) AS x FROM (SELECT DISTINCT gene FROM entries JOIN c2 USING (cell)) g CROSS JOIN c2 LEFT JOIN entries e ON e.gene = g.gene AND e.cell = c2.cell)"""


@query(
    "ranksum_u", "E11 E12",
    f"""WITH {DENSE}, r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY x) + (count(*) OVER (PARTITION BY gene, x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene, x) AS t FROM d),
    s AS (SELECT gene, sum(rk) FILTER (cluster = 'BUILDING') AS ra, count(*) FILTER (cluster = 'BUILDING') AS na, count(*) FILTER (cluster <> 'BUILDING') AS nb, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY gene)
    SELECT gene, round((ra - na * (na + 1) / 2.0)::DOUBLE, 3) AS u, round(((ra - na * (na + 1) / 2.0 - na * nb / 2.0) / sqrt(na * nb / 12.0 * ((na + nb + 1) - ties / ((na + nb)::DOUBLE * (na + nb - 1)))))::DOUBLE, 5) AS z FROM s""",
    matrix=True,
)
def ranksum_u(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    two = m.cells.filter(F.col("cluster").isin("BUILDING", "MACHINERY")).select("cell", F.when(F.col("cluster") == "BUILDING", "A").otherwise("B").alias("side"))
    sizes = two.agg(F.count_if(F.col("side") == "A").alias("n_a"), F.count_if(F.col("side") == "B").alias("n_b"))
    found = stats.rank_sum(m.entries.join(two, "cell").select("gene", "side", "x"), sizes)
    return found.select("gene", r6(F.col("u"), 3).alias("u"), r6(F.col("z"), 5).alias("z"))


@query(
    "ks_stat", "E12 D02",
    f"""WITH e AS (SELECT gene, x, count(*) FILTER (cluster = 'BUILDING') AS a, count(*) FILTER (cluster = 'MACHINERY') AS b FROM entries JOIN cells USING (cell) WHERE cluster IN {TWO} GROUP BY ALL),
    h AS (SELECT gene, sum(a) OVER u AS ua, sum(a) OVER t AS ta, sum(b) OVER u AS ub, sum(b) OVER t AS tb FROM e WINDOW u AS (PARTITION BY gene ORDER BY x), t AS (PARTITION BY gene))
    SELECT gene, round(max(abs(ua / ta - ub / tb)), 6) AS d FROM h WHERE ta > 0 AND tb > 0 GROUP BY gene""",
    matrix=True,
)
def ks_stat(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    two = m.cells.filter(F.col("cluster").isin("BUILDING", "MACHINERY")).select("cell", F.when(F.col("cluster") == "BUILDING", "A").otherwise("B").alias("side"))
    return stats.ks_distance(m.entries.join(two, "cell"), "gene", "side", "x").select("gene", r6(F.col("d")).alias("d")).filter("d IS NOT NULL")


#: Two-sided chance of Welch's t by the power series of the incomplete beta function; it is slow near 0, where the chance is no candidate for a low q.
T_TEST_SQL = """CASE WHEN abs(t) < 1.5e0 OR t IS NULL THEN 1 ELSE
    exp(nu / 2 * ln(nu / (nu + t * t)) + 0.5e0 * ln(t * t / (nu + t * t)) + lgamma(nu / 2 + 0.5e0) - lgamma(nu / 2) - lgamma(0.5e0) - ln(nu / 2))
    * list_sum(list_transform(range(0, 3000), lambda k: exp(lgamma(nu / 2 + 0.5e0 + k) - lgamma(nu / 2 + 0.5e0) - lgamma(nu / 2 + 1 + k) + lgamma(nu / 2 + 1) + k * ln(nu / (nu + t * t))))) END"""


@query(
    "binary_de", "E10 J09",
    f"""WITH {NORMAL_SQL}, sz AS (SELECT cluster, count(*) AS n FROM cells GROUP BY 1), w AS (SELECT gene, cluster, sum(x) AS s, sum(v) AS sv, sum(v * v) AS ss, count(*) FILTER (x > 0) AS nz FROM v JOIN cells USING (cell) GROUP BY 1, 2),
    f AS (SELECT g.gene, sz.cluster, n, coalesce(s, 0) / n AS mean, coalesce(sv, 0) / n AS level, coalesce(nz, 0)::DOUBLE / n AS f, greatest((coalesce(ss, 0) / n - (coalesce(sv, 0) / n) * (coalesce(sv, 0) / n)) * n / (n - 1), 0) AS var
      FROM (SELECT DISTINCT gene FROM entries) g CROSS JOIN sz LEFT JOIN w ON w.gene = g.gene AND w.cluster = sz.cluster),
    pr AS (SELECT a.gene, a.cluster AS a, b.cluster AS b, a.var / a.n AS pa, b.var / b.n AS pb, a.n AS na, b.n AS nb, a.level - b.level AS gap, greatest(a.mean, b.mean) >= 1.2e0 * least(a.mean, b.mean) AS folds,
      CASE WHEN a.mean >= b.mean THEN a.f ELSE b.f END AS up, CASE WHEN a.mean >= b.mean THEN b.f ELSE a.f END AS down FROM f a JOIN f b ON a.gene = b.gene AND a.cluster < b.cluster),
    tt AS (SELECT gene, a, b, folds AND up > 0.02e0 AND (up - down) / greatest(up, down) > 0.1e0 AS hit, gap / sqrt(pa + pb) AS t, (pa + pb) * (pa + pb) / (pa * pa / (na - 1) + pb * pb / (nb - 1)) AS nu FROM pr),
    pp AS (SELECT gene, a, b, hit, {T_TEST_SQL} AS p FROM tt), rk AS (SELECT *, p * count(*) OVER (PARTITION BY a, b) / row_number() OVER (PARTITION BY a, b ORDER BY p, gene) AS raw FROM pp),
    qq AS (SELECT *, min(raw) OVER (PARTITION BY a, b ORDER BY p DESC, gene DESC) AS q FROM rk)
    SELECT a, b, count(*) FILTER (hit AND q < 0.6e0)::BIGINT AS n FROM qq GROUP BY ALL""",
    matrix=True,
)
def binary_de(spark, sf_dir):
    """The limits are wide, as the tables' labels hardly differ."""
    return stats.pairwise_de(stats.welch(order_matrix(spark, sf_dir), "cluster"), 1.2, 0.02, 0.1, 0.6)


@query(
    "gsea_score", "E09 W02",
    f"""WITH {ENRICH}, b AS (SELECT cluster, gene, round(e, 9) AS e, row_number() OVER (PARTITION BY cluster ORDER BY gene) AS pos, count(*) OVER (PARTITION BY cluster) AS n FROM en),
    mm AS (SELECT DISTINCT category AS s, gene FROM genes WHERE gene IN (SELECT gene FROM b)), sz0 AS (SELECT s, count(*) AS k FROM mm GROUP BY s),
    rk AS (SELECT r, gene, row_number() OVER (PARTITION BY r ORDER BY {qc.hash_sql('gene', '1000 + r')}, gene) AS rank FROM (SELECT DISTINCT gene FROM b), range(0, 1000) t(r)),
    hit AS (SELECT s, -1 AS r, gene FROM mm UNION ALL SELECT s, r, gene FROM rk JOIN sz0 ON rank <= k),
    ld AS (SELECT cluster, s, r, sum(e) OVER w / sum(e) OVER (PARTITION BY cluster, s, r) - (pos - row_number() OVER w)::DOUBLE / (n - k) AS gap FROM hit JOIN b USING (gene) JOIN sz0 USING (s) WINDOW w AS (PARTITION BY cluster, s, r ORDER BY pos)),
    sc AS (SELECT cluster, s, r, max(gap) AS score FROM ld GROUP BY ALL)
    SELECT o.cluster, o.s AS "set", round(any_value(o.score), 6) AS score, round(1 - count(*) FILTER (z.score < o.score - 1e-12) / 1000e0, 6) AS p FROM sc o JOIN sc z ON z.cluster = o.cluster AND z.s = o.s AND z.r >= 0 WHERE o.r = -1 GROUP BY ALL""",
    matrix=True,
)
def gsea_score(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    scores = ag.enrichment(m, "cluster").select("cluster", "gene", F.round("enrichment", 9).alias("score"))
    members = m.genes.select(F.col("category").alias("set"), "gene")
    return stats.gsea(scores, members).select("cluster", "set", r6(F.col("score")).alias("score"), r6(F.col("p")).alias("p"))


@query(
    "tag_posterior", "N01 N02",
    """WITH r AS (SELECT * FROM (VALUES ('B', 1, 5), ('B', -1, 9), ('M', 1, 11), ('M', 1, 12), ('R', -1, 20)) v(tag, sign, gene)), sz AS (SELECT cluster, count(*) AS n FROM cells GROUP BY 1),
    t AS (SELECT r.tag, r.sign, r.gene, sz.cluster, least(1e0, 20e0 * (SELECT count(*) FROM entries JOIN cells USING (cell) WHERE entries.gene = r.gene AND cells.cluster = sz.cluster) / n) AS p FROM r CROSS JOIN sz),
    q AS (SELECT cluster, tag, product(CASE WHEN sign > 0 THEN p ELSE 1 - p END) AS posterior FROM t GROUP BY ALL)
    SELECT cluster, coalesce(string_agg(tag, ' ' ORDER BY tag) FILTER (posterior > 0.5e0), '') AS tags, round(max(posterior), 6) AS best FROM q GROUP BY cluster""",
    matrix=True,
)
def tag_posterior(spark, sf_dir):
    from cellgrid.operators.annotate import parse_definitions

    rules = parse_definitions(spark, [("B", "+5 -9"), ("M", "+11 +12"), ("R", "-20")]).withColumn("gene", F.col("gene").cast("long"))
    m = order_matrix(spark, sf_dir)
    genes = m.entries.join(F.broadcast(rules.select("gene").distinct()), "gene", "left_semi")
    filled = ag.by_label(type(m)(m.cells, m.genes, genes), "cluster").withColumn("trinary", F.least(F.lit(1.0), 20.0 * F.col("nnz") / F.col("n_cells")))
    p = stats.tag_posteriors(rules, filled)
    tags = F.array_join(F.array_sort(F.collect_list(F.when(F.col("posterior") > 0.5, F.col("tag")))), " ")
    return p.groupBy("cluster").agg(tags.alias("tags"), r6(F.max("posterior")).alias("best"))


@query(
    "marker_round_one", "N03 N04",
    f"WITH {ENRICH} SELECT cluster, gene FROM en WHERE f > 0.02e0 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(e, 9) DESC, gene) = 1", matrix=True,
)
def marker_round_one(spark, sf_dir):
    e = ag.enrichment(order_matrix(spark, sf_dir), "cluster").filter("nonzeros > 0.02")
    return ag.top_by(e, "cluster", F.round("enrichment", 9), 1, "gene").select("cluster", "gene")


@query("marker_sets", "N03 N04 A.19")
def marker_sets(spark, sf_dir):
    from cellgrid.operators.annotate import marker_sets as sets

    m = order_matrix(spark, sf_dir)
    return sets(stats.trinarize(ag.enrichment(m, "cluster"), f=0.02), pep=0.5, n_genes=3)


@query(
    "trinarize", "E07 2.12",
    f"""WITH {GRID}, u AS (SELECT DISTINCT n, nnz FROM gr), p AS (SELECT n, nnz, exp((1.5e0 + nnz) * ln(0.02e0)) * list_sum(list_transform(range(0, n - nnz + 2), lambda j: exp(lgamma(1.5e0 + nnz + j) - lgamma(1.5e0 + nnz) - lgamma(j + 1e0) + j * ln(0.98e0)))) AS low FROM u)
    SELECT gene, cluster, round(CASE WHEN low = 0 THEN 1 ELSE 1 - low END, 6) AS trinary FROM gr JOIN p USING (n, nnz)""", matrix=True,
)
def trinarize(spark, sf_dir):
    g = ag.by_label(order_matrix(spark, sf_dir), "cluster")
    return stats.trinarize(g, f=0.02).select("gene", "cluster", r6(F.col("trinary")).alias("trinary"))


@query(
    "confusion_report", "N07",
    """WITH p AS (SELECT cluster AS truth, CASE WHEN acctbal > 6000 THEN 'BUILDING' WHEN acctbal > 2000 THEN 'MACHINERY' ELSE cluster END AS guess FROM cells),
    c AS (SELECT l.cluster AS label, (SELECT count(*) FROM p WHERE truth = l.cluster AND guess = l.cluster) AS tp, (SELECT count(*) FROM p WHERE guess = l.cluster) AS g, (SELECT count(*) FROM p WHERE truth = l.cluster) AS t FROM (SELECT DISTINCT cluster FROM cells) l),
    r AS (SELECT label, t, CASE WHEN g = 0 THEN 0 ELSE tp::DOUBLE / g END AS prec, tp::DOUBLE / t AS rec FROM c)
    SELECT label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END, 6) AS f1, t::BIGINT AS support FROM r""",
    matrix=True,
)
def confusion_report(spark, sf_dir):
    guess = F.when(F.col("acctbal") > 6000, "BUILDING").when(F.col("acctbal") > 2000, "MACHINERY").otherwise(F.col("cluster"))
    p = order_matrix(spark, sf_dir).cells.select(F.col("cluster").alias("truth"), guess.alias("guess"))
    marks = p.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g"), F.lit(0).alias("tp")), F.struct(F.col("guess").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g"), (F.col("truth") == F.col("guess")).cast("int").alias("tp")))).alias("k")).select("k.*")
    c = marks.groupBy("label").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("tp").alias("tp"))
    c = c.withColumn("prec", F.when(F.col("g") == 0, 0.0).otherwise(F.col("tp") / F.col("g"))).withColumn("rec", F.col("tp") / F.col("t"))
    f1 = F.when(F.col("prec") + F.col("rec") == 0, 0.0).otherwise(2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec")))
    return c.select("label", r6(F.col("prec")).alias("precision"), r6(F.col("rec")).alias("recall"), r6(f1).alias("f1"), F.col("t").alias("support"))


@query("special_functions", "T02", "SELECT p_partkey AS k, round(lgamma(p_size + 0.5e0), 6) AS lg, round(ln(p_retailprice), 6) AS l, round(sqrt(p_size::DOUBLE), 6) AS s FROM part")
def special_functions(spark, sf_dir):
    from cellgrid.sources.tables import table

    x = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), r6(stats.lgamma(x + 0.5)).alias("lg"), r6(F.log("p_retailprice")).alias("l"), r6(F.sqrt(x)).alias("s"))


@query(
    "residual_clip", "F22",
    """WITH t AS (SELECT cell, sum(x) AS total FROM entries GROUP BY cell), g AS (SELECT gene, sum(x) AS gt FROM entries GROUP BY gene), s AS (SELECT sum(x) AS grand FROM entries), n AS (SELECT sqrt(count(*)) AS lim FROM cells),
    e AS (SELECT gene, x, total * gt / grand AS e FROM entries JOIN t USING (cell) JOIN g USING (gene), s)
    SELECT gene, round(sum(greatest(-lim, least(lim, (x - e) / sqrt(e + e * e / 100)))), 4) AS r FROM e, n GROUP BY gene""",
    matrix=True,
)
def residual_clip(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    r = qc.residuals(m).crossJoin(F.broadcast(m.cells.agg(F.sqrt(F.count("*")).alias("lim"))))
    return r.groupBy("gene").agg(r6(F.sum(F.greatest(-F.col("lim"), F.least("lim", "r"))), 4).alias("r"))


@query("normalized_level", "A09", f"WITH {NORMAL_SQL} SELECT round(max(level), 4) AS level, count(*)::BIGINT AS n FROM t, lv", matrix=True)
def normalized_level(spark, sf_dir):
    t = qc.cell_totals(order_matrix(spark, sf_dir).entries)
    return t.agg(r6(F.median("total"), 4).alias("level"), F.count("*").alias("n"))


@query(
    "cumulative_share", "W07 W02",
    "WITH n AS (SELECT category, count(*) AS n FROM genes GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS t FROM n) SELECT category, n::BIGINT AS n FROM c WHERE before <= 0.95e0 * t", matrix=True,
)
def cumulative_share(spark, sf_dir):
    n = order_matrix(spark, sf_dir).genes.groupBy("category").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("n").desc(), "category").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.withColumn("before", before).withColumn("t", F.sum("n").over(Window.partitionBy(F.lit(1)))).filter(F.col("before") <= 0.95 * F.col("t")).select("category", "n")
