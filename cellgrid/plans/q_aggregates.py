"""Queries that aggregate by label."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellgrid.model import div0, r6
from cellgrid.operators import aggregate as ag
from cellgrid.operators import qc
from cellgrid.plans.registry import query
from cellgrid.sources.tables import order_matrix, table

GRID = """sz AS (SELECT cluster, count(*)::BIGINT AS n FROM cells GROUP BY 1),
    st AS (SELECT gene, cluster, sum(x) AS s, count(*) FILTER (x > 0)::BIGINT AS nnz FROM entries JOIN cells USING (cell) GROUP BY 1, 2),
    gr AS (SELECT g.gene, sz.cluster, sz.n, coalesce(s, 0e0) AS s, coalesce(nnz, 0)::BIGINT AS nnz FROM (SELECT DISTINCT gene FROM entries) g CROSS JOIN sz LEFT JOIN st ON st.gene = g.gene AND st.cluster = sz.cluster)"""
ENRICH = GRID + """, tt AS (SELECT gene, sum(s) AS ts, sum(nnz) AS tn, sum(n) AS tc FROM gr GROUP BY 1),
    en AS (SELECT gr.gene, cluster, s / n AS mean, nnz::DOUBLE / n AS f,
      (nnz::DOUBLE / n + 0.1e0) / ((tn - nnz)::DOUBLE / (tc - n)::DOUBLE + 0.1e0) * ((s / n + 0.01e0) / ((ts - s) / (tc - n)::DOUBLE + 0.01e0)) AS e FROM gr JOIN tt USING (gene))"""


@query("cluster_mean", "A01", f"WITH {GRID} SELECT gene, cluster, round(s / n, 6) AS mean FROM gr", matrix=True)
def cluster_mean(spark, sf_dir):
    return ag.label_means(order_matrix(spark, sf_dir), "cluster").select("gene", "cluster", r6(F.col("mean")).alias("mean"))


@query("cluster_nonzeros", "A03", f"WITH {GRID} SELECT gene, cluster, nnz FROM gr", matrix=True)
def cluster_nonzeros(spark, sf_dir):
    return ag.by_label(order_matrix(spark, sf_dir), "cluster").select("gene", "cluster", "nnz")


@query("cluster_sizes", "A04 A10", "SELECT i AS cluster_id, count(cell)::BIGINT AS n FROM range(30) r(i) LEFT JOIN cells ON sample = i GROUP BY i", matrix=True)
def cluster_sizes(spark, sf_dir):
    ids = spark.range(30).withColumnRenamed("id", "cluster_id")
    n = order_matrix(spark, sf_dir).cells.groupBy(F.col("sample").cast("long").alias("cluster_id")).agg(F.count("*").alias("n"))
    return ids.join(F.broadcast(n), "cluster_id", "left").fillna(0, ["n"])


@query(
    "attr_tally", "A02",
    """SELECT cluster, count(*) FILTER (region = 0)::BIGINT AS r0, count(*) FILTER (region = 1)::BIGINT AS r1, count(*) FILTER (region = 2)::BIGINT AS r2,
    arg_min(sample, cell)::BIGINT AS first_sample, round(avg(acctbal), 4) AS mean_bal,
    (SELECT sample FROM cells c2 WHERE c2.cluster = cells.cluster GROUP BY sample ORDER BY count(*) DESC, sample LIMIT 1)::BIGINT AS mode_sample FROM cells GROUP BY cluster""",
    matrix=True,
)
def attr_tally(spark, sf_dir):
    c = order_matrix(spark, sf_dir).cells
    tally = c.groupBy("cluster").pivot("region", [0, 1, 2]).count().fillna(0).toDF("cluster", "r0", "r1", "r2")
    rest = c.groupBy("cluster").agg(F.min_by("sample", "cell").cast("long").alias("first_sample"), r6(F.avg("acctbal"), 4).alias("mean_bal"), F.mode("sample", True).cast("long").alias("mode_sample"))
    return tally.join(rest, "cluster")


@query("enrichment", "E01 A07", f"WITH {ENRICH} SELECT gene, cluster, round(e, 6) AS enrichment FROM en", matrix=True)
def enrichment(spark, sf_dir):
    return ag.enrichment(order_matrix(spark, sf_dir), "cluster").select("gene", "cluster", r6(F.col("enrichment")).alias("enrichment"))


@query("top_markers", "N05 W01", f"WITH {ENRICH} SELECT cluster, gene, rank, round(e, 6) AS enrichment FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(e, 9) DESC, gene)::BIGINT AS rank FROM en) WHERE rank <= 3", matrix=True)
def top_markers(spark, sf_dir):
    e = ag.enrichment(order_matrix(spark, sf_dir), "cluster")
    return ag.top_by(e, "cluster", F.round("enrichment", 9), 3, "gene").select("cluster", "gene", F.col("rank").cast("long").alias("rank"), r6(F.col("enrichment")).alias("enrichment"))


@query("cluster_median", "A06", "SELECT cluster, round(median(acctbal), 4) AS mid, round(quantile_cont(acctbal, 0.6), 4) AS p60 FROM cells GROUP BY cluster", matrix=True)
def cluster_median(spark, sf_dir):
    return order_matrix(spark, sf_dir).cells.groupBy("cluster").agg(r6(F.median("acctbal"), 4).alias("mid"), r6(F.percentile("acctbal", 0.6), 4).alias("p60"))


@query(
    "f_percentiles", "A08 A05",
    f"WITH {GRID} SELECT cluster, " + ", ".join(f"round(quantile_cont(nnz::DOUBLE / n, {p / 1000}), 6) AS p{p}" for p in (700, 800, 900, 990, 997, 999)) + " FROM gr GROUP BY cluster", matrix=True,
)
def f_percentiles(spark, sf_dir):
    g = ag.by_label(order_matrix(spark, sf_dir), "cluster").withColumn("f", F.col("nnz") / F.col("n_cells"))
    return g.groupBy("cluster").agg(*[r6(F.percentile("f", p / 1000)).alias(f"p{p}") for p in (700, 800, 900, 990, 997, 999)])


@query(
    "majority_sample", "A11 A23 V06",
    "SELECT sample::BIGINT AS sample, count(*)::BIGINT AS n FROM (SELECT cluster, region, arg_max(sample, n * 1000 - sample) AS sample FROM (SELECT cluster, region, sample, count(*) AS n FROM cells GROUP BY ALL) GROUP BY ALL) GROUP BY 1", matrix=True,
)
def majority_sample(spark, sf_dir):
    c = order_matrix(spark, sf_dir).cells.withColumn("of", F.struct("cluster", "region"))
    return ag.mode(c, "of", "sample").groupBy(F.col("sample").cast("long").alias("sample")).agg(F.count("*").alias("n"))


@query("pseudobulk", "A12", "SELECT sample::BIGINT AS sample, cluster, gene, sum(x) AS x FROM entries JOIN cells USING (cell) GROUP BY ALL", matrix=True)
def pseudobulk(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    e = m.entries.join(m.cells.select("cell", "sample", "cluster"), "cell")
    return e.groupBy(F.col("sample").cast("long").alias("sample"), "cluster", "gene").agg(F.sum("x").alias("x"))


@query("total_histogram", "A13 V04", "WITH t AS (SELECT cell, sum(x) AS total FROM entries GROUP BY cell) SELECT least(floor(total / 50), 39)::BIGINT AS bin, count(*)::BIGINT AS n FROM t WHERE total BETWEEN 0 AND 2000 GROUP BY 1", matrix=True)
def total_histogram(spark, sf_dir):
    return ag.histogram(qc.cell_totals(order_matrix(spark, sf_dir).entries), "total", 0.0, 2000.0, 40)


@query(
    "composition", "A14 A15",
    "WITH n AS (SELECT sample, cluster, count(*) AS n FROM cells GROUP BY ALL) SELECT sample::BIGINT AS sample, cluster, round(n / sum(n) OVER (PARTITION BY sample), 6) AS share FROM n QUALIFY sum(n) OVER (PARTITION BY sample) >= 50", matrix=True,
)
def composition(spark, sf_dir):
    return ag.composition(order_matrix(spark, sf_dir).cells, "sample", "cluster", 50).select(F.col("sample").cast("long").alias("sample"), "cluster", r6(F.col("share")).alias("share"))


@query("donor_share", "A16", "SELECT cluster, " + ", ".join(f"round((count(*) FILTER (region = {k}))::DOUBLE / count(*), 6) AS r{k}" for k in range(5)) + " FROM cells GROUP BY cluster", matrix=True)
def donor_share(spark, sf_dir):
    c = order_matrix(spark, sf_dir).cells
    return c.groupBy("cluster").agg(*[r6(F.count_if(F.col("region") == k) / F.count("*")).alias(f"r{k}") for k in range(5)])


@query(
    "age_double_norm", "A17",
    """WITH n AS (SELECT cluster, sample, count(*) AS n FROM cells GROUP BY ALL), a AS (SELECT *, n / sum(n) OVER (PARTITION BY sample) AS a FROM n)
    SELECT cluster, sample::BIGINT AS sample, round(a / sum(a) OVER (PARTITION BY cluster), 6) AS share FROM a""",
    matrix=True,
)
def age_double_norm(spark, sf_dir):
    return ag.double_normalized(order_matrix(spark, sf_dir).cells, "cluster", "sample").select("cluster", F.col("sample").cast("long").alias("sample"), r6(F.col("share")).alias("share"))


@query("set_ratio", "A18", "SELECT region::BIGINT AS region, CASE WHEN count(*) FILTER (cluster = 'BUILDING') = 0 THEN 0 ELSE round((count(*) FILTER (cluster IN ('MACHINERY', 'FURNITURE')))::DOUBLE / count(*) FILTER (cluster = 'BUILDING'), 6) END AS ratio FROM cells GROUP BY region", matrix=True)
def set_ratio(spark, sf_dir):
    a, b = F.count_if(F.col("cluster").isin("MACHINERY", "FURNITURE")), F.count_if(F.col("cluster") == "BUILDING")
    c = order_matrix(spark, sf_dir).cells.groupBy(F.col("region").cast("long").alias("region")).agg(a.alias("a"), b.alias("b"))
    return c.select("region", r6(div0(F.col("a").cast("double"), F.col("b").cast("double"))).alias("ratio"))


@query("pct_of_pool", "A19", "SELECT sample::BIGINT AS sample, round(100e0 * count(*) FILTER (acctbal > 5000) / count(*), 6) AS pct FROM cells GROUP BY sample", matrix=True)
def pct_of_pool(spark, sf_dir):
    return order_matrix(spark, sf_dir).cells.groupBy(F.col("sample").cast("long").alias("sample")).agg(r6(F.lit(100.0) * F.count_if(F.col("acctbal") > 5000) / F.count("*")).alias("pct"))


@query(
    "pct_expressing", "A20",
    """WITH h AS (SELECT cell, gene FROM entries WHERE gene IN (5, 7) AND x > 3), n AS (SELECT count(*) AS n FROM cells)
    SELECT gene::VARCHAR AS what, round(count(*)::DOUBLE / n, 6) AS share FROM h, n GROUP BY gene, n
    UNION ALL SELECT 'all', round(count(*)::DOUBLE / n, 6) FROM (SELECT cell FROM h GROUP BY cell HAVING count(*) = 2), n GROUP BY n""",
    matrix=True,
)
def pct_expressing(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    found = ag.share_expressing(m.entries, [5, 7], 3, m.n_cells())
    return found.filter("n > 0").select("what", r6(F.col("share")).alias("share"))


@query("fine_per_coarse", "A21", "SELECT region::BIGINT AS region, count(DISTINCT sample)::BIGINT AS n_samples, count(DISTINCT cluster)::BIGINT AS n_clusters FROM cells GROUP BY region", matrix=True)
def fine_per_coarse(spark, sf_dir):
    return order_matrix(spark, sf_dir).cells.groupBy(F.col("region").cast("long").alias("region")).agg(F.countDistinct("sample").alias("n_samples"), F.countDistinct("cluster").alias("n_clusters"))


@query(
    "low_umi_samples", "A22",
    """WITH t AS (SELECT cell, cluster, sample, sum(x) AS total FROM entries JOIN cells USING (cell) GROUP BY ALL), p AS (SELECT cluster, quantile_cont(total, 0.05) AS p5 FROM t GROUP BY cluster)
    SELECT sample::BIGINT AS sample, round(avg((total < p5)::INT), 6) AS share FROM t JOIN p USING (cluster) GROUP BY sample HAVING avg((total < p5)::INT) >= 0.06e0""",
    matrix=True,
)
def low_umi_samples(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    t = qc.cell_totals(m.entries).join(m.cells, "cell")
    low = t.join(F.broadcast(t.groupBy("cluster").agg(F.percentile("total", 0.05).alias("p5"))), "cluster").withColumn("low", (F.col("total") < F.col("p5")).cast("int"))
    return low.groupBy(F.col("sample").cast("long").alias("sample")).agg(F.avg("low").alias("share")).filter("share >= 0.06").withColumn("share", r6(F.col("share")))


@query("genotype_depth", "A24", "SELECT cell, count(*) FILTER (x > 0)::BIGINT AS depth, count(*) FILTER (x > 0 AND ad / x <= 0.6e0)::BIGINT AS n_ref FROM entries GROUP BY cell", matrix=True)
def genotype_depth(spark, sf_dir):
    return ag.genotype(order_matrix(spark, sf_dir).entries.select("cell", "ad", F.col("x").alias("dp")), 0.6)


@query("crosstab", "A25", "SELECT cluster, " + ", ".join(f"count(*) FILTER (region = {k})::BIGINT AS region_{k}" for k in range(5)) + " FROM cells GROUP BY cluster", matrix=True)
def crosstab(spark, sf_dir):
    return order_matrix(spark, sf_dir).cells.groupBy("cluster").pivot("region", list(range(5))).count().fillna(0).toDF("cluster", *[f"region_{k}" for k in range(5)])


@query(
    "cell_cycle", "A26",
    """WITH s AS (SELECT cell, sum(x) AS total, coalesce(sum(x) FILTER (size = 1), 0e0) AS a, coalesce(sum(x) FILTER (size = 2), 0e0) AS b, coalesce(sum(x) FILTER (size = 3), 0e0) AS c FROM entries JOIN genes USING (gene) GROUP BY cell)
    SELECT cell, round(a / total, 6) AS g1, round(b / total, 6) AS s, round(c / total, 6) AS g2m, round((a + b + c) / total, 6) AS cycle, (a + b + c) / total > 0.01e0 AS is_cycling FROM s""",
    matrix=True,
)
def cell_cycle(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    phase = lambda k: F.sum(F.when(F.col("size") == k, F.col("x")).otherwise(0.0))
    s = m.entries.join(m.genes.select("gene", "size"), "gene").groupBy("cell").agg(F.sum("x").alias("t"), phase(1).alias("a"), phase(2).alias("b"), phase(3).alias("c"))
    all_ = (F.col("a") + F.col("b") + F.col("c")) / F.col("t")
    return s.select("cell", *[r6(F.col(p) / F.col("t")).alias(n) for p, n in (("a", "g1"), ("b", "s"), ("c", "g2m"))], r6(all_).alias("cycle"), (all_ > 0.01).alias("is_cycling"))


MEANS = "mm AS (SELECT sample, category AS f, sum(x) AS v FROM entries JOIN cells USING (cell) JOIN genes USING (gene) GROUP BY ALL)"


@query("correlation_matrix", "A27", f"WITH {MEANS} SELECT a.sample::BIGINT AS a, b.sample::BIGINT AS b, round(corr(a.v, b.v), 6) AS r FROM mm a JOIN mm b ON a.f = b.f AND a.sample < b.sample GROUP BY ALL", matrix=True)
def correlation_matrix(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    named = m.entries.join(m.cells.select("cell", "sample"), "cell").join(m.genes.select("gene", "category"), "gene")
    v = named.groupBy(F.col("sample").cast("long").alias("s"), F.col("category").alias("f")).agg(F.sum("x").alias("v"))
    pairs = v.select(F.col("s").alias("a"), "f", F.col("v").alias("va")).join(v.select(F.col("s").alias("b"), "f", F.col("v").alias("vb")), "f").filter("a < b")
    return pairs.groupBy("a", "b").agg(r6(F.corr("va", "vb")).alias("r"))


@query("cluster_breadth", "A28", "WITH n AS (SELECT sample, cluster, count(*) AS n FROM cells GROUP BY ALL), c AS (SELECT *, n / sum(n) OVER (PARTITION BY sample) AS f FROM n) SELECT cluster, round(avg((f > 0.2e0)::INT), 6) AS breadth FROM c GROUP BY cluster", matrix=True)
def cluster_breadth(spark, sf_dir):
    return ag.composition(order_matrix(spark, sf_dir).cells, "sample", "cluster").groupBy("cluster").agg(r6(F.avg((F.col("share") > 0.2).cast("int"))).alias("breadth"))


@query("median_group_size", "A29", "SELECT region::BIGINT AS region, median(n) AS mid FROM (SELECT region, sample, count(*) AS n FROM cells GROUP BY ALL) GROUP BY region", matrix=True)
def median_group_size(spark, sf_dir):
    n = order_matrix(spark, sf_dir).cells.groupBy("region", "sample").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("region").cast("long").alias("region")).agg(F.median("n").alias("mid"))


@query("samples_per_region", "A30", "SELECT region::BIGINT AS region, sample::BIGINT AS sample, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY region ORDER BY sample)::BIGINT AS ord FROM cells GROUP BY region, sample", matrix=True)
def samples_per_region(spark, sf_dir):
    n = order_matrix(spark, sf_dir).cells.groupBy(F.col("region").cast("long").alias("region"), F.col("sample").cast("long").alias("sample")).agg(F.count("*").alias("n"))
    return n.withColumn("ord", F.row_number().over(Window.partitionBy("region").orderBy("sample")).cast("long"))


@query("gene_set_score", "A31", "SELECT cell, sum(x) AS score FROM entries WHERE gene IN (SELECT gene FROM genes WHERE category = 'Brand#3' ORDER BY gene LIMIT 50) GROUP BY cell", matrix=True)
def gene_set_score(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    listed = m.genes.filter("category = 'Brand#3'").orderBy("gene").limit(50)
    return m.entries.join(F.broadcast(listed.select("gene")), "gene", "left_semi").groupBy("cell").agg(F.sum("x").alias("score"))


@query(
    "region_overlap", "A32",
    """WITH c AS (SELECT sample, gene, count(*) AS n FROM entries JOIN cells USING (cell) GROUP BY ALL HAVING count(*) > 1), s AS (SELECT sample, count(*) AS k FROM c GROUP BY sample)
    SELECT a.sample::BIGINT AS a, b.sample::BIGINT AS b, round(count(*)::DOUBLE / k, 6) AS share FROM c a JOIN c b ON a.gene = b.gene AND a.sample <> b.sample JOIN s ON s.sample = a.sample GROUP BY a.sample, b.sample, k""",
    matrix=True,
)
def region_overlap(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    c = m.entries.join(m.cells.select("cell", F.col("sample").cast("long").alias("s")), "cell").groupBy("s", "gene").agg(F.count("*").alias("n")).filter("n > 1")
    both = c.select(F.col("s").alias("a"), "gene").join(c.select(F.col("s").alias("b"), "gene"), "gene").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return both.join(F.broadcast(c.groupBy(F.col("s").alias("a")).agg(F.count("*").alias("k"))), "a").select("a", "b", r6(F.col("n") / F.col("k")).alias("share"))


@query("cube_counts", "A10", "SELECT cluster, region::BIGINT AS region, count(*)::BIGINT AS n FROM cells GROUP BY CUBE (cluster, region)", matrix=True)
def cube_counts(spark, sf_dir):
    return order_matrix(spark, sf_dir).cells.withColumn("region", F.col("region").cast("long")).cube("cluster", "region").agg(F.count("*").alias("n"))


@query(
    "heatmap_matrix", "V02",
    """WITH g AS (SELECT cluster, gene, ln(sum(x) + 1) AS v FROM entries JOIN cells USING (cell) GROUP BY ALL), p AS (SELECT gene, quantile_cont(v, 0.99) AS p FROM g GROUP BY gene),
    top AS (SELECT gene, arg_max(cluster, round(v, 9)) AS top FROM (SELECT * FROM g ORDER BY cluster) GROUP BY gene)
    SELECT g.gene, cluster, round(v / (p + 0.1e0), 6) AS v FROM g JOIN p USING (gene)""",
    matrix=True,
)
def heatmap_matrix(spark, sf_dir):
    g = order_matrix(spark, sf_dir)
    v = g.entries.join(g.cells.select("cell", "cluster"), "cell").groupBy("cluster", "gene").agg(F.log1p(F.sum("x")).alias("v"))
    p = v.groupBy("gene").agg(F.percentile("v", 0.99).alias("p"))
    return v.join(p, "gene").select("gene", "cluster", r6(F.col("v") / (F.col("p") + 0.1)).alias("v"))


@query("strong_factors", "V07", "WITH p AS (SELECT gene, quantile_cont(x, 0.99) AS p FROM entries GROUP BY gene) SELECT gene, count(*)::BIGINT AS n FROM entries JOIN p USING (gene) WHERE x > 0.5e0 * p GROUP BY gene", matrix=True)
def strong_factors(spark, sf_dir):
    e = order_matrix(spark, sf_dir).entries
    p = e.groupBy("gene").agg(F.percentile("x", 0.99).alias("p"))
    return e.join(p, "gene").filter(F.col("x") > 0.5 * F.col("p")).groupBy("gene").agg(F.count("*").alias("n"))


@query("event_counts", "A10", "SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1")
def event_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
