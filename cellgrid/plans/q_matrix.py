"""Queries on the matrix: quality control, normalization, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.model import div0, r6
from cellgrid.operators import qc
from cellgrid.plans.registry import query
from cellgrid.sources.tables import combine, gene_subset, order_matrix, table

MITO = ("MT", "PROMO")


@query("cell_totals", "F05 IO05", "SELECT cell, sum(x) AS total, count(*) FILTER (x <> 0)::BIGINT AS n_genes FROM entries GROUP BY cell", matrix=True)
def cell_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.cell_totals(order_matrix(spark, sf_dir).entries)


@query(
    "mean_total_umi", "F05",
    "SELECT round(sum(x) / (SELECT count(*) FROM cells), 6) AS mean_total, round(sum(x) / (SELECT count(*) FROM cells) / (SELECT count(*) FROM cells), 6) AS mean_total_again FROM entries",
    matrix=True,
)
def mean_total_umi(spark, sf_dir):
    return qc.mean_total(order_matrix(spark, sf_dir)).select(r6(F.col("mean_total")).alias("mean_total"), r6(F.col("mean_total_again")).alias("mean_total_again"))


@query(
    "valid_genes", "F01 IO01",
    """WITH n AS (SELECT gene, count(*)::BIGINT AS nnz FROM entries WHERE x <> 0 GROUP BY gene)
    SELECT genes.gene, coalesce(nnz, 0)::BIGINT AS nnz, coalesce(nnz, 0) > 10 AND coalesce(nnz, 0) < 0.6e0 * (SELECT count(*) FROM cells) AS valid
    FROM genes LEFT JOIN n USING (gene)""",
    matrix=True,
)
def valid_genes(spark, sf_dir):
    return qc.valid_genes(order_matrix(spark, sf_dir))


QUALITY_SQL = """
  SELECT cell, sum(x) AS total, count(*) FILTER (x <> 0)::BIGINT AS n_genes,
         coalesce(sum(x) FILTER (chromosome = 'PROMO'), 0e0) / sum(x) AS mito_ratio, sum(unspliced) / sum(x) AS unspliced_ratio
  FROM entries JOIN genes USING (gene) GROUP BY cell
"""


@query("mito_ratio", "F06", f"SELECT cell, round(mito_ratio, 6) AS ratio FROM ({QUALITY_SQL})", matrix=True)
def mito_ratio(spark, sf_dir):
    return qc.category_ratio(order_matrix(spark, sf_dir), MITO).select("cell", r6(F.col("ratio")).alias("ratio"))


@query("unspliced_ratio", "F07", f"SELECT cell, round(unspliced_ratio, 6) AS ratio FROM ({QUALITY_SQL})", matrix=True)
def unspliced_ratio(spark, sf_dir):
    return qc.layer_ratio(order_matrix(spark, sf_dir).entries, "unspliced").select("cell", r6(F.col("ratio")).alias("ratio"))


@query("cell_qc_filter", "F02 F18", f"SELECT cell, total, n_genes FROM ({QUALITY_SQL}) WHERE total >= 300 AND mito_ratio < 0.25e0 AND unspliced_ratio > 0.1e0", matrix=True)
def cell_qc_filter(spark, sf_dir):
    quality = qc.cell_quality(order_matrix(spark, sf_dir), MITO)
    return quality.filter(qc.passes(quality, 300, 0.25, 0.1)).select("cell", "total", "n_genes")


@query(
    "sample_gate", "F03",
    f"""WITH q AS ({QUALITY_SQL})
    SELECT sample::BIGINT AS sample, count(*)::BIGINT AS n, count(*) FILTER (total >= 300 AND mito_ratio < 0.25e0 AND unspliced_ratio > 0.1e0)::BIGINT AS n_good,
           (count(*) FILTER (total >= 300 AND mito_ratio < 0.25e0 AND unspliced_ratio > 0.1e0))::DOUBLE / count(*) > 0.4e0 AS kept
    FROM q JOIN cells USING (cell) GROUP BY sample""",
    matrix=True,
)
def sample_gate(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    quality = qc.cell_quality(m, MITO)
    return qc.sample_gate(quality.join(m.cells, "cell"), qc.passes(quality, 300, 0.25, 0.1), 0.4).withColumn("sample", F.col("sample").cast("long"))


@query(
    "qc_status", "F04",
    f"""WITH q AS ({QUALITY_SQL}), s AS (
      SELECT sample, avg(total) AS umi, avg((mito_ratio < 0.25e0)::INT) AS mt_ok, avg((unspliced_ratio > 0.1e0)::INT) AS us_ok FROM q JOIN cells USING (cell) GROUP BY sample)
    SELECT sample::BIGINT AS sample, round(umi, 4) AS mean_umi, umi >= 1000 AS passed,
           CASE WHEN umi < 1000 THEN 'failed' WHEN mt_ok < 0.8e0 THEN 'warn mitochondrial' WHEN us_ok < 0.8e0 THEN 'warn unspliced' ELSE 'passed' END AS status FROM s""",
    matrix=True,
)
def qc_status(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    quality = qc.cell_quality(m, MITO).join(m.cells, "cell")
    per = quality.groupBy("sample").agg(F.avg("total").alias("umi"), F.avg((F.col("mito_ratio") < 0.25).cast("int")).alias("mt"), F.avg((F.col("unspliced_ratio") > 0.1).cast("int")).alias("us"))
    status = F.when(F.col("umi") < 1000, "failed").when(F.col("mt") < 0.8, "warn mitochondrial").when(F.col("us") < 0.8, "warn unspliced").otherwise("passed")
    return per.select(F.col("sample").cast("long").alias("sample"), r6(F.col("umi"), 4).alias("mean_umi"), (F.col("umi") >= 1000).alias("passed"), status.alias("status"))


NORMAL_SQL = """t AS (SELECT cell, sum(x) AS total FROM entries GROUP BY cell), lv AS (SELECT median(total) AS level FROM t),
    v AS (SELECT cell, gene, x, log2(x / total * level + 1) AS v FROM entries JOIN t USING (cell), lv)"""


@query(
    "gene_mean_sd", "F20 A09",
    f"""WITH {NORMAL_SQL}, n AS (SELECT count(*) AS n FROM cells)
    SELECT gene, round(sum(v) / n, 5) AS mean, round(sqrt(greatest(sum(v * v) / n - (sum(v) / n) * (sum(v) / n), 0)), 5) AS sd FROM v, n GROUP BY gene, n""",
    matrix=True,
)
def gene_mean_sd(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    return qc.gene_moments(qc.normalized(m), "v", m.n_cells()).select("gene", r6(F.col("mean"), 5).alias("mean"), r6(F.col("sd"), 5).alias("sd"))


@query(
    "normalized_top", "F20",
    f"""WITH {NORMAL_SQL}, n AS (SELECT count(*) AS n FROM cells),
    s AS (SELECT gene, sum(v) / n AS mean, sqrt(greatest(sum(v * v) / n - (sum(v) / n) * (sum(v) / n), 0)) AS sd FROM v, n GROUP BY gene, n)
    SELECT gene, cell, round((v - mean) / sd, 4) AS z FROM v JOIN s USING (gene) QUALIFY row_number() OVER (PARTITION BY gene ORDER BY round(v, 8) DESC, cell) <= 3""",
    matrix=True,
)
def normalized_top(spark, sf_dir):
    z = qc.standardized(order_matrix(spark, sf_dir))
    order = qc.Window.partitionBy("gene").orderBy(F.round("v", 8).desc(), "cell")
    return z.withColumn("k", F.row_number().over(order)).filter("k <= 3").select("gene", "cell", r6(F.col("z"), 4).alias("z"))


@query(
    "log_cpm", "F21",
    "WITH t AS (SELECT cell, sum(x) AS total FROM entries GROUP BY cell) SELECT gene, round(sum(ln(x / (total / 10e6) + 1)), 4) AS v FROM entries JOIN t USING (cell) GROUP BY gene", matrix=True,
)
def log_cpm(spark, sf_dir):
    return qc.log_per_ten_million(order_matrix(spark, sf_dir).entries).groupBy("gene").agg(r6(F.sum("v"), 4).alias("v"))


RESIDUAL_SQL = """t AS (SELECT cell, sum(x) AS total FROM entries GROUP BY cell), g AS (SELECT gene, sum(x) AS gt FROM entries GROUP BY gene), s AS (SELECT sum(x) AS grand FROM entries)"""


@query(
    "pearson_residual_top", "F22",
    f"""WITH {RESIDUAL_SQL}, e AS (SELECT cell, gene, x, total * gt / grand AS e FROM entries JOIN t USING (cell) JOIN g USING (gene), s),
    r AS (SELECT cell, gene, (x - e) / sqrt(e + e * e / 100) AS r FROM e)
    SELECT cell, gene, round(r, 5) AS r FROM r QUALIFY row_number() OVER (PARTITION BY gene ORDER BY round(r, 8) DESC, cell) <= 2""",
    matrix=True,
)
def pearson_residual_top(spark, sf_dir):
    r = qc.residuals(order_matrix(spark, sf_dir))
    order = qc.Window.partitionBy("gene").orderBy(F.round("r", 8).desc(), "cell")
    return r.withColumn("k", F.row_number().over(order)).filter("k <= 2").select("cell", "gene", r6(F.col("r"), 5).alias("r"))


@query(
    "deviance_top", "E06 W01",
    f"""WITH {RESIDUAL_SQL}, grid AS (SELECT g.gene, c.cell, coalesce(total, 0) * gt / grand AS e FROM g, cells c LEFT JOIN t USING (cell), s),
    r AS (SELECT grid.gene, CASE WHEN e = 0 THEN 0 ELSE (coalesce(x, 0) - e) / sqrt(e + e * e / 100) END AS r FROM grid LEFT JOIN entries ON grid.cell = entries.cell AND grid.gene = entries.gene),
    d AS (SELECT gene, var_pop(r) AS d FROM r GROUP BY gene)
    SELECT gene, round(d, 4) AS deviance FROM d ORDER BY round(d, 8) DESC, gene LIMIT 50""",
    matrix=True,
)
def deviance_top(spark, sf_dir):
    d = qc.deviance(order_matrix(spark, sf_dir)).withColumn("by", F.round("deviance", 8))
    return qc.top(d, "by", 50).select("gene", r6(F.col("deviance"), 4).alias("deviance"))


@query(
    "gene_cv", "E05",
    """WITH n AS (SELECT count(*) AS n FROM cells), s AS (SELECT gene, sum(x) / n AS mean, sqrt(sum(x * x) / n - (sum(x) / n) * (sum(x) / n)) AS sd FROM entries, n GROUP BY gene, n)
    SELECT gene, round(log2(mean), 5) AS log_mean, round(log2(sd / mean), 5) AS log_cv FROM s""",
    matrix=True,
)
def gene_cv(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    s = qc.gene_moments(m.entries, "x", m.n_cells())
    return s.select("gene", r6(F.log2("mean"), 5).alias("log_mean"), r6(F.log2(F.col("sd") / F.col("mean")), 5).alias("log_cv"))


@query("gene_mask", "F11", "SELECT gene, category IN ('Brand#1', 'Brand#12') OR chromosome = 'PROMO' AS masked FROM genes", matrix=True)
def gene_mask(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    lists = spark.createDataFrame([("category", "Brand#1"), ("category", "Brand#12"), ("chromosome", "PROMO")], "kind string, value string")
    # A gene is masked if it is in any of the categories.
    tagged = m.genes.select("gene", F.explode(F.create_map(F.lit("category"), "category", F.lit("chromosome"), "chromosome")).alias("kind", "value"))
    hit = tagged.join(F.broadcast(lists), ["kind", "value"]).select("gene").distinct().withColumn("hit", F.lit(True))
    return m.genes.select("gene").join(hit, "gene", "left").select("gene", F.col("hit").isNotNull().alias("masked"))


@query(
    "species_by_sentinel", "F12",
    """SELECT coalesce((SELECT species FROM (VALUES (1, 'red widget', 'Homo sapiens'), (2, 'hot gear', 'Mus musculus'), (3, 'no such', 'Danio rerio')) v(rank, name, species)
    WHERE name IN (SELECT name FROM genes) ORDER BY rank LIMIT 1), 'unknown') AS species""",
    matrix=True,
)
def species_by_sentinel(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    sentinels = spark.createDataFrame([(1, "red widget", "Homo sapiens"), (2, "hot gear", "Mus musculus"), (3, "no such", "Danio rerio")], "rank int, name string, species string")
    met = sentinels.join(m.genes.select("name").distinct(), "name", "left_semi")
    return met.agg(F.coalesce(F.min_by("species", "rank"), F.lit("unknown")).alias("species"))


@query("cap_select", "F14 F15", "SELECT cell, cluster FROM cells QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY " + qc.hash_sql("cell", 1) + ", cell) <= 20", matrix=True)
def cap_select(spark, sf_dir):
    return qc.cap_select(order_matrix(spark, sf_dir).cells, "cluster", "cell", 20).select("cell", "cluster")


@query("random_valid_genes", "F16", "SELECT gene FROM genes WHERE gene IN (SELECT gene FROM entries GROUP BY gene HAVING count(*) > 10) ORDER BY " + qc.hash_sql("gene", 5) + ", gene LIMIT 100", matrix=True)
def random_valid_genes(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    return qc.valid_genes(m, 10, 1e9).filter("valid").select("gene").orderBy(qc.hashed(F.col("gene"), 5), "gene").limit(100)


@query(
    "thinned_counts", "F17",
    f"""WITH t AS (SELECT cell, sum(x) AS total FROM entries GROUP BY cell), lo AS (SELECT floor(min(total)) AS least FROM t),
    u AS (SELECT cell, gene, least / total * {qc.HASH_RANGE} AS most, unnest(range(1, x::BIGINT + 1)) AS u FROM entries JOIN t USING (cell), lo)
    SELECT cell, gene, count(*)::DOUBLE AS x FROM u WHERE {qc.hash_sql(qc.unit_key_sql('cell', 'gene', 'u'), 13)} < most GROUP BY ALL""", matrix=True,
)
def thinned_counts(spark, sf_dir):
    return qc.thinned(order_matrix(spark, sf_dir).entries).select("cell", "gene", "x")


@query("div0", "F19", "SELECT gene, CASE WHEN sum(unspliced) = 0 THEN 0 ELSE round(sum(ad) / sum(unspliced), 6) END AS ratio FROM entries GROUP BY gene", matrix=True)
def div0_query(spark, sf_dir):
    s = order_matrix(spark, sf_dir).entries.groupBy("gene").agg(F.sum("ad").alias("a"), F.sum("unspliced").alias("b"))
    return s.select("gene", r6(div0(F.col("a"), F.col("b"))).alias("ratio"))


@query(
    "combine_samples", "IO02 J05 U02",
    """WITH a AS (SELECT * FROM cells WHERE sample < 5 AND acctbal > 0), b AS (SELECT * FROM cells WHERE sample >= 20 AND cluster <> 'MACHINERY'),
    u AS (SELECT cell FROM a UNION ALL SELECT cell FROM b)
    SELECT gene, sum(x) AS x, count(*)::BIGINT AS n FROM entries JOIN u USING (cell) JOIN genes USING (gene) WHERE size < 30 AND category <> 'Brand#1' GROUP BY gene""",
    matrix=True,
)
def combine_samples(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    a = type(m)(m.cells, m.genes.filter("size < 30"), m.entries)
    b = type(m)(m.cells, m.genes.filter("category <> 'Brand#1'"), m.entries)
    both = combine([(a, (F.col("sample") < 5) & (F.col("acctbal") > 0)), (b, (F.col("sample") >= 20) & (F.col("cluster") != "MACHINERY"))])
    return both.entries.groupBy("gene").agg(F.sum("x").alias("x"), F.count("*").alias("n"))


@query("gene_block_scan", "IO04 IO06", "SELECT gene, sum(x) AS x, sum(unspliced) AS unspliced FROM entries WHERE gene IN (SELECT gene FROM genes WHERE size = 7) GROUP BY gene", matrix=True)
def gene_block_scan(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    return gene_subset(m, m.genes.filter("size = 7")).groupBy("gene").agg(F.sum("x").alias("x"), F.sum("unspliced").alias("unspliced"))


@query(
    "permuted_order", "IO07",
    "SELECT cell, row_number() OVER (ORDER BY cluster, acctbal DESC, cell)::BIGINT - 1 AS ord FROM cells", matrix=True,
)
def permuted_order(spark, sf_dir):
    cells = order_matrix(spark, sf_dir).cells
    # Rank within a label, plus the sizes of the labels before it: no window over all rows.
    sizes = cells.groupBy("cluster").agg(F.count("*").alias("n"))
    before = sizes.select("cluster", (F.sum("n").over(qc.Window.orderBy("cluster")) - F.col("n")).alias("before"))
    own = F.row_number().over(qc.Window.partitionBy("cluster").orderBy(F.col("acctbal").desc(), "cell"))
    return cells.withColumn("own", own).join(F.broadcast(before), "cluster").select("cell", (F.col("before") + F.col("own") - 1).cast("long").alias("ord"))


@query(
    "nearest_centroid", "F24",
    """WITH r AS (SELECT cell, acctbal, CASE cluster WHEN 'MACHINERY' THEN 'industry' WHEN 'BUILDING' THEN 'industry' WHEN 'AUTOMOBILE' THEN 'road' ELSE 'home' END AS coarse FROM cells),
    m AS (SELECT coarse, avg(acctbal) AS mid FROM r GROUP BY coarse)
    SELECT coarse, cell, round(abs(acctbal - mid), 4) AS dist FROM r JOIN m USING (coarse) QUALIFY row_number() OVER (PARTITION BY coarse ORDER BY round(abs(acctbal - mid), 6), cell) = 1""",
    matrix=True,
)
def nearest_centroid(spark, sf_dir):
    cells = order_matrix(spark, sf_dir).cells
    fine = F.create_map(*[F.lit(x) for pair in (("MACHINERY", "industry"), ("BUILDING", "industry"), ("AUTOMOBILE", "road")) for x in pair])
    r = cells.withColumn("coarse", F.coalesce(fine[F.col("cluster")], F.lit("home")))
    d = r.join(r.groupBy("coarse").agg(F.avg("acctbal").alias("mid")), "coarse").withColumn("dist", F.abs(F.col("acctbal") - F.col("mid")))
    near = F.row_number().over(qc.Window.partitionBy("coarse").orderBy(F.round("dist", 6), "cell"))
    return d.withColumn("k", near).filter("k = 1").select("coarse", "cell", r6(F.col("dist"), 4).alias("dist"))


@query(
    "hvg_intersection", "F25 E17",
    """WITH h AS (SELECT region, gene, stddev_pop(x) AS sd FROM entries JOIN cells USING (cell) GROUP BY 1, 2),
    t AS (SELECT region, gene FROM h QUALIFY row_number() OVER (PARTITION BY region ORDER BY round(sd, 8) DESC, gene) <= 800)
    SELECT gene FROM ((SELECT gene FROM t WHERE region = 0 INTERSECT SELECT gene FROM t WHERE region = 1) UNION (SELECT gene FROM t WHERE region = 2 INTERSECT SELECT gene FROM t WHERE region = 3))""",
    matrix=True,
)
def hvg_intersection(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    spread = m.entries.join(m.cells.select("cell", "region"), "cell").groupBy("region", "gene").agg(F.stddev_pop("x").alias("sd"))
    k = F.row_number().over(qc.Window.partitionBy("region").orderBy(F.round("sd", 8).desc(), "gene"))
    chosen = spread.withColumn("k", k).filter("k <= 800")
    of = lambda r: chosen.filter(F.col("region") == r).select("gene")
    return of(0).intersect(of(1)).union(of(2).intersect(of(3))).distinct()


@query(
    "clean_table", "F23 T01",
    """SELECT o_orderkey, substr(o_orderpriority, 3) AS priority, upper(o_orderstatus) || '-' || year(o_orderdate) AS tag FROM orders
    WHERE o_totalprice > 1000 AND nullif(o_orderstatus, 'P') IS NOT NULL AND o_orderpriority NOT LIKE '4%'""",
)
def clean_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P"))).na.drop(subset=["status"])
    o = o.filter((F.col("o_totalprice") > 1000) & ~F.col("o_orderpriority").startswith("4"))
    return o.select("o_orderkey", F.expr("substring(o_orderpriority, 3)").alias("priority"), F.concat_ws("-", F.upper("status"), F.year("o_orderdate").cast("string")).alias("tag"))


