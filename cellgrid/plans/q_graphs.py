"""Queries on neighbour graphs and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.model import r6
from cellgrid.operators import graph as g
from cellgrid.operators import stats
from cellgrid.plans.registry import query
from cellgrid.sources.tables import order_matrix, table, work_folder

K = 8
KNN = f"""pr AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))) AS d
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    knn AS (SELECT src, dst, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS rank FROM pr) WHERE rank <= {K}),
    mk AS (SELECT x.src, x.dst, least(x.d, y.d) AS d FROM knn x JOIN knn y ON x.src = y.dst AND x.dst = y.src),
    mx AS (SELECT max(d) AS md FROM knn), lb AS (SELECT vec_id AS id, label FROM embeddings)"""


folder = work_folder


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", "v")
    return g.exact_knn(v, v, K)


@query("knn_exact", "J11 C05", f"WITH {KNN} SELECT src, dst, round(d, 5) AS d, rank::BIGINT AS rank FROM knn")
def knn_exact(spark, sf_dir):
    return knn(spark, sf_dir).select("src", "dst", r6(F.col("d"), 5).alias("d"), F.col("rank").cast("long").alias("rank"))


@query("mutual_graph", "G03", f"WITH {KNN} SELECT src, dst, round(d, 5) AS d FROM mk")
def mutual_graph(spark, sf_dir):
    return g.mutual(knn(spark, sf_dir)).select("src", "dst", r6(F.col("d"), 5).alias("d"))


@query(
    "similarity_rnn", "G05",
    f"WITH {KNN}, rd AS (SELECT quantile_cont(1 - (md - d) / md, 0.9) AS radius FROM knn, mx) SELECT src, dst, round((md - d) / md, 5) AS sim FROM mk, mx, rd WHERE (md - d) / md > 1 - radius",
)
def similarity_rnn(spark, sf_dir):
    return g.radius_graph(knn(spark, sf_dir)).select("src", "dst", r6(F.col("sim"), 5).alias("sim"))


EDGES = """el AS (SELECT src, dst, d, a.label AS c1, b.label AS c2 FROM knn JOIN lb a ON a.id = src JOIN lb b ON b.id = dst)"""


@query(
    "skeleton", "G07",
    f"""WITH {KNN}, {EDGES}, n AS (SELECT least(c1, c2) AS a, greatest(c1, c2) AS b, count(*) AS n FROM el GROUP BY ALL), sz AS (SELECT label, count(*) AS s FROM lb GROUP BY 1),
    o AS (SELECT n.a, n.b, n.n::DOUBLE / (coalesce(x.n, 0) + coalesce(y.n, 0) + n.n) AS obs, sa.s::DOUBLE / (sa.s + sb.s) AS f FROM n LEFT JOIN n x ON x.a = n.a AND x.b = n.a LEFT JOIN n y ON y.a = n.b AND y.b = n.b
      JOIN sz sa ON sa.label = n.a JOIN sz sb ON sb.label = n.b WHERE n.a < n.b)
    SELECT a::BIGINT AS a, b::BIGINT AS b, round(obs / (2 * f - 2 * f * f), 6) AS w FROM o WHERE obs * 100 > 2""",
)
def skeleton(spark, sf_dir):
    return g.skeleton(knn(spark, sf_dir), vectors(spark, sf_dir).select("id", "label")).select("a", "b", r6(F.col("w")).alias("w"))


@query(
    "symmetric_skeleton", "G08",
    f"""WITH {KNN}, {EDGES}, n AS (SELECT least(c1, c2) AS a, greatest(c1, c2) AS b, count(*) AS n FROM el GROUP BY ALL), sz AS (SELECT label, count(*) AS s FROM lb GROUP BY 1),
    o AS (SELECT n.a, n.b, n.n::DOUBLE / (coalesce(x.n, 0) + coalesce(y.n, 0) + n.n) AS obs, sa.s::DOUBLE / (sa.s + sb.s) AS f FROM n LEFT JOIN n x ON x.a = n.a AND x.b = n.a LEFT JOIN n y ON y.a = n.b AND y.b = n.b
      JOIN sz sa ON sa.label = n.a JOIN sz sb ON sb.label = n.b WHERE n.a < n.b),
    w AS (SELECT a, b, obs / (2 * f - 2 * f * f) AS w FROM o WHERE obs * 100 > 5)
    SELECT p.label::BIGINT AS a, q.label::BIGINT AS b, round(coalesce((SELECT w FROM w WHERE w.a = least(p.label, q.label) AND w.b = greatest(p.label, q.label)), 0), 6) AS w FROM sz p CROSS JOIN sz q""",
)
def symmetric_skeleton(spark, sf_dir):
    return g.symmetric_skeleton(knn(spark, sf_dir), vectors(spark, sf_dir).select("id", "label"), 5.0).select("a", "b", r6(F.col("w")).alias("w"))


@query("approximate_knn", "J12", "SELECT count(*)::BIGINT AS points, 10::BIGINT AS k, true AS complete, true AS good FROM embeddings")
def approximate_knn(spark, sf_dir):
    """The search through cells, held against the exact one: every point gets k neighbours, and at least nine of ten are right."""
    v = vectors(spark, sf_dir).select("id", "v")
    found = g.approximate_knn(v, v, 10, cells=max(1, v.count() // 64))
    exact = g.exact_knn(v, v, 10)
    hit = found.select("src", "dst").join(exact.select("src", "dst"), ["src", "dst"]).agg(F.count("*").alias("hits"))
    per = found.groupBy("src").agg(F.count("*").alias("k")).agg(F.count("*").alias("points"), F.max("k").alias("k"), (F.min("k") == F.max("k")).alias("complete"))
    return per.crossJoin(hit).select("points", "k", "complete", (F.col("hits") >= 0.9 * F.col("points") * F.col("k")).alias("good"))


@query("coverage", "G12", f"WITH {KNN}, u AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS t FROM knn) SELECT round(avg((a.label = b.label)::INT), 6) AS coverage FROM u JOIN lb a ON a.id = s JOIN lb b ON b.id = t")
def coverage(spark, sf_dir):
    return g.coverage(knn(spark, sf_dir), vectors(spark, sf_dir).select("id", "label")).select(r6(F.col("coverage")).alias("coverage"))


@query("induced_graph", "G13", f"WITH {KNN}, {EDGES} SELECT least(c1, c2)::BIGINT AS a, greatest(c1, c2)::BIGINT AS b, round(sum(d), 4) AS w FROM el GROUP BY ALL")
def induced_graph(spark, sf_dir):
    return g.induced(knn(spark, sf_dir), vectors(spark, sf_dir).select("id", "label"), "d").select("a", "b", r6(F.col("w"), 4).alias("w"))


@query("neighborhood_stats", "G09", f"WITH {KNN} SELECT src, round(min(d), 5) AS nearest, round(max(d), 5) AS farthest, round((count(*) FILTER (d > 1.2e0))::DOUBLE / count(*), 6) AS outside FROM knn GROUP BY src")
def neighborhood_stats(spark, sf_dir):
    return g.neighborhood(knn(spark, sf_dir), 1.2).select("src", r6(F.col("nearest"), 5).alias("nearest"), r6(F.col("farthest"), 5).alias("farthest"), r6(F.col("outside")).alias("outside"))


@query("majority_vote", "A11 C02", f"WITH {KNN}, n AS (SELECT src, label, count(*) AS n FROM knn JOIN lb ON id = dst GROUP BY ALL) SELECT src, label::BIGINT AS label, n::BIGINT AS n FROM n QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, label) = 1")
def majority_vote(spark, sf_dir):
    return g.vote(knn(spark, sf_dir), vectors(spark, sf_dir).select("id", "label"))


@query(
    "nearest_labelled", "J13",
    f"WITH {KNN.split('knn AS')[0].rstrip().rstrip(',')}, nn AS (SELECT src, dst FROM pr JOIN embeddings e ON e.vec_id = dst AND e.label >= 3 JOIN embeddings q ON q.vec_id = src AND q.label < 3 QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) = 1) SELECT src, label::BIGINT AS label FROM nn JOIN embeddings ON vec_id = dst",
)
def nearest_labelled(spark, sf_dir):
    v = vectors(spark, sf_dir)
    near = g.exact_knn(v.filter("label >= 3").select("id", "v"), v.filter("label < 3").select("id", "v"), 1)
    return near.join(v.select(F.col("id").alias("dst"), "label"), "dst").select("src", "label")


ENTRIES_E = "ee AS (SELECT vec_id AS cell, i AS gene, greatest(embedding[i]::DOUBLE, 0e0) AS x FROM embeddings, range(1, 65) t(i) WHERE embedding[i] > 0)"


def vector_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = vectors(spark, sf_dir).select(F.col("id").alias("cell"), F.posexplode("v").alias("p", "x"))
    return long.filter("x > 0").select("cell", (F.col("p") + 1).cast("long").alias("gene"), "x")


@query("pool_counts", "G02", f"WITH {KNN}, {ENTRIES_E}, nb AS (SELECT src, dst FROM knn UNION SELECT vec_id, vec_id FROM embeddings) SELECT src AS cell, gene, round(sum(x), 5) AS x FROM nb JOIN ee ON cell = dst GROUP BY ALL")
def pool_counts(spark, sf_dir):
    out = g.pool_counts(knn(spark, sf_dir), vector_entries(spark, sf_dir), vectors(spark, sf_dir).select(F.col("id").alias("cell")))
    return out.select("cell", "gene", r6(F.col("x"), 5).alias("x"))


@query("smooth", "G02 G04", f"WITH {KNN}, {ENTRIES_E}, nb AS (SELECT src, dst FROM knn UNION SELECT vec_id, vec_id FROM embeddings) SELECT src AS cell, gene, round(sum(x / {K + 1}), 5) AS x FROM nb JOIN ee ON cell = dst GROUP BY ALL")
def smooth(spark, sf_dir):
    out = g.smooth(knn(spark, sf_dir), vector_entries(spark, sf_dir), vectors(spark, sf_dir).select(F.col("id").alias("cell")))
    return out.select("cell", "gene", r6(F.col("x"), 5).alias("x"))


@query(
    "neighborhood_enrichment", "E08",
    f"""WITH {KNN}, {ENTRIES_E}, n AS (SELECT count(*) AS n FROM embeddings), t AS (SELECT gene, sum(x) AS ts, count(*) AS tz FROM ee GROUP BY gene), s AS (SELECT src AS cell, gene, sum(x) AS s, count(*) AS z FROM knn JOIN ee ON cell = dst GROUP BY ALL)
    SELECT cell, gene, round((z / {K}e0 + 0.1e0) / ((tz - z)::DOUBLE / (n - {K}) + 0.1e0) * ((s / {K}e0 + 0.1e0) / ((ts - s) / (n - {K}) + 0.1e0)), 4) AS e FROM s JOIN t USING (gene), n""",
)
def neighborhood_enrichment(spark, sf_dir):
    n = vectors(spark, sf_dir).agg(F.count("*").alias("n_cells"))
    e = stats.neighborhood_enrichment(knn(spark, sf_dir), vector_entries(spark, sf_dir), n, float(K))
    return e.select("cell", "gene", r6(F.col("enrichment"), 4).alias("e"))


@query(
    "laplacian", "E15",
    f"""WITH {KNN}, {ENTRIES_E}, dg AS (SELECT src AS cell, count(*)::DOUBLE AS d FROM mk GROUP BY 1), sd AS (SELECT sum(d) AS sd FROM dg), ow AS (SELECT gene, sum(d * x) AS t, sum(d * x * x) AS q FROM ee JOIN dg USING (cell) GROUP BY gene),
    cr AS (SELECT a.gene, sum(a.x * b.x) AS c FROM mk JOIN ee a ON a.cell = src JOIN ee b ON b.cell = dst AND a.gene = b.gene GROUP BY a.gene)
    SELECT ow.gene, round(1 - (coalesce(c, 0) - t * t / sd) / (CASE WHEN q - t * t / sd < 1e-12 THEN 1e4 ELSE q - t * t / sd END), 5) AS score FROM ow LEFT JOIN cr USING (gene), sd""",
)
def laplacian(spark, sf_dir):
    edges = g.mutual(knn(spark, sf_dir)).withColumn("w", F.lit(1.0))
    return stats.laplacian_score(edges, vector_entries(spark, sf_dir)).select("gene", r6(F.col("score"), 5).alias("score"))


@query(
    "components", "G10 G11",
    f"""WITH RECURSIVE {KNN}, ed AS (SELECT src, dst FROM mk WHERE d < 1.0e0), rc AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT rc.id, ed.dst FROM rc JOIN ed ON ed.src = rc.reach),
    c AS (SELECT id, min(reach) AS comp FROM rc GROUP BY id), z AS (SELECT *, count(*) OVER (PARTITION BY comp) AS n FROM c), k AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS new FROM (SELECT DISTINCT comp FROM z WHERE n > 1))
    SELECT id, coalesce(new, -1)::BIGINT AS comp FROM z LEFT JOIN k USING (comp)""",
)
def components(spark, sf_dir):
    found = g.components(g.mutual(knn(spark, sf_dir)).filter("d < 1.0"), vectors(spark, sf_dir), folder(spark))
    return g.renumbered(found)


PROF = "pf AS (SELECT label, list(s ORDER BY i) AS v FROM (SELECT label, i, sum(abs(embedding[i]::DOUBLE)) AS s FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label)"
SHARE = "sh AS (SELECT label, list_transform(v, lambda x: x / list_sum(v)) AS p FROM pf)"


def profile_pairs(spark: SparkSession, sf_dir: str, counts: bool = False) -> DataFrame:
    """Pairs of labels a < b with their summed absolute vectors, as shares or as rounded counts."""
    long = vectors(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.abs("x")).alias("s"))
    value = F.floor(F.col("s") * 3).cast("double") if counts else F.col("s")
    p = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("s")))), lambda x: x["s"]).alias("v"))
    if not counts:
        p = p.withColumn("v", g.shares("v"))
    return p.select(F.col("label").alias("a"), F.col("v").alias("p")).join(p.select(F.col("label").alias("b"), F.col("v").alias("q"))).filter("a < b")


ZIP = "list_zip(a.p, b.p)"


@query(
    "js_distance", "M01 M02",
    f"""WITH {PROF}, {SHARE} SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(list_sum(list_transform({ZIP}, lambda t: t[1] * log2(t[1] / t[2]))), 6) AS kl,
    round(sqrt(list_sum(list_transform({ZIP}, lambda t: (t[1] * log2(t[1] / ((t[1] + t[2]) / 2)) + t[2] * log2(t[2] / ((t[1] + t[2]) / 2))) / 2))), 6) AS js FROM sh a JOIN sh b ON a.label < b.label""",
)
def js_distance(spark, sf_dir):
    return profile_pairs(spark, sf_dir).select("a", "b", r6(g.kullback_leibler("p", "q")).alias("kl"), r6(F.sqrt(g.jensen_shannon("p", "q"))).alias("js"))


@query(
    "minkowski", "M04",
    f"""WITH {PROF}, {SHARE}, sb AS (SELECT label, list_transform(p, lambda x: (sqrt(x * 5000) + 0.8e0 * sqrt(x * 5000 + 1)) / 1.8e0) AS y, p FROM sh)
    SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(list_sum(list_transform(list_zip(a.y, b.y), lambda t: abs(t[1] - t[2]) ** 10)) ** 0.1e0, 5) AS stable, round(list_sum(list_transform({ZIP}, lambda t: (t[1] - t[2]) ** 2)) ** 0.5e0, 6) AS euclid FROM sb a JOIN sb b ON a.label < b.label""",
)
def minkowski(spark, sf_dir):
    p = profile_pairs(spark, sf_dir).withColumn("y", g.stabilized("p")).withColumn("z", g.stabilized("q"))
    return p.select("a", "b", r6(g.minkowski("y", "z", 10.0), 5).alias("stable"), r6(g.minkowski("p", "q", 2.0)).alias("euclid"))


@query(
    "multinomial", "M05",
    f"""WITH {PROF}, ct AS (SELECT label, list_transform(v, lambda x: floor(x * 3)) AS p, list_sum(list_transform(v, lambda x: floor(x * 3))) AS s FROM pf)
    SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(1 / (1 + exp(-(lgamma(64) + lgamma(a.s + b.s + 64) - lgamma(a.s + 64) - lgamma(b.s + 64) + list_sum(list_transform({ZIP}, lambda t: lgamma(t[1] + 1) + lgamma(t[2] + 1) - lgamma(t[1] + t[2] + 1)))))), 6) AS d
    FROM ct a JOIN ct b ON a.label < b.label""",
)
def multinomial(spark, sf_dir):
    return profile_pairs(spark, sf_dir, counts=True).select("a", "b", r6(g.multinomial("p", "q")).alias("d"))


@query(
    "mad_outlier", "C04",
    """WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT label, median(x) AS mx, median(y) AS my FROM p GROUP BY label),
    d AS (SELECT vec_id, p.label, sqrt((x - mx) ** 2 + (y - my) ** 2) AS d FROM p JOIN m USING (label)), a AS (SELECT label, median(d) AS mad FROM d GROUP BY label)
    SELECT vec_id, CASE WHEN mad = 0 THEN false ELSE 0.6745e0 * d / mad > 1.5e0 END AS outlier FROM d JOIN a USING (label)""",
)
def mad_outlier(spark, sf_dir):
    p = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), "label", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return g.mad_outliers(p, "label", ["x", "y"], 1.5).select("vec_id", "outlier")


@query("factor_norm", "D09", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE) / list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE))))), 6) AS total, round(list_sum(list_transform(range(1, 65), lambda i: i * abs(embedding[i]::DOUBLE))) / list_sum(list_transform(embedding, lambda y: abs(y::DOUBLE))), 5) AS middle FROM embeddings")
def factor_norm(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("a", F.transform("v", F.abs)).withColumn("a", g.shares("a"))
    return v.select(F.col("id").alias("vec_id"), r6(F.aggregate("a", F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(F.aggregate(F.zip_with("a", F.sequence(F.lit(1), F.lit(64)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x), 5).alias("middle"))


@query(
    "poisson_proximity", "M06",
    f"""WITH {PROF}, ct AS (SELECT label, list_transform(v, lambda x: floor(x * 3)) AS p, list_sum(list_transform(v, lambda x: floor(x * 3))) AS s FROM pf),
    z AS (SELECT a.label AS a, b.label AS b, a.s AS sx, b.s AS sy, b.s / a.s AS c, list_sum(list_transform({ZIP}, lambda t: lgamma(2 + t[1] + t[2]) - lgamma(2 + t[1]) - lgamma(2 + t[2]))) AS g FROM ct a JOIN ct b ON a.label < b.label)
    SELECT a::BIGINT AS a, b::BIGINT AS b, round(64 * lgamma(2) + 64 * 2 * ln((0.5e0 * c + 1) * 1.5e0 / (1.5e0 + 0.5e0 * c)) + sx * (ln(c) + ln(0.5e0 / (1.5e0 + 0.5e0 * c)) - ln(0.5e0 * c / (0.5e0 * c + 1))) + sy * (ln(0.5e0 / (1.5e0 + 0.5e0 * c)) - ln(0.5e0 / 1.5e0)) + g, 4) AS f FROM z""",
)
def poisson_proximity(spark, sf_dir):
    return profile_pairs(spark, sf_dir, counts=True).select("a", "b", r6(g.poisson_proximity("p", "q", 2.0, 0.5), 4).alias("f"))


def digamma_sql(x: str) -> str:
    """The asymptotic series, eight steps further up."""
    y = f"({x} + 8)"
    return f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - list_sum(list_transform(range(0, 8), lambda k: 1 / ({x} + k))))"


@query(
    "gamma_divergence", "M03",
    f"""WITH c AS (SELECT gene, avg(x) AS m, var_pop(x) AS v FROM entries GROUP BY gene), p AS (SELECT gene, m * m / v AS s, m / v AS r FROM c WHERE v > 0)
    SELECT gene, round(((s - 2) * {digamma_sql('s')} - lgamma(s) + lgamma(2) + 2 * (ln(r) - ln(0.1e0)) + s * (0.1e0 - r) / r) / ln(2), 5) AS kl FROM p""", matrix=True,
)
def gamma_divergence(spark, sf_dir):
    c = order_matrix(spark, sf_dir).entries.groupBy("gene").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v")).filter("v > 0")
    return c.select("gene", r6(g.gamma_divergence(F.col("m") * F.col("m") / F.col("v"), F.col("m") / F.col("v"), F.lit(2.0), F.lit(0.1)), 5).alias("kl"))


@query(
    "correlation_knn", "G14",
    """WITH u AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)), r AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1 - corr(a.x, b.x) AS d FROM u a JOIN u b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL)
    SELECT src, dst, round(d, 5) AS d FROM r QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(sqrt(2 * d), 9), dst) <= 4""",
)
def correlation_knn(spark, sf_dir):
    return g.correlation_knn(vectors(spark, sf_dir).select("id", "v"), 4).select("src", "dst", r6(F.col("d"), 5).alias("d"))
