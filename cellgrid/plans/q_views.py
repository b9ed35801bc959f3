"""Queries for the tables behind drawings, for functions chosen by name, and for dates and maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cellgrid.model import r6
from cellgrid.operators import aggregate as ag
from cellgrid.operators import cluster, views
from cellgrid.operators import graph as g
from cellgrid.plans.q_aggregates import ENRICH
from cellgrid.plans.q_graphs import EDGES, KNN, PROF, SHARE, ZIP, folder, knn, profile_pairs, vectors
from cellgrid.plans.q_statistics import PERMUTED
from cellgrid.plans.registry import query
from cellgrid.sources.tables import order_matrix, table

PLANE = "pt AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"


def plane(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", "label", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


@query(
    "marker_size", "V01",
    f"""WITH {PLANE}, c AS (SELECT least(floor(count(*) / 3), 50) AS k, greatest(max(x), max(y)) - least(min(x), min(y)) AS span FROM pt),
    d AS (SELECT a.id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pt a JOIN pt b ON a.id <> b.id), r AS (SELECT id, d FROM d, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = any_value(k) OVER ())
    SELECT round(2500 / span * (SELECT quantile_cont(d, 0.6) FROM r), 4) AS size FROM c""",
)
def marker_size(spark, sf_dir):
    return spark.createDataFrame([(round(views.marker_size(plane(spark, sf_dir)), 4),)], "size double")


@query(
    "overview", "V03",
    """WITH t AS (SELECT cell, sum(x) AS total, count(*) AS n FROM entries GROUP BY cell), c AS (SELECT cells.*, coalesce(total, 0) AS total FROM cells LEFT JOIN t USING (cell)), l AS (SELECT median(total) AS level FROM t),
    mk AS (SELECT cluster, gene, sum(x) AS s FROM entries JOIN cells USING (cell) WHERE gene IN (5, 9, 11) GROUP BY ALL), ct AS (SELECT cluster, sum(total) AS total, count(*) AS n FROM c GROUP BY cluster)
    SELECT cluster, 'mean_total' AS what, round(avg(total), 4) AS value FROM c GROUP BY cluster
    UNION ALL SELECT cluster, 'flagged', round(avg((acctbal < 0)::INT), 6) FROM c GROUP BY cluster
    UNION ALL SELECT cluster, 'region ' || region, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY cluster), 6) FROM c GROUP BY cluster, region
    UNION ALL SELECT ct.cluster, 'gene ' || g.gene, round(log10(coalesce(s, 0) / ct.n / (ct.total / ct.n) * (SELECT median(total / n) FROM ct) + 0.001e0), 6) FROM ct CROSS JOIN (VALUES (5), (9), (11)) g(gene) LEFT JOIN mk ON mk.cluster = ct.cluster AND mk.gene = g.gene""",
    matrix=True,
)
def overview(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    return views.overview(m, "cluster", "region", {"flagged": F.col("acctbal") < 0}, [5, 9, 11]).select("cluster", "what", r6(F.col("value")).alias("value")).withColumn(
        "value", F.when(F.col("what") == "mean_total", F.round("value", 4)).otherwise(F.col("value"))
    )


@query(
    "dendrogram_segments", "V05",
    """WITH RECURSIVE t AS (SELECT 0 AS step, 0e0 AS lx, 0e0 AS ly, 1e0 AS rx, 1e0 AS h UNION ALL SELECT step + 1, lx + (rx - lx) / 2, h, step + 2e0, h + step + 2 FROM t WHERE step < (SELECT count(*) FROM nation) - 2)
    SELECT step::BIGINT AS step, lx, ly, rx, 0e0 AS ry, h FROM t""",
)
def dendrogram_segments(spark, sf_dir):
    """Nations joined one after another: a tree that SQL can follow."""
    n = table(spark, sf_dir, "nation").count()
    heights = np.cumsum(np.arange(1, n))
    tree = np.array([(n + k - 1 if k else 0, k + 1, heights[k], k + 2) for k in range(n - 1)], float)
    rows = [(k, *map(float, s)) for k, s in enumerate(views.segments(tree))]
    return spark.createDataFrame(rows, "step long, lx double, ly double, rx double, ry double, h double")


@query(
    "metro_map", "V08 W05",
    f"""WITH RECURSIVE {KNN}, {EDGES}, {PLANE}, n AS (SELECT least(c1, c2) AS a, greatest(c1, c2) AS b, count(*) AS n FROM el GROUP BY ALL),
    o AS (SELECT n.a, n.b FROM n LEFT JOIN n x ON x.a = n.a AND x.b = n.a LEFT JOIN n y ON y.a = n.b AND y.b = n.b WHERE n.a < n.b AND n.n::DOUBLE / (coalesce(x.n, 0) + coalesce(y.n, 0) + n.n) > 0.12e0),
    ed AS (SELECT a, b FROM o UNION SELECT b, a FROM o), rc AS (SELECT DISTINCT label AS id, label AS reach FROM pt UNION SELECT rc.id, ed.b FROM rc JOIN ed ON ed.a = rc.reach),
    c AS (SELECT id, min(reach) AS comp FROM rc GROUP BY id), z AS (SELECT *, count(*) OVER (PARTITION BY comp) AS n FROM c), k AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS new FROM (SELECT DISTINCT comp FROM z WHERE n > 1)),
    md AS (SELECT label, median(x) AS x, median(y) AS y FROM pt GROUP BY label)
    SELECT id::BIGINT AS cluster, coalesce(new, -1)::BIGINT AS line, round(x, 6) AS x, round(y, 6) AS y FROM z LEFT JOIN k USING (comp) JOIN md ON md.label = id""",
)
def metro_map(spark, sf_dir):
    p = plane(spark, sf_dir)
    return views.metro_map(g.skeleton(knn(spark, sf_dir), p, 12.0), p, folder(spark)).select("cluster", "line", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(
    "covariates", "V08",
    "WITH x AS (SELECT cell, sum(x) AS x FROM entries WHERE gene = 7 GROUP BY cell) SELECT cell, dense_rank() OVER (ORDER BY cluster)::BIGINT - 1 AS tissue, dense_rank() OVER (ORDER BY sample)::BIGINT - 1 AS sample, coalesce(x, 0e0) AS sex FROM cells LEFT JOIN x USING (cell)",
    matrix=True,
)
def covariates(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    return views.covariates(m, {"tissue": "cluster", "sample": "sample"}, {"sex": 7})


@query(
    "volcano", "E13 A12",
    """WITH s AS (SELECT gene, sum(x) FILTER (cluster = 'BUILDING') AS a, sum(x) FILTER (cluster = 'MACHINERY') AS b FROM entries JOIN cells USING (cell) GROUP BY gene), t AS (SELECT gene, log2((coalesce(a, 0) + 1) / (coalesce(b, 0) + 1)) AS change FROM s),
    p AS (SELECT gene, change, CASE WHEN abs(change) > 3 THEN 0 ELSE exp(-abs(change)) END AS padj FROM t), l AS (SELECT min(padj) AS least FROM p WHERE padj > 0)
    SELECT gene, round(change, 6) AS change, round(-log10(CASE WHEN padj = 0 THEN least ELSE padj END), 6) AS height, CASE WHEN abs(change) < 1 OR padj >= 0.2e0 THEN 'none' WHEN change > 0 THEN 'up' ELSE 'down' END AS side FROM p, l""",
    matrix=True,
)
def volcano(spark, sf_dir):
    """The drawing's rule on pseudobulk sums of two labels; the chances are stand-ins, as those of the test come from elsewhere."""
    m = order_matrix(spark, sf_dir)
    side = lambda c: F.coalesce(F.sum(F.when(F.col("cluster") == c, F.col("x"))), F.lit(0.0)) + 1
    s = m.entries.join(m.cells.select("cell", "cluster"), "cell").groupBy("gene").agg(F.log2(side("BUILDING") / side("MACHINERY")).alias("change"))
    tested = s.withColumn("padj", F.when(F.abs("change") > 3, 0.0).otherwise(F.exp(-F.abs("change"))))
    return views.volcano(tested, 1.0, 0.2).select("gene", r6(F.col("change")).alias("change"), r6(F.col("height")).alias("height"), "side")


@query(
    "metric_names", "2.12 M02 M04",
    f"""WITH {PROF}, {SHARE} SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(sqrt(list_sum(list_transform({ZIP}, lambda t: (t[1] - t[2]) ** 2))), 6) AS euclidean,
    round(sqrt(list_sum(list_transform({ZIP}, lambda t: (t[1] * log2(t[1] / ((t[1] + t[2]) / 2)) + t[2] * log2(t[2] / ((t[1] + t[2]) / 2))) / 2))), 6) AS js,
    round(list_max(list_transform({ZIP}, lambda t: abs(t[1] - t[2]))), 6) AS own FROM sh a JOIN sh b ON a.label < b.label""",
)
def metric_names(spark, sf_dir):
    widest = lambda p, q: F.array_max(F.zip_with(p, q, lambda x, y: F.abs(x - y)))
    return profile_pairs(spark, sf_dir).select("a", "b", *[r6(g.distance(m, "p", "q")).alias(n) for n, m in (("euclidean", "euclidean"), ("js", "js"), ("own", widest))])


@query(
    "aggregator_names", "2.12 A02 A05",
    "SELECT cluster, round(median(acctbal), 4) AS acctbal, arg_min(sample, cell)::BIGINT AS sample, (max(cell) - min(cell))::BIGINT AS cell FROM cells GROUP BY cluster",
    matrix=True,
)
def aggregator_names(spark, sf_dir):
    c = order_matrix(spark, sf_dir).cells.withColumn("ord", F.col("cell"))
    found = ag.aggregated(c, "cluster", {"acctbal": "median", "sample": "first", "cell": lambda v: F.max(v) - F.min(v)}, "ord")
    return found.select("cluster", r6(F.col("acctbal"), 4).alias("acctbal"), F.col("sample").cast("long").alias("sample"), "cell")


@query(
    "dates_and_maps", "T04",
    """SELECT event_id, date_trunc('week', ts) AS week, ts + INTERVAL 36 HOUR AS later, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS days, date_part('dow', ts)::BIGINT AS weekday, strftime(ts, '%Y-%m') AS month,
    (props->>'k')::BIGINT AS k, event_type || '=' || value AS pair, (extract(epoch FROM ts + INTERVAL 1 MONTH) - extract(epoch FROM ts))::BIGINT // 86400 AS month_days FROM events""",
)
def dates_and_maps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>")).withColumn("own", F.create_map("event_type", F.col("value").cast("string")))
    return e.select(
        "event_id", F.date_trunc("week", "ts").alias("week"), (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("later"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("days"),
        (F.dayofweek("ts") - 1).cast("long").alias("weekday"), F.date_format("ts", "yyyy-MM").alias("month"), F.element_at("m", "k").cast("long").alias("k"),
        F.concat_ws("=", F.map_keys("own")[0], F.map_values("own")[0]).alias("pair"),
        F.floor((F.unix_timestamp(F.expr("ts + INTERVAL 1 MONTH")) - F.unix_timestamp("ts")) / 86400).cast("long").alias("month_days"),
    )


def greedy_sql(n: int) -> str:
    """Each cluster in turn takes its ``n`` best genes that none before it took; five clusters."""
    names = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    out = []
    for k, name in enumerate(names):
        taken = " UNION ALL ".join(f"SELECT gene FROM gm{j}" for j in range(k))
        free = f"AND gene NOT IN ({taken})" if k else ""
        out.append(f"gm{k} AS (SELECT cluster, gene, row_number() OVER (ORDER BY round(e, 9) DESC, gene) AS rank FROM en WHERE cluster = '{name}' {free} QUALIFY rank <= {n})")
    return ", ".join(out) + ", gm AS (" + " UNION ALL ".join(f"SELECT * FROM gm{k}" for k in range(len(names))) + ")"


@query("greedy_markers", "E02 C14", f"WITH {ENRICH}, {greedy_sql(10)} SELECT cluster, gene, rank::INT AS rank FROM gm", matrix=True)
def greedy_markers(spark, sf_dir):
    from cellgrid.operators.annotate import greedy_unique

    e = ag.enrichment(order_matrix(spark, sf_dir), "cluster")
    return greedy_unique(e, "cluster", "gene", "enrichment", 10)


@query(
    "aggregate_gene_order", "C14",
    f"""WITH {ENRICH}, {greedy_sql(10)}, tb AS (SELECT gene, min(cluster) AS top FROM en JOIN (SELECT gene, max(round(e, 9)) AS m FROM en GROUP BY gene) x USING (gene) WHERE round(e, 9) = m GROUP BY gene)
    SELECT gene, gene IN (SELECT gene FROM gm) AS marker, (row_number() OVER (ORDER BY gene NOT IN (SELECT gene FROM gm), top, gene) - 1)::BIGINT AS ord FROM tb""",
    matrix=True,
)
def aggregate_gene_order(spark, sf_dir):
    from cellgrid.operators.annotate import gene_order, greedy_unique

    e = ag.enrichment(order_matrix(spark, sf_dir), "cluster")
    return gene_order(e, greedy_unique(e, "cluster", "gene", "enrichment", 10)).select("gene", "marker", "ord")


@query(
    "unpolished_tail", "C06 J13",
    f"""WITH {KNN.split('knn AS')[0].rstrip().rstrip(',')}, sz AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), mid AS (SELECT median(n) AS m FROM sz),
    keep AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS new FROM sz, mid WHERE n >= m), lb AS (SELECT vec_id AS id, coalesce(new, -1) AS label FROM embeddings LEFT JOIN keep USING (label)),
    nn AS (SELECT src, q.label FROM pr JOIN lb p ON p.id = src AND p.label < 0 JOIN lb q ON q.id = dst AND q.label >= 0 QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) = 1)
    SELECT id, coalesce(nn.label, lb.label)::BIGINT AS label FROM lb LEFT JOIN nn ON src = id""",
)
def unpolished_tail(spark, sf_dir):
    v = vectors(spark, sf_dir)
    least = int(np.ceil(v.groupBy("label").count().agg(F.median("count")).first()[0]))
    return cluster.reassigned(v.select("id", "label"), v.select("id", "v"), least)


@query(
    "split_decision", "C10 G12",
    f"""WITH {KNN}, br AS (SELECT id, (label >= 5)::INT AS part FROM lb), u AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS t FROM knn),
    c AS (SELECT avg((a.part = b.part)::INT) AS coverage FROM u JOIN br a ON a.id = s JOIN br b ON b.id = t), z AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM br GROUP BY part))
    SELECT threshold, round(coverage, 6) AS coverage, least::BIGINT AS least, least >= 25 AND coverage >= threshold AS separable FROM c, z, (VALUES (0.2e0), (0.98e0)) t(threshold)""",
)
def split_decision(spark, sf_dir):
    parts = vectors(spark, sf_dir).select("id", (F.col("label") >= 5).cast("long").alias("label"))
    out = [(t, *cluster.separable(knn(spark, sf_dir), parts, t)) for t in (0.2, 0.98)]
    return spark.createDataFrame([(t, round(c, 6), n, ok) for t, ok, c, n in out], "threshold double, coverage double, least long, separable boolean")


@query(
    "merge_round", "C11",
    f"""WITH {ENRICH}, {PERMUTED}, s AS (SELECT cluster, count(*) FILTER (round(q, 9) < 0.7e0 AND e > 1.2e0) AS score FROM qv GROUP BY cluster), c AS (SELECT cluster, median(acctbal) AS x, median(region) AS y FROM cells GROUP BY cluster),
    w AS (SELECT cluster AS weak, score, x, y FROM s JOIN c USING (cluster) ORDER BY score, cluster LIMIT 1)
    SELECT weak, (SELECT cluster FROM c WHERE cluster <> weak ORDER BY (c.x - w.x) ** 2 + (c.y - w.y) ** 2, cluster LIMIT 1) AS "into", score::BIGINT AS score FROM w""",
    matrix=True,
)
def merge_round(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    centres = m.cells.select("cluster", F.col("acctbal").alias("x"), F.col("region").cast("double").alias("y"))
    weak, near, score = cluster.next_merge(m, "cluster", centres, threshold=1000, most_q=0.7, least_enrichment=1.2)
    return spark.createDataFrame([(weak, near, score)], "weak string, into string, score long")
