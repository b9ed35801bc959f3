"""Queries that join, select by decks, rank and combine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellgrid.model import r6
from cellgrid.operators import deck
from cellgrid.plans.registry import query
from cellgrid.sources.tables import order_matrix, table

FOUR = """SELECT r_name, n_name, c_custkey, c_mktsegment FROM region, nation, customer WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_acctbal > 0 AND r_name <> 'ASIA'"""


@query("sample_lane_join", "IO10 J10", f"SELECT r_name, n_name, count(*)::BIGINT AS n, min(c_custkey) AS first_key, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM ({FOUR}) GROUP BY 1, 2")
def sample_lane_join(spark, sf_dir):
    for t in ("region", "nation", "customer"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    rows = spark.sql(FOUR)
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("two_key_join", "J01", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus WHERE l_returnflag = 'R'")
def two_key_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"))
    return lines.join(orders, ["l_orderkey", "l_linestatus"]).select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("o_orderstatus"))


@query("lookup_left", "J02 J06", "SELECT p_partkey, coalesce(m.name, 'N/A') AS name FROM part LEFT JOIN (VALUES ('Brand#1', 'one'), ('Brand#2', 'two')) m(brand, name) ON brand = p_brand")
def lookup_left(spark, sf_dir):
    names = spark.createDataFrame([("Brand#1", "one"), ("Brand#2", "two")], "p_brand string, name string")
    return table(spark, sf_dir, "part").join(F.broadcast(names), "p_brand", "left").select("p_partkey", F.coalesce("name", F.lit("N/A")).alias("name"))


@query("lookup_inner", "J03", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_inner(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey").select("c_custkey", "n_name")


@query("semi", "J04", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("anti", "J04", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti(spark, sf_dir):
    some = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(some, "c_custkey", "left_anti").select("c_custkey")


@query(
    "gene_align_zero_fill", "J07",
    """WITH a AS (SELECT gene, row_number() OVER (ORDER BY size, gene) - 1 AS ord FROM genes WHERE category = 'Brand#7'), b AS (SELECT gene, sum(x) AS x FROM entries JOIN cells USING (cell) WHERE sample = 3 GROUP BY gene)
    SELECT ord::BIGINT AS ord, gene, coalesce(x, 0e0) AS x FROM a LEFT JOIN b USING (gene)""",
    matrix=True,
)
def gene_align_zero_fill(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    a = m.genes.filter("category = 'Brand#7'").select("gene", (F.row_number().over(Window.orderBy("size", "gene")) - 1).cast("long").alias("ord"))
    b = m.entries.join(m.cells.filter("sample = 3").select("cell"), "cell", "left_semi").groupBy("gene").agg(F.sum("x").alias("x"))
    return a.join(b, "gene", "left").fillna(0.0, ["x"]).select("ord", "gene", "x")


@query("barcode_lookup", "J08 T01", "SELECT c_custkey, split_part(c_name, '#', 2)::BIGINT AS code FROM customer")
def barcode_lookup(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.split("c_name", "#")[1].cast("long").alias("code"))


@query("pairs_theta", "J09", "WITH c AS (SELECT cluster, avg(acctbal) AS m FROM cells GROUP BY 1) SELECT a.cluster AS a, b.cluster AS b, round(abs(a.m - b.m), 4) AS gap FROM c a JOIN c b ON a.cluster < b.cluster", matrix=True)
def pairs_theta(spark, sf_dir):
    c = order_matrix(spark, sf_dir).cells.groupBy("cluster").agg(F.avg("acctbal").alias("m"))
    a, b = c.select(F.col("cluster").alias("a"), F.col("m").alias("ma")), c.select(F.col("cluster").alias("b"), F.col("m").alias("mb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", r6(F.abs(F.col("ma") - F.col("mb")), 4).alias("gap"))


@query("dense_relabel", "A10 W05", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment)::BIGINT - 1 AS label FROM customer")
def dense_relabel(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # Ranks over the distinct labels only, joined back.
    ids = c.select("c_mktsegment").distinct().withColumn("label", (F.row_number().over(Window.orderBy("c_mktsegment")) - 1).cast("long"))
    return c.join(F.broadcast(ids), "c_mktsegment").select("c_custkey", "label")


SUBSETS = [deck.Subset("Heavy", ["build", "mach"], "acctbal > 3000 and region != 2"), deck.Subset("Wheels", ["auto"]), deck.Subset("Low", ["home"], "acctbal < 0 or sample in [3, 4]"), deck.Subset("Rest", [])]
DECK_SQL = """tg AS (SELECT *, CASE cluster WHEN 'BUILDING' THEN 'build heavy' WHEN 'MACHINERY' THEN 'mach heavy' WHEN 'AUTOMOBILE' THEN 'auto' ELSE 'home' END AS tags FROM cells),
    sb AS (SELECT cell, CASE WHEN (tags LIKE 'build%' OR tags LIKE 'mach%') AND acctbal > 3000 AND region <> 2 THEN 'Heavy' WHEN tags = 'auto' THEN 'Wheels' WHEN tags = 'home' AND (acctbal < 0 OR sample IN (3, 4)) THEN 'Low' ELSE 'Rest' END AS subset, tags FROM tg)"""


def tagged(m):
    tags = F.when(F.col("cluster") == "BUILDING", "build heavy").when(F.col("cluster") == "MACHINERY", "mach heavy").when(F.col("cluster") == "AUTOMOBILE", "auto").otherwise("home")
    return m.cells.withColumn("tags", tags)


@query("first_match_subset", "F10 F09 P09", f"WITH {DECK_SQL} SELECT cell, subset FROM sb", matrix=True)
def first_match_subset(spark, sf_dir):
    return deck.first_match(tagged(order_matrix(spark, sf_dir)), SUBSETS).select("cell", "subset")


@query("category_include", "F09", f"WITH {DECK_SQL} SELECT subset, count(*)::BIGINT AS n FROM (SELECT CASE WHEN cluster IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'Trade' END AS subset FROM cells) GROUP BY 1", matrix=True)
def category_include(spark, sf_dir):
    found = deck.first_match(tagged(order_matrix(spark, sf_dir)), [deck.Subset("Trade", ["trade"])], categories={"trade": ["heavy", "auto"]})
    return found.groupBy("subset").agg(F.count("*").alias("n"))


@query("onlyif_filter", "F08", "SELECT cell FROM cells WHERE (acctbal / 2 > 1000 AND NOT sample IN (1, 2)) OR (region = 3 AND cluster <> 'BUILDING')", matrix=True)
def onlyif_filter(spark, sf_dir):
    cells = order_matrix(spark, sf_dir).cells
    return cells.filter(deck.expression("(acctbal / 2 > 1000 and not sample in [1, 2]) or (ds.ca.region == 3 & (cluster != 'BUILDING'))".replace("ds.ca.region == 3 &", "(ds.ca.region == 3) &"), cells.columns)).select("cell")


POOL_SQL = """p AS (SELECT cell, region, dense_rank() OVER (PARTITION BY region ORDER BY cluster) - 1 AS k FROM cells), t AS (SELECT region, max(k) + 1 AS t FROM p GROUP BY region),
    o AS (SELECT region, coalesce(sum(t) OVER (ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM t)"""


@query("pool_offset_union", "U02 P09", f"WITH {POOL_SQL} SELECT cell, 'R' || p.region AS source, k::BIGINT AS source_clusters, (k + o)::BIGINT AS clusters FROM p JOIN o USING (region)", matrix=True)
def pool_offset_union(spark, sf_dir):
    c = order_matrix(spark, sf_dir).cells
    ids = c.select("region", "cluster").distinct().withColumn("clusters", (F.row_number().over(Window.partitionBy("region").orderBy("cluster")) - 1).cast("long"))
    named = c.join(F.broadcast(ids), ["region", "cluster"])
    parts = [(f"R{k}", named.filter(F.col("region") == k).select("cell", "clusters")) for k in range(5)]
    return deck.pooled(parts).select("cell", "source", "source_clusters", "clusters")


@query("set_operations", "U01", "SELECT gene FROM ((SELECT gene FROM genes WHERE size < 20 INTERSECT SELECT gene FROM genes WHERE category LIKE 'Brand#1%') EXCEPT SELECT gene FROM genes WHERE chromosome = 'LARGE')", matrix=True)
def set_operations(spark, sf_dir):
    g = order_matrix(spark, sf_dir).genes
    of = lambda e: g.filter(e).select("gene")
    return of("size < 20").intersect(of("category LIKE 'Brand#1%'")).subtract(of("chromosome = 'LARGE'"))


@query("midpoints", "W03 W02", "WITH n AS (SELECT category, count(*) AS n FROM genes GROUP BY 1), b AS (SELECT category, sum(n) OVER (ORDER BY category) AS border FROM n) SELECT category, border::BIGINT AS border, round((border + coalesce(lag(border) OVER (ORDER BY category), 0)) / 2e0, 2) AS middle FROM b", matrix=True)
def midpoints(spark, sf_dir):
    w = Window.orderBy("category")
    b = order_matrix(spark, sf_dir).genes.groupBy("category").agg(F.count("*").alias("n")).withColumn("border", F.sum("n").over(w))
    return b.select("category", "border", r6((F.col("border") + F.coalesce(F.lag("border").over(w), F.lit(0))) / 2.0, 2).alias("middle"))


@query("winner_takes_all", "W04", "WITH s AS (SELECT gene, cluster, sum(x) AS s FROM entries JOIN cells USING (cell) GROUP BY ALL) SELECT gene, cluster, least(s, 40e0) AS s FROM s QUALIFY row_number() OVER (PARTITION BY gene ORDER BY s DESC, cluster) = 1", matrix=True)
def winner_takes_all(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    s = m.entries.join(m.cells.select("cell", "cluster"), "cell").groupBy("gene", "cluster").agg(F.sum("x").alias("s"))
    best = s.groupBy("gene").agg(F.min(F.struct((-F.col("s")).alias("k"), "cluster")).alias("b"))
    return best.select("gene", F.col("b.cluster").alias("cluster"), F.least(-F.col("b.k"), F.lit(40.0)).alias("s"))


@query("first_appearance", "W06 C12", "WITH a AS (SELECT cluster, min((cell * 48271 + 9) % 2147483647) AS f FROM cells GROUP BY 1) SELECT cluster, row_number() OVER (ORDER BY f)::BIGINT - 1 AS label FROM a", matrix=True)
def first_appearance(spark, sf_dir):
    a = order_matrix(spark, sf_dir).cells.groupBy("cluster").agg(F.min(F.pmod(F.col("cell") * 48271 + 9, F.lit(2147483647))).alias("f"))
    return a.select("cluster", (F.row_number().over(Window.orderBy("f")) - 1).cast("long").alias("label"))


@query("stable_sort", "S01", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey DESC)::BIGINT AS place FROM orders")
def stable_sort(spark, sf_dir):
    w = Window.partitionBy("o_orderstatus").orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey").desc())
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("string_functions", "T01", r"SELECT p_partkey, trim(regexp_replace(p_name, '[^a-m ]+', '', 'g')) AS a, replace(upper(p_brand), '#', '-') AS b, substr(p_name, 2, 3) AS c, p_name LIKE 'red%' AS d, printf('%05d', p_size) AS e FROM part")
def string_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", F.trim(F.regexp_replace("p_name", "[^a-m ]+", "")).alias("a"), F.replace(F.upper("p_brand"), F.lit("#"), F.lit("-")).alias("b"),
        F.substring("p_name", 2, 3).alias("c"), F.startswith("p_name", F.lit("red")).alias("d"), F.format_string("%05d", "p_size").alias("e"),
    )


@query("vector_functions", "T03", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS dot, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings")
def vector_functions(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    dot = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return v.select("vec_id", r6(dot).alias("dot"), r6(F.sqrt(dot)).alias("norm"), r6(F.array_max("v")).alias("top"))


@query("cpu_sizing", "C15", "WITH a AS (SELECT * FROM (VALUES (100, 1), (1000, 3), (10000, 7), (100000, 14), (500000, 28), (1000000, 28), (2000000, 56)) v(n, cpus)), s AS (SELECT c_nationkey, count(*) * 37 AS n FROM customer GROUP BY 1) SELECT c_nationkey::BIGINT AS sample, arg_min(cpus, abs(a.n - s.n) * 100 + cpus)::BIGINT AS cpus FROM s, a GROUP BY 1")
def cpu_sizing(spark, sf_dir):
    anchors = spark.createDataFrame([(100, 1), (1000, 3), (10000, 7), (100000, 14), (500000, 28), (1000000, 28), (2000000, 56)], "anchor long, cpus long")
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("sample")).agg((F.count("*") * 37).alias("n"))
    return s.crossJoin(F.broadcast(anchors)).groupBy("sample").agg(F.min_by("cpus", F.abs(F.col("anchor") - F.col("n")) * 100 + F.col("cpus")).alias("cpus"))


@query("split_names", "IO19", "SELECT i::BIGINT AS i, repeat(chr((65 + i % 26)::INT), (1 + i // 26)::INT) AS name FROM range(60) t(i)")
def split_names(spark, sf_dir):
    return spark.range(60).select(F.col("id").alias("i"), F.expr("repeat(char(65 + id % 26), cast(1 + id div 26 AS int))").alias("name"))


@query("relabel_outliers", "C13 C12", "WITH l AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1 ELSE c_nationkey * 3 END AS label FROM customer) SELECT c_custkey, (label = -1)::INT AS outlier, CASE WHEN label = -1 THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN label = -1 THEN 1000000 ELSE label END) - 1 END::BIGINT AS label FROM l")
def relabel_outliers(spark, sf_dir):
    l = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, -1).otherwise(F.col("c_nationkey") * 3).alias("raw"))  # noqa: E741
    ids = l.filter("raw >= 0").select("raw").distinct().withColumn("label", (F.row_number().over(Window.orderBy("raw")) - 1).cast("long"))
    return l.join(F.broadcast(ids), "raw", "left").select("c_custkey", (F.col("raw") == -1).cast("int").alias("outlier"), F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


@query("json_lookup", "T04", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE event_type = 'error'")
def json_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
