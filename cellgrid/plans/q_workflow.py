"""Queries on decks, settings and builds."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators.deck import Deck, Subset, topological
from cellgrid.plans import engines
from cellgrid.plans.config import DEFAULTS, flat, merged, with_subset
from cellgrid.plans.registry import query
from cellgrid.plans.workflow import Build
from cellgrid.sources.tables import fresh_path, order_matrix, table, write_matrix


def nation_deck(spark: SparkSession, sf_dir: str) -> Deck:
    """A deck of regions, divided into nations, and a view of two regions."""
    nations = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").orderBy("n_regionkey", "n_nationkey").collect()]  # 25 rows
    regions = sorted({r for r, _ in nations})
    files = {"Root.yaml": yaml.safe_dump({f"R{r}": {"include": [f"r{r}"], "execution": {"n_cpus": r + 1, "n_gpus": r % 2}} for r in regions}), "views/Both.yaml": "sources: [R0, R1]\ninclude: []\n"}
    files |= {f"R{r}.yaml": yaml.safe_dump({f"N{n}": {"include": [], "onlyif": f"sample == {n}"} for of, n in nations if of == r}, sort_keys=False) for r in regions}
    return Deck(files)


def pairs(spark: SparkSession, deck: Deck) -> DataFrame:
    rows = [(t, need) for t, needs in deck.tasks().items() for need in needs]
    return spark.createDataFrame(rows, "task string, needs string")


NEEDS = """nt AS (SELECT n_regionkey AS r, n_nationkey AS n, 'R' || n_regionkey AS region, 'R' || n_regionkey || '_N' || n_nationkey AS task FROM nation),
    nd AS (SELECT task, region AS needs FROM nt UNION ALL SELECT 'Both', unnest(['R0', 'R1']) UNION ALL SELECT 'Pool', task FROM nt),
    od AS (SELECT task, row_number() OVER (ORDER BY level, r, n) - 1 AS place FROM (SELECT DISTINCT region AS task, 0 AS level, r, 0 AS n FROM nt UNION ALL SELECT task, 1, r, n FROM nt UNION ALL SELECT 'Both', 2, 0, 0 UNION ALL SELECT 'Pool', 3, 0, 0))"""


@query("deck_tasks", "P02 P03 P04", f"WITH {NEEDS} SELECT task, needs FROM nd")
def deck_tasks(spark, sf_dir):
    return pairs(spark, nation_deck(spark, sf_dir))


@query("task_order", "S02", f"WITH {NEEDS} SELECT task, place::BIGINT AS place FROM od")
def task_order(spark, sf_dir):
    order = topological(nation_deck(spark, sf_dir).tasks())
    return spark.createDataFrame([(t, k) for k, t in enumerate(order)], "task string, place long")


@query("pending_tasks", "P05 P06", f"WITH {NEEDS} SELECT task, (row_number() OVER (ORDER BY place) - 1)::BIGINT AS place FROM od WHERE task NOT IN ('R0', 'R3', 'R0_N0')")
def pending_tasks(spark, sf_dir):
    """What is left to do when three tasks are complete; one other was begun."""
    out = fresh_path(spark, "build")
    for task in ("R0", "R3", "R0_N0"):
        spark.range(1).write.parquet(f"{out}/{task}/cells")
    spark.range(1).write.parquet(f"{out}/R1/work/knn")
    order = Build(spark, nation_deck(spark, sf_dir), "", out, DEFAULTS).plan()
    return spark.createDataFrame([(t, k) for k, t in enumerate(order)], "task string, place long")


@query(
    "job_files", "P07",
    f"""WITH {NEEDS}, ru AS (SELECT n_regionkey AS r FROM nation GROUP BY 1) SELECT od.task, CASE WHEN od.task LIKE 'R_' THEN substr(od.task, 2, 1)::INT + 1 ELSE 9 END::BIGINT AS cpus, CASE WHEN od.task IN ('R1', 'R3') THEN 1 ELSE 0 END::BIGINT AS gpus,
    (128 * 1024)::BIGINT AS memory, CASE od.task WHEN 'Pool' THEN 'pool' ELSE 'process ' || od.task END AS arguments, coalesce((SELECT string_agg(needs, ' ' ORDER BY needs) FROM nd WHERE nd.task = od.task AND needs <> 'R0'), '') AS parents FROM od WHERE od.task <> 'R0'""",
)
def job_files(spark, sf_dir):
    """The scheduler's files, read back: one task is complete already."""
    out = fresh_path(spark, "build")
    spark.range(1).write.parquet(f"{out}/R0/cells")
    build = Build(spark, nation_deck(spark, sf_dir), "", out, merged(DEFAULTS, {"execution": {"n_cpus": 9}}))
    files = engines.job_files(build, "cellgrid", f"{out}/condor")
    graph = [line.split() for line in files["_dag.condor"].splitlines()]
    parents = {w[-1]: sorted(w[1 : w.index("CHILD")]) for w in graph if w[0] == "PARENT"}
    rows = []
    for task in (w[1] for w in graph if w[0] == "JOB"):
        own = dict(line.split(" = ", 1) for line in files[f"{task}.condor"].splitlines() if " = " in line)
        rows.append((task, int(own["request_cpus"]), int(own.get("request_gpus", 0)), int(own["request_memory"]), own["arguments"].strip('"'), " ".join(parents.get(task, []))))
    return spark.createDataFrame(rows, "task string, cpus long, gpus long, memory long, arguments string, parents string")


@query(
    "layered_settings", "P01",
    "SELECT * FROM (VALUES ('params.k', (SELECT count(*)::VARCHAR FROM nation)), ('params.n_genes', '50'), ('params.n_factors', '50'), ('params.mask', '[cellcycle, sex, ieg, mt]'), ('steps', '[nn, clustering]'), ('execution.memory', (SELECT count(*)::VARCHAR FROM region))) v(name, value)",
)
def layered_settings(spark, sf_dir):
    """Defaults, a user's file, a build's file, and a subset's own settings."""
    user = yaml.safe_load(f"params: {{k: 3, n_genes: 50}}\nexecution: {{memory: {table(spark, sf_dir, 'region').count()}}}")
    build = yaml.safe_load(f"params: {{k: {table(spark, sf_dir, 'nation').count()}}}")
    own = Subset("A", steps=["nn", "clustering"], params={"n_genes": 50})
    found = with_subset(merged(merged(DEFAULTS, user), build), own)
    names = ("params.k", "params.n_genes", "params.n_factors", "params.mask", "steps", "execution.memory")
    return spark.createDataFrame([r for r in flat(found) if r[0] in names], "name string, value string")


@query("processors", "P13", "SELECT n_nationkey, bit_count(n_nationkey * 2654435 + 1)::BIGINT AS cpus FROM nation")
def processors(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey").collect()  # 25 rows
    mask = lambda n: f"Name:\tpython\nCpus_allowed:\t{n * 2654435 + 1:08x}\nCpus_allowed_list:\t0-7\n"
    return spark.createDataFrame([(r[0], engines.cpus_of_mask(mask(r[0]))) for r in rows], "n_nationkey int, cpus long")


@query(
    "build_deck", "P06 P08 P09 P11 P12",
    """WITH q AS (SELECT cells.cell, cluster, sample, coalesce(sum(x), 0) AS total, coalesce(sum(unspliced) / sum(x), 0) AS us FROM cells LEFT JOIN entries USING (cell) GROUP BY ALL), t AS (SELECT *, CASE WHEN cluster IN ('BUILDING', 'MACHINERY') THEN 'Trade' ELSE 'Home' END AS source, total >= 300 AND us > 0.1e0 AS good FROM q),
    g AS (SELECT source, sample FROM t GROUP BY ALL HAVING count(*) FILTER (good) > 0.4e0 * count(*)) SELECT source, cell, true AS clustered FROM t JOIN g USING (source, sample) WHERE good""",
    matrix=True,
)
def build_deck(spark, sf_dir):
    """A deck of two subsets built to the end; its cells passed the quality gates, and every one has a cluster or is an outlier."""
    samples, out = fresh_path(spark, "samples"), fresh_path(spark, "build")
    write_matrix(order_matrix(spark, sf_dir), samples)
    config = merged(DEFAULTS, {"params": {"min_umis": 300, "n_genes": 200, "n_factors": 10, "k": 10, "features": "variance", "max_doubletFinder_th": 1.0, "graph": "KNN"}})
    deck = Deck({"Root.yaml": "Trade: {include: [BUILDING, MACHINERY], steps: [nn, clustering, aggregate]}\nHome: {include: [], steps: [nn, aggregate]}\n"})
    build = Build(spark, deck, samples, out, config)
    build.run()
    pool = build.read("Pool").select("cell", "source")
    cells = [build.read(t).select(F.lit(t).alias("source"), "cell", "clusters", "outliers") for t in ("Trade", "Home")]
    both = cells[0].unionByName(cells[1]).join(pool.withColumnRenamed("source", "pooled"), "cell", "left")
    ok = ((F.col("clusters") >= 0) & (F.col("outliers") == 0) & (F.col("pooled") == F.col("source"))) | ((F.col("outliers") == 1) & F.col("pooled").isNull())
    return both.select("source", "cell", F.coalesce(ok, F.lit(False)).alias("clustered"))
