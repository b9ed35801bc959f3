"""Queries that write the tables in a text format and take them back through its reader."""

from __future__ import annotations

import sqlite3

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.model import r6
from cellgrid.plans.registry import query
from cellgrid.sources import formats
from cellgrid.sources.tables import fresh_path, open_matrix, order_matrix, table, write_matrix


def lines(rows: DataFrame, name: str) -> str:
    """The path of a text file of the rows' only column."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.text(path)
    return path


@query("matrix_bundle", "IO03 IO01 IO04", "SELECT cell, gene, x, unspliced FROM entries", matrix=True)
def matrix_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "bundle")
    write_matrix(order_matrix(spark, sf_dir), path)
    return open_matrix(spark, path).entries.select("cell", "gene", "x", "unspliced")


def sample_database(spark: SparkSession, sf_dir: str) -> str:
    """Regions and nations as the four tables of a sample database."""
    nations = [tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]  # 25 rows
    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE sample(id, name, sampleok); CREATE TABLE lane(id, laneno, flowcell_id); CREATE TABLE flowcell(id, name, runstatus); CREATE TABLE lanesample(sample_id, lane_id)")
    db.executemany("INSERT INTO sample VALUES (?, ?, ?)", [(i, n, "Y" if i % 4 else "N") for i, n, _ in nations])
    db.executemany("INSERT INTO lane VALUES (?, ?, ?)", [(100 + i, 1 + i % 8, r) for i, _, r in nations])
    db.executemany("INSERT INTO flowcell VALUES (?, ?, ?)", [(r, f"FC{r}", "COPYFAIL" if r == 2 else "READY") for r in sorted({r for *_, r in nations})])
    db.executemany("INSERT INTO lanesample VALUES (?, ?)", [(i, 100 + i) for i, *_ in nations])
    path = f"{fresh_path(spark, 'metadata')}.db"
    formats.put_bytes(spark, path, db.serialize())
    return path


@query(
    "sqlite_sample", "IO08",
    "SELECT unnest(['Id', 'Name', 'Sampleok']) AS key, unnest([n_nationkey::VARCHAR, n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'N' ELSE 'Y' END]) AS value FROM nation WHERE n_name = 'NATION_7'",
)
def sqlite_sample(spark, sf_dir):
    row = formats.sqlite_sample(spark, sample_database(spark, sf_dir), "NATION_7")
    return spark.createDataFrame([(k, str(v)) for k, v in row.items()], "key string, value string")


@query(
    "sqlite_lanes", "IO10 J10",
    "SELECT n_name AS name, 'FC' || n_regionkey AS flowcell, (1 + n_nationkey % 8)::BIGINT AS laneno FROM nation WHERE n_nationkey % 4 <> 0 AND n_regionkey <> 2",
)
def sqlite_lanes(spark, sf_dir):
    path = sample_database(spark, sf_dir)
    for name, schema in (("sample", "id long, name string, sampleok string"), ("lane", "id long, laneno long, flowcell_id long"), ("flowcell", "id long, name string, runstatus string"), ("lanesample", "sample_id long, lane_id long")):
        formats.sqlite_table(spark, path, name, schema).createOrReplaceTempView(f"db_{name}")
    return spark.sql(
        "SELECT s.name, f.name AS flowcell, l.laneno FROM db_sample s, db_lanesample x, db_lane l, db_flowcell f "
        "WHERE s.id = x.sample_id AND x.lane_id = l.id AND l.flowcell_id = f.id AND s.sampleok = 'Y' AND f.runstatus <> 'COPYFAIL'"
    )


@query("tab_metadata", "IO08", "SELECT c_name AS name, c_mktsegment AS tissue FROM customer WHERE c_name = 'Customer#000000042'")
def tab_metadata(spark, sf_dir):
    path = fresh_path(spark, "tab")
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Tissue")).write.csv(path, sep="\t", header=True)
    return formats.sample_metadata(spark, path, "Customer#000000042")


@query("typed_metadata", "IO09", 'SELECT c_name AS "SampleID", c_mktsegment AS "Tissue", CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS "Balance" FROM customer')
def typed_metadata(spark, sf_dir):
    path = fresh_path(spark, "typed")
    c = table(spark, sf_dir, "customer")
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    c.select(F.col("c_name").alias("SampleID:string"), F.col("c_mktsegment").alias("Tissue:string"), balance.alias("Balance:double")).write.csv(path, sep=";", header=True)
    return formats.typed_metadata(spark, path).select("SampleID", "Tissue", F.col("Balance").cast("double").alias("Balance"))


@query("fastq_names", "IO11", r"SELECT p_partkey FROM part WHERE regexp_full_match(replace(p_brand, '#', '') || '_S' || p_size || '_L00' || (p_partkey % 8 + 1) || '_R' || (p_partkey % 2 + 1) || '_001.fastq.gz', 'Brand1.*_L00[1-4]_R._001\.fastq\.gz')")
def fastq_names(spark, sf_dir):
    name = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("_S"), "p_size", F.lit("_L00"), F.col("p_partkey") % 8 + 1, F.lit("_R"), F.col("p_partkey") % 2 + 1, F.lit("_001.fastq.gz"))
    return formats.matching_files(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "Brand1*_L00[1-4]_R?_001.fastq.gz").select("p_partkey")


GENOTYPE = "CASE p_size % 3 WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' ELSE '1/1' END"


@query("vcf_sites", "IO12 J01", f"SELECT p_brand AS chrom, count(*)::BIGINT AS n, max(p_partkey) AS last FROM part WHERE {GENOTYPE} = '1/1' GROUP BY 1")
def vcf_sites(spark, sf_dir):
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("##source=cellgrid",), ("\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "donor")),)], "value string")
    body = table(spark, sf_dir, "part").select(F.concat_ws("\t", "p_brand", F.col("p_partkey").cast("string"), *[F.lit(x) for x in (".", "A", "G", ".", "PASS", ".", "GT")], F.expr(GENOTYPE)).alias("value"))
    path = fresh_path(spark, "sites")
    head.coalesce(1).unionByName(body).write.text(path, compression="gzip")
    sites = formats.vcf(spark, path).filter("donor = '1/1'")
    return sites.groupBy(F.col("CHROM").alias("chrom")).agg(F.count("*").alias("n"), F.max("POS").alias("last"))


@query("matrix_market_depth", "IO13 A24", "SELECT cell, count(*) FILTER (x > 0)::BIGINT AS depth, count(*) FILTER (x > 0 AND ad / x <= 0.1e0)::BIGINT AS n_ref FROM entries GROUP BY cell", matrix=True)
def matrix_market_depth(spark, sf_dir):
    """Allele and total depths as two MatrixMarket files; whole numbers of matrix places, written from 1."""
    from cellgrid.operators import aggregate

    m = order_matrix(spark, sf_dir)
    size = m.cells.count(), m.genes.count(), m.entries.count()
    found = {}
    for name, value in (("ad", "ad"), ("dp", "x")):
        head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), ("%",), (" ".join(map(str, size)),)], "value string").coalesce(1)
        path = lines(head.unionByName(m.entries.select(F.concat_ws(" ", (F.col("cell") + 1).cast("string"), (F.col("gene") + 1).cast("string"), F.col(value).cast("string")).alias("value"))), name)
        found[name] = formats.matrix_market(spark, path).select(F.col("i").alias("cell"), F.col("j").alias("gene"), F.col("v").alias(name))
    return aggregate.genotype(found["dp"].join(found["ad"], ["cell", "gene"], "left").fillna(0.0, ["ad"]), 0.1)


@query("gmt_counts", "IO14 A31", """SELECT category AS "set", count(DISTINCT gene)::BIGINT AS n, round(sum(x), 4) AS total FROM entries JOIN genes USING (gene) GROUP BY 1""", matrix=True)
def gmt_counts(spark, sf_dir):
    m = order_matrix(spark, sf_dir)
    ids = F.array_join(F.array_sort(F.collect_list(F.col("gene"))).cast("array<string>"), "\t")
    path = lines(m.genes.groupBy("category").agg(ids.alias("ids")).select(F.concat_ws("\t", "category", F.lit("a description"), "ids").alias("value")), "sets")
    e = m.entries.select(F.format_string("ENSMUSG%011d", "gene").alias("gene"), "x")
    return formats.gene_sets(spark, path).join(e, "gene").groupBy("set").agg(F.countDistinct("gene").alias("n"), r6(F.sum("x"), 4).alias("total"))


@query(
    "annotation_files", "IO15 N02",
    """SELECT 'T' || r_regionkey AS tag, unnest([1, -1]) AS sign, unnest([r_name, 'N' || r_regionkey]) AS gene, 'c' || r_regionkey % 2 AS category FROM region WHERE r_regionkey <> 3""",
)
def annotation_files(spark, sf_dir):
    folder = fresh_path(spark, "annotations")
    for key, name in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect():  # 5 rows
        gene = name.replace(" ", "~")
        body = yaml.safe_dump({"name": name, "abbreviation": f"T{key}", "definition": f"+{gene} -N{key}" if key != 3 else "no signs here", "categories": f"c{key % 2}"})
        text, end = (f"---\n{body}---\n# {name}\n", "md") if key % 2 else (body, "yaml")
        formats.put_bytes(spark, f"{folder}/{'deep/' if key > 1 else ''}{key}.{end}", text.encode())
    formats.put_bytes(spark, f"{folder}/README.md", b"no definition")
    rules, categories = formats.annotation_folder(spark, folder)
    return rules.join(categories, "tag").select("tag", "sign", F.replace("gene", F.lit("~"), F.lit(" ")).alias("gene"), "category")


@query(
    "replicate_sets", "IO16",
    "SELECT n_name AS sample, count(*) OVER (PARTITION BY n_regionkey)::BIGINT AS of, min(n_name) OVER (PARTITION BY n_regionkey) AS first FROM nation",
)
def replicate_sets(spark, sf_dir):
    from pyspark.sql import Window

    sets = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("value"))
    found = formats.replicate_sets(spark, lines(sets.select("value"), "replicates"))
    w = Window.partitionBy("replicate")
    return found.select("sample", F.count("*").over(w).alias("of"), F.min("sample").over(w).alias("first"))


@query(
    "published", "IO17 IO18",
    "SELECT form, c_custkey, round(c_acctbal * 2, 2) AS balance FROM customer, (VALUES ('csv'), ('json'), ('parquet')) f(form)",
)
def published(spark, sf_dir):
    """The second version of a table that is published twice in each format."""
    c, out = table(spark, sf_dir, "customer"), None
    for form in ("csv", "json", "parquet"):
        path = fresh_path(spark, f"published-{form}")
        formats.publish(c.select("c_custkey"), path, form)
        formats.publish(c.select("c_custkey", r6(F.col("c_acctbal") * 2, 2).alias("balance")), path, form)
        part = spark.read.schema("c_custkey long, balance double").option("header", True).format(form).load(path).select(F.lit(form).alias("form"), "c_custkey", "balance")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "species_mask", "F13 F11",
    "SELECT gene, coalesce(category IN ('Brand#1', 'Brand#2', 'Brand#3') AND size % 2 = 0, false) AS masked, CASE WHEN size = 7 THEN 'seven' WHEN size = 8 THEN 'eight' END AS marker FROM genes",
    matrix=True,
)
def species_mask(spark, sf_dir):
    """A species' categories and marker classes from a user's file; genes of the masked categories, and each gene's class."""
    m = order_matrix(spark, sf_dir)
    picked = lambda where: [r[0] for r in m.genes.filter(where).select("gene").collect()]
    spec = {
        "Homo sapiens": {
            "categories": {"cellcycle": picked("category = 'Brand#1' AND size % 2 = 0"), "sex": picked("category IN ('Brand#2', 'Brand#3') AND size % 2 = 0"), "TFs": picked("category = 'Brand#9'")},
            "markers": {"seven": picked("size = 7"), "eight": picked("size = 8")},
        },
        "Mus musculus": {"categories": {"sex": picked("size = 1")}},
    }
    path = f"{fresh_path(spark, 'species')}.yaml"
    formats.put_bytes(spark, path, yaml.safe_dump(spec).encode())
    listed = formats.species_genes(spark, path).filter("species = 'Homo sapiens'").withColumn("gene", F.col("gene").cast("long"))
    masked = listed.filter("kind = 'categories' AND name IN ('cellcycle', 'sex')").select("gene").distinct().withColumn("masked", F.lit(True))
    markers = listed.filter("kind = 'markers'").select("gene", F.col("name").alias("marker"))
    return m.genes.select("gene").join(masked, "gene", "left").join(markers, "gene", "left").select("gene", F.coalesce("masked", F.lit(False)).alias("masked"), "marker")
