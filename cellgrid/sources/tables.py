"""Matrix bundles on Parquet."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.model import CellMatrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a temporary one only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cellgrid-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later actions don't compute it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_matrix(spark: SparkSession, sf_dir: str) -> CellMatrix:
    """Customers by parts: the quantity of each part that each customer ordered, in all and by flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    q = F.col("l_quantity")
    entries = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias("cell"), F.col("l_partkey").alias("gene"))
        .agg(F.sum(q).alias("x"), F.sum(F.when(F.col("l_returnflag") == "R", q).otherwise(0.0)).alias("unspliced"), F.sum(F.when(F.col("l_linestatus") == "F", q).otherwise(0.0)).alias("ad"))
    )
    nation = table(spark, sf_dir, "nation")
    cells = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("cluster"), F.col("c_nationkey").alias("sample"), F.col("n_regionkey").alias("region"), F.col("c_acctbal").alias("acctbal")
    )
    genes = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("gene"), F.col("p_brand").alias("category"), F.col("p_type").alias("chromosome"), F.col("p_name").alias("name"), F.col("p_size").alias("size")
    )
    return CellMatrix(cells, genes, entries)


def write_matrix(m: CellMatrix, path: str) -> None:
    """Store a bundle: entries clustered by gene, so gene statistics and gene subsets read few files' ranges."""
    m.cells.write.mode("overwrite").parquet(f"{path}/cells")
    m.genes.write.mode("overwrite").parquet(f"{path}/genes")
    m.entries.repartitionByRange("gene").sortWithinPartitions("gene", "cell").write.mode("overwrite").parquet(f"{path}/entries")


def open_matrix(spark: SparkSession, path: str) -> CellMatrix:
    return CellMatrix(*(spark.read.parquet(f"{path}/{part}") for part in ("cells", "genes", "entries")))


def bundle_of_files(spark: SparkSession, matrix: str, cells: str, genes: str) -> CellMatrix:
    """A matrix of a MatrixMarket file (genes by cells, from 1) and tab-separated attributes, a header line first, in the order of its rows and columns."""
    from cellgrid.sources.formats import matrix_market

    def attributes(path: str, key: str) -> DataFrame:
        rows = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
        return rows if key in rows.columns else rows.select(F.monotonically_increasing_id().alias(key), "*")

    entries = matrix_market(spark, matrix).select(F.col("j").alias("cell"), F.col("i").alias("gene"), F.col("v").alias("x")).filter("x <> 0")
    return CellMatrix(attributes(cells, "cell"), attributes(genes, "gene"), entries)


def gene_subset(m: CellMatrix, genes: DataFrame) -> DataFrame:
    """Entries of the given genes only."""
    return m.entries.join(genes.select("gene"), "gene", "left_semi")


def common_columns(frames: list[DataFrame]) -> list[str]:
    """Columns that all frames have with one type, in the order of the first."""
    kinds = [dict(f.dtypes) for f in frames]
    return [c for c in frames[0].columns if all(k.get(c) == kinds[0][c] for k in kinds)]


def combine(parts: list[tuple[CellMatrix, Column]], key: str = "gene") -> CellMatrix:
    """One matrix of the selected cells of many; genes are those that all have, cells keep the attributes that all have.

    Each part's selection is a filter on its cells, applied below the union.
    """
    chosen = [(m.cells.filter(keep), m) for m, keep in parts]
    names = common_columns([c for c, _ in chosen])
    cells = reduce(DataFrame.unionByName, [c.select(*names) for c, _ in chosen])
    genes = reduce(lambda a, b: a.join(b, key, "left_semi"), [m.genes for _, m in chosen])
    values = common_columns([m.entries for _, m in chosen])
    entries = reduce(DataFrame.unionByName, [m.entries.join(c.select("cell"), "cell", "left_semi").select(*values) for c, m in chosen])
    return CellMatrix(cells, genes, entries.join(genes.select(key), key, "left_semi"))
