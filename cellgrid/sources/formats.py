"""Readers of the text formats that feed a matrix."""

from __future__ import annotations

import logging
import sqlite3
import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file to any place that Spark can write to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def texts(spark: SparkSession, folder: str) -> dict[str, str]:
    """The whole text of every file below a folder of small files (configuration, definitions), by its path below the folder."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", "_metadata.file_path").collect()
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    return {r["file_path"].split(top, 1)[1]: r["value"] for r in rows}


def sqlite_database(spark: SparkSession, path: str) -> sqlite3.Connection:
    """A SQLite file of any store, opened in memory on the driver: databases of sample metadata are small."""
    data = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    db = sqlite3.connect(":memory:")
    db.deserialize(bytes(data))
    return db


def sqlite_sample(spark: SparkSession, path: str, sample: str) -> dict[str, object]:
    """The row of table ``sample`` whose name is ``sample``, its column names capitalized; empty if there is none."""
    cursor = sqlite_database(spark, path).execute("SELECT * FROM sample WHERE name = ?", (sample,))
    row = cursor.fetchone()
    return dict(zip([c[0].capitalize() for c in cursor.description], row, strict=True)) if row else {}


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a SQLite file; its columns are those of ``schema``."""
    from pyspark.sql.types import StructType

    columns = ", ".join(f'"{f.name}"' for f in StructType.fromDDL(schema).fields)
    rows = sqlite_database(spark, path).execute(f'SELECT {columns} FROM "{name}"').fetchall()
    return spark.createDataFrame(rows, schema)


def sample_metadata(spark: SparkSession, path: str, sample: str, sep: str = "\t") -> DataFrame:
    """The rows of a tab-separated table whose ``sampleid`` (else ``name``) is ``sample``; header names in lower case."""
    rows = spark.read.csv(path, sep=sep, header=True)
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    return rows.filter(F.col("sampleid" if "sampleid" in rows.columns else "name") == sample)


def typed_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A semicolon table with headers such as ``SampleID:string``; the types are cut off."""
    rows = spark.read.csv(path, sep=";", header=True)
    return rows.toDF(*[c.split(":")[0] for c in rows.columns])


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a VCF file, gzipped or not; ``#CHROM`` becomes CHROM, POS a number."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("##"))
    head = lines.filter(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError(f"{path} has no #CHROM line")
    names = head["value"].lstrip("#").split("\t")
    parts = lines.filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))
    out = parts.select(*[F.col("p")[k].alias(n) for k, n in enumerate(names)])
    return out.withColumn("POS", F.col("POS").cast("long"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a coordinate MatrixMarket file, from 0; the size line, the first that is no comment, is left out."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("at")
    rows = spark.read.text(path).select("value", at).filter(~F.col("value").startswith("%")).select(F.split(F.trim("value"), r"\s+").alias("p"), "at")
    first = rows.agg(F.min("at").alias("first"))
    body = rows.crossJoin(F.broadcast(first)).filter("at > first")
    return body.select((F.col("p")[0].cast("long") - 1).alias("i"), (F.col("p")[1].cast("long") - 1).alias("j"), F.col("p")[2].cast("double").alias("v"))


def gene_sets(spark: SparkSession, path: str, pattern: str = "ENSMUSG%011d") -> DataFrame:
    """(set, gene) rows of a GMT file; numeric ids take the given form."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return parts.select(F.col("p")[0].alias("set"), F.explode(F.expr("slice(p, 3, greatest(size(p) - 2, 0))")).alias("id")).select("set", F.format_string(pattern, F.col("id").cast("long")).alias("gene"))


def matching_files(names: DataFrame, pattern: str) -> DataFrame:
    """Names that match a shell pattern."""
    import fnmatch

    return names.filter(F.col("name").rlike(fnmatch.translate(pattern).replace("(?s:", "(?s)(?:")))


def annotation_folder(spark: SparkSession, folder: str, genes: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(tag, sign, gene) and (tag, category) of all definition files below a folder.

    A file is YAML, or Markdown with YAML between its first two ``---`` lines. README.md is passed
    over; files that cannot be read, and definitions with genes that ``genes`` lacks, are logged
    and left out.
    """
    from cellgrid.operators.annotate import parse_definitions

    definitions, categories = [], []
    for path, text in sorted(texts(spark, folder).items()):
        if not path.endswith((".yaml", ".yml", ".md")) or path.rsplit("/", 1)[-1] == "README.md":
            continue
        try:
            spec = yaml.safe_load(text.split("---")[1] if path.endswith(".md") else text)
            tag, definition = str(spec["abbreviation"]), str(spec["definition"])
            words = definition.split()
            if not words or any(w[0] not in "+-" for w in words):
                raise ValueError(f"{definition!r} has words without a sign")
            if genes is not None and (missing := {w[1:] for w in words} - genes):
                raise ValueError(f"no genes {sorted(missing)}")
        except Exception as error:  # one bad file must not hide the others
            logging.getLogger(__name__).warning("%s left out: %s", path, error)
            continue
        definitions.append((tag, definition))
        categories += [(tag, c) for c in str(spec.get("categories") or "").replace(",", " ").split()]
    return parse_definitions(spark, definitions) if definitions else spark.createDataFrame([], "tag string, sign int, gene string"), spark.createDataFrame(categories, "tag string, category string")


def species_genes(spark: SparkSession, path: str) -> DataFrame:
    """(species, kind, name, gene) rows of a user's YAML file ``{species: {categories: {name: [genes]}, markers: {name: [genes]}}}``.

    A species that the file lacks has no categories and no markers.
    """
    spec = yaml.safe_load(spark.read.text(path, wholetext=True).first()["value"]) or {}
    rows = [(species, kind, name, str(gene)) for species, kinds in spec.items() for kind in ("categories", "markers") for name, genes in (kinds.get(kind) or {}).items() for gene in genes]
    return spark.createDataFrame(rows, "species string, kind string, name string, gene string")


def replicate_sets(spark: SparkSession, path: str) -> DataFrame:
    """(replicate, sample) rows of a CSV file whose lines are lists of samples."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("replicate"), F.split("value", ",").alias("s"))
    return lines.select("replicate", F.explode("s").alias("sample")).select("replicate", F.trim("sample").alias("sample")).filter("sample <> ''")


def publish(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a table beside its place and move it there when it is whole, so readers see the old or the new one."""
    spark = df.sparkSession
    beside = f"{path}.tmp-{uuid.uuid4().hex}"
    writer = df.write.option("header", True) if form == "csv" else df.write
    writer.format(form).save(beside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(hadoop(path), True)
    if not files.rename(hadoop(beside), hadoop(path)):
        raise OSError(f"{beside} could not be moved to {path}")
