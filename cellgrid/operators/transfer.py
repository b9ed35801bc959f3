"""Label transfer: a classifier trained on labelled cells, and counts normalized by the training cells' figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell is uncertain if no class has this chance.
SURE = 0.6


def total(c: str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def normalizer(train: DataFrame) -> DataFrame:
    """One row: the median total of the training cells, and 0.9 times the greatest ln(x + 1) of each feature at that size."""
    level = train.agg(F.median(total("x")).alias("level"))
    sized = train.crossJoin(F.broadcast(level)).select("level", F.posexplode(scaled("x")).alias("k", "v"))
    tops = sized.groupBy("k").agg(F.max("v").alias("top"), F.first("level").alias("level"))
    packed = tops.agg(F.array_sort(F.collect_list(F.struct("k", (F.col("top") * 0.9).alias("top")))).alias("tops"), F.first("level").alias("level"))
    return packed.select("level", F.transform("tops", lambda t: t["top"]).alias("tops"))


def scaled(x: str) -> Column:
    """ln(x + 1) of counts brought to the level's size."""
    size = total(x)
    return F.transform(x, lambda v: F.log1p(F.when(size > 0, v / size * F.col("level")).otherwise(0.0)))


def features(cells: DataFrame, figures: DataFrame) -> DataFrame:
    """Adds ``v``: scaled counts over the training cells' tops."""
    met = cells.crossJoin(F.broadcast(figures)).withColumn("_s", scaled("x"))
    return met.withColumn("v", F.zip_with("_s", "tops", lambda a, t: F.when(t > 0, a / t).otherwise(0.0))).drop("_s", "tops", "level")


def transferred(train: DataFrame, cells: DataFrame, trees: int = 60, depth: int = 10, seed: int = 1) -> DataFrame:
    """(cell, label, predicted, uncertain) of ``cells`` (cell, x, label) by a random forest on ``train``, its classes weighted evenly."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    figures = normalizer(train)
    sizes = train.groupBy("label").agg(F.count("*").alias("_n"))
    n, classes = train.count(), sizes.count()
    weighed = features(train, figures).join(sizes, "label").select("label", (F.lit(n / max(classes, 1)) / F.col("_n")).alias("weight"), array_to_vector("v").alias("features"))
    model = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(weighed)
    found = model.transform(features(cells, figures).select("cell", "label", array_to_vector("v").alias("features"))).withColumn("p", vector_to_array("probability"))
    return found.select("cell", "label", F.col("prediction").cast("long").alias("predicted"), (F.array_max("p") < SURE).alias("uncertain"))
