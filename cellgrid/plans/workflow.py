"""From a deck to results: collect cells, analyse, aggregate, export, assign children, pool."""

from __future__ import annotations

from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.model import CellMatrix
from cellgrid.operators import cluster
from cellgrid.operators.deck import Deck, emit_card, first_match, pooled, topological
from cellgrid.plans.analysis import Analysis, checked, describe, exported, gated, predictive_power, scored_doublets
from cellgrid.plans.config import with_subset
from cellgrid.sources.formats import put_bytes, texts
from cellgrid.sources.tables import open_matrix, staged

#: Tasks of a build that run at once.
SIDE_BY_SIDE = 2


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Build:
    """Runs a deck in one session. A task is complete when its ``cells`` table has been committed; complete tasks are skipped.

    Every task obeys the build's settings with its own subset's on top. Cells that a task has
    collected are kept beside its results, so a task that failed goes on from them.
    """

    def __init__(self, spark: SparkSession, deck: Deck, samples: str, out: str, config: dict, definitions: DataFrame | None = None, species: DataFrame | None = None, species_name: str | None = None, categories: dict[str, list[str]] | None = None):
        self.spark, self.deck, self.samples, self.out, self.config = spark, deck, samples, out, config
        self.definitions, self.species, self.species_name, self.categories = definitions, species, species_name, categories or {}

    def is_complete(self, task: str) -> bool:
        return exists(self.spark, f"{self.out}/{task}/cells/_SUCCESS")

    def plan(self) -> list[str]:
        return [t for t in topological(self.deck.tasks()) if not self.is_complete(t)]

    def settings(self, task: str) -> dict:
        subset = self.deck.views.get(task) or self.deck.subsets().get(task)
        return checked(with_subset(self.config, subset))

    def read(self, task: str, table: str = "cells") -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{task}/{table}")

    def write(self, df: DataFrame, task: str, table: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.out}/{task}/{table}")

    def assigned(self, card: str) -> DataFrame:
        """Cells of a card's task with the subset that each belongs to."""
        return first_match(self.read(card), list(self.deck.cards[card].subsets.values()), categories=self.categories)

    def collect(self, task: str) -> CellMatrix:
        whole = open_matrix(self.spark, self.samples)
        if task in self.deck.views:
            view = self.deck.views[task]
            parts = [self.read(s) for s in view.sources]
            union = parts[0]
            for p in parts[1:]:
                union = union.unionByName(p, allowMissingColumns=True)
            chosen = first_match(union, [view], categories=self.categories).filter("subset IS NOT NULL").select("cell").distinct()
        elif (subset := self.deck.subsets()[task]).card == "Root":
            tagged = whole.cells if "tags" in whole.cells.columns else whole.cells.withColumn("tags", F.col("cluster"))
            chosen = first_match(tagged, list(self.deck.root.subsets.values()), categories=self.categories).filter(F.col("subset") == task).select("cell")
        else:
            chosen = self.assigned(subset.card).filter(F.col("subset") == task).select("cell")
        return CellMatrix(whole.cells.join(chosen, "cell", "left_semi"), whole.genes, whole.entries.join(chosen, "cell", "left_semi"))

    def collected(self, task: str, config: dict) -> CellMatrix:
        """The task's cells, from an earlier attempt if there was one; those of the Root card after their quality gates."""
        whole, path = open_matrix(self.spark, self.samples), f"{self.out}/{task}/chosen"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            m = self.collect(task)
            if task in self.deck.subsets() and self.deck.subsets()[task].card == "Root":
                if config["params"]["max_doubletFinder_th"] < 1 and "doublet_score" not in m.cells.columns and config["params"]["min_umis"] > 0:
                    m = CellMatrix(m.cells.join(scored_doublets(m, config), "cell", "left"), m.genes, m.entries)
                m = gated(m, config)
            m.cells.write.mode("overwrite").parquet(path)
        cells = self.spark.read.parquet(path)
        return CellMatrix(cells, whole.genes, whole.entries.join(cells.select("cell"), "cell", "left_semi"))

    def process(self, task: str) -> None:
        if task == "Pool":
            parts = [(leaf, self.read(leaf).select("cell", "clusters").filter("clusters >= 0")) for leaf in self.deck.leaves()]
            self.write(pooled(parts), "Pool", "cells")
            return
        config = self.settings(task)
        chain = Analysis(self.collected(task, config), config, f"{self.out}/{task}/work", self.species, self.species_name)
        if not chain.n:
            raise ValueError(f"{task} has no cells")
        made = chain.run()
        for name in ("selected", "pca", "hpf", "hpf_beta", "knn", "mknn", "rnn", "tsne", "umap", "umap3d"):
            if name in made:
                self.write(made[name], task, name)
        labels = made.get("labels", chain.points.select("id", F.lit(0).cast("long").alias("label")))
        about = {"cells": chain.m.cells.join(labels.select(F.col("id").alias("cell"), F.col("label").alias("clusters")), "cell")}
        if "aggregate" in config["steps"]:
            about = describe(chain.m, labels, chain.genes, chain.selected, chain.keep, self.definitions, made.get("knn") if "skeletonize" in config["steps"] else None)
        cells = about["cells"].withColumn("outliers", (F.col("clusters") < 0).cast("int"))
        if "tags" in about:
            cells = cells.drop("tags").join(about["tags"].select(F.col("cluster").alias("clusters"), "tags"), "clusters", "left").fillna("", ["tags"])
        elif "tags" not in cells.columns:
            cells = cells.withColumn("tags", F.col("cluster") if "cluster" in cells.columns else F.lit(""))
        for name, table in about.items():
            if name not in ("cells", "tags"):
                self.write(table, task, name)
        if "export" in config["steps"]:
            for name, table in exported(chain.m, about, made).items():
                self.write(table, task, f"export/{name}")
        if "cluster-validation" in config["steps"] and not labels.filter("label > 0").isEmpty():
            self.write(predictive_power(chain.points, labels), task, "export/predictive_power")
        self.write(cells, task, "cells")
        remove(self.spark, f"{self.out}/{task}/work")  # all that is kept has been written

    def run(self, dry: bool = False) -> list[str]:
        """The tasks still to do, in order; done in this session, unless ``dry``: a few side by side, each when all that it needs is complete."""
        tasks = self.plan()
        if dry:
            return tasks
        needs, left, running = self.deck.tasks(), list(tasks), {}
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            while left or running:
                waiting = {*left, *running.values()}
                ready = [t for t in left if not waiting & set(needs[t])][: SIDE_BY_SIDE - len(running)]
                left = [t for t in left if t not in ready]
                running |= {pool.submit(self.process, t): t for t in ready}
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for one in done:
                    running.pop(one)
                for one in done:
                    one.result()  # after a failure nothing new is begun
        return tasks

    def labelled(self, task: str) -> DataFrame:
        return self.read(task).select(F.col("cell").alias("id"), F.col("clusters").alias("label"))

    def tree(self, task: str) -> tuple[list, object] | None:
        import numpy as np

        if not exists(self.spark, f"{self.out}/{task}/linkage"):
            return None
        rows = self.read(task, "linkage").orderBy("step").collect()  # clusters of one task
        return list(range(len(rows) + 1)), np.array([(r["left"], r["right"], r["distance"], r["size"]) for r in rows], float)

    def split(self, task: str, method: str = "coverage", threshold: float | None = None) -> str | None:
        """The YAML of a card that divides a finished task's cells by ``split``, an attribute that they get; None if they are not to be divided."""
        labels = staged(self.labelled(task), "split-labels")
        parts = cluster.split(labels, self.read(task, "knn"), method, self.tree(task), threshold)
        if parts is None:
            return None
        parts = staged(parts, "split-parts")
        cells = staged(self.read(task).drop("split").join(parts.select(F.col("id").alias("cell"), F.col("label").alias("split")), "cell", "left"), "split-cells")
        self.write(cells, task, "cells")
        sizes = {r["label"]: r["n"] for r in parts.groupBy("label").agg(F.count("*").alias("n")).collect()}
        return emit_card([(s, sizes[s]) for s in sorted(sizes)], self.config["execution"]["memory"])

    def merge(self, task: str, threshold: int = 1) -> int:
        """Merge a finished task's weak clusters; the number that is left. The cells keep their earlier clusters as ``clusters_before``."""
        cells, plane, whole = self.read(task), self.read(task, "tsne"), open_matrix(self.spark, self.samples)
        own = cells.select("cell")
        m = CellMatrix(own, whole.genes, whole.entries.join(own, "cell", "left_semi"))
        found = staged(cluster.merged(m, self.labelled(task), plane, threshold), "merged")
        renamed = cells.drop("clusters_before").withColumnRenamed("clusters", "clusters_before").join(found.select(F.col("id").alias("cell"), F.col("label").alias("clusters")), "cell", "left").fillna(-1, ["clusters"])
        self.write(staged(renamed, "merged-cells"), task, "cells")
        return found.select("label").distinct().count()


def load_deck(folder: str, spark: SparkSession | None = None) -> Deck:
    """A deck from a folder of this machine, or, with a session, of any store."""
    deck = Deck(texts(spark, folder) if spark else folder)
    return deck


def save_card(spark: SparkSession, folder: str, task: str, card: str) -> None:
    put_bytes(spark, f"{folder}/{task}.yaml", card.encode())
