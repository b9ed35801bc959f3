"""The steps from a matrix to clusters and their aggregate, as a subset's settings ask for them."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.model import CellMatrix
from cellgrid.operators import aggregate, annotate, cluster, doublets, embed, factor, forest, graph, qc, stats, views

STEPS = ("poisson_pooling", "nn", "embeddings", "clustering", "aggregate", "export", "skeletonize", "cluster-validation")
CHOICES = {
    "factorization": ("PCA", "HPF", "both"),
    "features": ("enrichment", "variance"),
    "nn_space": ("auto", "PCA", "HPF"),
    "clusterer": ("louvain", "leiden", "surprise", "unpolished", "sknetwork"),
    "graph": ("RNN", "KNN", "MKNN"),
    "doublets_method": ("scrublet", "doublet-finder"),
    "doublets_action": ("remove", "score"),
}
#: Least cells of a cluster, and cells up to which the embeddings take their settings for few points.
MIN_CELLS, FEW = 10, 200


def checked(config: dict) -> dict:
    """The configuration, if every choice and step in it is known and they go together; else an error."""
    p = config["params"]
    for name, known in CHOICES.items():
        if p[name] not in known:
            raise ValueError(f"params.{name} is {p[name]!r}, not one of {', '.join(known)}")
    for step in config["steps"]:
        if step not in STEPS:
            raise ValueError(f"no step {step!r}; there are {', '.join(STEPS)}")
    if p["nn_space"] != "auto" and p["factorization"] not in (p["nn_space"], "both"):
        raise ValueError(f"params.nn_space {p['nn_space']} needs that factorization, not {p['factorization']}")
    return config


class Stage:
    """Tables of one task below its folder, each written once and read again."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def gated(m: CellMatrix, config: dict, mito: tuple[str, ...] = ("MT", "chrM")) -> CellMatrix:
    """Cells that pass the quality limits, of samples with enough of them: totals always, the others where the matrix has what they need.

    With ``passedQC``, only cells of samples marked so count; doublets are scored and removed if the
    limit on their score is below 1 and the action is to remove them.
    """
    p = config["params"]
    cells = m.cells
    if p["passedQC"]:
        if "passedQC" not in cells.columns:
            raise ValueError("params.passedQC asks for the attribute passedQC, which the cells do not have")
        cells = cells.filter("passedQC")
    found = cells.join(qc.cell_totals(m.entries).select("cell", "total"), "cell", "left").fillna(0.0, ["total"])
    good = F.col("total") >= p["min_umis"]
    if "chromosome" in m.genes.columns:
        found = found.join(qc.category_ratio(m, mito).withColumnRenamed("ratio", "mito_ratio"), "cell", "left").fillna(0.0, ["mito_ratio"])
        good = good & ((F.col("mito_ratio") < p["max_fraction_MT_genes"]) | F.lit(p["max_fraction_MT_genes"] >= 1))
    if "unspliced" in m.entries.columns:
        found = found.join(qc.layer_ratio(m.entries, "unspliced").withColumnRenamed("ratio", "unspliced_ratio"), "cell", "left").fillna(0.0, ["unspliced_ratio"])
        good = good & (F.col("unspliced_ratio") > p["min_fraction_unspliced_reads"])
    if "doublet_score" in cells.columns and p["doublets_action"] == "remove":
        good = good & (F.coalesce("doublet_score", F.lit(0.0)) < p["max_doubletFinder_th"])
    if "sample" in cells.columns:
        share = qc.sample_gate(found, good, p["min_fraction_good_cells"]).filter("kept").select("sample")
        found = found.join(share, "sample", "left_semi")
    kept = found.filter(good).select(*m.cells.columns)
    return CellMatrix(kept, m.genes, m.entries.join(kept.select("cell"), "cell", "left_semi"))


def scored_doublets(m: CellMatrix, config: dict) -> DataFrame:
    """(cell, doublet_score, doublet_flag) of all cells."""
    n = m.cells.count()
    scores, made = doublets.scores_of(m.entries, m.cells.select("cell"))
    limit = doublets.flag_threshold(scores, made, n, config["params"]["max_doubletFinder_th"])
    return scores.select("cell", F.col("score").alias("doublet_score"), (F.col("score") >= limit).cast("int").alias("doublet_flag"))


def masked_genes(m: CellMatrix, species: DataFrame | None, name: str | None, mask: list[str]) -> DataFrame:
    """Genes of the masked categories of a species (table of ``sources.formats.species_genes``); none without one."""
    if species is None or name is None or not mask:
        return m.genes.select("gene").limit(0)
    listed = species.filter((F.col("species") == name) & (F.col("kind") == "categories") & F.col("name").isin(*mask)).select(F.col("gene").alias("_listed")).distinct()
    by = "name" if "name" in m.genes.columns else "gene"
    return m.genes.join(listed, F.col(by).cast("string") == F.col("_listed"), "left_semi").select("gene")


class Analysis:
    """One task's chain. Every table that a later step reads more than once is staged below ``folder``."""

    def __init__(self, m: CellMatrix, config: dict, folder: str, species: DataFrame | None = None, species_name: str | None = None):
        self.config, self.p, self.steps = checked(config), config["params"], config["steps"]
        self.spark, self.folder = m.cells.sparkSession, folder
        self.keep = Stage(self.spark, folder)
        entries = self.keep(m.entries, "collected-entries")
        self.m = CellMatrix(self.keep(m.cells, "collected"), self.keep(m.genes, "collected-genes"), entries)
        self.n = self.m.cells.count()
        self.species, self.species_name = species, species_name
        self.main = entries
        self.made: dict[str, DataFrame] = {}

    def layer(self) -> CellMatrix:
        return CellMatrix(self.m.cells, self.m.genes, self.main)

    def usable_genes(self) -> None:
        valid = qc.valid_genes(self.m).select("gene", "valid")
        masked = masked_genes(self.m, self.species, self.species_name, self.p["mask"]).withColumn("masked", F.lit(True))
        self.genes = self.keep(valid.join(masked, "gene", "left").fillna(False, ["masked"]), "gene-use")
        self.usable = self.genes.filter("valid AND NOT masked").select("gene")

    def by_variance(self, entries: DataFrame) -> DataFrame:
        moments = qc.gene_moments(entries.join(self.usable, "gene", "left_semi").select("cell", "gene", "x"), "x", self.m.n_cells())
        scored = factor.variance_trend(moments)
        return scored.orderBy(F.round("score", 6).desc(), "gene").limit(self.p["n_genes"]).select("gene")

    def harmonized(self, points: DataFrame) -> DataFrame:
        keys = self.p["batch_keys"]
        if not keys:
            return points
        batch = self.m.cells.select(F.col("cell").alias("id"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("batch"))
        return factor.harmonized(points.join(batch, "id")).select("id", "v")

    def principal(self, selected: DataFrame, name: str) -> DataFrame:
        values = self.keep(qc.normalized(self.layer()).join(selected, "gene", "left_semi").select("cell", "gene", "v"), f"{name}-values")
        parts = factor.pca(values, self.n, min(self.p["n_factors"], self.n))
        # Rounded, as sums in another order are not equal: equal cells are then equal points.
        points = factor.project(values, self.m.cells, parts).select(F.col("cell").alias("id"), F.transform("pca", lambda x: F.round(x, 9)).alias("v"))
        return self.keep(self.harmonized(self.keep(points, f"{name}-raw")), name)

    def poisson_factors(self, selected: DataFrame) -> DataFrame:
        k = max(1, min(self.p["n_factors"], round(self.n / 3)))
        entries = self.keep(self.main.join(selected, "gene", "left_semi").select("cell", "gene", "x"), "hpf-entries")
        found = factor.ordered(factor.hpf(entries, k, self.folder), k)
        self.made["hpf_beta"] = found.beta.select(F.col("id").alias("gene"), factor.expected(found.beta).alias("beta"))
        theta = found.theta.select("id", factor.expected(found.theta).alias("v")).withColumn("v", graph.shares("v"))
        even = F.array(*[F.lit(1.0 / k)] * k)
        return self.keep(self.m.cells.select(F.col("cell").alias("id")).join(theta, "id", "left").select("id", F.coalesce("v", even).alias("v")), "hpf")

    def pool(self) -> None:
        """Counts summed over near cells, in the space of components of variable genes."""
        points = self.principal(self.by_variance(self.main), "pooling-points")
        self.main = self.keep(graph.poisson_pooled(points, self.main.select("cell", "gene", "x"), self.m.cells, min(self.p["k_pooling"], self.n)), "pooled")

    def select(self) -> None:
        first = self.keep(self.by_variance(self.m.entries if self.p["features"] == "enrichment" else self.main), "variable")
        if self.p["features"] == "enrichment":
            points = self.principal(first, "preliminary")
            near = self.keep(graph.near_neighbours(points, max(1, min(self.p["k"], self.n) - 1)), "preliminary-near")
            labels = self.keep(cluster.communities(points.select("id"), near.withColumn("w", 1 / (1 + F.col("d"))), min_cells=0, folder=self.folder), "preliminary-labels")
            count = max(labels.select("label").distinct().count(), 1)
            cells = self.m.cells.join(labels.select(F.col("id").alias("cell"), F.col("label").alias("_label")), "cell")
            usable = CellMatrix(cells, self.m.genes, self.m.entries.join(self.usable, "gene", "left_semi"))
            if count > 1:
                first = annotate.greedy_unique(aggregate.enrichment(usable, "_label"), "cluster", "gene", "enrichment", max(1, self.p["n_genes"] // count)).select("gene").distinct()
        self.selected = self.keep(first, "selected")

    def factorize(self) -> None:
        spaces = {}
        if self.p["factorization"] in ("PCA", "both"):
            spaces["PCA"] = self.principal(self.selected, "pca")
        if self.p["factorization"] in ("HPF", "both"):
            spaces["HPF"] = self.poisson_factors(self.selected)
        self.made |= {name.lower(): points for name, points in spaces.items()}
        self.space = self.p["nn_space"] if self.p["nn_space"] != "auto" else next(iter(spaces))
        self.points = spaces[self.space]

    def neighbours(self) -> None:
        k = max(1, min(self.p["k"], self.n - 1))
        near = graph.js_neighbours if self.space == "HPF" else graph.near_neighbours
        sight = near(self.points, min(2 * k, max(self.n - 1, 1)))
        self.knn = self.keep(cluster.balanced_knn(self.spark, sight, k, 2 * k), "knn")
        self.mknn = self.keep(graph.mutual(self.knn), "mknn")
        self.rnn = self.keep(graph.radius_graph(self.knn), "rnn")
        self.made |= {"knn": self.knn, "mknn": self.mknn, "rnn": self.rnn}

    def embed(self) -> None:
        few = self.n <= FEW
        points = self.points if self.space == "PCA" else self.points.select("id", F.transform("v", F.sqrt).alias("v"))
        options = {"neighbours": 15, "least": 0.1, "rate": 1.0} if few else {"neighbours": max(2, self.p["k"] // 2), "least": 0.25, "rate": 0.3}
        layouts = {"tsne": lambda: embed.embed(points, perplexity=5.0 if few else 30.0), "umap": lambda: embed.umap_embed(points, 2, **options), "umap3d": lambda: embed.umap_embed(points, 3, **options)}
        with ThreadPoolExecutor(len(layouts)) as pool:  # each is one long task: they run side by side
            self.made |= zip(layouts, pool.map(lambda name: self.keep(layouts[name](), name), layouts), strict=True)
        self.plane = self.made["tsne"]

    def cluster(self) -> None:
        weighted = {"RNN": lambda: self.rnn.withColumnRenamed("sim", "w"), "KNN": lambda: graph.similarities(self.knn).withColumnRenamed("sim", "w"), "MKNN": lambda: graph.similarities(self.mknn).withColumnRenamed("sim", "w")}
        how, nodes = self.p["clusterer"], self.points.select("id")
        edges = self.keep(weighted["KNN" if how == "sknetwork" else self.p["graph"]]().select("src", "dst", "w"), "cluster-edges")
        if how == "unpolished":
            labels = cluster.unpolished(self.points, edges, MIN_CELLS, self.folder)
        elif how == "sknetwork":
            labels = cluster.communities(nodes, edges, min_cells=0, folder=self.folder)
        else:
            raw = self.keep(cluster.communities(nodes, edges, min_cells=MIN_CELLS, folder=self.folder, method=how), "raw-labels")
            labels = cluster.polish(raw, self.knn, MIN_CELLS, plane=self.plane if how in ("louvain", "leiden") else None, folder=self.folder)
        labels = self.keep(labels, "labels")
        if labels.filter("label >= 0").isEmpty():  # too small or too uniform to divide: one cluster
            labels = self.keep(labels.withColumn("label", F.lit(0).cast("long")), "one-label")
        self.made["labels"] = labels

    def run(self) -> dict[str, DataFrame]:
        """The tables made, by name: selected genes, coordinates, graphs, embeddings, labels."""
        self.usable_genes()
        if self.usable.isEmpty():  # too few cells for any gene to tell them apart: one cluster
            ids = self.m.cells.select(F.col("cell").alias("id"))
            self.selected, self.points = self.usable, ids.withColumn("v", F.array(F.lit(0.0)))
            self.made |= {"selected": self.selected, "labels": ids.withColumn("label", F.lit(0).cast("long"))}
            return self.made
        if "poisson_pooling" in self.steps:
            self.pool()
        self.select()
        self.made["selected"] = self.selected
        self.factorize()
        if {"nn", "clustering"} & set(self.steps):
            self.neighbours()
        if {"embeddings", "clustering"} & set(self.steps):
            self.embed()
        if "clustering" in self.steps:
            self.cluster()
        return self.made


def describe(m: CellMatrix, labels: DataFrame, genes: DataFrame, selected: DataFrame, keep: Callable[[DataFrame, str], DataFrame], definitions: DataFrame | None = None, knn: DataFrame | None = None, f: float = 0.2) -> dict[str, DataFrame]:
    """The aggregate of a clustered matrix: clusters numbered by similarity, means, nonzeros, enrichment, trinaries, markers, gene order, tags and marker sets; with a graph, its skeleton.

    ``genes`` (gene, valid, masked) says which genes may be markers.
    """
    own = m.cells.join(labels.select(F.col("id").alias("cell"), F.col("label").alias("clusters")), "cell")
    inside = own.filter("clusters >= 0")
    sizes = inside.groupBy("clusters").agg(F.count("*").alias("n_cells"))
    if sizes.count() < 2:
        return {"cells": own, "sizes": sizes}
    grouped = lambda cells: CellMatrix(cells, m.genes, m.entries.join(cells.select("cell"), "cell", "left_semi"))
    means = aggregate.label_means(grouped(inside), "clusters").join(selected, "gene", "left_semi")
    names, distance, tree = cluster.correlation_tree(means)
    order = {names[i]: k for k, i in enumerate(cluster.leaf_order(tree, distance))}
    rank = m.cells.sparkSession.createDataFrame([(int(c), k) for c, k in order.items()], "clusters long, new long")
    renamed = lambda cells: cells.join(F.broadcast(rank), "clusters", "left").withColumn("clusters", F.coalesce("new", F.lit(-1).cast("long"))).drop("new")
    own = keep(renamed(own), "numbered-cells")
    inside = own.filter("clusters >= 0")
    turned = cluster.leaf_order(tree, distance)
    again = cluster.linkage(distance[turned][:, turned])  # the tree of the new numbers
    table = keep(stats.trinarize(aggregate.enrichment(grouped(inside), "clusters"), f=f), "aggregate-table")
    candidates = table.join(genes.filter("valid AND NOT masked").select("gene"), "gene", "left_semi")
    markers = keep(annotate.greedy_unique(candidates, "cluster", "gene", "enrichment", 10), "markers")
    out = {
        "cells": own, "aggregate": table, "markers": markers, "gene_order": annotate.gene_order(table, markers), "sizes": inside.groupBy("clusters").agg(F.count("*").alias("n_cells")),
        "linkage": m.cells.sparkSession.createDataFrame([(k, int(a), int(b), float(d), int(n)) for k, (a, b, d, n) in enumerate(again)], "step int, left int, right int, distance double, size int"),
        "marker_sets": annotate.marker_sets(table.withColumn("cluster", F.col("cluster").cast("string"))),
    }
    if definitions is not None:
        out["tags"] = stats.tag_posteriors(definitions, table).filter("posterior > 0.5").groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("tag")), " ").alias("tags"))
    if knn is not None:
        out["skeleton"] = graph.skeleton(knn, inside.select(F.col("cell").alias("id"), F.col("clusters").alias("label")), 1.0)
    return out


def exported(m: CellMatrix, about: dict[str, DataFrame], made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables behind a task's drawings."""
    cells = about["cells"]
    out = {}
    if "tsne" in made:
        plane = made["tsne"].join(cells.select(F.col("cell").alias("id"), F.col("clusters").alias("label")), "id")
        out["positions"] = plane.filter("label >= 0").groupBy("label").agg(F.median("x").alias("x"), F.median("y").alias("y"), F.lit(views.marker_size(plane.select("id", "x", "y"))).alias("marker_size"))
    if "knn" in made:
        out["radius"] = graph.neighborhood(made["knn"], float(made["knn"].agg(F.percentile("d", 0.9)).first()[0] or 0.0))
    if "aggregate" in about:
        out["heatmap"] = about["markers"].select(F.col("cluster").alias("of"), "gene").join(about["aggregate"].select("gene", "cluster", F.log1p("mean").alias("value")), "gene")
    totals = qc.cell_totals(m.entries)
    out["umi_genes"] = totals.select("cell", "total", "n_genes")
    return out


def predictive_power(points: DataFrame, labels: DataFrame, trees: int = 100, depth: int = 30) -> DataFrame:
    """(label, class, p): mean chance of each class that a random forest, trained on four fifths of the cells, gives to the held-out cells of each cluster."""
    known = points.join(labels.filter("label >= 0"), "id").select("id", "label", "v", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("held"))
    n, top, width = known.agg(F.count("*"), F.max("label"), F.max(F.size("v"))).first()
    if n and n * max(top + 1, width) <= forest.FOREST_VALUES:
        return forest.held_out_chances(known, int(top) + 1, trees, depth)
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = known.select("label", "held", array_to_vector("v").alias("features"))
    model = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=1).fit(rows.filter("NOT held"))
    found = model.transform(rows.filter("held")).select("label", F.posexplode(vector_to_array("probability")).alias("class", "p"))
    return found.groupBy("label", "class").agg(F.avg("p").alias("p"))
