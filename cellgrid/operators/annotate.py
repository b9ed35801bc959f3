"""Rule-based annotation of clusters and greedy choice of marker genes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_definitions(spark: SparkSession, definitions: list[tuple[str, str]]) -> DataFrame:
    """(tag, sign, gene) rows of definitions such as ``+A +B -C``; anything without a sign is an error."""
    rows = []
    for tag, text in definitions:
        for word in text.split():
            if not re.fullmatch(r"[+-]\S+", word):
                raise ValueError(f"{tag}: {word!r} has no sign")
            rows.append((tag, 1 if word[0] == "+" else -1, word[1:]))
    return spark.createDataFrame(rows, "tag string, sign int, gene string")


def greedy_unique(scores: DataFrame, cluster: str, gene: str, score: str, n: int) -> DataFrame:
    """For each cluster in label order, its ``n`` best genes that no earlier cluster took.

    The first clusters can take at most n genes each, so n times the number of clusters candidates
    of each cluster suffice; only these reach the driver.
    """
    k = scores.select(cluster).distinct().count()
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.round(score, 9).desc(), gene))
    near = scores.withColumn("rank", rank).filter(F.col("rank") <= n * k).select(cluster, gene, "rank").orderBy(cluster, "rank").collect()
    taken, out, count = set(), [], {}
    for c, g, _ in near:
        if g not in taken and count.get(c, 0) < n:
            taken.add(g)
            count[c] = count.get(c, 0) + 1
            out.append((c, g, count[c]))
    kinds = dict(scores.dtypes)
    return scores.sparkSession.createDataFrame(out, f"{cluster} {kinds[cluster]}, {gene} {kinds[gene]}, rank int")


def gene_order(scores: DataFrame, markers: DataFrame) -> DataFrame:
    """(gene, marker, ord) of an aggregate's genes: markers first, then by the cluster in which a gene scores highest (the least of several), then by gene.

    The order runs over the genes of one aggregate, one row each.
    """
    top = F.row_number().over(Window.partitionBy("gene").orderBy(F.round("enrichment", 9).desc(), "cluster"))
    best = scores.withColumn("_k", top).filter("_k = 1").select("gene", F.col("cluster").alias("top"))
    found = best.join(markers.select("gene", F.lit(True).alias("marker")).distinct(), "gene", "left").withColumn("marker", F.coalesce("marker", F.lit(False)))
    return found.withColumn("ord", (F.row_number().over(Window.orderBy(F.col("marker").desc(), "top", "gene")) - 1).cast("long"))


def marker_sets(trinaries: DataFrame, pep: float = 0.05, n_genes: int = 6, blocked: tuple = ()) -> DataFrame:
    """Gene combinations that single out each cluster.

    The first gene of a cluster is its most enriched positive one; each further one is positive in
    the cluster, chosen nowhere yet, and leaves the fewest clusters in which all chosen genes are
    positive (ties: highest enrichment). Positive pairs are a table of at most genes by clusters,
    which is as small as the aggregate that it comes from, and are looked at on the driver.
    Returns cluster, ord, gene, breadth.
    """
    rows = trinaries.filter((F.col("trinary") > 1 - pep) & ~F.col("gene").isin(*blocked)).select("cluster", "gene", F.round("enrichment", 9).alias("e")).collect()
    where, best = {}, {}
    for c, g, e in rows:
        where.setdefault(g, set()).add(c)
        best.setdefault(c, {})[g] = e
    chosen, out = set(), []
    for c in sorted(best):
        alive = None
        for k in range(n_genes):
            free = [g for g in best[c] if g not in chosen]
            if not free:
                break
            if alive is None:
                g = max(free, key=lambda g: (best[c][g], -g))
                alive = set(where[g])
            else:
                g = min(free, key=lambda g: (len(alive & where[g]), -best[c][g], g))
                alive &= where[g]
            chosen.add(g)
            out.append((c, k, g, len(alive)))
    return trinaries.sparkSession.createDataFrame(out, "cluster string, ord int, gene long, breadth int")
