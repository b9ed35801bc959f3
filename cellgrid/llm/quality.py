"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training: at most ``SAMPLE`` labelled documents, the first in the order of a hash of their ids
among those that are not held out, are described by statistics of their texts and binned; each
tree adds, level by level, the splits with the greatest gain over histograms of first and second
derivatives of the logistic loss. Scoring: the trees lie flattened in arrays (complete binary
trees, so node k's children are 2k + 1 and 2k + 2) and numpy takes whole batches down a level at
a time. All texts are read whole. Labels, language, source and id are no inputs.

Null and empty texts get the score of a text without words. Without labelled documents every
score is one half. Rows are mapped one to one; ids may be null or repeat (a null id is never
held out, nor learned from); only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import arrow_map, table, utf8_rows
from cellgrid.llm.textstats import FEATURES, features

SAMPLE = 20_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
SMOOTH = 1.0
LEAST_ROWS = 10
FOLDS = 5
CUT = 0.3


@dataclass
class Boosted:
    """Flattened trees: split column and threshold of every inner node, value of every leaf."""

    start: float
    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        margin = np.full(len(rows), self.start)
        at_row, inner = np.arange(len(rows)), self.column.shape[1] if self.column.size else 0
        for column, cut, value in zip(self.column, self.cut, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at_row, column[node]] > cut[node])
            margin += value[node - inner]
        return 1 / (1 + np.exp(-margin))


def bin_edges(rows: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cuts between the bins of each column, at quantiles."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in rows.T]


def best_splits(binned: np.ndarray, node: np.ndarray, nodes: int, slope: np.ndarray, bend: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node the column and bin (rows up to it go left) of greatest gain; bin -1 if none gains."""
    gain = np.zeros(nodes)
    column, cut = np.zeros(nodes, np.int64), np.full(nodes, -1)
    for k in range(binned.shape[1]):
        cell = node * bins + binned[:, k]
        g, h, n = (np.bincount(cell, w, nodes * bins).reshape(nodes, bins).cumsum(axis=1) for w in (slope, bend, None))
        all_g, all_h, all_n = g[:, -1:], h[:, -1:], n[:, -1:]
        won = g**2 / (h + SMOOTH) + (all_g - g) ** 2 / (all_h - h + SMOOTH) - all_g**2 / (all_h + SMOOTH)
        won[(n < LEAST_ROWS) | (all_n - n < LEAST_ROWS)] = 0
        at = won.argmax(axis=1)
        top = won[np.arange(nodes), at]
        better = top > gain + 1e-9
        gain[better], column[better], cut[better] = top[better], k, at[better]
    return column, cut


def train(rows: np.ndarray, label: np.ndarray) -> Boosted:
    if not len(rows):
        none = np.empty((0, 0))
        return Boosted(0.0, none, none, none)
    edges = bin_edges(rows)
    binned = np.column_stack([np.searchsorted(edge, column, side="left") for edge, column in zip(edges, rows.T, strict=True)])
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, inner = np.full(len(rows), start), 2**DEPTH - 1
    columns, cuts, values = [], [], []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        slope, bend = chance - label, chance * (1 - chance)
        column, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(rows), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            own, at = best_splits(binned, node - first, nodes, slope, bend, BINS)
            column[first : first + nodes] = own
            for k in np.flatnonzero((at >= 0) & (at < np.array([len(edges[c]) for c in own]))):
                cut[first + k] = edges[own[k]][at[k]]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), column[node]] > cut[node])
        leaf = node - inner
        g, h = (np.bincount(leaf, w, 2**DEPTH) for w in (slope, bend))
        value = -RATE * g / (h + SMOOTH)
        margin += value[leaf]
        columns.append(column), cuts.append(cut), values.append(value)
    return Boosted(start, np.array(columns), np.array(cuts), np.array(values))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Boosted:
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out()).select("doc_id", "quality").dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([features(text)[1] for text in utf8_rows(batch.column(2))])
        return pa.record_batch([*batch.columns[:2], *[pa.array(found[:, k]) for k in range(len(FEATURES))]], names=["doc_id", "quality", *FEATURES])

    described = arrow_map(rows, kernel, f"doc_id {kind}, quality int, " + ", ".join(f"{name} double" for name in FEATURES))
    # Of rows that repeat an id the least counts, so the sample is the same in every run and holds at most ``bound`` rows.
    sample = described.groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("row")).select("row.*").toPandas()
    sample = sample.sort_values(list(sample.columns)).to_numpy(dtype=float)  # rows arrive in any order
    return train(sample[:, 1:], sample[:, 0])


def scores(documents: DataFrame, model: Boosted) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of nodes

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([features(text)[1] for text in utf8_rows(batch.column(1))])
        return pa.record_batch([batch.column(0), pa.array(sent.value.score(found))], names=["doc_id", "score"])

    scored = arrow_map(documents.select("doc_id", "text"), kernel, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(documents: DataFrame, model: Boosted) -> DataFrame:
    """The documents that score at least ``CUT``, whole and in one pass."""
    names = list(documents.columns)
    place = names.index("text")
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([features(text)[1] for text in utf8_rows(batch.column(place))])
        return batch.filter(pa.array(sent.value.score(found) >= CUT))

    return arrow_map(documents, kernel, documents.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scores(documents, fit(documents, table(spark, sf_dir, "labels")))
