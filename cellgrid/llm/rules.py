"""Quality rules and an isolation forest on their statistics.

Two fixed rules come first: fewer than 20 words, or more than 30 % of the words in repeated
8-word windows, fail a document (``base_failed``). The rest is left to an isolation forest over
the rules' statistics: random splits isolate unusual documents on short paths.

Statistics are taken of all labelled documents. Each of the ``TREES`` trees is grown from its own
``PER_TREE`` rows, as the method has it: a draw by hash from all rows that are not held out, so the
forest does not grow with the corpus. The threshold on the anomaly score is calibrated on all
labelled rows that are held out from the trees, one of ``CALIBRATE`` by hash: the least one that
rejects at most ``MOST_WRONG`` of the good documents.

All texts are then scored in one pass, the trees flattened into arrays that numpy traverses for
whole batches. Null and empty texts have no words, so they fail the first rule. Without any
labelled document the forest is empty and only the fixed rules speak. Rows are mapped one to
one; ids may be null or repeat; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import arrow_map, scratch, staged, table, utf8_rows
from cellgrid.llm.textstats import base_stats

TREES = 200
#: Small, so that junk of one kind stays rare in each tree and does not hide behind its own mass.
PER_TREE = 64
MOST_WRONG = 0.002
CALIBRATE = 3
LEAST_WORDS = 20
REPEAT_PERCENT = 30


def ratios(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on, from rows of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words, chars = np.maximum(stats[:, 0], 1), np.maximum(stats[:, 1], 1)
    repeats = np.minimum(stats[:, 4] / words, REPEAT_PERCENT / 100) + np.log1p(stats[:, 3]) / 5
    return np.column_stack([stats[:, 1] / words, stats[:, 2] / words, stats[:, 2] / chars, np.log1p(stats[:, 2]), repeats])


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < LEAST_WORDS) | (100 * stats[:, 4] > REPEAT_PERCENT * stats[:, 0])


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Trees in arrays: node k of a tree goes to ``left[k]`` below ``cut[k]`` of column ``column[k]``, else one further; a leaf points at itself."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    depth: int
    per_tree: int
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row, from 0 to 1."""
        if not len(self.column):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for column, cut, left, length in zip(self.column, self.cut, self.left, self.length, strict=True):
            at = np.zeros(len(rows), np.int32)
            for _ in range(self.depth):
                down = left[at]
                inner = down != at
                at = np.where(inner, down + (rows[at_row, column[at]] >= cut[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.column) / max(mean_path(self.per_tree), 1e-9))


def grow(rows: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(per_tree, len(rows))
    depth = int(np.ceil(np.log2(max(size, 2))))
    nodes = 2 ** (depth + 1)
    column, cut, left, length = (np.zeros((trees, nodes), t) for t in (np.int32, float, np.int32, float))
    left[:] = np.arange(nodes)
    for tree in range(trees):
        # Enough rows are dealt out, so that every tree has its own; of fewer each tree draws.
        own = np.arange(tree * size, (tree + 1) * size) if len(rows) >= trees * size else rng.choice(len(rows), size, replace=False)
        todo, used = [(0, own, 0)], 1
        while todo:
            node, own, level = todo.pop()
            part = rows[own]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0))
            if level == depth or len(own) <= 1 or not len(spread):
                length[tree, node] = level + mean_path(len(own))
                continue
            k = int(rng.choice(spread))
            at = rng.uniform(part[:, k].min(), part[:, k].max())
            at = at if at > part[:, k].min() else part[:, k].max()
            below = part[:, k] < at
            column[tree, node], cut[tree, node], left[tree, node] = k, at, used
            todo += [(used, own[below], level + 1), (used + 1, own[~below], level + 1)]
            used += 2
    return Forest(column, cut, left, length, depth, size, 1.0)


def threshold_place(n: int, most_wrong: float = MOST_WRONG) -> int:
    """The place, among ``n`` scores of good documents in order, of the least threshold above which at most ``most_wrong`` of them lie."""
    return max(int(np.ceil((1 - most_wrong) * n)) - 1, 0)


def chosen_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality), one row for each labelled document."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").dropDuplicates(["doc_id"])


def labelled_texts(documents: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, text, quality) of at most ``bound`` labelled documents, the first by a hash of their ids."""
    chosen = chosen_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_stats(documents: DataFrame) -> DataFrame:
    """doc_id and the five base statistics of ``text``."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.array([base_stats(text)[0] for text in utf8_rows(batch.column(1))], np.int64)
        return pa.record_batch([batch.column(0), *[pa.array(stats[:, k]) for k in range(len(NAMES))]], names=["doc_id", *NAMES])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return arrow_map(documents.select("doc_id", "text"), kernel, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES))


def passed(rows: DataFrame) -> DataFrame:
    """Rows of base statistics that the fixed rules accept."""
    return rows.filter((F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= REPEAT_PERCENT * F.col("n_words")))


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """The anomaly scores of rows of base statistics."""
    model = rows.sparkSession.sparkContext.broadcast(forest)  # a fixed number of nodes

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(NAMES))])
        return pa.record_batch([pa.array(model.value.score(ratios(stats)))], names=["score"])

    return arrow_map(rows.select(*NAMES), kernel, "score double")


def fit(documents: DataFrame, labels: DataFrame) -> Forest:
    """Grow and calibrate the forest on all labelled documents that pass the fixed rules."""
    with scratch(documents.sparkSession):
        # Statistics meet the labels, as texts are too large to be dealt out. Of rows that repeat an id the least counts.
        stats = text_stats(documents).join(chosen_labels(labels), "doc_id").groupBy("doc_id").agg(F.min(F.struct("quality", *NAMES)).alias("row"))
        rows = staged(passed(stats.select("doc_id", "row.*")).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(CALIBRATE)) == 1), "rule-stats")
        good = rows.filter("held AND quality = 1")
        n = good.count()
        own = rows.filter("NOT held")
        if not n:  # too few rows to hold some out
            own, good = rows, rows.filter("quality = 1")
            n = good.count()
        drawn = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TREES * PER_TREE).select(*NAMES).toPandas().to_numpy(dtype=np.int64)
        if not len(drawn):
            none = np.empty((0, 1))
            return Forest(none, none, none, none, 0, 0, 1.0)
        forest = grow(ratios(drawn))
        if n:
            # The scores from the threshold on, a fixed small share of all.
            most = scored(good, forest).orderBy(F.desc("score")).limit(n - threshold_place(n)).agg(F.min("score"))
            forest.threshold = float(most.first()[0])
    return forest


def judge(documents: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, base statistics, base_failed, anomaly score and kept of each document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    model = documents.sparkSession.sparkContext.broadcast(forest)  # a fixed number of nodes

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.array([base_stats(text)[0] for text in utf8_rows(batch.column(1))], np.int64)
        failed = base_failed(stats)
        score = model.value.score(ratios(stats))
        kept = ~failed & (score <= model.value.threshold)
        return pa.record_batch(
            [batch.column(0), *[pa.array(stats[:, k]) for k in range(5)], pa.array(failed), pa.array(score), pa.array(kept)],
            names=["doc_id", *NAMES, "base_failed", "anomaly", "kept"],
        )

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean, anomaly double, kept boolean"
    return arrow_map(documents.select("doc_id", "text"), kernel, schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return judge(documents, fit(documents, table(spark, sf_dir, "labels")))
