"""Cross-site boilerplate lines, found by the spread of each line over sites.

A line is boilerplate if it stands on at least ``min_sites`` distinct sites. Its spread is
estimated by a HyperLogLog sketch of the sites in which its hash occurs; partial sketches merge
by aggregation, so a line that stands in a third of all documents costs one sketch per task.
Lines whose estimate is within ``MARGIN`` of the threshold (over six standard errors of the
sketch) get an exact distinct count, so the outcome is that of exact counts throughout.

Boilerplate lines are then taken out of the texts, wherever they stand. A text of nothing but
boilerplate and lines without a word becomes what is left, mostly the empty text. Where a later
step keeps one of several copies, ``spare_whole`` leaves such a text as it is, as else every copy
of a document that stands on many sites would be emptied and none left to keep.

Lines are the pieces between ``\\n``, compared as they are. Lines without a word are kept. A
null site counts for no line. Null and empty texts have no lines and stay as they are. Texts
are handled row by row, so repeated rows and null ids are harmless. Results carry all input
columns; the two counts are named ``_lines`` and ``_cut``, with as many underscores before that
as it takes to differ from the input's columns (``count_names``). Empty tables give empty ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.llm.common import arrow_map, fresh, staged, table

MIN_SITES = 10
#: Registers of a sketch as a power of two; the standard error is 1.04 / sqrt(2 ** LG_K) = 1.6 %.
LG_K = 12
MARGIN = 0.1
#: Hashes of boilerplate lines are sent to all tasks up to this count (about 100 MB in a Python worker); beyond, they are joined.
SEND_UP_TO = 1_000_000
NO_WORD = " \t\r\x0b\x0c"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_sites(documents: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(line, site): hashes of each line with a word and of its site."""
    lines = documents.select(F.col(site_col).alias("site"), F.explode(split_lines(F.col(text_col))).alias("line"))
    return lines.filter(has_word(F.col("line")) & F.col("site").isNotNull()).select(F.xxhash64("line").alias("line"), F.xxhash64("site").alias("site"))


def boilerplate(documents: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Hashes of the lines that stand on at least ``min_sites`` sites, as a staged table."""
    pairs = line_sites(documents, text_col, site_col)
    # A line that stands in fewer places than the threshold has fewer sites, so only the others' sketches are read.
    spread = pairs.groupBy("line").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = staged(spread.filter(F.col("n") >= min_sites).select("line", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    low, high = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    sure = spread.filter(F.col("sites") > high).select("line")
    near = spread.filter(F.col("sites").between(low, high)).select("line")
    exact = pairs.join(near, "line", "left_semi").distinct().groupBy("line").count().filter(F.col("count") >= min_sites).select("line")
    return staged(sure.unionByName(exact), "boilerplate-lines")


def count_names(documents: DataFrame) -> tuple[str, str]:
    """Names of the result's columns for the lines that a document had and that it lost."""
    return fresh("_lines", documents.columns), fresh("_cut", documents.columns)


def _strip_sent(documents: DataFrame, hashes: np.ndarray, text_col: str, spare_whole: bool) -> DataFrame:
    """``text_col`` without the lines in ``hashes``, with both counts, in one pass over the rows."""
    known = documents.sparkSession.sparkContext.broadcast(np.sort(hashes))
    n_name, cut_name = count_names(documents)
    schema = T.StructType([*documents.schema.fields, T.StructField(n_name, T.LongType()), T.StructField(cut_name, T.LongType())])
    names = list(documents.columns)
    place = names.index(text_col)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = set_of(known)
        texts, n_lines, n_cut = [], [], []
        for value in batch.column(place):
            text = value.as_py()
            lines = text.split("\n") if text else []
            kept = [x for x in lines if not x.strip(NO_WORD) or xxhash.xxh64_intdigest(x.encode(), 42) not in cut]
            if len(kept) == len(lines) or spare_whole and not any(x.strip(NO_WORD) for x in kept):
                texts.append(text)
                n_cut.append(0)
            else:
                texts.append("\n".join(kept))
                n_cut.append(len(lines) - len(kept))
            n_lines.append(len(lines))
        columns = list(batch.columns)
        columns[place] = pa.array(texts, batch.schema.field(place).type)
        return pa.record_batch([*columns, pa.array(n_lines, pa.int64()), pa.array(n_cut, pa.int64())], names=[*names, n_name, cut_name])

    return arrow_map(documents, kernel, schema)


def _strip_joined(documents: DataFrame, lines: DataFrame, text_col: str, spare_whole: bool) -> DataFrame:
    """The same by joins, for any number of boilerplate lines: equal texts lose the same lines, so the key is the text's digest."""
    n_name, cut_name = count_names(documents)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(text_col).alias("text"), F.md5(F.col(text_col)).alias("digest"))
    at = rows.select("digest", F.posexplode(split_lines(F.col("text"))).alias("at", "x")).filter(has_word(F.col("x")))
    found = at.select("digest", "at", F.xxhash64("x").alias("line")).join(lines, "line", "left_semi")
    joined = rows.join(found.groupBy("digest").agg(F.collect_set("at").alias("gone")), "digest", "left")
    whole = F.when(F.length("text") > 0, split_lines(F.col("text"))).otherwise(F.array().cast("array<string>"))
    joined = joined.withColumn("all", whole).withColumn("kept", F.when(F.col("gone").isNull(), F.col("all")).otherwise(F.expr("filter(all, (x, i) -> NOT array_contains(gone, i))")))
    stays = F.col("gone").isNull()
    if spare_whole:
        stays = stays | ~F.exists("kept", has_word)
    joined = joined.withColumn("cut", F.when(stays, 0).otherwise(F.size("all") - F.size("kept")).cast("long"))
    text = F.when(F.col("cut") > 0, F.array_join("kept", "\n")).otherwise(F.col("text")).alias(text_col)
    columns = [text if c == text_col else F.col("row")[c].alias(c) for c in documents.columns]
    return joined.select(*columns, F.size("all").cast("long").alias(n_name), F.col("cut").alias(cut_name))


def set_of(known, built: dict = {}) -> frozenset[int]:  # noqa: B006
    """The broadcast hashes as a set, built once in each worker and only for the latest broadcast."""
    if known.value is not built.get("from"):
        built.update({"from": known.value, "set": frozenset(known.value.tolist())})
    return built["set"]


def strip_lines(documents: DataFrame, lines: DataFrame, text_col: str = "text", send_up_to: int = SEND_UP_TO, spare_whole: bool = False) -> DataFrame:
    """``documents`` without the boilerplate ``lines``, with the lines each had and lost (``count_names``)."""
    if lines.count() <= send_up_to:
        return _strip_sent(documents, lines.toPandas()["line"].to_numpy(dtype=np.int64).view(np.uint64), text_col, spare_whole)
    return _strip_joined(documents, lines, text_col, spare_whole)


def dedup_lines(documents: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", send_up_to: int = SEND_UP_TO, spare_whole: bool = False) -> DataFrame:
    return strip_lines(documents, boilerplate(documents, min_sites, text_col, site_col), text_col, send_up_to, spare_whole)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(documents).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_cut").alias("n_removed"), "text")


OP1_SQL = rf"""
WITH pieces AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE length(text) > 0),
wordy AS (SELECT * FROM pieces WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
spread AS (SELECT line FROM wordy GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT p.doc_id, p.line, p.pos, s.line IS NOT NULL AS shared
  FROM pieces p LEFT JOIN spread s ON p.line = s.line),
summed AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (shared) AS n_shared,
         string_agg(line, chr(10) ORDER BY pos) FILTER (NOT shared) AS rest
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines,
       coalesce(n_shared, 0)::BIGINT AS n_removed,
       CASE WHEN n_shared > 0 THEN coalesce(rest, '') ELSE d.text END AS text
FROM documents d LEFT JOIN summed USING (doc_id)
"""
