"""Mixing sources to target weights.

1. Every document gets a hash-random key (MD5 of seed and id), so the order within a source is
   random and the same in every run.
2. The key's range is cut into as many equal slices as the source needs to hold about
   ``SLICE_ROWS`` documents each. A slice is a range partition of the source's sorted order, so a
   source with a third of all rows is spread over many tasks.
3. Prefix sums of the sizes on three levels: rows along each slice, slices along each block of
   ``SLICE_BLOCK`` slices, and blocks along each source.
4. A source's target is its share by weight, but at most ``epochs`` times its size; what it
   cannot take goes to the others by weight. Whole epochs repeat every document; the rest of the
   budget takes the documents, in key order, up to the one whose middle passes the budget.

Sizes count ``[^\\x20\\x09-\\x0D]+``; null text has size 0. A null source is one source, the
last. A null id takes its text's hash instead; rows with equal ids and sizes are interchangeable.
Documents of size 0 are taken 0 words and appear 0 times. An empty table gives an empty result.
Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrid.llm.common import staged, table

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
SLICE_ROWS = 2_000
#: Slices whose totals are summed in one task.
SLICE_BLOCK = 1_000
WORD = r"[^\x20\x09-\x0D]+"


def mix_key(id_col: str, text_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit(""))))


def words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: rows, source_size, target.

    Filling by weight under caps: the sources whose cap is smallest for their weight fill up
    first, so along that order each is held to its cap while its share of what is left would
    pass it; from the first that is not held, all get one common multiple of their weight, which
    is the largest of the levels met from there on.
    """
    # One row per source from here on: the single-partition windows hold as many rows as there are sources.
    per_source = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = per_source.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    weighed = weighed.withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    held = weighed.withColumn("level", level).withColumn("held", F.col("cap") / F.col("w") <= F.col("level"))
    common = F.max(F.when(~F.col("held"), F.col("level"))).over(everything)
    return held.select("source", "rows", "source_size", F.when(F.col("held"), F.col("cap")).otherwise(F.col("w") * common).alias("target"))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, key, size, source_size, target, full, extra, times, taken.

    ``full`` counts the whole epochs of the document's source, ``extra`` is 1 if the cut epoch
    takes the document, ``times`` is how often it appears and ``taken`` the words it brings.
    """
    # The texts are read once; all that follows works on these short rows.
    sizes = staged(
        documents.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            words(text_col).alias("size"), mix_key(id_col, text_col, seed).alias("key"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, epochs)
    planned = targets.select(
        F.col("source").alias("target_source"), "source_size", "target",
        F.greatest(F.ceil(F.col("rows") / SLICE_ROWS), F.lit(1)).cast("long").alias("slices"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("full"),
    )
    keyed = sizes.join(planned, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    position = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = keyed.withColumn("slice", F.floor(position * F.col("slices") / F.lit(2**32)).cast("long"))
    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    # One row per slice, SLICE_ROWS times fewer than documents; they are summed in blocks, and blocks along the source.
    slices = slices.withColumn("block", F.floor(F.col("slice") / SLICE_BLOCK).cast("long"))
    blocks = slices.groupBy("source", "block").agg(F.sum("slice_size").alias("block_size"))
    blocks = blocks.select(
        F.col("source").alias("block_source"), F.col("block").alias("block_no"),
        (F.sum("block_size").over(Window.partitionBy("source").orderBy("block")) - F.col("block_size")).alias("block_offset"),
    )
    inside = F.sum("slice_size").over(Window.partitionBy("source", "block").orderBy("slice")) - F.col("slice_size")
    offsets = (
        slices.withColumn("inside", inside).join(blocks, F.col("source").eqNullSafe(F.col("block_source")) & (F.col("block") == F.col("block_no")))
        .select(F.col("source").alias("slice_source"), F.col("slice").alias("slice_no"), (F.col("block_offset") + F.col("inside")).alias("offset"))
    )
    within = Window.partitionBy("source", "slice").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        keyed.withColumn("upto", F.sum("size").over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("slice_source")) & (F.col("slice") == F.col("slice_no")))
        .withColumn("before", F.col("offset") + F.col("upto") - F.col("size"))
    )
    left = F.col("target") - F.col("full") * F.col("source_size")
    extra = F.when((F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * left), 1).otherwise(0)
    out = placed.withColumn("extra", extra).withColumn("times", F.when(F.col("size") > 0, F.col("full") + F.col("extra")).otherwise(0).cast("long"))
    return out.select("doc_id", "source", "key", "size", "source_size", "target", "full", "extra", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(documents: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as the mix takes it, with the columns of ``documents``.

    The order of keys makes the cut of a source one (key, size) pair, so the texts meet only a
    table of cuts, one row per source, and are not shuffled. Rows that repeat the cut document's
    key and size are told apart by number, as only some of them may fit.
    """
    seed, id_col, text_col, source_col = (options.get(k, d) for k, d in (("seed", SEED), ("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    counted = mix(documents, **options)
    ends = counted.groupBy("source").agg(F.max("full").alias("full"), F.max(F.when(F.col("extra") == 1, F.struct("key", "size"))).alias("cut"))
    at_cut = (
        counted.join(ends.select(F.col("source").alias("s"), "cut"), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("key") == F.col("cut.key")) & (F.col("size") == F.col("cut.size")))
        .groupBy("s").agg(F.count("*").alias("tied"), F.sum("extra").alias("fit"))
    )
    cuts = staged(
        ends.join(at_cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
            F.col("source").alias("_source"), F.col("full").alias("_full"), F.col("cut").alias("_cut"), F.col("tied").alias("_tied"), F.col("fit").alias("_fit")
        ),
        "mix-cuts",
    )
    rows = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("_row"), F.col(source_col).alias("_of"), mix_key(id_col, text_col, seed).alias("_key"), words(text_col).alias("_words"))
    met = rows.join(cuts, F.col("_of").eqNullSafe(F.col("_source")))
    at = F.col("_key") == F.col("_cut.key")
    extra = F.when(F.col("_cut").isNull() | (F.col("_key") > F.col("_cut.key")), 0).when(F.col("_key") < F.col("_cut.key"), 1)
    met = met.withColumn("_extra", extra.when(F.col("_words") <= F.col("_cut.size"), 1).otherwise(0))
    tied = at & (F.col("_tied") > F.col("_fit")) & (F.col("_words") == F.col("_cut.size"))
    if not cuts.filter(F.col("_tied") > F.col("_fit")).isEmpty():
        number = F.row_number().over(Window.partitionBy("_source").orderBy("_key"))
        some = met.filter(F.coalesce(tied, F.lit(False))).withColumn("_extra", F.when(number <= F.col("_fit"), 1).otherwise(0))
        met = met.filter(~F.coalesce(tied, F.lit(False))).unionByName(some)
    times = F.when(F.col("_words") > 0, F.col("_full") + F.col("_extra")).otherwise(0)
    repeated = met.withColumn("_epoch", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return repeated.select(*[F.col("_row")[c].alias(c) for c in documents.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


OP9_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(text), '')) AS key
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, (source_size * {EPOCHS})::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w
  FROM per_source),
levelled AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER p, 0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0e0)) AS level
  FROM weighed WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap / w <= level THEN cap ELSE w * max(CASE WHEN cap / w <= level THEN NULL ELSE level END) OVER () END AS target
  FROM levelled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * times)::BIGINT AS taken, times
FROM (SELECT *, (CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END END)::BIGINT AS times FROM placed)
"""
