"""Quality control and normalization of cells and genes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.model import CellMatrix, div0, scalar

HASH_RANGE = 2147483647
#: Distinct cell totals up to which they are sent to every task (16 MB).
MOST_LEVELS = 1_000_000


def cell_totals(entries: DataFrame) -> DataFrame:
    """Total count and number of expressed genes of each cell that has any entry."""
    return entries.groupBy("cell").agg(F.sum("x").alias("total"), F.count_if(F.col("x") != 0).alias("n_genes"))


def mean_total(m: CellMatrix) -> DataFrame:
    """One row: the mean total of a cell, and the reference's figure, which is divided by the number of cells once more."""
    totals = m.cells.select("cell").join(cell_totals(m.entries), "cell", "left").fillna(0.0, ["total"])
    return totals.agg(F.avg("total").alias("mean_total"), (F.avg("total") / F.count("*")).alias("mean_total_again"))


def valid_genes(m: CellMatrix, least: int = 10, most_share: float = 0.6) -> DataFrame:
    """nnz of every gene, and whether it is above ``least`` and below ``most_share`` of the cells."""
    nnz = m.entries.filter("x <> 0").groupBy("gene").agg(F.count("*").alias("nnz"))
    counted = scalar(m.genes.select("gene").join(nnz, "gene", "left").fillna(0, ["nnz"]), m.n_cells())
    return counted.select("gene", "nnz", ((F.col("nnz") > least) & (F.col("nnz") < F.col("n_cells") * most_share)).alias("valid"))


def category_ratio(m: CellMatrix, names: tuple[str, ...]) -> DataFrame:
    """Share of each cell's total in genes of the first chromosome name that any gene has (names are tried in order)."""
    ranked = m.genes.withColumn("try", F.array_position(F.array(*map(F.lit, names)), F.col("chromosome"))).filter("try > 0")
    chosen = ranked.join(F.broadcast(ranked.agg(F.min("try").alias("best"))), F.col("try") == F.col("best"))
    inside = m.entries.join(chosen.select("gene", F.lit(True).alias("inside")), "gene", "left")
    sums = inside.groupBy("cell").agg(F.sum(F.when(F.col("inside"), F.col("x")).otherwise(0.0)).alias("part"), F.sum("x").alias("total"))
    return sums.select("cell", div0(F.col("part"), F.col("total")).alias("ratio"))


def layer_ratio(entries: DataFrame, layer: str) -> DataFrame:
    """Share of a layer in each cell's total."""
    sums = entries.groupBy("cell").agg(F.sum(layer).alias("part"), F.sum("x").alias("total"))
    return sums.select("cell", div0(F.col("part"), F.col("total")).alias("ratio"))


def cell_quality(m: CellMatrix, mito: tuple[str, ...], layer: str = "unspliced") -> DataFrame:
    """total, n_genes, mito_ratio and unspliced_ratio of each cell, in one pass over the entries."""
    ranked = m.genes.withColumn("try", F.array_position(F.array(*map(F.lit, mito)), F.col("chromosome"))).filter("try > 0")
    chosen = ranked.join(F.broadcast(ranked.agg(F.min("try").alias("best"))), F.col("try") == F.col("best"))
    inside = m.entries.join(chosen.select("gene", F.lit(True).alias("inside")), "gene", "left")
    sums = inside.groupBy("cell").agg(
        F.sum("x").alias("total"), F.count_if(F.col("x") != 0).alias("n_genes"), F.sum(F.when(F.col("inside"), F.col("x")).otherwise(0.0)).alias("mt"), F.sum(layer).alias("us")
    )
    return sums.select("cell", "total", "n_genes", div0(F.col("mt"), F.col("total")).alias("mito_ratio"), div0(F.col("us"), F.col("total")).alias("unspliced_ratio"))


def passes(quality: DataFrame, min_umis: float, max_mito: float, min_unspliced: float) -> Column:
    """The conjunction of a cell's quality limits."""
    return (F.col("total") >= min_umis) & (F.col("mito_ratio") < max_mito) & (F.col("unspliced_ratio") > min_unspliced)


def sample_gate(cells: DataFrame, good: Column, min_fraction: float) -> DataFrame:
    """Samples whose share of good cells is above the least one."""
    share = cells.groupBy("sample").agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"))
    return share.withColumn("kept", F.col("n_good") / F.col("n") > min_fraction)


def qc_report(m: CellMatrix, params: dict, mito: tuple[str, ...] = ("MT", "chrM")) -> DataFrame:
    """(sample, n, mean_umi, passed, status): samples pass by their mean total; a warning says that too few cells are within a limit."""
    quality = m.cells.join(cell_totals(m.entries).select("cell", "total"), "cell", "left").fillna(0.0, ["total"]).withColumn("mt", F.lit(1)).withColumn("us", F.lit(1))
    if "chromosome" in m.genes.columns:
        ratio = category_ratio(m, mito).select("cell", (F.col("ratio") < params["max_fraction_MT_genes"]).cast("int").alias("mt"))
        quality = quality.drop("mt").join(ratio, "cell", "left").fillna(1, ["mt"])
    if "unspliced" in m.entries.columns:
        ratio = layer_ratio(m.entries, "unspliced").select("cell", (F.col("ratio") > params["min_fraction_unspliced_reads"]).cast("int").alias("us"))
        quality = quality.drop("us").join(ratio, "cell", "left").fillna(0, ["us"])
    if "sample" not in quality.columns:
        quality = quality.withColumn("sample", F.lit("all"))
    per = quality.groupBy("sample").agg(F.count("*").alias("n"), F.avg("total").alias("mean_umi"), F.avg("mt").alias("mt"), F.avg("us").alias("us"))
    least, passed = 1 - params["min_fraction_good_cells"], F.col("mean_umi") >= params["min_umis"]
    status = F.when(~passed, "failed").when(F.col("mt") < least, "warn mitochondrial").when(F.col("us") < least, "warn unspliced").otherwise("passed")
    return per.select("sample", "n", "mean_umi", passed.alias("passed"), status.alias("status"))


def normalized(m: CellMatrix) -> DataFrame:
    """entries with v = log2(x / total * median total + 1); zeros stay 0, so they need no row."""
    totals = cell_totals(m.entries)
    level = totals.agg(F.median("total").alias("level"))
    return scalar(m.entries.join(totals.select("cell", "total"), "cell"), level).withColumn("v", F.log2(div0(F.col("x"), F.col("total")) * F.col("level") + 1))


def gene_moments(entries: DataFrame, value: str, n_cells: DataFrame) -> DataFrame:
    """Mean and population standard deviation of each gene over all cells, zeros included, from sparse sums."""
    sums = scalar(entries.groupBy("gene").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss")), n_cells)
    mean = F.col("s") / F.col("n_cells")
    return sums.select("gene", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n_cells") - mean * mean, F.lit(0.0))).alias("sd"))


def standardized(m: CellMatrix, standardize: bool = True) -> DataFrame:
    """Normalized entries less their gene's mean, optionally divided by its deviation. Zeros become -mean (/ sd), which is left implicit."""
    v = normalized(m)
    z = v.join(gene_moments(v, "v", m.n_cells()), "gene")
    centred = F.col("v") - F.col("mean")
    return z.withColumn("z", div0(centred, F.col("sd")) if standardize else centred)


def log_per_ten_million(entries: DataFrame) -> DataFrame:
    """ln(x / (total / 10e6) + 1): the reference's constant stands for ten million."""
    return entries.join(cell_totals(entries).select("cell", "total"), "cell").withColumn("v", F.log1p(div0(F.col("x"), F.col("total") / 10e6)))


def residuals(m: CellMatrix, theta: float = 100.0) -> DataFrame:
    """Pearson residuals of the nonzero entries."""
    e = F.col("total") * F.col("gene_total") / F.col("grand")
    return with_totals(m).withColumn("e", e).withColumn("r", (F.col("x") - F.col("e")) / F.sqrt(F.col("e") + F.col("e") * F.col("e") / theta))


def with_totals(m: CellMatrix) -> DataFrame:
    """Entries with the total of their cell, of their gene, and of all."""
    genes = m.entries.groupBy("gene").agg(F.sum("x").alias("gene_total"))
    return scalar(m.entries.join(cell_totals(m.entries).select("cell", "total"), "cell").join(genes, "gene"), m.entries.agg(F.sum("x").alias("grand")))


def deviance(m: CellMatrix, theta: float = 100.0) -> DataFrame:
    """Population variance of each gene's Pearson residuals over all cells, zeros included.

    A zero's residual depends only on its cell's and gene's totals. So the sum over all cells is
    taken over the distinct cell totals, weighted by their cells, once for each distinct gene total,
    and corrected at the nonzero entries; no grid of genes by cells is made. Up to ``MOST_LEVELS``
    distinct cell totals are sent to the tasks, more are joined. Cells without entries have residual 0.
    """
    zero = lambda e: -e / F.sqrt(e + e * e / theta)
    genes = m.entries.groupBy("gene").agg(F.sum("x").alias("gene_total"))
    levels = cell_totals(m.entries).groupBy("total").agg(F.count("*").alias("n_at"))
    grand = m.entries.agg(F.sum("x").alias("grand"))
    sums = genes.select("gene_total").distinct()
    sent = levels.limit(MOST_LEVELS + 1).toPandas()
    if len(sent) <= MOST_LEVELS:
        total, n_at, all_ = sent["total"].to_numpy(float), sent["n_at"].to_numpy(float), float((sent["total"] * sent["n_at"]).sum())

        def zeros(frames):
            for frame in frames:
                z1, z2 = np.zeros(len(frame)), np.zeros(len(frame))
                for k, gene_total in enumerate(frame["gene_total"].to_numpy(float)):
                    e = total * gene_total / all_
                    z = np.divide(-e, np.sqrt(e + e * e / theta), out=np.zeros_like(e), where=e > 0)
                    z1[k], z2[k] = (z * n_at).sum(), (z * z * n_at).sum()
                yield frame.assign(z1=z1, z2=z2)

        kind = sums.schema["gene_total"].dataType.simpleString()
        at = sums.mapInPandas(zeros, f"gene_total {kind}, z1 double, z2 double")
    else:
        grid = scalar(sums.crossJoin(levels), grand).withColumn("z", zero(F.col("total") * F.col("gene_total") / F.col("grand")))
        at = grid.groupBy("gene_total").agg(F.sum(F.col("z") * F.col("n_at")).alias("z1"), F.sum(F.col("z") * F.col("z") * F.col("n_at")).alias("z2"))
    at_zero = genes.join(at, "gene_total").select("gene", "z1", "z2")
    r = residuals(m, theta).withColumn("z", zero(F.col("e")))
    found = r.groupBy("gene").agg(F.sum(F.col("r") - F.col("z")).alias("d1"), F.sum(F.col("r") * F.col("r") - F.col("z") * F.col("z")).alias("d2"))
    both = scalar(at_zero.join(found, "gene"), m.n_cells())
    mean = (F.col("z1") + F.col("d1")) / F.col("n_cells")
    return both.select("gene", ((F.col("z2") + F.col("d2")) / F.col("n_cells") - mean * mean).alias("deviance"))


def top(df: DataFrame, by: str, n: int, key: str = "gene") -> DataFrame:
    return df.orderBy(F.col(by).desc(), key).limit(n)


def hashed(key: Column, seed: int) -> Column:
    """A fixed pseudo-random whole number below 2^31 - 1 that any SQL engine can follow; seeds give unlike orders."""
    h = F.pmod(F.pmod(key, F.lit(HASH_RANGE)) * 1103515245 + seed * 40503, F.lit(HASH_RANGE))
    for add in (seed * 69621 + 1, 11):
        h = F.pmod(h.bitwiseXOR(F.shiftright(h, 15)) * 48271 + add, F.lit(HASH_RANGE))
    return h


def hash_sql(key: str, seed: int | str) -> str:
    """The same in SQL; the seed may be an expression."""
    h = f"((({key}) % {HASH_RANGE}) * 1103515245 + ({seed}) * 40503) % {HASH_RANGE}"
    for add in (f"({seed}) * 69621 + 1", 11):
        h = f"(xor({h}, ({h}) >> 15) * 48271 + {add}) % {HASH_RANGE}"
    return f"({h})"


def numbered(df: DataFrame, key: Column, tie: str, name: str, slice_rows: int = 100_000) -> DataFrame:
    """Adds ``name``: the place, from 1, of each row in the order of ``key`` (below 2^31 - 1, evenly spread) and ``tie``.

    The key's range is cut into slices of about ``slice_rows`` rows: rows are counted inside their
    slice, and slices along their order, so no task holds the table.
    """
    slices = max(1, -(-df.count() // slice_rows))
    cut = df.withColumn("_key", key).withColumn("_slice", F.floor(F.col("_key") * slices / F.lit(HASH_RANGE)).cast("long"))
    sizes = cut.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = sizes.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_slice").orderBy("_key", tie))
    return cut.withColumn("_own", own).join(before, "_slice").withColumn(name, F.col("_before") + F.col("_own")).drop("_key", "_slice", "_before", "_own")


def cap_select(df: DataFrame, label: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """At most ``n`` random rows of each label, without replacement."""
    order = Window.partitionBy(label).orderBy(hashed(F.col(key), seed), key)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def hashes(keys: np.ndarray, seed: int) -> np.ndarray:
    """``hashed`` in numpy."""
    h = (keys % HASH_RANGE * 1103515245 + seed * 40503) % HASH_RANGE
    for add in (seed * 69621 + 1, 11):
        h = ((h ^ (h >> 15)) * 48271 + add) % HASH_RANGE
    return h


def unit_key_sql(cell: str, gene: str, unit: str) -> str:
    """A whole number for each counted molecule, from which its draw is hashed."""
    return f"({hash_sql(cell, 11)} * 65537 + {hash_sql(gene, 12)} * 257 + {unit} * 7919) % {HASH_RANGE}"


def thinned(entries: DataFrame, seed: int = 13) -> DataFrame:
    """Binomial thinning of counts to the smallest total: each counted molecule stays with chance min / total, drawn by its hash.

    Molecules are numbers inside a batch, never rows; entries that lose all are dropped.
    """
    totals = cell_totals(entries).select("cell", "total")
    met = scalar(entries.join(totals, "cell"), totals.agg(F.floor(F.min("total")).alias("least")))
    rows = met.select(*entries.columns, (F.col("least") / F.col("total") * HASH_RANGE).alias("_most"))

    def draw(frames):
        for frame in frames:
            for at in range(0, len(frame), 20_000):
                part = frame.iloc[at : at + 20_000]
                counts = part["x"].to_numpy().astype(np.int64)
                of = np.repeat(np.arange(len(part)), counts)
                unit = np.arange(len(of)) - np.repeat(counts.cumsum() - counts, counts) + 1
                base = hashes(part["cell"].to_numpy(np.int64), 11) * 65537 + hashes(part["gene"].to_numpy(np.int64), 12) * 257
                stay = hashes((base[of] + unit * 7919) % HASH_RANGE, seed) < part["_most"].to_numpy()[of]
                left = np.bincount(of[stay], minlength=len(part)).astype(float)
                yield part.assign(x=left)[left > 0].drop(columns="_most")

    return rows.mapInPandas(draw, entries.schema)
