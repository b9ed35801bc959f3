"""Factorizations: principal components and hierarchical Poisson factors."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.operators.stats import digamma, lgamma

#: Genes up to which the genes x genes matrix is summed (128 MB on the driver); beyond, its leading subspace is iterated.
GRAM_GENES = 4_000
#: Extra directions of the iteration, its end by the change of variances, and its most rounds.
EXTRA, SETTLED, MOST_ROUNDS = 20, 1e-7, 60


@dataclass
class Components:
    """Loadings (genes x components, largest variance first), gene means, and variances."""

    genes: list
    mean: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray


def summed_rows(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of partial matrices given as (i, row) rows, added up row by row on the executors."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [frame["i"].iloc[0]], "row": [np.sum(np.stack(frame["row"].to_list()), axis=0)]})

    found = parts.groupBy("i").applyInPandas(add, "i long, row array<double>").toPandas().sort_values("i")
    return np.stack(found["row"].to_list()) if len(found) else np.zeros((0, width))


def signed(loadings: np.ndarray) -> np.ndarray:
    """A fixed sign: the largest loading of each component is positive."""
    if not loadings.size:
        return loadings
    return loadings * np.where(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])] < 0, -1, 1)


def solved(genes: list, n_cells: int, k: int, batches, rows: DataFrame, gram_genes: int) -> Components:
    """Components from ``batches(frame)``, dense matrices (cells x genes) of whole cells made from batches of ``rows``.

    Up to ``gram_genes`` the Gram matrix is summed. Beyond, a subspace is multiplied by it again and
    again, cells staying where they are, until its variances settle; the driver then holds genes by
    components.
    """
    size = len(genes)

    def multiplied(by: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The Gram matrix, or its product with ``by``, and the column sums."""
        width = size if by is None else by.shape[1]

        def run(frames):
            total, first = np.zeros((size, width)), np.zeros(size)
            for frame in frames:
                for dense in batches(frame):
                    total += dense.T @ (dense if by is None else dense @ by)
                    first += dense.sum(0)
            yield pd.DataFrame({"i": np.arange(size), "row": list(np.column_stack([total, first]))})

        out = summed_rows(rows.mapInPandas(run, "i long, row array<double>"), width + 1)
        return out[:, :-1], out[:, -1]

    if not size:
        return Components(genes, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    if size <= gram_genes:
        total, sums = multiplied(None)
        mean = sums / n_cells
        variance, loadings = np.linalg.eigh(total / n_cells - np.outer(mean, mean))
        order = np.argsort(variance)[::-1][:k]
        return Components(genes, mean, signed(loadings[:, order]), variance[order])
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(size, min(size, k + EXTRA))))[0]
    before = None
    for _ in range(MOST_ROUNDS):
        total, sums = multiplied(basis)
        mean = sums / n_cells
        image = total / n_cells - np.outer(mean, mean @ basis)
        variance, turn = np.linalg.eigh(basis.T @ image)
        order = np.argsort(variance)[::-1][:k]
        variance, loadings = variance[order], basis @ turn[:, order]
        if before is not None and np.abs(variance - before).max() <= SETTLED * max(variance[0], 1e-300):
            break
        before, basis = variance, np.linalg.qr(image)[0]
    return Components(genes, mean, signed(loadings), variance)


def listed_genes(values: DataFrame) -> list:
    return [r[0] for r in values.select("gene").distinct().orderBy("gene").collect()]


def pca(values: DataFrame, n_cells: int, k: int, value: str = "v", gram_genes: int = GRAM_GENES) -> Components:
    """Components of a sparse matrix (cell, gene, value), zeros included, of any number of genes."""
    genes = listed_genes(values)
    place = {g: i for i, g in enumerate(genes)}
    size, step = len(genes), max(1, 4_000_000 // max(len(genes), 1))
    rows = values.groupBy("cell").agg(F.collect_list("gene").alias("g"), F.collect_list(value).alias("v")).select("g", "v")

    def batches(frame: pd.DataFrame):
        for at in range(0, len(frame), step):
            part = frame.iloc[at : at + step]
            dense = np.zeros((len(part), size))
            for i, (g, v) in enumerate(zip(part["g"], part["v"], strict=True)):
                dense[i, [place[x] for x in g]] = v
            yield dense

    return solved(genes, n_cells, k, batches, rows, gram_genes)


def residual_pca(entries: DataFrame, totals: DataFrame, k: int, theta: float = 100.0, gram_genes: int = GRAM_GENES) -> tuple[Components, DataFrame]:
    """Components of Pearson residuals, clipped at the root of the number of cells, and (cell, pca) of all cells.

    ``entries`` (cell, gene, x) of the selected genes, ``totals`` (cell, total) over all genes of
    every cell. Residuals of zeros are not zero, so batches of whole cells are made dense, one
    after another, and never stored.
    """
    by_gene = entries.groupBy("gene").agg(F.sum("x").alias("s")).orderBy("gene").collect()
    genes, share = [r["gene"] for r in by_gene], np.array([r["s"] for r in by_gene], float)
    n_cells, grand = totals.agg(F.count("*"), F.sum("total")).first()
    share, limit, place = share / max(float(grand or 0), 1e-300), math.sqrt(max(n_cells, 1)), {g: i for i, g in enumerate(genes)}
    size, step = len(genes), max(1, 4_000_000 // max(len(genes), 1))
    packed = entries.groupBy("cell").agg(F.collect_list("gene").alias("g"), F.collect_list(F.col("x").cast("double")).alias("v"))
    rows = totals.select("cell", F.col("total").cast("double").alias("total")).join(packed, "cell", "left")

    def batches(frame: pd.DataFrame):
        for at in range(0, len(frame), step):
            part = frame.iloc[at : at + step]
            dense = np.zeros((len(part), size))
            for i, (g, v) in enumerate(zip(part["g"], part["v"], strict=True)):
                if g is not None:
                    dense[i, [place[x] for x in g]] = v
            mean = part["total"].to_numpy(float)[:, None] * share[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.where(mean > 0, (dense - mean) / np.sqrt(mean + mean**2 / theta), 0.0)
            yield np.clip(r, -limit, limit)

    found = solved(genes, n_cells, min(k, size), batches, rows.select("total", "g", "v"), gram_genes)

    def coordinates(frames):
        for frame in frames:
            at = 0
            for dense in batches(frame):
                own = frame["cell"].iloc[at : at + len(dense)]
                yield pd.DataFrame({"cell": own.to_numpy(), "pca": list((dense - found.mean) @ found.loadings)})
                at += len(dense)

    return found, rows.mapInPandas(coordinates, "cell long, pca array<double>")


def project(values: DataFrame, cells: DataFrame, parts: Components, value: str = "v") -> DataFrame:
    """(cell, pca): coordinates of every cell, zeros included, by a join with the loadings."""
    k = parts.loadings.shape[1]
    if not k:
        return cells.select("cell", F.array().cast("array<double>").alias("pca"))
    table = cells.sparkSession.createDataFrame(pd.DataFrame({"gene": parts.genes, "w": parts.loadings.tolist()}), "gene long, w array<double>")
    shift = parts.mean @ parts.loadings
    sums = values.join(table, "gene").groupBy("cell").agg(*[F.sum(F.col(value) * F.col("w")[i]).alias(f"c{i}") for i in range(k)])
    out = cells.select("cell").join(sums, "cell", "left").fillna(0.0)
    return out.select("cell", F.array(*[F.col(f"c{i}") - float(shift[i]) for i in range(k)]).alias("pca"))


def significant(projected: DataFrame, k: int, alpha: float = 0.1) -> list[int]:
    """Components whose distribution differs from the one before by a Kolmogorov-Smirnov test; the first is always kept; (0, 1) if too few are left."""
    from cellgrid.operators.stats import ks_distance

    long = projected.select("cell", F.posexplode("pca").alias("c", "x"))
    a = long.select(F.col("c").alias("pair"), F.lit("A").alias("side"), "x").filter(F.col("pair") < k - 1)
    b = long.select((F.col("c") - 1).alias("pair"), F.lit("B").alias("side"), "x").filter("pair >= 0")
    n = projected.count()
    p = {r["pair"]: 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * r["d"] ** 2 * n / 2) for j in range(1, 101)) for r in ks_distance(a.unionByName(b), "pair", "side", "x").collect()}
    kept = [0] + [c + 1 for c in sorted(p) if p[c] < alpha]
    return kept if len(kept) > 1 else [0, 1]


#: Entries times factors up to which the Poisson factors are fitted in one task (about 500 MB).
FACTOR_VALUES = 10_000_000
#: Genes times factors up to which the genes' side is held by the driver and sent to each task, and entries times factors of a block of cells.
GENE_VALUES, BLOCK_VALUES = 100_000, 1_000_000


@dataclass
class PoissonFactors:
    """Shapes and rates of the factors' gamma distributions, as tables (id, shape, rate) of arrays, and the log-likelihoods met."""

    theta: DataFrame
    beta: DataFrame
    likelihood: list[float]


def _shape_rate(ids: DataFrame, k: int, seed: int, shape: float, rate: float) -> DataFrame:
    """Starting values: U(.5, 1.5) times the prior, from a hash of the id."""
    from cellgrid.operators.qc import HASH_RANGE, hashed

    u = lambda j, s: hashed(F.col("id") * 128 + (2 * j + s), seed) / HASH_RANGE + 0.5
    return ids.select("id", F.array(*[u(j, 1) * shape for j in range(k)]).alias("shape"), F.array(*[u(j, 2) * rate for j in range(k)]).alias("rate"), F.lit(None).cast("double").alias("cap"))


def hpf(entries: DataFrame, k: int, folder: str, max_iter: int = 200, min_iter: int = 10, interval: int = 10, epsilon: float = 1e-3, a: float = 0.3, b: float = 0.3, c: float = 0.3, d: float = 0.3, seed: int = 1, beta: DataFrame | None = None, one_task: int = FACTOR_VALUES, gene_values: int = GENE_VALUES) -> PoissonFactors:
    """Hierarchical Poisson factors of the nonzero entries (cell, gene, x) by coordinate ascent.

    Up to ``one_task`` entries times factors all rounds run in numpy, in one task. Beyond, while genes times
    factors are at most ``gene_values``, cells are dealt to tasks with their entries and each round
    sends the genes' side to them. Beyond that too, each round joins the entries with the two parameter
    tables, splits every count over the factors, and sums by cell and by gene. What a round makes is
    written to ``folder``, which cuts the lineage. With ``beta`` given, only the cells' side is fitted.
    """
    spark = entries.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = f"{folder}/hpf-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def prior(key: str, scale: float) -> float:
        sums = entries.groupBy(key).agg(F.sum("x").alias("s")).agg(F.avg("s").alias("m"), F.var_pop("s").alias("v")).first()
        return scale * sums["m"] / max(sums["v"], 1e-12)

    bp, dp = prior("cell", b), prior("gene", d)
    kappa, tau = b + k * a, d + k * c
    theta = kept(_shape_rate(entries.select(F.col("cell").alias("id")).distinct(), k, seed, a, b))
    items = beta if beta is not None else kept(_shape_rate(entries.select(F.col("gene").alias("id")).distinct(), k, seed + 1, c, d))
    mean = lambda t, side: F.aggregate(F.zip_with(t["shape"], t["rate"], lambda s, r: s / r), F.lit(0.0), lambda p, q: p + q).alias(side)

    def column_means(t: DataFrame) -> list[float]:
        return list(t.agg(*[F.sum(F.col("shape")[j] / F.col("rate")[j]) for j in range(k)]).first())

    def updated(side: DataFrame, sums: DataFrame, key: str, shape: float, capped: float, prior_rate: float, other: list[float], first: float) -> DataFrame:
        """New shapes and rates; ``cap`` is the rate of the id's own prior."""
        t = side.join(sums.withColumnRenamed(key, "id"), "id", "left").withColumn("cap", F.coalesce("cap", F.lit(first)))
        shapes = F.array(*[shape + F.coalesce(F.col(f"y{j}"), F.lit(0.0)) for j in range(k)])
        rates = F.transform(F.array(*map(F.lit, other)), lambda o: F.lit(capped) / F.col("cap") + o)
        t = t.select("id", shapes.alias("shape"), rates.alias("rate"))
        return t.withColumn("cap", F.lit(shape / shape) * prior_rate + mean(t, "m"))

    likelihood: list[float] = []
    shared = (a, c, kappa, tau, b / bp, d / dp, bp, dp), (max_iter, min_iter, interval, epsilon)
    if entries.count() * k <= one_task:
        return _hpf_in_one_task(entries, theta, items, kept, beta is None, *shared)
    if items.count() * k <= gene_values:
        return _hpf_by_cells(entries, theta, items, kept, beta is None, k, *shared)
    log_part = lambda t, n: F.transform(F.arrays_zip(t["shape"], t["rate"]), lambda z: digamma(z["shape"]) - F.log(z["rate"])).alias(n)
    rate_part = lambda t, n: F.transform(F.arrays_zip(t["shape"], t["rate"]), lambda z: z["shape"] / z["rate"]).alias(n)
    for step in range(1, max_iter + 1):
        def split(u: DataFrame, i: DataFrame) -> DataFrame:
            met = entries.join(u.select(F.col("id").alias("cell"), log_part(u, "lu")), "cell").join(i.select(F.col("id").alias("gene"), log_part(i, "li")), "gene")
            logs = F.zip_with("lu", "li", lambda p, q: p + q)
            met = met.withColumn("phi", logs).withColumn("top", F.array_max("phi")).withColumn("phi", F.transform("phi", lambda p: F.exp(p - F.col("top"))))
            return met.withColumn("all", F.aggregate("phi", F.lit(0.0), lambda p, q: p + q)).withColumn("y", F.transform("phi", lambda p: F.col("x") * p / F.col("all")))

        sums = lambda met, key: met.groupBy(key).agg(*[F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(k)])
        met = split(theta, items)
        by_cell, by_gene = sums(met, "cell"), sums(met, "gene")
        new_theta = kept(updated(theta, by_cell, "cell", a, kappa, b / bp, column_means(items), bp))
        if beta is None:
            items = kept(updated(items, by_gene, "gene", c, tau, d / dp, column_means(new_theta), dp))
        theta = new_theta
        if step % interval == 0 or step == max_iter:
            fit = entries.join(theta.select(F.col("id").alias("cell"), rate_part(theta, "tu")), "cell").join(items.select(F.col("id").alias("gene"), rate_part(items, "ti")), "gene")
            s = F.aggregate(F.zip_with("tu", "ti", lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
            likelihood.append(fit.agg(F.sum(F.col("x") * F.log(s) - s - lgamma(F.col("x") + 1))).first()[0])
            if len(likelihood) > 1 and step >= min_iter and (likelihood[-1] - likelihood[-2]) / abs(likelihood[-2]) < epsilon:
                break
    return PoissonFactors(theta, items, likelihood)


def _np_digamma(x: np.ndarray) -> np.ndarray:
    """The series of ``stats.digamma``."""
    y = x + 8
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - sum(1 / (x + j) for j in range(8))


def _hpf_in_one_task(entries: DataFrame, theta: DataFrame, items: DataFrame, kept, both: bool, prior: tuple, ends: tuple) -> PoissonFactors:
    """The same rounds on a table of bounded size: it goes to one task together with the starting values."""
    a, c, kappa, tau, cell_rate, gene_rate, cell_first, gene_first = prior
    max_iter, min_iter, interval, epsilon = ends
    start = lambda t, key: t.select(F.col("id").alias(key), F.struct("shape", "rate", F.coalesce("cap", F.lit(cell_first if key == "cell" else gene_first)).alias("cap")).alias(f"of_{key}"))
    met = entries.select("cell", "gene", "x").join(start(theta, "cell"), "cell").join(start(items, "gene"), "gene").withColumn("all", F.lit(1))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame["x"].to_numpy(float)
        sides = []
        for key in ("cell", "gene"):
            ids, first, at = np.unique(frame[key].to_numpy(), return_index=True, return_inverse=True)
            own = frame[f"of_{key}"].iloc[first]
            sides.append([ids, at, *(np.array([r[n] for r in own], float) for n in ("shape", "rate", "cap"))])
        (cells, u, ts, tr, tc), (genes, i, bs, br, bc) = sides
        k, constant, seen = ts.shape[1], sum(map(math.lgamma, x + 1)), []
        summed = lambda at, y, n: np.column_stack([np.bincount(at, y[:, j], n) for j in range(k)])
        for step in range(1, max_iter + 1):
            phi = (_np_digamma(ts) - np.log(tr))[u] + (_np_digamma(bs) - np.log(br))[i]
            phi = np.exp(phi - phi.max(1, keepdims=True))
            y = x[:, None] * phi / phi.sum(1, keepdims=True)
            ts, tr = a + summed(u, y, len(cells)), kappa / tc[:, None] + (bs / br).sum(0)
            tc = cell_rate + (ts / tr).sum(1)
            if both:
                bs, br = c + summed(i, y, len(genes)), tau / bc[:, None] + (ts / tr).sum(0)
                bc = gene_rate + (bs / br).sum(1)
            if step % interval == 0 or step == max_iter:
                s = ((ts / tr)[u] * (bs / br)[i]).sum(1)
                seen.append(float((x * np.log(s) - s).sum() - constant))
                if len(seen) > 1 and step >= min_iter and (seen[-1] - seen[-2]) / abs(seen[-2]) < epsilon:
                    break
        rows = [("cell", int(n), s.tolist(), r.tolist(), float(p)) for n, s, r, p in zip(cells, ts, tr, tc, strict=True)]
        rows += [("gene", int(n), s.tolist(), r.tolist(), float(p)) for n, s, r, p in zip(genes, bs, br, bc, strict=True)]
        return pd.DataFrame([*rows, ("likelihood", 0, seen, [], 0.0)], columns=["side", "id", "shape", "rate", "cap"])

    found = kept(met.groupBy("all").applyInPandas(run, "side string, id long, shape array<double>, rate array<double>, cap double"))
    side = lambda name: found.filter(F.col("side") == name).select("id", "shape", "rate", "cap")
    seen = found.filter("side = 'likelihood'").select("shape").first()
    # With given items, those that no entry has are kept too.
    return PoissonFactors(side("cell"), side("gene") if both else items, list(seen["shape"]) if seen else [])


def _hpf_by_cells(entries: DataFrame, theta: DataFrame, items: DataFrame, kept, both: bool, k: int, prior: tuple, ends: tuple) -> PoissonFactors:
    """The same rounds with the cells' side in blocks of cells with their entries, and the genes' side on the driver.

    A round is one pass over the blocks, without a shuffle of entries: a task updates its cells and
    leaves the sums of their split counts by gene and of their factors, from which the driver updates
    the genes' side. The likelihood of a round is taken by the next pass, which meets its sides
    anyway. A round's files are removed when the second one after it has been written.
    """
    spark = entries.sparkSession
    a, c, kappa, tau, cell_rate, gene_rate, cell_first, gene_first = prior
    max_iter, min_iter, interval, epsilon = ends
    first = items.select("id", "shape", "rate", F.coalesce("cap", F.lit(gene_first)).alias("cap")).orderBy("id").toPandas()  # at most GENE_VALUES
    genes = first["id"].to_numpy()
    bs, br = (np.array(first[name].tolist(), float).reshape(-1, k) for name in ("shape", "rate"))
    bc = first["cap"].to_numpy(float)[:, None]
    n_blocks = max(1, entries.count() * k // BLOCK_VALUES)
    fields = "cells binary, u binary, i binary, x binary, shape binary, rate binary, cap binary, sums array<double>"  # numbers as numpy lays them out
    names = [f.split()[0] for f in fields.split(", ")]
    of = lambda v, kind=np.float64: np.frombuffer(v, kind)

    def pack(own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=names)
        own, met = own.sort_values("id"), met[np.isin(met["gene"].to_numpy(), genes)].sort_values(["cell", "gene"])
        cells = own["id"].to_numpy()
        u, i = np.searchsorted(cells, met["cell"].to_numpy()), np.searchsorted(genes, met["gene"].to_numpy())
        flat = lambda name: np.concatenate(own[name].to_list()).astype(float)
        parts = (cells.astype(np.int64), u.astype(np.int32), i.astype(np.int32), met["x"].to_numpy(float), flat("shape"), flat("rate"), np.full(len(own), cell_first))
        return pd.DataFrame([(*(v.tobytes() for v in parts), np.zeros(0))], columns=names)

    def dealt(df: DataFrame, key: str) -> DataFrame:
        block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
        return df.filter(F.col(key).isNotNull()).withColumn("block", block).repartition(n_blocks, "block").groupBy("block")

    counts = entries.select("cell", "gene", F.col("x").cast("double").alias("x")).filter("gene IS NOT NULL")
    now = kept(dealt(theta.select("id", "shape", "rate"), "id").cogroup(dealt(counts, "cell")).applyInPandas(pack, fields))

    def passed(sent, fitted: bool):
        def run(frames):
            bs, br = sent
            log_b, mean_b = _np_digamma(bs) - np.log(br), bs / br
            for frame in frames:
                for r in frame.itertuples(index=False):
                    u, i, x, n = of(r.u, np.int32), of(r.i, np.int32), of(r.x), len(r.cells) // 8
                    ts, tr, tc = (of(v).reshape(n, -1) for v in (r.shape, r.rate, r.cap))
                    fit = 0.0
                    if fitted:
                        s = ((ts / tr)[u] * mean_b[i]).sum(1)
                        fit = float((x * np.log(s) - s).sum())
                    phi = (_np_digamma(ts) - np.log(tr))[u] + log_b[i]
                    phi = np.exp(phi - phi.max(1, keepdims=True))
                    y = x[:, None] * phi / phi.sum(1, keepdims=True)
                    ts = a + np.column_stack([np.bincount(u, y[:, j], n) for j in range(k)])
                    tr = kappa / tc + mean_b.sum(0)
                    tc = cell_rate + (ts / tr).sum(1, keepdims=True)
                    by_gene = np.column_stack([np.bincount(i, y[:, j], len(bs)) for j in range(k)])
                    sums = np.concatenate([by_gene.ravel(), (ts / tr).sum(0), [fit]])
                    yield pd.DataFrame([(r.cells, r.u, r.i, r.x, ts.tobytes(), tr.tobytes(), tc.tobytes(), sums)], columns=names)

        return run

    def removed(df: DataFrame) -> None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    constant = counts.join(items.select(F.col("id").alias("gene")), "gene", "left_semi").agg(F.sum(lgamma(F.col("x") + 1))).first()[0] or 0.0
    likelihood: list[float] = []
    for step in range(1, max_iter + 2):
        fitted = step > 1 and ((step - 1) % interval == 0 or step - 1 == max_iter)
        after = kept(now.mapInPandas(passed((bs, br), fitted), fields))
        found = after.select(F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum("s").alias("s")).orderBy("place").toPandas()["s"].to_numpy(float)
        if fitted:
            likelihood.append(float(found[-1] - constant))
            settled = len(likelihood) > 1 and step - 1 >= min_iter and (likelihood[-1] - likelihood[-2]) / abs(likelihood[-2]) < epsilon
            if settled or step - 1 == max_iter:
                removed(after)
                break
        removed(now)
        now = after
        if both:
            bs, br = c + found[: bs.size].reshape(bs.shape), tau / bc + found[bs.size : -1]
            bc = gene_rate + (bs / br).sum(1, keepdims=True)

    def unpacked(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                yield pd.DataFrame({"id": of(r.cells, np.int64), "shape": list(of(r.shape).reshape(-1, k)), "rate": list(of(r.rate).reshape(-1, k)), "cap": of(r.cap)})

    state = "id long, shape array<double>, rate array<double>, cap double"
    cells = now.select("cells", "shape", "rate", "cap").mapInPandas(unpacked, state)
    if both:
        items = spark.createDataFrame(pd.DataFrame({"id": genes, "shape": bs.tolist(), "rate": br.tolist(), "cap": bc[:, 0]}), state)
    return PoissonFactors(cells, items, likelihood)


def explained(found: PoissonFactors, k: int) -> list[int]:
    """Components by the share of all expected counts that they explain, the largest first."""
    sums = lambda t: np.array(t.agg(*[F.sum(F.col("shape")[j] / F.col("rate")[j]) for j in range(k)]).first(), float)
    return [int(j) for j in np.argsort(-(sums(found.theta) * sums(found.beta)), kind="stable")]


def ordered(found: PoissonFactors, k: int) -> PoissonFactors:
    """The same factors with their components in the order of ``explained``."""
    order = explained(found, k)
    turned = lambda t: t.select(*[F.array(*[F.col(c)[j] for j in order]).alias(c) if c in ("shape", "rate") else F.col(c) for c in t.columns])
    return PoissonFactors(turned(found.theta), turned(found.beta), found.likelihood)


def expected(t: DataFrame) -> Column:
    return F.zip_with(t["shape"], t["rate"], lambda s, r: s / r)


def component_correlations(factors: DataFrame, k: int, vector: str = "v") -> np.ndarray:
    """Correlations between the components of a table of factor vectors, from sums that the executors make."""

    def sums(frames):
        total, first, n = np.zeros((k, k)), np.zeros(k), 0
        for frame in frames:
            if len(frame):
                x = np.array(frame[vector].tolist(), float)
                total, first, n = total + x.T @ x, first + x.sum(0), n + len(x)
        yield pd.DataFrame({"i": np.arange(k), "row": list(np.column_stack([total, first, np.full(k, float(n))]))})

    found = summed_rows(factors.select(vector).mapInPandas(sums, "i long, row array<double>"), k + 2)
    n, mean = found[0, -1], found[:, -2] / max(found[0, -1], 1)
    cov = found[:, :k] / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(cov / np.outer(sd, sd))


def redundant(beta: np.ndarray, theta: np.ndarray, most_r: float) -> list[int]:
    """Components to drop, from the two factors as matrices of a column for each component."""
    return redundant_by(np.corrcoef(beta.T), np.corrcoef(theta.T), most_r)


def redundant_by(beta: np.ndarray, theta: np.ndarray, most_r: float) -> list[int]:
    """Components to drop: in each group linked by a correlation above ``most_r`` in both factors' correlation matrices, all but the first."""

    def later(correlation: np.ndarray) -> set[int]:
        k = len(correlation)
        root = list(range(k))
        near = correlation > most_r
        for i in range(k):
            for j in range(i):
                if near[i, j]:
                    p, q = root[i], root[j]
                    root = [min(p, q) if r in (p, q) else r for r in root]
        return {i for i in range(k) if root[i] != i}

    return sorted(later(beta) & later(theta))


def permuted(values: DataFrame, cells: DataFrame, seed: int = 31) -> DataFrame:
    """Each gene's values, zeros too, moved to other cells: along one random order of the cells, by a step of the gene's own, round the end.

    Steps of different genes are independent, so what genes had in common is lost, and every gene keeps its values.
    """
    from cellgrid.operators.qc import hashed, numbered

    places = numbered(cells.select("cell"), hashed(F.col("cell"), seed), "cell", "place")
    n = cells.agg(F.count("*").alias("n"))
    moved = values.join(places, "cell").crossJoin(F.broadcast(n)).select("gene", "v", (F.pmod(F.col("place") - 1 + hashed(F.col("gene"), seed + 1), F.col("n")) + 1).alias("place"))
    return moved.join(places, "place").select("cell", "gene", "v")


def harmonized(points: DataFrame, clusters: int = 8, rounds: int = 10, sigma: float = 0.5, ridge: float = 1.0, seed: int = 1, settled: float = 1e-2) -> DataFrame:
    """(id, batch, v) with each batch's shift within soft clusters taken out.

    A round assigns points softly to a fixed number of centres, sums each batch's offsets from the
    centres, weighted and shrunk by ``ridge``, and subtracts them; rounds end when the offsets have
    become small beside the first ones (by ``settled``), or after ``rounds``. Only centres and
    offsets, clusters by batches of them, reach the driver.
    """
    first = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(clusters).collect()
    centre, shifts, first_move = np.array([r["v"] for r in first], float), [], 0.0
    k, width = centre.shape

    def soft(z: np.ndarray, middle: np.ndarray) -> np.ndarray:
        d = ((z[:, None, :] - middle[None]) ** 2).sum(2)
        share = np.exp(-(d - d.min(1, keepdims=True)) / (sigma * max(d.mean(), 1e-12)))
        return share / share.sum(1, keepdims=True)

    def corrected(frame: pd.DataFrame, steps: list) -> np.ndarray:
        z = np.array(frame["v"].tolist(), float).reshape(len(frame), width)
        for middle, offset in steps:
            own = np.array([offset.get(b, np.zeros((k, width))) for b in frame["batch"]])
            z = z - (soft(z, middle)[:, :, None] * own).sum(1)
        return z

    for _ in range(rounds):
        steps, middle = list(shifts), centre.copy()

        def sums(frames, steps=steps, middle=middle):
            for frame in frames:
                z = corrected(frame, steps)
                share = soft(z, middle)
                for batch in frame["batch"].unique():
                    on = (frame["batch"] == batch).to_numpy()
                    yield pd.DataFrame({"batch": batch, "k": np.arange(k), "n": share[on].sum(0), "s": list(share[on].T @ z[on])})

        found = points.mapInPandas(sums, "batch string, k long, n double, s array<double>")
        table = found.groupBy("batch", "k").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width)]).toPandas()
        s, n, offset = np.zeros((k, width)), np.zeros(k), {}
        for r in table.itertuples(index=False):
            s[r.k] += r[3:]
            n[r.k] += r.n
        centre = s / np.maximum(n, 1e-12)[:, None]
        for r in table.itertuples(index=False):
            offset.setdefault(r.batch, np.zeros((k, width)))[r.k] = (np.array(r[3:]) - r.n * centre[r.k]) / (r.n + ridge)
        shifts.append((middle, offset))
        moved = math.sqrt(sum(float((o**2).sum()) for o in offset.values()))
        first_move = moved if len(shifts) == 1 else first_move
        if moved <= settled * first_move:
            break

    final = list(shifts)

    def apply(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "batch": frame["batch"], "v": list(corrected(frame, final))})

    return points.select("id", F.col("batch").cast("string").alias("batch"), "v").mapInPandas(apply, "id long, batch string, v array<double>")


def support_vector_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, gamma: float, cost: float = 1.0, tube: float = 0.1, sweeps: int = 2_000, settled: float = 1e-6) -> np.ndarray:
    """Coefficients of the points in an RBF regression with a tube of no loss, by descent along one coefficient after another.

    Each coefficient is held to ``cost`` times its point's weight. A constant in the kernel stands for the offset.
    """
    kernel = np.exp(-gamma * (x[:, None] - x[None]) ** 2) + 1
    beta, fit = np.zeros(len(x)), np.zeros(len(x))
    for _ in range(sweeps):
        most = 0.0
        for i in range(len(x)):
            free = beta[i] - (fit[i] - y[i]) / kernel[i, i]
            new = np.sign(free) * max(abs(free) - tube / kernel[i, i], 0.0)
            step = min(max(new, -cost * weight[i]), cost * weight[i]) - beta[i]
            if step:
                beta[i] += step
                fit += step * kernel[i]
                most = max(most, abs(step))
        if most < settled:
            break
    return beta


def variance_trend(moments: DataFrame, bins: int = 200) -> DataFrame:
    """Adds ``score``: log2 CV less its trend over log2 mean, by support vector regression with width gamma = 1000 / genes.

    The regression sees at most ``bins`` mean points, weighted by their genes, however many genes there are.
    """
    ok = moments.filter("mean > 0 AND sd > 0").select("gene", F.log2("mean").alias("m"), F.log2(F.col("sd") / F.col("mean")).alias("cv"))
    low, high, n = ok.agg(F.min("m"), F.max("m"), F.count("*")).first()
    if not n:
        return ok.withColumn("score", F.lit(0.0))
    width = max(high - low, 1e-9) / bins
    table = ok.groupBy(F.least(F.floor((F.col("m") - low) / width), F.lit(bins - 1)).alias("b")).agg(F.avg("m").alias("x"), F.avg("cv").alias("y"), F.count("*").alias("w")).orderBy("b").toPandas()
    x, y, gamma = table["x"].to_numpy(), table["y"].to_numpy(), 1000.0 / n
    middle = float(np.average(y, weights=table["w"]))
    alpha = support_vector_regression(x, y - middle, table["w"].to_numpy(float), gamma)

    @F.pandas_udf("double")
    def trend(m: pd.Series) -> pd.Series:
        return pd.Series((np.exp(-gamma * (m.to_numpy()[:, None] - x[None]) ** 2) + 1) @ alpha + middle)

    return ok.withColumn("score", F.col("cv") - trend("m"))
