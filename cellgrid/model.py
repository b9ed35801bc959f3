"""The annotated sparse matrix: one long table of nonzero entries and two dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CellMatrix:
    """``entries(cell, gene, x, …)`` holds nonzero values only: an absent row is a zero.

    Every operator says whether zeros count; where they do, statistics come from the moments of the
    nonzero entries and the number of cells, never from a filled grid of genes by cells.
    """

    cells: DataFrame
    genes: DataFrame
    entries: DataFrame

    def with_label(self, label: str) -> DataFrame:
        """Entries with the label of their cell."""
        return self.entries.join(self.cells.select("cell", F.col(label).alias("cluster")), "cell")

    def n_cells(self) -> DataFrame:
        """One row: the number of cells."""
        return self.cells.agg(F.count("*").alias("n_cells"))


def scalar(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table."""
    return df.crossJoin(F.broadcast(one))


def div0(a: Column, b: Column) -> Column:
    """a / b, and 0 where the quotient is not finite."""
    finite = (b != 0) & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) != float("inf"))
    return F.when(finite, a / b).otherwise(F.lit(0.0))


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
