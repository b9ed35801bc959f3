"""Registry of the engine's queries and of the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: Inventory rows that a query stands for.
COVERS: dict[str, str] = {}

#: Views on the driver's tables that play the matrix and its dimensions, in SQL.
MATRIX_SQL = """
entries AS (
  SELECT o_custkey AS cell, l_partkey AS gene, sum(l_quantity) AS x,
         sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0e0 END) AS unspliced,
         sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0e0 END) AS ad
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
cells AS (
  SELECT c_custkey AS cell, c_mktsegment AS cluster, c_nationkey AS sample, n_regionkey AS region, c_acctbal AS acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
genes AS (SELECT p_partkey AS gene, p_brand AS category, p_type AS chromosome, p_name AS name, p_size AS size FROM part)
"""


def query(name: str, covers: str = "", sql: str | None = None, matrix: bool = False) -> Callable:
    """Register a query; ``matrix`` puts the matrix views before its SQL, whose own views then follow a comma."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        COVERS[name] = covers
        if sql:
            body = sql.strip()
            if matrix:
                body = f"WITH {MATRIX_SQL.strip()}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {MATRIX_SQL.strip()} {body}"
            ORACLES[name] = body
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    from cellgrid.plans import q_aggregates, q_graphs, q_matrix, q_models, q_relational, q_sources, q_statistics, q_streams, q_views, q_workflow  # noqa: F401
