"""Helpers shared by the operators: shared-folder staging and Arrow batch kernels."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellgrid.llm import shingles


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).

    Only a local session that names none, as in tests, gets a temporary folder; elsewhere executors
    would each write to their own disk, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cellgrid-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Paths that the open scratch scopes have staged, the innermost scope last.
_SCOPES: list[list[str]] = []


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage."""
    return _written(df, name)[0]


def staged(df: DataFrame, name: str, up: int = 0) -> DataFrame:
    """The same for an operator's own use: removed at the end of the innermost scratch scope, or of one ``up`` levels further out, if there is one."""
    out, path = _written(df, name)
    if len(_SCOPES) > up:
        _SCOPES[-1 - up].append(path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was staged inside it: for results that have been written, or intermediates that nothing reads any more."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


#: Rows that a kernel sees at once, and that an Arrow batch holds: both sides of the pipe keep buffers of its size.
PIECE = 1_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def give_back() -> None:
    """Return a Python worker's free memory to the system: workers outlive their partition, idle beside those of the next stage."""
    shingles.HASHES.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """Apply a function of Arrow rows to all rows of ``df``, in pieces, which bounds what a worker holds besides its batch.

    Batches are cut when a plan runs, by a setting of the session: it is lowered here, and a lower one of the user's stays.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, PIECE):
                    yield kernel(batch.slice(start, PIECE))
        finally:
            give_back()

    if not 0 < int(df.sparkSession.conf.get(BATCH_ROWS)) <= PIECE:
        df.sparkSession.conf.set(BATCH_ROWS, str(PIECE))
    return df.mapInArrow(run, schema)


def utf8_rows(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text of an Arrow column, one at a time; null counts as empty."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores before it as it takes to differ from all of ``columns`` (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
