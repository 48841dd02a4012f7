"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from crashlens.session import staging_path

#: Rows per Arrow batch sent to a Python task. Documents differ a lot in length; a low row
#: count keeps a batch of very long ones within a worker's memory.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MAX_ARROW_ROWS = 1000
PACKAGE_ZIP = "crashlens_package.zip"


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package (once per context), wherever the driver found it."""
    sc = spark.sparkContext
    if PACKAGE_ZIP in {os.path.basename(f) for f in sc._python_includes}:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="crashlens-"), PACKAGE_ZIP)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)  # Spark copies it to every executor


def python_tasks(spark: SparkSession) -> None:
    """Prepare a session for Python tasks: ship the package, and lower the Arrow batch size to
    ``MAX_ARROW_ROWS`` (it is never raised)."""
    ship_package(spark)
    now = int(spark.conf.get(ARROW_ROWS, "10000"))
    if now <= 0 or now > MAX_ARROW_ROWS:
        spark.conf.set(ARROW_ROWS, str(MAX_ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Staging:
    """Intermediate tables of one operator call, as Parquet below the shared checkpoint folder.

    A written table cuts the lineage: when an executor is lost, later stages read the files
    again instead of recomputing what came before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = staging_path(spark, f"{name}-{uuid.uuid4().hex}")
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.tables):03d}-{name}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, table: DataFrame) -> None:
        """Delete the files of a table made here that nothing reads any more."""
        place = next(p for t, p in self.tables if t is table)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column of an Arrow batch as Python strings; null becomes the empty text."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
         for c, f in zip(columns, schema)], schema=schema)

