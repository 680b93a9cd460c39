"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Functions sent to workers carry this package's code with them; workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table, read by Spark whatever the store behind the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set for local masters, as in tests; on a cluster the setting
    is required, since a machine-local folder would lose rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once everything read from them is itself written or collected."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if spark.sparkContext.applicationId in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes every table that this application wrote with `written`; call it once the results are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run within hand at most `rows` rows at a time to Python workers, which bounds what both sides hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker, idle until its next task, gives back what its Arrow pool has free."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return mapped


def let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once per row however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(vector_col: str) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    c = F.col(vector_col)
    return F.coalesce(c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrow lists of `width` numbers each as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def schema_with(df: DataFrame, **added: str | DataType) -> StructType:
    """The schema of `df` and the columns added to it."""
    out = StructType(list(df.schema.fields))
    for name, kind in added.items():
        out = out.add(name, kind)
    return out
