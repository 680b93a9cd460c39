"""Tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application below the one that ``spark.checkpoint.dir`` names; a temporary one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def ended(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that have ended.

    It does so once the driver has collected their plans as garbage. A driver that only schedules seldom collects, so the
    files of all steps would lie on the executors' disks to the end.
    """
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder; the steps before it have `ended`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    ended(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` over as many tasks as a shuffle has, from however few files or row groups it is read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of the largest table that one task gets where tables are dealt by their size.
ROWS = 60_000


def dealt_by_size(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt by `keys` over a task for each ROWS of `rows`, so that tasks grow in number and not in size: partitions that
    adaptive execution joins hold 64 MB as they are packed for a shuffle, many times that when they are sorted."""
    return df if rows <= ROWS else df.repartition(-(-rows // ROWS), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join that shuffles it. Files of few bytes may hold many rows, of which a broadcast would put all in each executor."""
    return df.hint("merge")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file or folder, a file also over another one, at once where the store can."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    _, at = _file_system(spark, old)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(at), context.makeQualified(jvm.org.apache.hadoop.fs.Path(new)), options)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small text file of this content, instead of any before it: readers see the old or the new one."""
    fs, at = _file_system(spark, f"{path}-{uuid.uuid4().hex}")
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename(spark, at.toString(), path)


def release(spark: SparkSession) -> None:
    """Deletes every table that this application has written here, once the results read from them are stored."""
    delete(spark, shared_dir(spark))
