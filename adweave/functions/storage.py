"""Where results between jobs are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's tables, so that ``release`` can remove them.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a folder
    of our own is taken under a local master, as in tests; under any other master
    this is an error, because executors don't see the driver's folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("adweave.own.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="adweave-")
        spark.conf.set("adweave.own.checkpoint.dir", path)
    return path


def _new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back.

    This cuts the lineage: what follows survives a lost executor without
    running the earlier steps again, and is planned on a columnar table.
    """
    path = _new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_dealt(df: DataFrame, label: str, key: str, parts: int) -> DataFrame:
    """Like ``materialise``, but bucketed: what then groups or joins by ``key`` needs no shuffle.

    With ``parts`` a multiple of the session's shuffle partitions, rows that are
    dealt by ``key`` already go to few files a task.  The catalog holds the table
    only until it has been resolved; its files are read by path.
    """
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, key).option("path", _new_path(spark, label)).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  # resolves the table
    spark.sql(f"DROP TABLE {name}")  # an external table: the files stay
    return out


def release(spark: SparkSession) -> None:
    """Remove the tables that ``materialise`` has written in this process.

    For callers who have written their results: DataFrames that still read
    such a table fail afterwards.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
