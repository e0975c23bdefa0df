"""Tables that are written once and read several times, below the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Tables of the catalog that stand for bucketed files, by session.
_named: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in plain local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="pagewarden-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return "file://" + _local["dir"]


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written as Parquet and read back: evaluated once, its lineage cut, safe from lost executors.

    With ``by`` it is a table bucketed by that column, as many buckets as a shuffle has partitions, so
    that a join or aggregation on it need not move it.  The files go when the application ends.
    """
    spark = df.sparkSession
    label = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/pagewarden/{label}"
    if by:
        table = "pagewarden_" + label.replace("-", "_")
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
        if not _named:
            atexit.register(_forget)
        _named.append((spark, table))
        out = spark.table(table)
        out._pagewarden_table = table
    else:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    out._pagewarden_path = path
    return out


def _forget() -> None:
    """Take the names of bucketed tables out of catalogs that outlive the application."""
    while _named:
        spark, table = _named.pop()
        with contextlib.suppress(Exception):  # the session may have ended
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read again, and the names of bucketed ones."""
    for df in tables:
        spark = df.sparkSession
        if table := getattr(df, "_pagewarden_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            _named.remove((spark, table))
        where = spark._jvm.org.apache.hadoop.fs.Path(df._pagewarden_path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application."""
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if _local.get("shipped") == app:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="pagewarden-src-"), "pagewarden.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("pagewarden", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(to)
    _local["shipped"] = app
