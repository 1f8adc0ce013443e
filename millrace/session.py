"""Session settings, the shared scratch folder, and shipping of this package to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_rooted: set[str] = set()


def make_session(app: str = "millrace", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session is given from outside."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, whatever their working directory is.

    The sources are zipped once per Spark context into the shared folder and distributed with ``addPyFile``.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.parent.suffix == ".zip":  # already running out of a shipped copy
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, str(path.relative_to(package.parent)))
    target = f"{_application_dir(spark)}/millrace_src.zip"
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    stream = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    stream.write(packed.getvalue())
    stream.close()
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by the cluster in ``spark.checkpoint.dir``.

    Only in local mode (as in tests) a local folder is chosen and set where none is named; on a cluster executors would
    write to folders of their own, so a missing setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def _application_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the driver ends."""
    sc = spark.sparkContext
    root = f"{scratch_dir(spark)}/millrace-{sc.applicationId}"
    if root not in _rooted:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _rooted.add(root)
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage at a table that outlives any executor, keeps columns prunable, and lets several
    consumers read what was computed once. The tables of an application are deleted when its driver ends.
    """
    path = f"{_application_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by name."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
