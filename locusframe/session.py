"""Session helpers: shipping the package to executors and tables that cut lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_OWN_FOLDER: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker: an archive in the shared folder, added once per application."""
    sc = spark.sparkContext
    if any(x.endswith(f"{_PACKAGE.name}.zip") for x in sc.listFiles):
        return
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    at = f"{shared_folder(spark)}/package-{uuid.uuid4().hex}/{_PACKAGE.name}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(archive.getvalue())
    out.close()
    sc.addPyFile(at)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and the master is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDER:
            _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        at = _OWN_FOLDER[app]
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. What is written there is removed when the application ends."""
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and the table survives lost executors.

    The table stays as long as the application, since results read from it.
    """
    at = fresh_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def local_session(cores: str | None = None, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("locusframe")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
