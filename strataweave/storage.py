"""Code and intermediate tables in places that driver and executors share.

Tables go below spark.checkpoint.dir, in a folder of the application's own: `clean` removes it, a table no plan reads any more goes by `drop`.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_strataweave_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="strataweave-")) / "strataweave_pkg.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((PACKAGE_ROOT / "strataweave").rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE_ROOT))
    sc.addPyFile(str(archive))
    sc._strataweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_strataweave_dir", None):
        sc._strataweave_dir = "file://" + tempfile.mkdtemp(prefix="strataweave-shared-")
    return sc._strataweave_dir


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strataweave/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back: its lineage ends there, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strataweave_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_strataweave_path", None):
            drop_path(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application: results that were not written elsewhere go with them."""
    drop_path(spark, _own(spark))
