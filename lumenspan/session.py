"""Sessions, tables, shared folders and the shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def get_spark(app: str = "lumenspan", master: str | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with the defaults that the queries expect; a cluster brings its own master."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return (builder.master(master) if master else builder).getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone (any store that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each SparkContext."""
    context = spark.sparkContext
    if getattr(context, "_lumenspan_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "lumenspan.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, str(source.relative_to(PACKAGE.parent)))
    context.addPyFile(path)
    context._lumenspan_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a temporary folder is set in its place, on one machine only: a cluster's
    executors would each write to a folder of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_lumenspan_dir", None) or tempfile.mkdtemp(prefix="lumenspan-")
        spark.sparkContext._lumenspan_dir = root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lumenspan-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenspan_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing refers to any more."""
    for df in tables:
        if path := getattr(df, "_lumenspan_path", None):
            jvm, context = df.sparkSession._jvm, df.sparkSession._jsc
            place = jvm.org.apache.hadoop.fs.Path(path).getParent()
            place.getFileSystem(context.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Ask the driver to collect what nothing refers to: Spark then deletes the shuffles of jobs whose results are stored."""
    spark.sparkContext._jvm.java.lang.System.gc()
