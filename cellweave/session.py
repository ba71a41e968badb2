"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "cellweave", cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session may pick its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellweave-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Unlike a checkpoint, the result carries a fresh size estimate, so later joins are planned on what was written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def forget(df: DataFrame | None) -> None:
    """Delete the files behind a frame made by ``stored``; anything else is left alone."""
    at = getattr(df, "_stored_at", None)
    if at:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Restart the lineage of ``df`` from files in the shared folder; the files of the step it replaces go."""
    out = stored(df)
    forget(replaces)
    return out


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per session, so that its functions import there."""
    sc = spark.sparkContext
    if getattr(sc, "_cellweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="cellweave-"), "cellweave.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)
    sc._cellweave_shipped = True
