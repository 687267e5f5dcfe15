"""Session helpers shared by every operator."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per context: their Python workers need not have it installed.

    The archive is served by the driver like any ``--py-files`` argument.
    """
    sc = spark.sparkContext
    if getattr(sc, "_dialoom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    target = Path(tempfile.mkdtemp(prefix="dialoom-code-")) / "dialoom_code.zip"
    target.write_bytes(packed.getvalue())
    sc.addPyFile(str(target))
    sc._dialoom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``checkpoint()`` usable: the session's ``spark.checkpoint.dir`` decides.

    Only an in-process ``local`` master without that setting (tests) gets a temporary folder; a cluster
    without a shared folder is an error, because checkpoints on one machine die with it.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="dialoom-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def spread(df: DataFrame) -> DataFrame:
    """Repartition an input that has fewer splits than the cluster has cores (small single-file tables).

    A table of many files or row groups is returned as it is, so at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores)
