"""Spark session helpers.

Lineage is cut with ``DataFrame.checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``. A temporary default is made only for a ``local`` master (tests,
benchmarks), where driver and executors are one process; any other master without that setting
raises, as no executor could read another machine's temporary folder.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, partitions: int = 8, app: str = "fieldspark") -> SparkSession:
    """Session tuned for local runs; on a cluster ``getOrCreate`` returns the existing one."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; a ``local`` master without one gets a temporary one."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set; master {master} needs a folder that all executors share")
        current = tempfile.mkdtemp(prefix="fieldspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once a session (Spark distributes the archive);
    nothing to do where it was submitted with ``--py-files``."""
    root = os.path.dirname(os.path.abspath(__file__))
    sc = spark.sparkContext
    if os.path.isdir(root) and getattr(sc, "_package_archive", None) is None:
        sc._package_archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "fieldspark_code")
        sc.addPyFile(shutil.make_archive(sc._package_archive, "zip", os.path.dirname(root), os.path.basename(root)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never ``localCheckpoint``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
