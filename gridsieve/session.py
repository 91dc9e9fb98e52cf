"""Session construction and the few settings the library reads back from a session."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "gridsieve", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tested under.

    On a cluster the submit command supplies master, memory and shuffle settings; only the
    semantic ones (time zone, ANSI, adaptive execution) are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the Python workers, which need it where it is not installed."""
    sc = spark.sparkContext
    if getattr(sc, "_gridsieve_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="gridsieve-package-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "gridsieve"), "zip", root, "gridsieve"))
    atexit.register(shutil.rmtree, folder, True)
    sc._gridsieve_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may leave it unset (tests on one
    machine); it then gets a fresh folder that goes when the driver ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="gridsieve-")
        atexit.register(shutil.rmtree, configured, True)
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder unless the session already did."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def default_buckets(spark: SparkSession) -> int:
    """How many range buckets a distributed ranking uses: a few per shuffle partition."""
    return max(32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
