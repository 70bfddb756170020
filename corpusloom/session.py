"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution. Sizes are left to the cluster unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per application."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return spark
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(home):
            for name in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(archive)
    context._corpusloom_shipped = True
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only where none is named: a scratch folder of this machine for a local master, else a folder of the default file
    system, which must not be a local one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and re.match(r"local(\[(?!-)|$)", context.master):
        named = tempfile.mkdtemp(prefix="corpusloom-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not named:
        home = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration()).getHomeDirectory()
        if home.toUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{home.toString()}/corpusloom-checkpoints"
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder so later branches read the very same rows."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan that yields fewer partitions than there are cores.

    Small files cannot be split, and everything after them would run on a few tasks. Each partition of the scan is dealt to
    as many tasks as there are cores, so tasks do not grow with the table. A scan with enough partitions, as any large
    table has, is returned as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = df.rdd.getNumPartitions()
    return df.repartition(cores * max(found, 1)) if found < cores else df
