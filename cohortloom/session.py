"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Runtime SQL settings, so they also reach a session that somebody else created.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even if that costs one more shuffle of the joined rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Small shuffle partitions are merged up to this many bytes, not up to one task a core: what a task sorts and groups
    # is then bounded however large the tables are. Compressed rows of the clinical plans take up to 50 times this in memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # A task reads this much of a file, not up to 128 MB as files grow: it sorts and groups its rows before the shuffle.
    "spark.sql.files.maxPartitionBytes": "32m",
    # A batch of rows for Python, in the JVM and in the worker: 10,000 texts can be far larger.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Give the settings the operators rely on to a session, unless its owner has given them.

    Timestamps are without a zone throughout, so the time zone is left alone.
    """
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


#: The setting for the shuffle partitions before merging, bytes of input that make one, and how many there are at most.
FIRST_PARTITIONS, PARTITION_INPUT, MOST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 2 << 20, 1 << 15


def sized(spark: SparkSession, folder: str | None) -> SparkSession:
    """Let the number of shuffle partitions follow the bytes of the tables in a folder, unless the session's owner chose one.

    Adaptive execution merges partitions but does not cut those of a grouping, so with a fixed number a task would grow
    with the tables. The session's own number is the least; without a folder it holds.
    """
    mine = getattr(spark.sparkContext, "_cohortloom_partitions", None)
    given = spark.conf.get(FIRST_PARTITIONS, None)
    if given is not None and given != mine:
        return spark
    wanted = 0
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        wanted = min(files.getContentSummary(path).getLength() // PARTITION_INPUT, MOST_PARTITIONS)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.sparkContext._cohortloom_partitions = str(wanted)
        spark.conf.set(FIRST_PARTITIONS, str(wanted))
    elif given is not None:
        spark.conf.unset(FIRST_PARTITIONS)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, as in tests, a session on this one machine gets a folder of its own, which goes when
    the program ends. Any other session must have the setting.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(context, "_cohortloom_folder"):
        context._cohortloom_folder = tempfile.mkdtemp(prefix="cohortloom-")
        atexit.register(shutil.rmtree, context._cohortloom_folder, ignore_errors=True)
    return context._cohortloom_folder


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_folder`` named, wherever it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> SparkSession:
    """Give this package to the executors' Python workers, once per context.

    Functions that run in tasks import their modules there; a cluster that has the package installed loses nothing.
    """
    context = spark.sparkContext
    if getattr(context, "_cohortloom_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "cohortloom_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._cohortloom_shipped = True
    return spark
