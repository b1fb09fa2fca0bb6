"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every textmill job relies on.  The variant flag makes duplicate JSON
# keys resolve to the last occurrence, like Python's json module.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # per-group top-n (holdout samples of up to 5 000 per source) keeps the
    # partial, pre-shuffle WindowGroupLimit
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # whole texts and archives pass through Arrow: bound a batch by its bytes
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "textmill") -> SparkSession:
    """Local/test session.  On a cluster, use the cluster's own session and
    call :func:`configure` on it instead."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               # checkpoints of intermediate tables are removed once unreferenced
               # (set at startup; on a cluster put it in the session's launch conf)
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.driver.memory", os.environ.get("TEXTMILL_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``textmill`` importable on the executors (its Arrow UDFs refer to
    package functions): the package sources are zipped once per application
    and registered with ``addPyFile`` (Spark distributes the file).  Local
    masters need it too: their Python workers don't see what the driver has
    put on its import path."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="textmill-pkg-"), "textmill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` (the cluster's shared folder).  Only when it
    is unset -- local runs and tests -- a private scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            current = tempfile.mkdtemp(prefix="textmill-ckpt-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for written tables."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(clear_scratch, spark)
    _SCRATCH.append(path)
    return path


_SCRATCH: list = []


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables that this process has made, through their
    Hadoop file system.  DataFrames that read them end with it; it runs by
    itself when the process ends in order."""
    paths, _SCRATCH[:] = list(_SCRATCH), []
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has gone: what is left belongs to its checkpoint folder
        return


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path's scheme
    (local, HDFS, object stores alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))
