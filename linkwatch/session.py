"""SparkSession construction and cluster-wide settings."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session zone (all stored times are UTC),
# ANSI on (divisions go through try_divide), AQE for runtime coalescing,
# skew-join splitting and size-checked broadcast conversion.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites of every Column operation: half of the time in which a plan is built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "linkwatch",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the package's base settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared file system and is used as is.
    Only in local mode, where driver and executors are one process, a scratch
    folder is created if it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="linkwatch-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables /
    stream state; remembered per application for ``drop_scratch``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    base = base.rstrip("/")
    path = f"{base}/{name}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this application wrote (call once the
    DataFrames built on them are no longer needed). Returns the count."""
    sc = spark.sparkContext
    paths = _SCRATCH.pop(sc.applicationId, [])
    jvm = sc._jvm
    conf = sc._jsc.hadoopConfiguration()
    n = 0
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        fs = hp.getFileSystem(conf)
        if fs.exists(hp):
            fs.delete(hp, True)
            n += 1
    return n


def local_test_session(cores: int = 4, shuffle_partitions: int = 8) -> SparkSession:
    """Session used by the tests: local mode, small shuffle partition count."""
    return build_session(
        master=f"local[{cores}]",
        app_name="linkwatch-tests",
        shuffle_partitions=shuffle_partitions,
        extra={"spark.driver.memory": os.environ.get("LINKWATCH_DRIVER_MEMORY", "4g")},
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``linkwatch`` importable on executors (for the Pandas UDF paths).

    Zips the package sources once per application and hands the archive to
    ``SparkContext.addPyFile``, which distributes it to every executor.
    """
    import zipfile

    import linkwatch

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    # Opt out where the package is installed on the executors already
    # (wheel in the image, --py-files at submit time).
    if (spark.conf.get("spark.linkwatch.shipPackage", "true") or "true").lower() == "false":
        _SHIPPED.add(key)
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(linkwatch.__file__)))
    fd, path = tempfile.mkstemp(prefix="linkwatch-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(os.path.join(root, "linkwatch")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    atexit.register(_drop_file, path)  # executors may ask for it until the end
    _SHIPPED.add(key)


def _drop_file(path: str) -> None:
    with contextlib.suppress(OSError):
        os.remove(path)
