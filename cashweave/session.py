"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this library is written against. AQE re-plans joins and coalesces
# shuffle partitions at run time; skew-join splitting covers hot keys in sort-merge joins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.parquet.filterPushdown": "true",
    # Ledger plans carry ~40 aliased payload expressions under filters and joins; Catalyst's
    # constraint inference grows combinatorially on such plans (minutes, or heap exhaustion,
    # in the optimizer) while adding no useful filter here.
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}

# SQL settings the jobs need, applied to a caller's session at runtime.
RUNTIME_CONF = {
    "spark.sql.constraintPropagation.enabled": "false",
    # Let a join on (a, b, c) reuse a side already hash-partitioned on (a, b).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME_CONF` to an existing session (e.g. one a platform hands us)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextlib.contextmanager
def tuned(spark: SparkSession):
    """:func:`tune` for the duration of a block, then the caller's previous values come back.

    Settings are read when a query is planned, so the block must contain the actions (writes,
    collects), not only the DataFrame definitions.
    """
    previous = {key: spark.conf.get(key, None) for key in RUNTIME_CONF}
    tune(spark)
    try:
        yield spark
    finally:
        for key, value in previous.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app_name: str = "cashweave",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local/test session. On a cluster, the platform's own session is passed in instead."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it is not installed on every node.

    Python stages (the chain fold, open JSON, the state store) import it on the workers. Called once a
    session; a second call does nothing.
    """
    import pathlib
    import shutil

    context = spark.sparkContext
    if getattr(context, "_cashweave_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cashweave-ship-")  # on the driver; Spark copies the archive from it
    context.addPyFile(shutil.make_archive(f"{folder}/cashweave", "zip", package.parent, package.name))
    context._cashweave_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session may leave it unset (tests): a folder of our own is chosen and registered
    then. On a cluster that is an error, as executors do not see each other's local folders.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="cashweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured
