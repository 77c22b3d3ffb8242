"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings: safe to apply to a session somebody else created.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot entitlement keys, cells and namespaces are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot keys even where that costs one more shuffle further down.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Key lists of up to this size become Bloom filters that large scans apply before their rows are shuffled.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    # Recursive queries walk documents, which end; no number of rows or levels cuts them short.
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.cteRecursionLevelLimit": "-1",
    # Deep pages sort globally instead of holding limit+offset rows in every task.
    "spark.sql.execution.topKSortFallbackThreshold": "1000000",
}

# Only settable when the session is created.
STATIC_CONF = {
    # Plans here are built from many small columns; recording a call site for each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


class NoSharedFolder(RuntimeError):
    """A session on a cluster names no folder that its machines share."""


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "wardline", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the library's settings plus ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**STATIC_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediates, below the cluster's ``spark.checkpoint.dir``.

    Without that setting only a session on one machine gets a temporary folder; on a cluster it would be another one on each
    machine, so that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/wardline-{purpose}-{uuid.uuid4().hex}"
