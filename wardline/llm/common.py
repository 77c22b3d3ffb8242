"""What several operators of this folder share: shared folders, cut lineage, free column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import NoSharedFolder, configure

WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Library settings; small Arrow batches, because one text can be a thousand times the usual size."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a session without it gets a folder of its own on one machine (tests), and raises
    on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    used = spark.sparkContext.getCheckpointDir()
    if used is None:
        if root is None and not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-"))
        used = spark.sparkContext.getCheckpointDir()
    return root or used


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_root(spark).rstrip('/')}/llm-{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, survives lost executors."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, for small tables of an iteration."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called that (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_share(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus
