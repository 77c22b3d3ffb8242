"""Disclosure audit: one record per dataset that left the system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def disclosure_records(disclosures: DataFrame, page: DataFrame | None = None) -> DataFrame:
    """Audit rows from ``(dataset_id, consumer_id, agreement_id, transfer_id, principals)``.

    ``page`` is the page that was returned; its row count goes into every record. Without it
    ``disclosures`` must already carry ``row_count``.
    """
    count = F.col("row_count") if page is None else page.agg(F.count(F.lit(1))).scalar()
    return disclosures.select(
        "dataset_id",
        "consumer_id",
        "agreement_id",
        "transfer_id",
        count.cast("bigint").alias("row_count"),
        F.col("principals").alias("authorized_subject_ids"),
    )


def principals_summary(people: DataFrame) -> DataFrame:
    """``(dataset_id, n_principals, principals_digest)`` of ``people`` (``dataset_id``, ``principal``), each counted once.

    The digest doesn't depend on the order: two texts of the same people have the same one.
    """
    each = people.filter(F.col("principal").isNotNull()).distinct()
    half = lambda salt: F.lpad(F.hex(F.bit_xor(F.xxhash64(F.lit(salt), "principal"))), 16, "0")
    return each.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_principals"), F.lower(F.concat(half("a"), half("b"))).alias("principals_digest")
    )


def write_page(records: DataFrame, path: str, page_id: str, at: str) -> None:
    """Write what belongs to a page, once: under the day of ``at``, the time it was served, and its id.

    Writing the same page again, as after a failure, puts the same rows in place of the first.
    """
    stamped = records.withColumn("recorded_at", F.lit(at).cast("timestamp"))
    placed = stamped.withColumn("day", F.to_date("recorded_at")).withColumn("page_id", F.lit(page_id))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "page_id").parquet(path)


def append_audit(records: DataFrame, path: str, at: Column | None = None) -> None:
    """Append records, partitioned by day, stamped with the time of writing."""
    stamped = records.withColumn("recorded_at", F.current_timestamp() if at is None else at)
    stamped.withColumn("day", F.to_date("recorded_at")).write.mode("append").partitionBy("day").parquet(path)


def disclosure_totals(records: DataFrame, *by: str) -> DataFrame:
    """Roll-up of the audit table."""
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("disclosures"),
        F.sum("row_count").alias("rows_disclosed"),
        F.countDistinct("agreement_id").alias("agreements"),
    )
