"""Fingerprints, manifests and all-or-nothing publishing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import workspace  # noqa: F401

# Metadata a manifest entry must carry and the timestamp form of each precision.
REQUIRED_METADATA = ["status", "source", "provenance", "precision", "batch_id", "version", "scope"]
TIMESTAMP_FORMS = {"second": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "date": r"^\d{4}-\d{2}-\d{2}$"}


def fingerprint(df: DataFrame, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(source, rows, digest) of a table's content (all columns by default), independent of row order and partitioning.

    Each value is written with its length and null as a dash, so no two rows share an encoding. The digest adds up
    60-bit prefixes of each row's SHA-256, so it combines map-side in one pass.
    """
    values = [F.col(c).cast("string") for c in columns or df.columns]
    row = F.sha2(F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)
    prefix = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.lit(source).alias("source"), F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum(prefix), F.lit(0)).cast("string").alias("digest"))


def build_manifest(actual: DataFrame, metadata: DataFrame, previous: DataFrame | None, batch_id: str, timestamp: str) -> DataFrame:
    """Manifest rows; a source whose content did not change keeps its earlier provenance and batch."""
    rows = actual.join(metadata, "source")
    new_stamp, new_batch = F.lit(timestamp), F.lit(batch_id)
    if previous is not None:
        old = previous.select("source", F.col("digest").alias("_digest"), F.col("rows").alias("_rows"),
                              F.col("provenance").alias("_provenance"), F.col("batch_id").alias("_batch"))
        rows = rows.join(old, "source", "left")
        same = F.coalesce((F.col("_digest") == F.col("digest")) & (F.col("_rows") == F.col("rows")), F.lit(False))
        new_stamp = F.when(same, F.col("_provenance")).otherwise(new_stamp)
        new_batch = F.when(same, F.col("_batch")).otherwise(new_batch)
    out = rows.withColumn("provenance", new_stamp).withColumn("batch_id", new_batch)
    return out.withColumn("precision", F.when(F.col("provenance").contains("T"), "second").otherwise("date")).drop(
        "_digest", "_rows", "_provenance", "_batch")


def check_fingerprint(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(source, reasons) for missing sources, wrong counts or digests, bad timestamps and missing metadata."""
    facts = actual.select("source", F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    rows = manifest.withColumn("_listed", F.lit(True)).join(facts, "source", "full")
    listed = F.coalesce("_listed", F.lit(False))
    form = F.lit(None).cast("boolean")
    for precision, pattern in TIMESTAMP_FORMS.items():
        form = F.when(F.col("precision") == precision, F.col("provenance").rlike(pattern)).otherwise(form)
    checks = [F.when(~listed, "not in manifest"), F.when(listed & F.col("_rows").isNull(), "source missing"),
              F.when(listed & (F.col("rows") != F.col("_rows")), "row count differs"),
              F.when(listed & (F.col("digest") != F.col("_digest")), "digest differs"),
              F.when(listed & ~F.coalesce(form, F.lit(False)), "bad timestamp")]
    checks += [F.when(listed & F.coalesce(F.trim(F.col(c)) == "", F.lit(True)), F.lit(f"missing {c}")) for c in REQUIRED_METADATA]
    reasons = F.array_join(F.array_compact(F.array(*checks)), ",")
    return rows.select("source", reasons.alias("reasons")).where("reasons <> ''")


class PublishError(RuntimeError):
    """A check failed; nothing became visible."""


def publish_if_valid(frames: Mapping[str, DataFrame], root: str,
                     checks: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]]) -> str:
    """Write all tables of a batch, check what was written, then make them visible together.

    Each table lands in ``root/_batch=<id>/<name>``; readers follow the newest row of ``root/current``,
    which is appended only after every check came back empty, so a failed batch is never read.
    """
    spark = next(iter(frames.values())).sparkSession
    batch = uuid.uuid4().hex
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{root}/_batch={batch}/{name}")
    staged = {name: spark.read.schema(df.schema).parquet(f"{root}/_batch={batch}/{name}") for name, df in frames.items()}
    for label, check in checks.items():
        if not check(staged).isEmpty():
            raise PublishError(f"{label}: batch {batch} stays unpublished")
    spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("published_at")).coalesce(1) \
        .write.mode("append").parquet(f"{root}/current")
    return batch


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of the newest published batch (the pointer is one row per batch)."""
    pointer = spark.read.schema("batch string, published_at timestamp").parquet(f"{root}/current")
    batch = pointer.orderBy(F.desc("published_at"), F.desc("batch")).first()["batch"]
    return spark.read.parquet(f"{root}/_batch={batch}/{name}")
