"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Runtime settings the jobs are tuned for.  Sizes such as the shuffle partition
# count stay with whoever owns the cluster; AQE coalesces or splits from there.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime defaults to an existing session."""
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def object_store_settings(endpoint: str, key: str, secret: str) -> dict[str, str]:
    """Session settings for an S3-compatible store addressed by path; pass them to the session builder."""
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.access.key": key,
        "spark.hadoop.fs.s3a.secret.key": secret,
        "spark.hadoop.fs.s3a.path.style.access": "true",
    }


def located(path: str) -> str:
    """The path as Spark's file systems name it: ``s3://`` is ``s3a://``."""
    return path.replace("s3://", "s3a://", 1) if path.startswith("s3://") else path


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the cluster's shared checkpoint folder, or below the warehouse where none is set.

    Both are to be shared by driver and executors; a machine's temporary folder is never taken, and on a cluster neither is
    a warehouse in a machine's own file system.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        master = spark.conf.get("spark.master", "local")
        alone = master == "local" or master.startswith("local[")
        if not alone and (base.startswith("file:") or "://" not in base):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; {base} lies on one machine")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
