"""Snapshots of sources: admitted files under a key of their identity."""

from __future__ import annotations

from datetime import datetime, timezone
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatrix.operators import acquire

IDENTITY = ("source_type", "provider", "canonical_url", "requested_ref", "resolved_ref", "integrity")


def key(source: dict) -> str:
    return hashlib.sha256(json.dumps({k: source.get(k, "") for k in IDENTITY}, sort_keys=True).encode()).hexdigest()[:24]


def take(spark: SparkSession, files: DataFrame, source: dict, root: str, policy: acquire.Policy = acquire.Policy()) -> dict:
    """Writes the files that the policy admits and a manifest under ``root``; an
    existing snapshot of the same source is used again. Raises if a limit is exceeded."""
    folder = f"{root.rstrip('/')}/{key(source)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return json.loads(spark.read.json(f"{folder}/manifest").select(F.to_json(F.struct("*"))).first()[0]) | {"cache_hit": True}
    acquire.require_policy(files, policy)
    admitted = acquire.within_policy(files, policy).select("rel_path")
    files.join(admitted, "rel_path", "left_semi").write.mode("overwrite").parquet(f"{folder}/docs")
    docs = spark.read.parquet(f"{folder}/docs")
    suspicious = acquire.trust_scan(docs)
    suspicious.write.mode("overwrite").parquet(f"{folder}/suspicious")
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("b")).first()
    manifest = {"schema_version": "1", **{k: source.get(k, "") for k in ("library", "selector", *IDENTITY)}, "fetched_at": datetime.now(timezone.utc).isoformat(), "snapshot_dir": folder, "docs_dir": f"{folder}/docs", "files_copied": total.n, "total_bytes": total.b, "suspicious_count": spark.read.parquet(f"{folder}/suspicious").count()}
    # the manifest comes last: a snapshot without one isn't used
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest | {"cache_hit": False}
