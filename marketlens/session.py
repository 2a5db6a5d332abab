"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode. Scoring rows have ~100 columns, so
    # their fused loop is larger; below this limit Spark falls back to split, compiled projections.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Applies the settings that can change at run time."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
