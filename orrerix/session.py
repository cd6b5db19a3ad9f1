"""A session with the settings that the engine is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "orrerix", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, skew-join splitting and UTC; other settings stay the cluster's own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=fixed | conf).getOrCreate()
