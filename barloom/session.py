"""A session with the settings that the jobs expect; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "barloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    usual = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (usual | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
