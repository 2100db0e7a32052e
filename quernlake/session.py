"""Spark session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "quernlake", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and a state store for keyed state; ``conf`` adds or overrides settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    settings["spark.sql.streaming.stateStore.providerClass"] = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ready(spark: SparkSession) -> bool:
    """Readiness probe: the session runs a job."""
    return spark.range(1).count() == 1
