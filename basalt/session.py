"""The settings that the operators' semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Errors instead of nulls on overflow; the last of duplicate JSON keys; one time zone.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: What large inputs want of any session: adaptive plans that coalesce and split.
LARGE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def builder(name: str = "basalt") -> SparkSession.Builder:
    """A session builder with all settings; add the master and resources."""
    found = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | LARGE).items():
        found = found.config(key, value)
    return found


def configure(spark: SparkSession) -> SparkSession:
    """The settings on a session that exists."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
