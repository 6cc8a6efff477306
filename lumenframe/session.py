"""Session settings. The engine's queries rely on non-ANSI arithmetic and UTC timestamps."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results; every query applies them to the session it is given.
SEMANTICS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}

#: Settings that only change speed. A cluster's own values win over them.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-changing settings to a running session and return it."""
    for key, value in SEMANTICS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_spark(app: str = "lumenframe", master: str | None = None, **conf: str) -> SparkSession:
    """Build or fetch a session with the engine's defaults; keyword settings use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (TUNING | SEMANTICS).items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return configure(builder.getOrCreate())
