"""Session settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "tidestock", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC dates.

    Shuffle width is left to the cluster unless given; adaptive execution merges
    small partitions, so a wide setting costs little.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Text rules make long generated methods. Beyond 8000 bytes of bytecode the JVM does not compile a
        # method, and such a stage runs faster expression by expression than in one interpreted method.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Skips the per-call source position lookup while plans are built.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
