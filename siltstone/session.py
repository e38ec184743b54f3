"""Session settings that every job of the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "siltstone", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution on.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster both
    come from the submit command.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", os.environ.get("SILTSTONE_UI", "false"))
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
