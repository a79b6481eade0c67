"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "opsignal", master: str | None = None, shuffle_partitions: int | None = None, options: dict[str, str] | None = None
) -> SparkSession:
    """options: further settings, such as spark.driver.memory; they hold if no session exists yet."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (options or {}).items():
        b = b.config(name, value)
    return b.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Timestamps in the tables carry no zone; all epoch arithmetic assumes UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
