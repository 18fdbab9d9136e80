"""A session with the settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesced shuffles, skewed joins, size-checked broadcasts.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Generated methods beyond this many bytes are never compiled by the JVM;
    # such stages run faster split up.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "bookings", master: str | None = None, **settings: str) -> SparkSession:
    """A session with :data:`SETTINGS`; dotted setting names are passed with ``**{...}``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
