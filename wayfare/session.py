"""A session with the settings the operators expect, and presets by size of the input."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Reader and shuffle settings by size of the input; AQE coalesces what turns out small.
PRESETS = {
    "small": {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.shuffle.partitions": "16"},
    "medium": {"spark.sql.files.maxPartitionBytes": "64m", "spark.sql.shuffle.partitions": "200"},
    "large": {"spark.sql.files.maxPartitionBytes": "128m", "spark.sql.shuffle.partitions": "2000"},
    "huge": {"spark.sql.files.maxPartitionBytes": "256m", "spark.sql.shuffle.partitions": "20000"},
}
#: Beyond 8,000 bytes the JVM does not compile a method; such stages run as smaller methods instead.
BASE = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}


def preset_for(size_bytes: int) -> str:
    """The preset for an input of so many bytes: below 100 MB, 1 GB, 1 TB, or more."""
    return "small" if size_bytes < 100 << 20 else "medium" if size_bytes < 1 << 30 else "large" if size_bytes < 1 << 40 else "huge"


def session(master: str = "local[8]", preset: str = "small", memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("wayfare").config("spark.driver.memory", memory)
    for k, v in {**BASE, **PRESETS[preset], **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
