"""Session settings the plans are meant to run with."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# The rule projections are wide: their generated methods pass the size up to which the JVM
# compiles by default and would stay interpreted.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.driver.extraJavaOptions": JVM_OPTIONS,
    "spark.executor.extraJavaOptions": JVM_OPTIONS,
    # Recording the Python call site of every column costs more than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# Bytes of a method up to which the JVM compiles it where JVM_OPTIONS are not given.
COMPILED_BYTES = 8000


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """For wide rows written here and now: a stage whose generated code would stay interpreted runs operator by operator,
    whose expressions Spark cuts into small methods. Nothing else of the session is changed."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# What an exchange of the whole input would bring to one task.
PARTITION_BYTES = 256 << 20


def builder(app: str, input_bytes: int | None = None) -> SparkSession.Builder:
    """``input_bytes``, the size of what a run reads, sets with how many partitions an exchange begins: adaptive
    execution merges small ones but never makes more."""
    out = SparkSession.builder.appName(app)
    if input_bytes is not None:
        partitions = str(max(200, -(-input_bytes // PARTITION_BYTES)))
        out = out.config("spark.sql.shuffle.partitions", partitions)
        out = out.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions)
        out = out.config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(PARTITION_BYTES))
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    return out


def local(app: str, cpus: int | str = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A single-machine session for tests and timings; ``more`` has underscores for dots."""
    base = builder(app)
    for key, value in more.items():
        base = base.config(key.replace("_", "."), value)
    spark = (
        base
        .master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
