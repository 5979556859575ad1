"""Snapshots stored in buckets of their record key, so that two days meet without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions.keys import KEY, record_key
from milemark.sources.store import DAY, read_or_none

BUCKET_BYTES = 128 << 20
# Rows that one task sorts when a day is stored or two days meet; the wide base takes some 2 KB a row there.
BUCKET_ROWS = 250_000
_MANIFEST = f"fields array<string>, buckets int, location string, {DAY} string"


def bucket_count(size: int, per_bucket: int = BUCKET_BYTES) -> int:
    """Buckets for a day of so many bytes (or rows, with rows ``per_bucket``): a power of two, so that stores of different size can still be joined."""
    return 1 << (max(1, -(-size // per_bucket)) - 1).bit_length()


class BucketedSnapshots:
    """Days as Parquet tables, clustered and sorted by the record key, under ``path``.

    ``path/manifest`` names the place, header and number of buckets of every day and is written last; a day that is
    stored again gets a new place, so that readers see the old or the new one. The tables are registered in the
    session's catalog when they are read first, so a new session needs the path only.

    A day has ``buckets`` buckets, or more where they would hold over ``rows_per_bucket`` rows: a power of two, for which
    its rows are counted first. Days with other numbers of buckets meet with an exchange.
    """

    def __init__(
        self, spark: SparkSession, path: str, buckets: int, spec: C.DiffSpec = C.CONTRACT_DIFF, rows_per_bucket: int = BUCKET_ROWS
    ):
        self.spark, self.path, self.buckets, self.spec = spark, path, buckets, spec
        self.rows_per_bucket = rows_per_bucket

    def write(self, df: DataFrame, day: str) -> None:
        """Stores a day as text with its record key; a row without one fails the write, repeated keys the comparison."""
        missing = F.raise_error(F.lit(f"snapshot row without a key ({', '.join(self.spec.key_candidates)})"))
        keyed = df.withColumn(KEY, record_key(df, self.spec.key_candidates))
        if self.spec.skip_blank_keys:
            keyed = keyed.where(F.col(KEY).isNotNull())
        text = keyed.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns], F.coalesce(KEY, missing).alias(KEY))
        # Only the columns of the key are read for the count.
        buckets = max(self.buckets, bucket_count(keyed.select(KEY).count(), self.rows_per_bucket))
        version = uuid.uuid4().hex
        location = f"{self.path}/rows/{day}/{version}"
        # Dealt out as the buckets are: every task writes one file of one bucket.
        rows = text.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY)
        rows.option("path", location).saveAsTable(_table(location))
        listed = self.spark.createDataFrame([(df.columns, buckets, location)], _MANIFEST.rsplit(",", 1)[0])
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{DAY}={day}")

    def _listed(self) -> dict:
        manifest = read_or_none(self.spark, f"{self.path}/manifest", _MANIFEST)
        return {} if manifest is None else {r[DAY]: r for r in sorted(manifest.collect(), key=lambda r: r[DAY])}

    def days(self) -> list[str]:
        return list(self._listed())

    def at(self, day: str) -> DataFrame:
        """The rows of a day under its header, and their key: a scan that is already dealt out by it."""
        row = self._listed()[day]
        name = _table(row["location"])
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{c}` string" for c in [*row["fields"], KEY])
            place = row["location"].replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{KEY}`) SORTED BY (`{KEY}`) "
                f"INTO {row['buckets']} BUCKETS LOCATION '{place}'"
            )
        return self.spark.table(name)


def _table(location: str) -> str:
    return f"snapshot_{location.rsplit('/', 1)[1]}"
