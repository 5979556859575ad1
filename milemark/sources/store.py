"""Dated snapshots kept as one partitioned Parquet dataset with a manifest of their headers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark import session
from milemark.sources import marks

DAY = "snapshot_date"


VERSION = "_version"
_MANIFEST = f"fields array<string>, version string, {DAY} string"


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A Parquet dataset, or None where nothing has been written yet."""
    try:
        # Files are looked for when the schema is found, not with one given.
        spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return spark.read.schema(schema).parquet(path)


class SnapshotStore:
    """``path/rows`` holds the rows by day, ``path/manifest`` the header and version of every day.

    The manifest has one row per day, so reading it on the driver is bounded by the number of days; rows are never
    brought to the driver. It is written last: a day that it does not list is not read, and one whose rows were replaced
    by a run that stopped before the manifest fails when it is read, until it is stored again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.rows_path = f"{path}/rows"
        self.manifest_path = f"{path}/manifest"

    def write(self, df: DataFrame, day: str) -> None:
        """Stores the base of a day; the same day again replaces only that day, also by one without rows."""
        version = uuid.uuid4().hex
        text = marks.numbered(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns], F.lit(version).alias(VERSION)))
        header = self.spark.range(1).select(F.array(*[F.lit(c) for c in df.columns]).alias("fields"), F.lit(version).alias("version"))
        with session.compiled(self.spark):
            for frame, path in ((text, self.rows_path), (header.coalesce(1), self.manifest_path)):
                frame.write.mode("overwrite").parquet(f"{path}/{DAY}={day}")

    def _listed(self) -> dict[str, tuple[list[str], str]]:
        manifest = read_or_none(self.spark, self.manifest_path, _MANIFEST)
        rows = [] if manifest is None else manifest.collect()
        return {r[DAY]: (list(r["fields"]), r["version"] or "") for r in sorted(rows, key=lambda r: r[DAY])}

    def headers(self) -> dict[str, list[str]]:
        """Header of each day, in date order."""
        return {d: fields for d, (fields, _) in self._listed().items()}

    def versions(self) -> dict[str, str]:
        """What a day is known by until it is stored again, in date order."""
        return {d: version for d, (_, version) in self._listed().items()}

    def days(self) -> list[str]:
        return list(self.headers())

    def previous(self, current: str, strict: bool = False) -> str | None:
        """Last other day by name, even one after ``current``; ``strict`` allows earlier ones only."""
        others = [d for d in self.days() if d != current and (not strict or d < current)]
        return others[-1] if others else None

    def oldest(self) -> str | None:
        days = self.days()
        return days[0] if days else None

    def at(self, day: str) -> DataFrame:
        """The rows of one day under the header it had; only its partition is read."""
        rows, headers = self.history([day])
        return rows.select(*[F.col(f"`{c}`") for c in headers[day]])

    def previous_or_current(self, current: str) -> DataFrame:
        return self.at(self.previous(current) or current)

    def history(self, days: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
        """The wanted days (all by default) in one frame, and their headers; only their partitions are read."""
        rows, headers = self.numbered(days)
        return rows.drop(marks.ROW), headers

    def numbered(self, days: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
        """``history`` with the number that a row has within its day; null in days that were stored without."""
        listed = self._listed()
        listed = listed if days is None else {d: listed[d] for d in sorted(days)}
        headers = {d: fields for d, (fields, _) in listed.items()}
        fields = list(dict.fromkeys(f for h in headers.values() for f in h))
        schema = ", ".join(f"`{f}` string" for f in fields) + f", {VERSION} string, {marks.ROW} long, {DAY} string"
        rows = self.spark.read.schema(schema).parquet(self.rows_path).where(F.col(DAY).isin(list(listed)))
        version = F.create_map(*[F.lit(x) for d, (_, v) in listed.items() for x in (d, v)])[F.col(DAY)]
        broken = F.raise_error(F.concat(F.lit("snapshot not stored completely, store it again: "), F.col(DAY)))
        whole = F.when(F.coalesce(F.col(VERSION), F.lit("")) == version, F.lit(True)).otherwise(broken.cast("boolean"))
        return rows.where(whole).select(*[F.col(f"`{f}`") for f in fields], marks.ROW, DAY), headers


def merge(frames: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Separately read snapshots as one history."""
    dated = [df.withColumn(DAY, F.lit(day)) for day, df in sorted(frames.items())]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dated)
    return merged, {day: df.columns for day, df in sorted(frames.items())}
