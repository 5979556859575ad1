"""Loading prepared tables into the catalog."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milemark.sources import files, naming

log = logging.getLogger(__name__)


def _for_storage(df: DataFrame) -> DataFrame:
    """Timestamps are stored as calendar dates."""
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: F.col(c).cast("date") for c in stamps}) if stamps else df


def load_table(df: DataFrame, name: str, mode: str = "replace") -> None:
    """Creates the table when absent; else empties it first (replace) or adds to it (append).

    An existing table keeps its definition: columns are matched by name, one the load lacks
    is null and one the table lacks is an error.
    """
    if mode not in ("replace", "append"):
        raise ValueError(f"invalid load mode: {mode}")
    spark = df.sparkSession
    df = _for_storage(df)
    if not spark.catalog.tableExists(name):
        df.write.format("parquet").saveAsTable(name)
        return
    target = spark.table(name).schema
    unknown = [c for c in df.columns if c not in target.names]
    if unknown:
        raise ValueError(f"{name} has no columns {unknown}")
    aligned = df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields]
    )
    aligned.write.insertInto(name, overwrite=mode == "replace")


def prepare(df: DataFrame, loaded_at: dt.datetime) -> DataFrame:
    """Normalised names, inferred types, load stamp."""
    return naming.stamp_load(naming.infer_types(naming.slug_columns(df)), loaded_at)


@dataclass(frozen=True)
class LoadSpec:
    """One target table and how its rows are taken from a source."""

    source: str
    table: str
    pick: Callable[[DataFrame], DataFrame] | None = None


def load_many(
    spark: SparkSession, specs: Sequence[LoadSpec], mode: str = "replace", loaded_at: dt.datetime | None = None
) -> dict[str, str]:
    """Loads every target; returns the failures.

    A source that feeds several targets is looked into once and scanned for each, with the columns it asks for; nothing
    is cached. A target that fails is reported and the others go on.
    """
    loaded_at = loaded_at or dt.datetime.now()
    frames: dict[str, DataFrame] = {}
    failures: dict[str, str] = {}
    for spec in specs:
        try:
            if spec.source not in frames:
                frames[spec.source] = files.read_any(spark, spec.source)
            df = frames[spec.source]
            load_table(prepare(spec.pick(df) if spec.pick else df, loaded_at), spec.table, mode)
        except Exception as e:  # noqa: BLE001 - one bad source must not stop the batch
            log.warning("load of %s failed: %s", spec.table, e)
            failures[spec.table] = str(e)
    return failures
