"""Column names and column types of incoming tables.

Names are handled on the driver, they are schema and not data; types are decided by one
aggregate over the rows.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milemark import config as C

# What a decimal comma and a date look like.
DECIMAL_COMMA = r"^\d+,\d+\z"
DATE_LIKE = r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?\s*\z"
# Day-first forms, then month-first ones for days that are no month.
DATE_FORMATS = ["d/M/yyyy", "yyyy/M/d", "d/M/yy", "M/d/yyyy"]


def slug(name: object) -> str:
    """ASCII, lower case, words joined by underscores."""
    plain = unicodedata.normalize("NFKD", str(name)).encode("ascii", "ignore").decode("ascii")
    kept = "".join(ch for ch in plain if ch.isalnum() or ch in "_-" or ch.isspace())
    return "_".join(re.split(r"[-\s]+", kept.strip().lower()))


def slug_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[slug(c) for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Only the mapped columns, under their new names; an absent one is empty text."""
    return df.select(
        *[(df[f"`{old}`"] if old in df.columns else F.lit("")).alias(new) for old, new in mapping.items()]
    )


def choose(df: DataFrame, columns: Sequence[str], headers: Mapping[str, str], default: Sequence[str] | None = None) -> DataFrame:
    """Ordered subset of the columns under their display headings; ``default`` narrows the list."""
    wanted = [c for c in columns if default is None or c in default]
    return df.select(*[F.col(c).alias(headers.get(c, c)) for c in wanted])


def canonical_name(field: str) -> str:
    """One alias step, then the old suffix gives way to the new one."""
    name = C.FIELD_ALIASES.get(field, field)
    return name[: -len(C.OLD_SUFFIX)] + C.NEW_SUFFIX if name.endswith(C.OLD_SUFFIX) else name


def canonicalize(df: DataFrame) -> DataFrame:
    """Canonical names; of several columns with one name the first place and the last value stay."""
    last: dict[str, str] = {}
    for c in df.columns:
        last[canonical_name(c)] = c
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in last.items()])


def stamp_load(df: DataFrame, at: dt.datetime, column: str = "dte_carga") -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(at))


def comma_decimal(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def any_date(c: Column) -> Column:
    """Calendar day of a date text in any accepted form, else null."""
    day = F.regexp_replace(F.regexp_extract(c, r"^\s*([0-9./-]+)", 1), r"[-.]", "/")
    ok = c.rlike(DATE_LIKE)
    return F.when(ok, F.coalesce(*[F.try_to_timestamp(day, F.lit(f)).cast("date") for f in DATE_FORMATS]))


def infer_types(df: DataFrame, forced_text: Sequence[str] = tuple(C.FORCED_TEXT)) -> DataFrame:
    """Text columns become long, double or date when every value allows it.

    One aggregate over all rows decides, whatever their order: a column with a decimal comma anywhere is read that
    way, any other as numbers, and what is no number may be a date. A reading is taken only if all values parse.
    """
    skip = {slug(c) for c in forced_text}
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if not texts:
        return df
    readings: dict[str, dict[str, Column]] = {}
    aggs = []
    for c in texts:
        col = F.col(f"`{c}`")
        readings[c] = {
            "comma": comma_decimal(col), "long": F.trim(col).try_cast("bigint"), "double": F.trim(col).try_cast("double"),
            "date": any_date(col),
        }
        aggs += [F.count(col).alias(f"{c}|n"), F.count_if(col.rlike(DECIMAL_COMMA)).alias(f"{c}|commas")]
        aggs += [F.count(expr).alias(f"{c}|{kind}") for kind, expr in readings[c].items()]
    counts = df.agg(*aggs).first().asDict()
    chosen = {}
    for c in texts:
        numbers = ["comma"] if counts[f"{c}|commas"] else ["long", "double"]
        fits = [kind for kind in [*numbers, "date"] if counts[f"{c}|{kind}"] == counts[f"{c}|n"] > 0]
        if fits:
            chosen[c] = readings[c][fits[0]]
    return df.withColumns(chosen) if chosen else df
