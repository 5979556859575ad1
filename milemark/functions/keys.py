"""Record keys and the canonical form that turns tolerant equality into an equi-join."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milemark.functions.text import blank_to_null

NUMERIC_TEXT = r"^[0-9]+(\.[0-9]+)?\z"
_NUMERIC_PARTS = r"^0*([0-9]+?)(?:\.([0-9]*?)0*)?\z"

# The column of a stored snapshot that holds its record key.
KEY = "_chave"


def canonical_key(c: Column) -> Column:
    """Equal exactly when two keys are equal as text or as plain decimal numbers.

    Numeric text loses leading zeros and trailing fraction zeros, so it stays exact at
    any length; other text is compared as it is. Null stays null and matches nothing.
    """
    text = c.cast("string")
    return F.when(text.rlike(NUMERIC_TEXT), F.regexp_replace(text, _NUMERIC_PARTS, "n:$1.$2")).otherwise(
        F.concat(F.lit("t:"), text)
    )


def record_key(df: DataFrame, candidates: Iterable[str]) -> Column:
    """First non-blank candidate column, stripped; null when there is none."""
    present = [blank_to_null(F.col(n)) for n in candidates if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")
