"""Rows of a stored table picked by their place: a bit for each, so that whole rows are not exchanged to be found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The number that a row was stored under; it is only as good as the files it is read from, so it is always stored first.
ROW = "_linha"
_BLOCK, _BITS, _AT = "_bloco", "_bits", "_lugar"
# What one bitmap of Spark's covers (4 KB).
BLOCK_ROWS = 32768
# Bitmaps that are broadcast at most, of 4 KB each; more are joined by an exchange.
BROADCAST_BLOCKS = 20_000


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn(ROW, F.monotonically_increasing_id())


def digest(values: dict[str, Column]) -> Column:
    """128 bits of the SHA-256 of all values that are not null, by name: a field that is null counts as one that is not there.

    As JSON, with a hash of the bytes beside it, as JSON does not tell malformed bytes apart. Generated code stays small so.
    """
    named = sorted(values.items())
    said = F.to_json(F.struct(*[v.alias(f"f{n}") for n, v in named]), {"ignoreNullFields": "true"})
    whole = F.concat(said, F.xxhash64(F.array(*[v for _, v in named])).cast("string"))
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def list_digest(texts: Column) -> Column:
    """128 bits of the SHA-256 of a list of texts, none of them null.

    Joined texts, with a hash of the list beside them, as they do not tell where one ends. Cheaper than ``digest``, but it
    goes by places: only lists of the same fields can be compared.
    """
    whole = F.concat(F.array_join(texts, "\x1f"), F.xxhash64(texts).cast("string"))
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def picked(rows: DataFrame, places: DataFrame, by: Sequence[str] = (), keep: bool = True, most: int = BROADCAST_BLOCKS) -> DataFrame:
    """The rows whose number, within the columns ``by``, is among ``places`` (stored, as they are read twice); the others
    with ``keep=False``.

    Rows stay where they lie: the places go to them as bitmaps, an eighth of a byte for each row of a block.
    """
    block = F.expr(f"{ROW} div {BLOCK_ROWS}")
    at = places.select(*by, block.alias(_BLOCK), (F.col(ROW) % BLOCK_ROWS).alias(_AT))
    blocks = at.select(*by, _BLOCK).distinct().count()
    bits = at.repartition(*by, _BLOCK).groupBy(*by, _BLOCK).agg(F.bitmap_construct_agg(_AT).alias(_BITS))
    own = rows.withColumn(_BLOCK, block)
    found = own.join(F.broadcast(bits) if blocks <= most else bits, [*by, _BLOCK], "inner" if keep else "left")
    of_byte = f"conv(hex(substring({_BITS}, cast(({ROW} % {BLOCK_ROWS}) div 8 as int) + 1, 1)), 16, 10)"
    bit = F.expr(f"coalesce(getbit(cast({of_byte} as int), cast({ROW} % 8 as int)), 0)")
    return found.where(bit == (1 if keep else 0)).drop(_BLOCK, _BITS)
