"""Joins between sources and between snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milemark.functions.keys import KEY, canonical_key, record_key
from milemark.functions.text import blank_to_null, norm
from milemark.operators import skew


def tolerant_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left",
    blank_is_missing: bool = False, rows_per_split: int | None = None,
) -> DataFrame:
    """Joins on keys that may be written as text or as numbers (``12`` = ``012`` = ``12.0``).

    Column names of the two sides must differ. Duplicate keys multiply rows. By text equality a blank key equals a
    blank key, which multiplies all such rows; ``blank_is_missing`` lets them match nothing.
    """
    key = (lambda c: canonical_key(F.when(blank_to_null(c).isNotNull(), c))) if blank_is_missing else canonical_key
    lside = left.withColumn("_lkey", key(F.col(left_key)))
    rside = right.withColumn("_rkey", key(F.col(right_key)))
    return skew.skew_join(lside, rside, "_lkey", "_rkey", how, rows_per_split).drop("_lkey", "_rkey")


def plain_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on the key text as it stands."""
    return left.join(right, F.col(left_key).cast("string") == F.col(right_key).cast("string"), "left")


def first_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, out: str) -> DataFrame:
    """One value per left row from the tolerant matches: the smallest, so that re-runs agree."""
    lookup = (
        right.select(canonical_key(F.col(right_key)).alias("_rkey"), F.col(value).alias(out))
        .where(F.col("_rkey").isNotNull())
        .groupBy("_rkey")
        .agg(F.min(out).alias(out))
    )
    lside = left.withColumn("_lkey", canonical_key(F.col(left_key)))
    return skew.lookup_join(lside, lookup, {"_lkey": "_rkey"}).drop("_lkey", "_rkey")


def membership_flag(df: DataFrame, base: DataFrame, key: str, base_key: str, out: str) -> DataFrame:
    """SIM when the stripped key occurs among the base's stripped keys, else NÃO."""
    keys = base.select(blank_to_null(F.col(base_key)).alias("_bkey")).where(F.col("_bkey").isNotNull()).distinct()
    joined = skew.lookup_join(df.withColumn("_dkey", norm(F.col(key))), keys, {"_dkey": "_bkey"})
    return joined.withColumn(out, F.when(F.col("_bkey").isNotNull(), "SIM").otherwise("NÃO")).drop("_dkey", "_bkey")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def restrict_to(source: DataFrame, source_key: str, keys: DataFrame, key: str, tolerant: bool = True) -> DataFrame:
    """Source rows whose key occurs in ``keys``.

    Meant for sources already brought to one row per written key, as freshness does: then no
    key is hot on either side.
    """
    as_key = canonical_key if tolerant else (lambda c: c.cast("string"))
    wanted = keys.select(as_key(F.col(key)).alias("_wanted")).where(F.col("_wanted").isNotNull()).distinct()
    return source.join(wanted, as_key(F.col(source_key)) == F.col("_wanted"), "left_semi")


def _single_keys(df: DataFrame, candidates: Sequence[str], mark: str) -> DataFrame:
    """Each record key once, with a mark; a missing or repeated key fails when the plan runs."""
    missing = f"raise_error('snapshot row without a key ({', '.join(candidates)})')"
    # A key that was stored with its row is there and stays as it lies: days in equal buckets are not exchanged.
    key = F.col(KEY) if KEY in df.columns else F.coalesce(record_key(df, candidates), F.expr(missing))
    keys = df.select(key.alias("chave")).groupBy("chave").count()
    once = "case when count > 1 then raise_error(concat('duplicated snapshot key: ', chave)) else true end"
    return keys.select("chave", F.expr(once).alias(mark))


def match_snapshots(previous: DataFrame, current: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Where each record key occurs: entrou, saiu or comum. Keys must be there and be unique."""
    p = _single_keys(previous, candidates, "_p")
    c = _single_keys(current, candidates, "_c")
    side = (
        F.when(F.col("_p").isNull(), "entrou").when(F.col("_c").isNull(), "saiu").otherwise("comum").alias("presenca")
    )
    return c.join(p, "chave", "full").select("chave", side)


def key_diff(previous: DataFrame, current: DataFrame, candidates: Sequence[str], presence: str) -> DataFrame:
    """Keys that entered, left or stayed."""
    return match_snapshots(previous, current, candidates).where(F.col("presenca") == presence).select("chave")


def page_key(num_convenio: Column, cod_tci: Column) -> Column:
    """Contract number, else the code; stripped."""
    return norm(F.coalesce(F.nullif(num_convenio, F.lit("")), cod_tci))


def previous_row(current: DataFrame, previous: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Current rows with ``prev``: the earlier row's fields as a struct, null for a new record."""
    lookup = previous.select(
        page_key(F.col("num_convenio"), F.col("cod_tci")).alias("_pkey"), F.struct(*fields).alias("prev")
    )
    keyed = current.withColumn("_ckey", page_key(F.col("num_convenio"), F.col("cod_tci")))
    return skew.lookup_join(keyed, lookup, {"_ckey": "_pkey"}).drop("_ckey", "_pkey")


def key_report(df: DataFrame, candidates: Sequence[str], label: str) -> DataFrame:
    """One row: rows without a key, duplicated keys and up to five of them in order."""
    counts = df.select(record_key(df, candidates).alias("chave")).groupBy("chave").count()
    repeated = F.col("chave").isNotNull() & (F.col("count") > 1)
    # The limit is taken before the list is built, so the list never holds more than five keys.
    examples = (
        counts.where(repeated).orderBy("chave").limit(5).agg(F.array_sort(F.collect_list("chave")).alias("_ex"))
    )
    totals = counts.agg(
        F.coalesce(F.sum(F.when(F.col("chave").isNull(), F.col("count"))), F.lit(0)).alias("sem_chave"),
        F.count_if(repeated).alias("chaves_duplicadas"),
    )
    return totals.select(
        F.lit(label).alias("rotulo"),
        "sem_chave",
        "chaves_duplicadas",
        F.array_join(examples.scalar(), ", ").alias("exemplos"),
    )


def check_keys(df: DataFrame, candidates: Sequence[str], label: str) -> None:
    """Raises when a snapshot has rows without a key or repeated keys."""
    row = key_report(df, candidates, label).first()
    if row["sem_chave"]:
        raise ValueError(f"{label}: {row['sem_chave']} rows without a key ({', '.join(candidates)})")
    if row["chaves_duplicadas"]:
        raise ValueError(f"{label}: duplicated keys: {row['exemplos']}")


def restrict_previous(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Previous rows whose contract number and code both occur in the current rows; blank equals blank."""
    pair = ["num_convenio", "cod_tci"]
    keys = [norm(F.col(c)).alias(f"_{c}") for c in pair]
    marked = previous.select("*", *keys)
    return skew.semi_join(marked, current.select(*keys), {f"_{c}": f"_{c}" for c in pair}).select(*previous.columns)
