"""Mixing sources to target weights: hash-random order, distributed prefix sums, an exact cut for each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from milemark.llm import common

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
ROWS_PER_RANGE = 10_000


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    source = F.col(source_col).cast("string")
    return {
        "_size": common.word_count(text_col),
        "_key": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")),
        "_source": F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)),  # joins on it need no null
    }


def _targets(rows: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """One row a source: its size, target, whole rounds through its documents and the words left for a last round.

    Sources are few; the windows over all of them see one pre-aggregated row each. In rising order of the target at
    which a source meets its limit, the level (words for each unit of weight) that the sources from there on would
    share rises up to the first source that stays under its limit, and falls after it: the largest one holds.
    """
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    by_name = Window.orderBy(F.col("_source") == "", "_source")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(listed, (F.row_number().over(by_name) - 1) % len(weights) + 1)
    limit = F.col("source_size") * float(most)
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "_source")
    levels = sizes.withColumn("weight", weight).withColumn("limit", limit).withColumn(
        "level",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
    )
    target = F.least("limit", F.col("weight") * F.max("level").over(Window.partitionBy()))
    return (
        levels.withColumn("target", target)
        .withColumn("_budget", F.round("target").cast("long"))
        .withColumn("_rounds", F.expr("_budget div greatest(source_size, 1)"))
        .withColumn("_rest", F.col("_budget") - F.col("_rounds") * F.col("source_size"))
        .select("_source", "source_size", "target", "_rounds", "_rest")
    )


def cuts(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """``_targets`` with the place (``_at``) in its hash-random order at which a source's last round ends, the words left
    there (``_left``) and how many rows share that place (``_same``).

    The order is divided into ranges of the key. Sums of the ranges, then running sums over them, tell in which range
    a source's cut falls; only that range is sorted. ``rows`` (``_source, _key, _id, _size``) must be a stored table.
    """
    ranges = rows.count() // ROWS_PER_RANGE + 1
    part = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * ranges, 32)
    placed = rows.withColumn("_part", part)
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_source", "_part").agg(F.sum("_size").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    targets = common.stored(_targets(rows, weights, most))
    here = sums.join(targets, "_source").where("_before <= _rest and _rest < _before + _sum")
    here = common.stored(here.select("_source", "_part", "_before", "_rest"))
    alike = placed.join(here, ["_source", "_part"]).groupBy("_source", "_part", "_before", "_rest", "_key", "_id", "_size")
    inside = Window.partitionBy("_source").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        alike.agg(F.count("*").alias("_same"))
        .withColumn("_upto", F.col("_before") + F.coalesce(F.sum(F.col("_size") * F.col("_same")).over(inside), F.lit(0)))
        .where("_upto <= _rest and _rest < _upto + _size * _same")
        .select("_source", F.struct("_key", "_id", "_size").alias("_at"), (F.col("_rest") - F.col("_upto")).alias("_left"), "_same")
    )
    return common.stored(targets.join(last, "_source", "left"))


def _last_round() -> Column:
    """Words of a row in its source's last round: all before the cut, an equal share of what is left at it."""
    own = F.struct("_key", "_id", "_size")
    share = F.expr("_left div _same")
    return F.when(own < F.col("_at"), F.col("_size")).when(own == F.col("_at"), share).otherwise(0)


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_TIMES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per row: id, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    Sources in code point order, null last, take the weights in turn and share all words; none gets more than ``most``
    times its own, the excess goes to the others by weight. A source is repeated whole as often as its target allows;
    then its documents follow in the order of a hash of their id until the exact number of words is reached. Null
    texts have size 0; rows alike in id and size share their place and the words left at the cut (rounded down).
    """
    rows = common.stored(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"),
                    *[c.alias(k) for k, c in _keyed(docs, id_col, text_col, source_col).items()])
    )
    found = rows.join(cuts(rows, weights, most), "_source")
    return found.select(
        F.col("_id").alias(id_col), "source", F.col("_size").alias("size"), "source_size", "target",
        (F.col("_rounds") * F.col("_size") + _last_round()).alias("taken"),
    )


def repeated(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_TIMES) -> DataFrame:
    """The mixed documents themselves, whole and with their columns unchanged: a row for each time that one is taken.

    The document at which a source's cut falls is taken whole, so a source passes its target by less than one document
    (or the rows alike there). A document without words, also a null text, counts no words and stays once. Null ids are
    one id; rows alike in id and size share their place, so that at the cut all of them or none are taken.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # so that no column has a name used here
    own_id, text, source = (plain.columns[docs.columns.index(c)] for c in ("doc_id", "text", "source"))
    keyed = plain.withColumns(_keyed(plain, own_id, text, source)).withColumn("_id", F.col(own_id))
    rows = common.stored(keyed.select("_source", "_key", "_id", "_size"))
    found = keyed.join(cuts(rows, weights, most).drop("source_size", "target"), "_source")
    own = F.struct("_key", "_id", "_size")
    more = F.when(own < F.col("_at"), 1).when((own == F.col("_at")) & (F.col("_left") > 0), 1).otherwise(0)
    times = F.when(F.col("_size") == 0, 1).otherwise(F.col("_rounds") + more)
    some = found.withColumn("_times", times.cast("int")).where("_times > 0")
    return some.withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).select(*plain.columns).toDF(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 in turn."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (
    SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
    FROM d GROUP BY source
), l AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER (
                   ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM s
), t AS (
    SELECT source, source_size, least(3.0 * source_size, weight * max(level) OVER ())::DOUBLE AS target FROM l
), o AS (
    SELECT d.*, source_size, target, round(target)::BIGINT AS budget,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       (budget // greatest(source_size, 1) * size
        + greatest(0, least(size, budget % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM o
"""
