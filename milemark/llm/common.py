"""Helpers of the text operators: words, stored intermediate tables, components, blocked comparisons."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for a local session that sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="milemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def names(df: DataFrame) -> list[str]:
    """The columns, quoted, whatever their names hold."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def word_count(text: str | Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sample_by_group(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of each group that come first by their hash ``key``, the same on every run.

    Groups are counted first, and only rows whose hash is small enough to be among a few times ``n`` go on: what meets
    in the task that ranks a group depends on ``n`` and not on the size of the table.
    """
    uniform = F.pmod(F.col(key), F.lit(1 << 31)) / float(1 << 31)
    counts = stored(df.groupBy(group).agg(F.count("*").alias("_of")))
    # Groups are classes or languages; only a checked number of them is broadcast.
    counts = F.broadcast(counts) if counts.count() <= 10_000 else counts
    near = df.join(counts, group).where(uniform * F.col("_of") < 4 * n + 64)
    order = Window.partitionBy(group).orderBy(uniform, key)
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n", "_of")


def spread(text: str | Column, seed: str | Column, chars: int, part: int) -> Column:
    """The whole text if it has at most ``chars`` characters, else as many parts of ``part`` characters as make them up.

    The parts come from all over the text: ``seed`` and a part's number decide which, the same on every run. They keep
    their order and have a line break between them. Null stays null.
    """
    text = F.col(text) if isinstance(text, str) else text
    last = (F.ceil(F.length(text) / part) - 1).cast("int")
    drawn = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.struct(F.xxhash64(seed, k).alias("h"), k.alias("k"))
    )
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(drawn), 1, chars // part), lambda d: d["k"]))
    parts = F.transform(chosen, lambda k: F.substring(text, k * part + 1, F.lit(part)))
    return F.when(F.length(text) > chars, F.array_join(parts, "\n")).otherwise(text)


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that an edge (``a``, ``b``) touches.

    Alternating large-star and small-star rounds: each node is tied to the smallest of its neighbours until only
    stars are left. Every round is aggregates and equi-joins over stored tables, so that adaptive execution can cut
    the partition of a node with very many neighbours. Loops and nulls among the edges are left out.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    pairs, before = stored(pairs), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = stored(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        tied = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e")
        )
        pairs = stored(tied.where("e.u != e.m").select("e.u", F.col("e.m").alias("v")).distinct())
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n items the smallest index of its group under the given links."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while not np.array_equal(root, hop := root[root]):
            root = hop
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root


def block_pairs(rows: DataFrame, bucket: list[str], item: str, size: int = BLOCK, weight: Column | None = None) -> DataFrame:
    """Deals the rows of every bucket into blocks of about ``size`` and repeats them for each pair of blocks.

    With ``weight`` a row counts as so many.

    Adds ``block`` (the row's own), ``lo`` and ``hi``: grouped by bucket, ``lo`` and ``hi``, any two rows of a
    bucket meet in one bounded group, however large the bucket is. Two rows of one block meet where ``lo = hi``.
    """
    counts = rows.groupBy(bucket).agg(F.ceil((F.count("*") if weight is None else F.sum(weight)) / size).cast("int").alias("blocks"))
    dealt = rows.join(counts, bucket).withColumn(
        "block", F.pmod(F.xxhash64(item, F.lit("block")), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        dealt.withColumn("other", other)
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .drop("blocks", "other")
    )


def over_batches(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: ``work`` on every batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield work(batch)

    return run


def map_column(
    df: DataFrame, column: str, fields: dict[str, tuple[str, pa.DataType]], work: Callable[[], Callable[[list], list[tuple]]],
    rows: int | None = None,
) -> DataFrame:
    """``df`` without ``column`` and with ``fields`` worked out from it, row by row.

    ``work()`` is called once in each task and gives a function from the column's values to tuples of the fields. The
    other columns pass through as they are, so that long ids stay exact beside nulls. ``rows`` bounds how many results
    are held at once.
    """
    kept = [c for c in df.columns if c != column]
    types = [t for _, t in fields.values()]
    # Under plain names meanwhile: mapInArrow can't take columns whose names hold a dot.
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    asked = plain.columns[df.columns.index(column)]
    passed = [c for c in plain.columns if c != asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = work()
        for batch in (b.slice(at, rows or b.num_rows) for b in batches for at in range(0, b.num_rows, rows or b.num_rows or 1)):
            found = own(batch.column(asked).to_pylist())
            new = [pa.array([r[k] for r in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in passed], *new], names=[*passed, *[f"n{k}" for k in range(len(new))]]
            )

    schema = [f"{c} {plain.schema[c].dataType.simpleString()}" for c in passed]
    schema += [f"n{k} {ddl}" for k, (ddl, _) in enumerate(fields.values())]
    return plain.mapInArrow(run, ", ".join(schema)).toDF(*kept, *fields)
