"""Equi-joins that keep hot and missing keys from landing in one task.

Rows without a key get a stand-in of their own that no other side can hold, so they spread like any others. Both sides
of a join are plain exchanges on one column, which adaptive execution cuts at a hot key. It looks at the size of the sides
only, not of what they give: a few thousand blank keys on both sides are small and multiply to millions of rows. Blank keys
are therefore always dealt out, the left rows over ``BLANK_PARTS`` parts and the right rows repeated for each. Chains of joins
on one key cannot be cut by adaptive execution; for them, or without it, ``rows_per_split`` counts the keys first and salts
the hot ones. The result never depends on it.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where keys are counted, a key is split into about this many rows per task.
ROWS_PER_SPLIT = 1_000_000
# From this limit on a list of hot keys is short whatever the input and is broadcast: a row for each so many rows at most.
BROADCAST_FROM = 100_000
# Pieces of a side of a key that is hot on both sides: its rows are repeated for the pieces of the other one.
GRID_PIECES = 32
# Parts over which the rows with a blank key are dealt where keys are not counted.
BLANK_PARTS = 128


def hot_keys(df: DataFrame, key: str, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Keys with more rows than one task should hold: ``(hot_key, splits)``.

    Exact, by partial counts; at most rows / ``rows_per_split`` keys can be in it.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > rows_per_split).select(
        "hot_key", F.ceil(F.col("n") / rows_per_split).cast("int").alias("splits")
    )


def find_hot(df: DataFrame, key: str, rows_per_split: int | None = ROWS_PER_SPLIT) -> DataFrame | None:
    """``hot_keys`` as a lazy part of the plan; None when no limit is given. Meant for stored tables: ``df`` is read again."""
    return None if rows_per_split is None else hot_keys(df, key, rows_per_split)


def _listed(hot: DataFrame, rows_per_split: int) -> DataFrame:
    """A list of hot keys as it is joined: broadcast where the limit keeps it short, else as its size turns out."""
    # A row for each rows_per_split rows of the input at most: 100,000 for 100 billion rows and a limit of a million.
    return F.broadcast(hot) if rows_per_split >= BROADCAST_FROM else hot


def _with_splits(df: DataFrame, key: str, hot: DataFrame | None, out: str, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    if hot is None:
        return df.withColumn(out, F.lit(1))
    renamed = hot.select(F.col("hot_key").alias("_hot"), F.col("splits").alias("_n"))
    joined = df.join(_listed(renamed, rows_per_split), F.col(key) == F.col("_hot"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_n"), F.lit(1))).drop("_hot", "_n")


def _row_hash(columns: list[str]) -> Column:
    """A number that a retried task computes again; exact copies differ by input partition."""
    return F.xxhash64(*[F.col(c) for c in columns]) + F.spark_partition_id()


def _hashable(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]


def _pick(columns: list[str], n: Column) -> Column:
    return F.when(n > 1, F.pmod(_row_hash(columns), n).cast("int")).otherwise(F.lit(0))


def _blank(key: str) -> Column:
    """Whether a canonical key is that of a blank text."""
    return F.coalesce(F.col(key).rlike(r"^t:\s*\z"), F.lit(False))


def _every_part(key: str) -> Column:
    """The parts that a right row is needed in: all for a blank key, else one."""
    return F.explode(F.when(_blank(key), F.sequence(F.lit(0), F.lit(BLANK_PARTS - 1))).otherwise(F.array(F.lit(0))))


def _one_part(columns: list[str], key: str) -> Column:
    return F.when(_blank(key), F.pmod(_row_hash(columns), F.lit(BLANK_PARTS)).cast("int")).otherwise(F.lit(0))


def _in_part(key: str, part: str) -> Column:
    """A blank key with its part before it, so that it stays one column; keys must not begin with ``b:``."""
    return F.when(_blank(key), F.concat(F.lit("b:"), F.col(part).cast("string"), F.lit(":"), F.col(key))).otherwise(F.col(key))


def own_key(df: DataFrame, key: str) -> DataFrame:
    """A text key with nulls replaced by stand-ins that differ from row to row; keys must not begin with ``x:``."""
    stand_in = F.concat(F.lit("x:"), _row_hash(_hashable(df)).cast("string"))
    return df.withColumn(key, F.coalesce(F.col(key), stand_in))


def hot_grid(
    left: DataFrame, sources: Mapping[str, tuple[DataFrame, str | None]], key: str, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """How a chain of joins on ``key`` is cut: ``hot_key, splits`` of the left rows, ``parts`` of the rows of ``owner``.

    The owner of a hot key is the source with the most rows for it, counted by ``hot_text`` where a source's second
    element names a column whose text has to be equal as well. Exact; at most a row for each ``rows_per_split`` rows.
    """
    ways = []
    for tag, (df, text) in sources.items():
        said = F.lit(None).cast("string") if text is None else F.col(text)
        counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("hot_key"), said.alias("hot_text")).agg(F.count("*").alias("n"))
        ways.append(counts.where(F.col("n") > rows_per_split).withColumn("owner", F.lit(tag)))
    every = reduce(DataFrame.unionByName, ways)
    most = every.groupBy("hot_key").agg(F.max(F.struct("n", "owner", "hot_text")).alias("m")).select(
        "hot_key", "m.owner", "m.hot_text", F.ceil(F.col("m.n") / rows_per_split).cast("int").alias("parts")
    )
    both = hot_keys(left, key, rows_per_split).join(most, "hot_key", "full")
    s, p = (F.coalesce(F.col(c), F.lit(1)) for c in ("splits", "parts"))
    splits, parts = _bounded(s, p).alias("splits"), _bounded(p, s).alias("parts")
    return both.select("hot_key", splits, parts, "owner", "hot_text")


def _bounded(own: Column, other: Column) -> Column:
    """Pieces of one side: where the other is cut as well, no more than keep the repeated rows few."""
    return F.when(other > 1, F.least(own, F.lit(GRID_PIECES))).otherwise(own)


def _with_grid(df: DataFrame, key: str, hot: DataFrame, rows_per_split: int) -> DataFrame:
    renamed = hot.select(*[F.col(c).alias(f"_g_{c}") for c in ("hot_key", "splits", "parts", "owner", "hot_text")])
    joined = df.join(_listed(renamed, rows_per_split), F.col(key) == F.col("_g_hot_key"), "left")
    one = {c: F.coalesce(F.col(c), F.lit(1)) for c in ("_g_splits", "_g_parts")}
    return joined.withColumns(one)


def _cut(text: Column) -> Column:
    """Whether a row's key is cut by parts: also its text is the hot one, where that matters."""
    return F.col("_g_owner").isNotNull() & (F.col("_g_hot_text").isNull() | F.coalesce(text == F.col("_g_hot_text"), F.lit(False)))


_GRID = ["_g_hot_key", "_g_splits", "_g_parts", "_g_owner", "_g_hot_text"]


def spread_left(
    df: DataFrame, key: str, hot: DataFrame | None, salt: str, text: Column | None = None, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Left side of a chain of joins on one text key: a hot key's rows get different salts, missing keys stand-ins.
    Without a list of hot keys those are the blank ones.

    Where the key is hot in a source, a row is repeated for each part of the source's rows; ``_owner`` names the source
    then, and ``matched`` drops the copies that meet none of them.
    """
    columns = _hashable(df)
    own = own_key(df, key)
    if hot is None:
        return own.withColumns({salt: _one_part(columns, key), "_owner": F.lit(None).cast("string")})
    split = _with_grid(own, key, hot, rows_per_split).withColumn("_a", _pick(columns, F.col("_g_splits")))
    cut = _cut(F.lit(None).cast("string") if text is None else text)
    split = split.withColumn("_owner", F.when(cut, F.col("_g_owner")))
    split = split.withColumn("_b", F.explode(F.sequence(F.lit(0), F.when(cut, F.col("_g_parts")).otherwise(1) - 1)))
    return split.withColumn(salt, F.col("_a") * F.col("_g_parts") + F.col("_b")).drop("_a", "_b", *_GRID)


def spread_right(
    df: DataFrame, key: str, hot: DataFrame | None, salt: str, tag: str = "", text: Column | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """A source of the same chain: its rows are dealt to the parts of the hot keys that it owns (``tag``) and repeated for
    every other split."""
    known = df.where(F.col(key).isNotNull())
    if hot is None:
        return known.withColumn(salt, _every_part(key))
    columns = _hashable(df)
    split = _with_grid(known, key, hot, rows_per_split)
    own = F.when(_cut(F.lit(None).cast("string") if text is None else text), _pick(columns, F.col("_g_parts"))).otherwise(0)
    all_ = F.sequence(F.lit(0), F.col("_g_parts") - 1)
    split = split.withColumn("_b", F.explode(F.when(F.coalesce(F.col("_g_owner") == tag, F.lit(False)), F.array(own)).otherwise(all_)))
    split = split.withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_g_splits") - 1)))
    return split.withColumn(salt, F.col("_a") * F.col("_g_parts") + F.col("_b")).drop("_a", "_b", *_GRID)


def matched(joined: DataFrame, tag: str, found: Column) -> DataFrame:
    """Without copies of a left row that met no row of the source its key is hot in: another copy is certain to."""
    return joined.where(~F.coalesce(F.col("_owner") == tag, F.lit(False)) | found)


def lookup_join(left: DataFrame, right: DataFrame, on: Mapping[str, str], rows_per_split: int | None = None) -> DataFrame:
    """Left join to a table with unique keys; ``on`` maps left key columns to right ones.

    The sides meet on a hash of the keys, any number and type of them, and the keys themselves are compared there. The
    exchange of an aggregated lookup is thereby a new and plain one, and the join can be cut where a left key is hot.
    """
    lcols, rcols = left.columns, right.columns
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    lside = left.withColumn("_h", F.when(complete, F.xxhash64(*on)))
    hot = find_hot(lside.select("_h"), "_h", rows_per_split)
    limit = rows_per_split or ROWS_PER_SPLIT
    lside = _with_splits(lside, "_h", hot, "_splits", limit).withColumn("_salt", _pick(_hashable(left), F.col("_splits")))
    lside = lside.withColumn("_h", F.coalesce(F.col("_h"), _row_hash(_hashable(left)))).drop("_splits")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on.values()])
    rside = right.where(known).withColumn("_rh", F.xxhash64(*on.values()))
    if hot is None:
        rside = rside.withColumn("_rsalt", F.lit(0))
    else:
        rside = _with_splits(rside, "_rh", hot, "_splits", limit)
        rside = rside.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))).drop("_splits")
    cond = lside["_h"] == rside["_rh"]
    if hot is not None:
        cond = cond & (lside["_salt"] == rside["_rsalt"])
    for l, r in on.items():
        # Left out of the exchange: a residual condition, not a further key.
        cond = cond & F.coalesce(lside[l] == rside[r], F.lit(False))
    return lside.join(rside, cond, "left").select(*lcols, *rcols)


def semi_join(left: DataFrame, right: DataFrame, on: Mapping[str, str], rows_per_split: int | None = None) -> DataFrame:
    """Left rows whose key occurs on the right; repeated right keys are merged before they move."""
    keys = right.select(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())]).dropna().distinct()
    pairs = {l: f"_k{i}" for i, l in enumerate(on)}
    joined = lookup_join(left, keys, pairs, rows_per_split)
    return joined.where(F.col("_k0").isNotNull()).select(*left.columns)


def skew_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left", rows_per_split: int | None = None
) -> DataFrame:
    """Inner or left equi-join on text keys.

    With ``rows_per_split`` hot keys of either side are cut into a grid of tasks: a hot left key is split by rows and
    the matching right rows repeated; a hot right key the other way round. Copies of a left row that meet no right row in
    their cell are dropped only for hot right keys, where another cell is certain to match.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    lcols, rcols = left.columns, right.columns
    right = right.where(F.col(right_key).isNotNull())
    hot_l = find_hot(left.select(left_key), left_key, rows_per_split)
    hot_r = find_hot(right.select(right_key), right_key, rows_per_split)
    # The left key is shown as it was.
    kept = left.withColumn("_own", F.col(left_key))
    lside = own_key(kept, left_key)
    if rows_per_split is None:
        lside = lside.withColumn("_la", _one_part(_hashable(left), left_key)).withColumn(left_key, _in_part(left_key, "_la"))
        # The right key may be shown too and is not changed.
        rside = right.withColumn("_ra", _every_part(right_key)).withColumn("_rpart", _in_part(right_key, "_ra"))
        joined = lside.join(rside, lside[left_key] == rside["_rpart"], how)
        return joined.withColumn(left_key, F.col("_own")).select(*lcols, *rcols)

    def with_pieces(df: DataFrame, key: str, l: str, r: str) -> DataFrame:
        both = _with_splits(_with_splits(df, key, hot_l, "_sl", rows_per_split), key, hot_r, "_sr", rows_per_split)
        return both.withColumns({l: _bounded(F.col("_sl"), F.col("_sr")), r: _bounded(F.col("_sr"), F.col("_sl"))}).drop("_sl", "_sr")

    lside = with_pieces(lside, left_key, "_ls", "_rs").withColumn("_la", _pick(_hashable(left), F.col("_ls"))).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0), F.col("_rs") - 1))
    )
    rside = with_pieces(right, right_key, "_ls", "_rs2")
    rside = (
        rside.withColumn("_rb", _pick(_hashable(right), F.col("_rs2")))
        .withColumn("_ra", F.explode(F.sequence(F.lit(0), F.col("_ls") - 1)))
        .drop("_ls", "_rs2")
    )
    on = (lside[left_key] == rside[right_key]) & (F.col("_la") == F.col("_ra")) & (F.col("_lb") == F.col("_rb"))
    joined = lside.join(rside, on, how)
    if how == "left":
        joined = joined.where((F.col("_rs") == 1) | F.col("_rb").isNotNull())
    return joined.withColumn(left_key, F.col("_own")).select(*lcols, *rcols)
