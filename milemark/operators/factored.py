"""The tolerant join left factored: each side once, with the number of partners of its key on the other side."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milemark.functions.keys import canonical_key
from milemark.functions.text import blank_to_null
from milemark.operators import joins, skew

WEIGHT = "linhas"


@dataclass(frozen=True)
class FactoredJoin:
    """A left join on tolerant keys whose rows are not written out.

    A key with ``m`` rows on the left and ``n`` on the right stands for ``m * n`` rows, of which this keeps ``m + n``:
    it grows with the input, also where blank keys meet blank ones. Counts and sums over the joined rows come from the
    weights; ``unfold`` gives the rows themselves. ``blank_is_missing`` as in ``tolerant_join``.
    """

    left: DataFrame
    right: DataFrame
    left_key: str
    right_key: str
    blank_is_missing: bool = False

    def _key(self, name: str) -> Column:
        c = F.col(f"`{name}`")
        return canonical_key(F.when(blank_to_null(c).isNotNull(), c) if self.blank_is_missing else c)

    def _counted(self, side: str) -> DataFrame:
        df, name = (self.left, self.left_key) if side == "l" else (self.right, self.right_key)
        keys = df.select(self._key(name).alias(f"_{side}"))
        return keys.where(F.col(f"_{side}").isNotNull()).groupBy(f"_{side}").agg(F.count("*").alias(f"_n{side}"))

    def keys(self) -> DataFrame:
        """One row for each canonical key on either side: ``chave``, rows on the left and right, joined rows.

        Left rows without a key are in no row of this; each stands for one joined row.
        """
        both = self._counted("l").join(self._counted("r"), F.col("_l") == F.col("_r"), "full")
        m, n = (F.coalesce(c, F.lit(0)) for c in ("_nl", "_nr"))
        return both.select(
            F.coalesce("_l", "_r").alias("chave"), m.alias("linhas_esquerda"), n.alias("linhas_direita"), (m * F.greatest(n, F.lit(1))).alias(WEIGHT),
        )

    def _weighted(self, df: DataFrame, name: str, side: str) -> DataFrame:
        keyed = df.withColumn("_k", self._key(name))
        return skew.lookup_join(keyed, self._counted(side), {"_k": f"_{side}"})

    def left_rows(self) -> DataFrame:
        """The left rows with ``linhas``: how many joined rows each stands for, at least one."""
        found = self._weighted(self.left, self.left_key, "r")
        return found.select(*[F.col(f"`{c}`") for c in self.left.columns], F.coalesce("_nr", F.lit(1)).alias(WEIGHT))

    def right_rows(self) -> DataFrame:
        """The right rows that occur in the join with ``linhas``: how often each does."""
        found = self._weighted(self.right, self.right_key, "l").where(F.col("_nl").isNotNull())
        return found.select(*[F.col(f"`{c}`") for c in self.right.columns], F.col("_nl").alias(WEIGHT))

    def totals(self, by: list[str], sums: Mapping[str, Column]) -> DataFrame:
        """Joined rows and sums over them by columns of the left side, as a ``groupBy`` of the unfolded join gives.

        ``sums`` are expressions of left columns; a sum of nulls only is null.
        """
        rows = self.left_rows()
        return rows.groupBy(*by).agg(F.sum(WEIGHT).alias(WEIGHT), *[F.sum(c * F.col(WEIGHT)).alias(n) for n, c in sums.items()])

    def unfold(self, rows_per_split: int | None = None) -> DataFrame:
        """Every joined row; keys with more rows than ``rows_per_split`` on a side are cut over several tasks."""
        return joins.tolerant_join(
            self.left, self.right, self.left_key, self.right_key, blank_is_missing=self.blank_is_missing, rows_per_split=rows_per_split,
        )
