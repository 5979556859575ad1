"""The factored join against the rows it stands for."""

import pytest
from pyspark.sql import functions as F

from milemark.operators.factored import FactoredJoin

LEFT = [("1", "SP", 10), ("01", "SP", 20), ("1.0", "RJ", None), ("x", "RJ", 5), ("", "SP", 7), ("", "RJ", 8), (" ", "SP", 9), (None, "SP", 1), ("9", "MG", None)]
RIGHT = [("1", "a"), ("001", "b"), ("", "c"), ("", "d"), (None, "e"), ("7", "f"), (" ", "g")]


def sides(spark):
    return (
        spark.createDataFrame(LEFT, "k string, uf string, v int").repartition(3),
        spark.createDataFrame(RIGHT, "r string, w string").repartition(2),
    )


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("blank", [False, True])
def test_against_the_unfolded_rows(spark, blank):
    f = FactoredJoin(*sides(spark), "k", "r", blank)
    rows = f.unfold()
    assert rows_of(f.unfold(1)) == rows_of(rows)
    assert rows.count() == (6 + 6 if blank else 6 + 1 + 4 + 1 + 1 + 1)
    totals = f.totals(["uf"], {"v": F.col("v")})
    assert rows_of(totals) == rows_of(rows.groupBy("uf").agg(F.count("*").alias("linhas"), F.sum("v").alias("v")))
    each = rows.groupBy("k", "uf", "v").count().withColumnRenamed("count", "linhas")
    assert rows_of(f.left_rows()) == rows_of(each)
    right = rows.where("w is not null").groupBy("r", "w").count().withColumnRenamed("count", "linhas")
    assert rows_of(f.right_rows()) == rows_of(right)
    keyed = f.keys().agg(F.sum("linhas")).first()[0]
    without = f.left.where(F.col("k").isNull() if not blank else F.col("k").isNull() | (F.trim("k") == "")).count()
    assert keyed + without == rows.count()


def test_blank_by_blank_stays_small(spark):
    n = 30_000
    left = spark.range(n).select(F.lit("").alias("k"), F.col("id").alias("v"))
    right = spark.range(n).select(F.lit("").alias("r"), F.col("id").alias("w"))
    f = FactoredJoin(left, right, "k", "r")
    assert [tuple(r) for r in f.keys().collect()] == [("t:", n, n, n * n)]
    assert f.left_rows().count() == n and f.right_rows().count() == n
    assert f.totals([], {"v": F.col("v")}).first() == (n * n, n * n * (n - 1) // 2)


def test_empty_sides(spark):
    left, right = sides(spark)
    none = FactoredJoin(left, right.limit(0), "k", "r")
    assert none.totals([], {}).first()[0] == len(LEFT) == none.unfold().count()
    assert none.right_rows().count() == 0
    assert FactoredJoin(left.limit(0), right, "k", "r").keys().agg(F.sum("linhas")).first()[0] == 0
