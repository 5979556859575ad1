"""Intervals of unchanged days: every stored day comes back, stored rows grow with the changes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from milemark.sources.store import merge
from milemark.sources.validity import ValidityStore, intervals

DAYS = [f"2026-01-0{k}" for k in range(1, 7)]
# Record by day; '' and null are two values, and a record may leave and come back.
VALUES = {
    "a": ["x", "x", "x", "x", "x", "x"],
    "b": ["x", "y", "y", "x", "x", "z"],
    "c": ["x", None, None, "x", "x", None],
    "d": [None, None, "x", None, "x", "x"],
    "e": ["", "null", "", "", "null", "null"],
}


def day(spark, k):
    rows = [(key, "" if v[k] == "" else None if v[k] == "null" else v[k]) for key, v in VALUES.items() if v[k] is not None]
    return spark.createDataFrame(rows, "num_convenio string, uf string")


def brute(upto=len(DAYS)):
    out = []
    for key, v in VALUES.items():
        k = 0
        while k < upto:
            end = k
            while end + 1 < upto and v[end + 1] == v[k]:
                end += 1
            if v[k] is not None:
                out.append((key, None if v[k] == "null" else v[k], DAYS[k], DAYS[end]))
            k = end + 1
    return sorted(out, key=str)


def runs(df):
    return sorted([(r["num_convenio"], r["uf"], r["desde"], r["ate"]) for r in df.collect()], key=str)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_runs_of_a_history(spark):
    rows, headers = merge({d: day(spark, k) for k, d in enumerate(DAYS)})
    found = intervals(rows, list(headers))
    assert runs(found) == brute()
    found.collect()
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") <= 1


@pytest.mark.parametrize("built", [0, 3])
def test_every_day_comes_back(spark, tmp_path, built):
    store = ValidityStore(spark, str(tmp_path / "s"))
    if built:
        store.build(*merge({d: day(spark, k) for k, d in enumerate(DAYS[:built])}))
    for k in range(built, len(DAYS)):
        store.extend(day(spark, k), DAYS[k])
    assert store.days() == DAYS
    assert runs(store.intervals()) == brute()
    for k, d in enumerate(DAYS):
        assert rows_of(store.at(d)) == rows_of(day(spark, k)), d


@pytest.mark.parametrize("built", [0, 4])
def test_the_last_day_stored_again(spark, tmp_path, built):
    store = ValidityStore(spark, str(tmp_path / "s"))
    if built:
        store.build(*merge({d: day(spark, k) for k, d in enumerate(DAYS[:built])}))
    for k in range(built, 4):
        store.extend(day(spark, k), DAYS[k])
    for other in (5, 0, 1, 3):
        store.extend(day(spark, other), DAYS[3])
        assert rows_of(store.at(DAYS[3])) == rows_of(day(spark, other))
    assert runs(store.intervals()) == brute(4)
    with pytest.raises(ValueError, match="days come in order"):
        store.extend(day(spark, 1), DAYS[1])
    assert runs(store.intervals()) == brute(4)


def test_headers_that_change(spark, tmp_path):
    store = ValidityStore(spark, str(tmp_path / "s"))
    plain = day(spark, 0)
    wide = plain.withColumn("a b.c", F.when(F.col("num_convenio") == "b", "new"))
    store.extend(plain, DAYS[0])
    store.extend(wide, DAYS[1])
    store.extend(plain, DAYS[2])
    for d, df in ((DAYS[0], plain), (DAYS[1], wide), (DAYS[2], plain)):
        assert store.at(d).columns == df.columns
        assert rows_of(store.at(d)) == rows_of(df)
    # Only b has a value in the new column; the others go on.
    found = [(r["num_convenio"], r["desde"], r["ate"]) for r in store.intervals().collect()]
    assert sorted(found) == [("a", DAYS[0], DAYS[2]), ("b", DAYS[0], DAYS[0]), ("b", DAYS[1], DAYS[1]), ("b", DAYS[2], DAYS[2]),
                             ("c", DAYS[0], DAYS[2]), ("e", DAYS[0], DAYS[2])]


def test_stored_rows_grow_with_the_changes(spark, tmp_path):
    path = tmp_path / "s"
    store = ValidityStore(spark, str(path))
    base = spark.range(2000).select(F.col("id").cast("string").alias("num_convenio"), F.lit("SP").alias("uf"))
    for k, d in enumerate(DAYS):
        store.extend(base.withColumn("uf", F.when(F.col("num_convenio") == str(k), "RJ").otherwise(F.col("uf"))), d)
    begun = spark.read.parquet(f"{path}/begun").count()
    ended = spark.read.parquet(f"{path}/ended").count()
    assert begun == 2000 + 2 * 5 and ended == 2 * 5


def test_bad_keys_and_stopped_runs(spark, tmp_path):
    store = ValidityStore(spark, str(tmp_path / "s"))
    store.extend(day(spark, 0), DAYS[0])
    twice = day(spark, 1).union(day(spark, 1))
    with pytest.raises(PySparkException, match="duplicated snapshot key"):
        store.extend(twice, DAYS[1])
    with pytest.raises(PySparkException, match="without a key"):
        store.extend(day(spark, 1).withColumn("num_convenio", F.lit(" ")), DAYS[1])
    # Rows of a run that stopped before it was listed.
    day(spark, 1).withColumns({"_chave": F.lit("zz"), "desde": F.lit(DAYS[0])}).write.parquet(f"{store.begun_path}/run=lost")
    assert store.days() == DAYS[:1] and rows_of(store.at(DAYS[0])) == rows_of(day(spark, 0))
    with pytest.raises(ValueError, match="new folder"):
        store.build(*merge({DAYS[0]: day(spark, 0)}))
    rows, headers = merge({DAYS[0]: day(spark, 0), DAYS[1]: twice})
    with pytest.raises(PySparkException, match="duplicated snapshot key"):
        intervals(rows, list(headers)).collect()


def test_a_day_without_rows(spark, tmp_path):
    store = ValidityStore(spark, str(tmp_path / "s"))
    for k, df in enumerate((day(spark, 0), day(spark, 0).limit(0), day(spark, 0))):
        store.extend(df, DAYS[k])
    assert [store.at(d).count() for d in DAYS[:3]] == [4, 0, 4]
    assert all(a == b for _, _, a, b in runs(store.intervals()))
