"""Snapshots in buckets of their key."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from milemark import config as C
from milemark.operators import diff as D
from milemark.operators import joins as J
from milemark.sources.buckets import BucketedSnapshots, bucket_count


def day(spark, k):
    rows = [(str(n), f"{n}-2", "SP", f"v{n * k % 3}") for n in range(300) if (n + k) % 7]
    return spark.createDataFrame(rows, "num_convenio string, cod_saci string, uf string, vlr_repasse string").repartition(3)


def rows_of(df):
    return sorted(map(str, df.collect()))


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_two_days_meet_without_an_exchange(spark, tmp_path):
    store = BucketedSnapshots(spark, str(tmp_path / "s"), 8)
    for k, name in ((1, "2026-01-01"), (2, "2026-01-02")):
        store.write(day(spark, k), name)
    a, b = store.at("2026-01-01"), store.at("2026-01-02")
    for found, want in (
        (D.diff_pair(a, b), D.diff_pair(day(spark, 1), day(spark, 2))),
        (J.match_snapshots(a, b, C.CONTRACT_DIFF.key_candidates), J.match_snapshots(day(spark, 1), day(spark, 2), C.CONTRACT_DIFF.key_candidates)),
    ):
        assert rows_of(found) == rows_of(want)
        assert "Exchange" not in plan(found) and "SortMergeJoin" in plan(found)
        assert "Exchange" in plan(want)


def test_days_stored_again_and_new_sessions(spark, tmp_path):
    path = str(tmp_path / "it's here")
    store = BucketedSnapshots(spark, path, 4)
    store.write(day(spark, 1), "2026-01-02")
    before = store.at("2026-01-02")
    store.write(day(spark, 3), "2026-01-02")
    store.write(day(spark, 2).withColumn("objeto", F.lit("x")), "2026-01-01")
    assert store.days() == ["2026-01-01", "2026-01-02"]
    want = rows_of(day(spark, 3))
    assert rows_of(store.at("2026-01-02").drop("_chave")) == want
    assert rows_of(before.drop("_chave")) == rows_of(day(spark, 1))
    for t in spark.catalog.listTables():  # as a session finds it that knows the path only
        if t.name.startswith("snapshot_"):
            spark.sql(f"DROP TABLE {t.name}")
    again = BucketedSnapshots(spark, path, 4)
    assert rows_of(again.at("2026-01-02").drop("_chave")) == want
    assert again.at("2026-01-01").columns == ["num_convenio", "cod_saci", "uf", "vlr_repasse", "objeto", "_chave"]
    assert "Exchange" not in plan(D.diff_pair(again.at("2026-01-01"), again.at("2026-01-02")))


def test_bad_keys(spark, tmp_path):
    store = BucketedSnapshots(spark, str(tmp_path / "s"), 2)
    bad = spark.createDataFrame([("1", "a"), (" ", "b")], "num_convenio string, uf string")
    with pytest.raises(PySparkException, match="without a key"):
        store.write(bad, "2026-01-01")
    assert store.days() == []
    store.write(bad.where("uf = 'a'").union(bad.where("uf = 'a'")), "2026-01-01")
    store.write(bad.where("uf = 'a'"), "2026-01-02")
    with pytest.raises(PySparkException, match="duplicated snapshot key: 1"):
        J.match_snapshots(store.at("2026-01-02"), store.at("2026-01-01"), ["num_convenio"]).collect()


def test_buckets_follow_the_size():
    mb = 1 << 20
    assert [bucket_count(n * mb, 128 * mb) for n in (0, 1, 128, 129, 256, 257, 10**6)] == [1, 1, 1, 2, 2, 4, 8192]


def test_buckets_grow_with_the_rows(spark, tmp_path):
    store = BucketedSnapshots(spark, str(tmp_path / "s"), 2, rows_per_bucket=50)
    for k, name in ((1, "2026-01-01"), (2, "2026-01-02")):
        store.write(day(spark, k), name)
    a, b = store.at("2026-01-01"), store.at("2026-01-02")
    sizes = a.groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 70
    found = D.diff_pair(a, b)
    assert rows_of(found) == rows_of(D.diff_pair(day(spark, 1), day(spark, 2))) and "Exchange" not in plan(found)
