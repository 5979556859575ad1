"""Snapshots with digests by part: equal parts are not read, events are those of the whole days."""

import dataclasses

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from milemark import config as C
from milemark.operators import diff as D
from milemark.sources.digests import DigestedSnapshots

A, B = "2026-01-01", "2026-01-02"


def base(spark, n=3000):
    key = F.col("id").cast("string")
    return spark.range(n).select(
        key.alias("num_convenio_saci"), F.concat(key, F.lit("-2")).alias("cod_tci_saci"), F.lit("SP").alias("txt_uf_saci"),
        (F.col("id") % 7).cast("string").alias("vlr_repasse_saci"),
    )


def rows_of(df):
    return sorted(map(str, df.collect()))


def stored(spark, path, first, second, parts=32, spec=C.CONTRACT_DIFF):
    store = DigestedSnapshots(spark, str(path), parts, spec)
    store.write(first, A)
    store.write(second, B)
    return store


def read_parts(df):
    return set(r[0] for r in df.select(F.regexp_extract(F.input_file_name(), r"_parte=(\d+)", 1)).distinct().collect())


def test_only_differing_parts_are_read(spark, tmp_path):
    first = base(spark)
    second = first.where("num_convenio_saci <> '17'").withColumn(
        "vlr_repasse_saci", F.when(F.col("num_convenio_saci") == "44", "1000").otherwise(F.col("vlr_repasse_saci"))
    ).unionByName(base(spark, 1).withColumn("num_convenio_saci", F.lit("new")))
    store = stored(spark, tmp_path / "s", first, second)
    part = F.pmod(F.xxhash64(F.col("k")), F.lit(32)).cast("int")
    want = spark.createDataFrame([("17",), ("44",), ("new",)], "k string").select(part).distinct().collect()
    differing = store.differing(A, B)
    assert differing == sorted(r[0] for r in want) and len(differing) <= 3
    p, c = store.pair(A, B)
    assert read_parts(p) | read_parts(c) == {str(k) for k in differing}
    events = store.diff(A, B)
    assert rows_of(events) == rows_of(D.diff_pair(first, second)) and events.count() == 3


def test_one_record_of_a_hundred(spark, tmp_path):
    first = base(spark)
    hit = F.col("num_convenio_saci").isin([str(100 * k) for k in range(30)])
    second = first.withColumn("txt_uf_saci", F.when(hit, "RJ").otherwise(F.col("txt_uf_saci")))
    store = stored(spark, tmp_path / "s", first, second, 64)
    changed = first.where(hit).count()
    assert 0 < len(store.differing(A, B)) <= changed
    assert rows_of(store.diff(A, B)) == rows_of(D.diff_pair(first, second))


def test_equal_days_and_other_spellings(spark, tmp_path):
    first = base(spark, 200)
    # White space around a value and null for blank are no change; neither is another order of rows.
    same = first.withColumn("vlr_repasse_saci", F.concat(F.lit(" "), "vlr_repasse_saci")).orderBy(F.desc("num_convenio_saci"))
    store = stored(spark, tmp_path / "s", first, same)
    assert store.differing(A, B) == [] and store.diff(A, B).count() == 0
    # Values that move between records of one part.
    swapped = first.withColumn("vlr_repasse_saci", ((F.col("num_convenio_saci").cast("int") + 1) % 7).cast("string"))
    moved = stored(spark, tmp_path / "t", first, swapped, 1)
    assert moved.differing(A, B) == [0]
    assert rows_of(moved.diff(A, B)) == rows_of(D.diff_pair(first, swapped))


def test_headers_that_differ(spark, tmp_path):
    first = base(spark, 300)
    second = first.withColumn("observacao", F.lit("x"))
    store = stored(spark, tmp_path / "s", first, second)
    assert store.differing(A, B) == [] and rows_of(store.at(B).drop("_chave")) == rows_of(second)
    third = second.withColumn("observacao", F.when(F.col("num_convenio_saci") == "5", "y").otherwise("x"))
    store.write(third, "2026-01-03")
    assert len(store.differing(B, "2026-01-03")) == 1
    assert rows_of(store.diff(B, "2026-01-03")) == rows_of(D.diff_pair(second, third))
    # Days in other numbers of parts are compared in full.
    DigestedSnapshots(spark, str(tmp_path / "s"), 8).write(third, "2026-01-04")
    assert store.differing(B, "2026-01-04") is None
    assert rows_of(store.diff(B, "2026-01-04")) == rows_of(D.diff_pair(second, third))


def test_an_empty_day_and_fields_that_are_ignored(spark, tmp_path):
    first = base(spark, 50)
    store = stored(spark, tmp_path / "s", first, first.limit(0), 4)
    assert store.differing(A, B) == [0, 1, 2, 3]
    assert rows_of(store.diff(A, B)) == rows_of(D.diff_pair(first, first.limit(0)))
    spec = dataclasses.replace(C.CONTRACT_DIFF, ignored=frozenset({*C.CONTRACT_DIFF.ignored, "txt_uf_saci"}))
    other = stored(spark, tmp_path / "t", first, first.withColumn("txt_uf_saci", F.lit("RJ")), 4, spec)
    assert other.differing(A, B) == []


def test_bad_keys_are_refused_when_stored(spark, tmp_path):
    store = DigestedSnapshots(spark, str(tmp_path / "s"), 4)
    one = base(spark, 1)
    with pytest.raises(PySparkException, match="duplicated snapshot key: 0"):
        store.write(one.union(one), A)
    with pytest.raises(PySparkException, match="without a key"):
        store.write(one.withColumns({"num_convenio_saci": F.lit(" "), "cod_tci_saci": F.lit(None).cast("string")}), A)
    assert store.days() == []


def test_whole_rows_are_not_exchanged_when_stored(spark, tmp_path):
    store = DigestedSnapshots(spark, str(tmp_path / "s"), 4)
    day = base(spark, 400).repartition(3)
    store.write(day, A)
    part = F.pmod(F.xxhash64("num_convenio_saci"), F.lit(4)).cast("int").alias("p")
    held = day.select(F.spark_partition_id().alias("task"), part).distinct().count()
    files = [f for v in (tmp_path / "s" / "rows").iterdir() for f in v.rglob("*.parquet")]
    # A file for each part of each task: the rows were written where they lay.
    assert len(files) == held > 4 and rows_of(store.at(A).drop("_chave")) == rows_of(day)
