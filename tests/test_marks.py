"""Rows picked by their place, and stores that exchange keys in place of rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from milemark.operators import diff
from milemark.sources import marks
from milemark.sources.changelog import ChangeLog
from milemark.sources.marks import ROW
from milemark.sources.store import SnapshotStore, merge
from milemark.sources.validity import ValidityStore


@pytest.mark.parametrize("most", [marks.BROADCAST_BLOCKS, 0])
def test_picked(spark, most):
    """Any places, in any block; with bitmaps broadcast and joined."""
    numbers = [*range(70), 32767, 32768, 32769, 65535, 65536, (1 << 33) - 1, 1 << 33, (1 << 33) + 7, (5 << 33) + 40000]
    rows = spark.createDataFrame([(d, n, f"{d}{n}") for d in "ab" for n in numbers], f"d string, {ROW} long, `x.y` string").repartition(3)
    want = {(d, n) for d in "ab" for k, n in enumerate(numbers) if (k + (d == "a")) % 3 == 0}
    places = spark.createDataFrame([*want, ("c", 5)], f"d string, {ROW} long")
    for keep in (True, False):
        found = marks.picked(rows, places, ["d"], keep, most)
        assert sorted(found.columns) == sorted(rows.columns)
        got = [(r["d"], r[ROW]) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == {(d, n) for d in "ab" for n in numbers if ((d, n) in want) == keep}
    assert marks.picked(rows, places.limit(0), ["d"], True, most).count() == 0
    assert marks.picked(rows, places.limit(0), ["d"], False, most).count() == rows.count()


def test_digest(spark):
    """Null as absent, apart from blank; no two lists of values that read alike."""
    rows = [(None, None), ("", None), (None, ""), ("a", "b"), ("ab", ""), ("", "ab"), ("1:a", None), ("a1:bb", "x"), ("a", "1:bbx")]
    df = spark.createDataFrame(rows, "a string, bb string")
    both = {"a": F.col("a"), "bb": F.col("bb")}
    found = [bytes(r[0]) for r in df.select(marks.digest(both)).collect()]
    assert len(set(found)) == len(rows) and {len(f) for f in found} == {16}
    malformed = spark.sql("select cast(x as string) a from values (X'ff'), (X'fe'), (X'fefe') t(x)")
    assert malformed.select(marks.digest({"a": F.col("a")})).distinct().count() == 3
    alone = [bytes(r[0]) for r in df.where("bb is null").select(marks.digest({"a": F.col("a")})).collect()]
    assert alone == [f for f, r in zip(found, rows, strict=True) if r[1] is None]


def test_validity_exchanges_keys_only(spark, tmp_path):
    """A day is read back without an exchange of its rows, whatever may be broadcast otherwise."""
    store = ValidityStore(spark, str(tmp_path / "s"))
    day = lambda k: spark.range(50).select(F.col("id").cast("string").alias("num_convenio"), (F.col("id") % k).cast("string").alias("uf"))
    store.build(*merge({"2026-01-01": day(2), "2026-01-02": day(3)}))
    store.extend(day(5), "2026-01-03")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = store.at("2026-01-02")
        assert sorted(map(str, base.collect())) == sorted(map(str, day(3).collect()))
        plan = base._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "SortMergeJoin" not in plan and not any("num_convenio" in line or "_chave" in line for line in exchanges)


def test_log_compares_moved_records_only(spark, tmp_path):
    """Records that are the same on all days are left where they lie; the log has the events of all days compared whole."""
    store = SnapshotStore(spark, str(tmp_path / "store"))
    log = ChangeLog(store, str(tmp_path / "log"))
    days = ["2026-01-01", "2026-01-02", "2026-01-03"]
    for k, d in enumerate(days):
        changed = F.when(F.col("id") == k, "y").otherwise("x")
        rows = spark.range(k == 1, 1000).select(F.col("id").cast("string").alias("num_convenio"), changed.alias("vlr_repasse"), F.lit("SP").alias("uf"))
        store.write(rows, d)
    assert sorted(r["num_convenio"] for r in log._moved(days)[0].collect()) == sorted(["0", "0", *["1", "2"] * 3])
    log.update()
    want = diff.diff_history(*store.history())
    assert sorted(map(str, log.events().collect())) == sorted(map(str, want.collect())) != []
    # A key that is repeated on one day and missing on another has as many rows as there are days.
    store.write(rows.union(rows.where("num_convenio = '7'")), days[1])
    store.write(rows.where("num_convenio <> '7'"), days[2])
    with pytest.raises(PySparkException, match="duplicated snapshot key: 7"):
        log.update()


def test_list_digest_tells_places_and_separators_apart(spark):
    lists = [["a\x1fb", ""], ["a", "b"], ["a", "b", ""], ["", "a", "b"], ["a", "\x1fb"], ["ab", ""], ["", "ab"], [""], []]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*lists, *lists])], "i int, v array<string>")
    found = [bytes(r[0]) for r in df.orderBy("i").select(marks.list_digest(F.col("v"))).collect()]
    assert {len(d) for d in found} == {16} and len(set(found)) == len(lists)
    assert found[: len(lists)] == found[len(lists) :]
