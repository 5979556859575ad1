"""The change log kept by day, and stores that a stopped run leaves readable."""

import pytest
from pyspark.sql import functions as F

from milemark import config as C
from milemark.operators import diff as D
from milemark.plans import daily
from milemark.sources import files
from milemark.sources.changelog import ChangeLog
from milemark.sources.store import SnapshotStore

DAYS = ["2026-01-01", "2026-01-02", "2026-01-05", "2026-01-06"]


def day(spark, k, more=()):
    """Contracts of a day: some enter, leave and come back, some change."""
    rows = [(str(n), f"{n}-2", "SP", f"v{n * k % 3}") for n in range(30) if (n + k) % 7]
    return spark.createDataFrame([*rows, *more], "num_convenio string, cod_saci string, uf string, vlr_repasse string")


@pytest.fixture
def kept(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    return store, ChangeLog(store, str(tmp_path / "log"))


def rows_of(df):
    return sorted(map(str, df.collect()))


def whole(store):
    return rows_of(D.diff_history(*store.history()))


def test_day_by_day(spark, kept, monkeypatch):
    """Always the log of all days compared at once; a day more reads two snapshots, one stored again or late three."""
    store, log = kept
    read, history = [], store.history
    monkeypatch.setattr(store, "history", lambda days=None: (read.append(days), history(days))[1])
    store.write(day(spark, 1), DAYS[0])
    assert log.update() == [] and not read
    with pytest.raises(ValueError, match="second snapshot"):
        log.events()

    def step(k, rows, changed):
        store.write(rows, DAYS[k])
        read.clear()
        assert log.update() == [DAYS[j] for j in changed]
        assert read and all(len(days) <= 3 for days in read)
        assert log.stale() == []
        assert rows_of(log.events()) == whole(store)

    step(1, day(spark, 2), [1])
    step(3, day(spark, 4), [3])
    step(2, day(spark, 3), [2, 3])  # late
    step(1, day(spark, 9, [("99", "x", "RJ", "1")]), [1, 2])  # stored again
    step(0, day(spark, 5), [1])
    assert log.update() == []


def test_day_without_changes(spark, kept):
    """A day stored again as the day before leaves none of its old events."""
    store, log = kept
    for k in (0, 1, 2):
        store.write(day(spark, k + 1), DAYS[k])
    log.update()
    assert log.events().where(F.col("data") == DAYS[1]).count() > 0
    store.write(day(spark, 1), DAYS[1])
    log.update()
    assert log.events().where(F.col("data") == DAYS[1]).count() == 0
    assert rows_of(log.events()) == whole(store)


def test_headers_of_their_own(spark, kept):
    """A column that one day lacks is not compared with it."""
    store, log = kept
    store.write(day(spark, 1), DAYS[0])
    store.write(day(spark, 2).drop("uf"), DAYS[1])
    store.write(day(spark, 3).withColumn("situacao", F.col("vlr_repasse")), DAYS[2])
    store.write(day(spark, 4).withColumn("situacao", F.lit("z")), DAYS[3])
    log.update()
    assert rows_of(log.events()) == whole(store) != []


def test_column_that_one_day_lacks_moves_no_rows(spark, kept):
    """Rows are picked by the fields that each two neighbouring days are compared in, not by those of all days."""
    store, log = kept
    rows = spark.range(40).selectExpr("cast(id as string) num_convenio", "'x' cod_saci", "'SP' uf", "nullif(id % 2, 0) || '' situacao")
    store.write(rows.drop("situacao"), DAYS[0])
    store.write(rows, DAYS[1])
    store.write(rows.withColumn("situacao", F.expr("case when num_convenio = '7' then 'z' else situacao end")), DAYS[2])
    moved, _ = log._moved(DAYS[:3])
    assert {r["num_convenio"] for r in moved.collect()} == {"7"}
    assert log.update() == DAYS[1:3]
    assert rows_of(log.events()) == whole(store) and log.events().count() == 1


def test_stages_too_large_to_be_compiled_are_not_generated(spark, kept):
    """Only while a day is stored or compared; the session is as before after it, also when that fails."""
    key, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(key)
    store, log = kept
    store.write(day(spark, 1), DAYS[0])
    store.write(day(spark, 1), DAYS[1])
    moved = log._moved
    log._moved = lambda days: (seen.append(spark.conf.get(key)), moved(days))[1]
    log.update()
    assert seen == ["8000"] and spark.conf.get(key) == before
    with pytest.raises(Exception, match="no such day"):
        store.write(spark.range(1).selectExpr("raise_error('no such day') a"), DAYS[2])
    assert spark.conf.get(key) == before


def test_stopped_runs(spark, kept, tmp_path):
    store, log = kept
    store.write(day(spark, 1), DAYS[0])
    store.write(day(spark, 2), DAYS[1])
    log.update()
    want = rows_of(log.events())
    # Rows of a new day without its manifest: not a day yet.
    day(spark, 3).withColumn("_version", F.lit("v")).write.parquet(f"{store.rows_path}/snapshot_date={DAYS[2]}")
    assert store.days() == DAYS[:2] and whole(store) == want
    # Events without their manifest are not read.
    log.events().withColumn("run", F.lit("other")).write.mode("append").partitionBy("data").parquet(log.events_path)
    assert rows_of(log.events()) == want
    # Rows of a known day replaced without its manifest: refused until the day is stored again.
    day(spark, 3).withColumn("_version", F.lit("v")).write.mode("overwrite").parquet(f"{store.rows_path}/snapshot_date={DAYS[1]}")
    with pytest.raises(Exception, match="not stored completely"):
        store.at(DAYS[1]).collect()
    assert store.at(DAYS[0]).count() > 0
    store.write(day(spark, 2), DAYS[1])
    log.update()
    assert rows_of(log.events()) == want


def test_day_without_rows(spark, kept):
    store, log = kept
    store.write(day(spark, 1), DAYS[0])
    store.write(day(spark, 2), DAYS[1])
    store.write(day(spark, 2).limit(0), DAYS[1])
    assert store.at(DAYS[1]).count() == 0
    log.update()
    found = log.events()
    assert found.count() == day(spark, 1).count() and {r["secao"] for r in found.collect()} == {D.EXITED}


def test_refused_legacy_day_is_not_stored(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    paths = daily.DailyPaths.under(str(tmp_path / "out"), "x")

    def run(keys, date):
        sheet = spark.createDataFrame([(k, "SP", "1", date) for k in keys], "`OPERAÇÃO` string, UF string, `% FÍSICO REALIZADO` string, dt_atualizacao string")
        return daily.run_legacy(sheet, store, paths, "2026-01-01")

    run(["1", "2", ""], "12/06/2026")
    with pytest.raises(ValueError, match="duplicated keys: 1"):
        run(["1", "1"], "25/06/2026")
    assert store.days() == ["2026-06-12"]
    assert run(["1", "3"], "25/06/2026") == "2026-06-25"
    log = files.read_snapshot(spark, paths.changes)
    assert sorted((r.tipo, r.operacao) for r in log.collect()) == [("Novo", "3"), ("Removido", "2")]
    assert C.LEGACY_DIFF.skip_blank_keys
