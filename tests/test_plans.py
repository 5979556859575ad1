"""Physical plans of the registered queries, and the daily runs end to end."""

import dataclasses
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from catalog import queries as Q
from catalog import tables as T
from milemark import config as C
from milemark.functions import rules as R
from milemark.operators import diff as D
from milemark.plans import contract_base, daily, panel
from milemark.sources import files
from milemark.sources.store import SnapshotStore

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "PythonRDD"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(Q.queries()[name](spark, SF))
    assert not [f for f in FORBIDDEN if f in text]


def test_contracts_move_once_through_the_source_chain(spark, tmp_path):
    stored = {}
    for name, df in T.sources(spark, SF).items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = contract_base.join_sources(stored, T.SETTINGS)
        text = plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("SortMergeJoin") == 7
    # One exchange for the contracts and one per joined side, none between the joins; the
    # tender events are first brought to one row per number.
    assert text.count("Exchange hashpartitioning(_key") == 8
    assert text.count("Exchange hashpartitioning(num_convenio") == 1
    # Only the used columns are read, and the filters reach the scan.
    assert "PushedFilters: [IsNotNull(txt_fonte)" in text or "EqualTo(txt_fonte,OGU)" in text


def test_enrich_is_the_same_however_keys_are_split(spark):
    src = T.sources(spark, SF)
    rows = lambda n: sorted(map(str, contract_base.enrich(src, T.SETTINGS, rows_per_split=n).collect()))
    assert rows(2) == rows(10**6)


@pytest.mark.parametrize("rows_per_split", [None, 2])
def test_rules_are_worked_out_before_contracts_are_multiplied(spark, rows_per_split):
    src = T.sources(spark, SF)
    df = contract_base.enrich(src, T.SETTINGS, rows_per_split)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        text = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    last, below = text.split("Join LeftOuter", 1)
    # Of the rules, those of the suspension alone are in the projection over the last join.
    once = ["Inconsistência de base", "Iniciada em atraso", "Cumpriu o prazo", "Concluída em atraso", C.DOC_NAO_APRESENTADOS]
    assert not [t for t in once if t in last] and all(t in below for t in once)
    assert "RETIRADA" in last and "31–90 dias" in last
    wide = R.with_contract_rules(contract_base.join_sources(src, T.SETTINGS), T.SETTINGS).withColumn("cod_saci", F.col("cod_tci"))
    wide = wide.select(*[F.col(n).alias(published) for n, published in C.BASE_COLUMNS.items()])
    assert sorted(map(str, df.collect())) == sorted(map(str, wide.collect()))


def test_rule_filters_reach_the_scan(spark):
    text = plan(T.read(spark, SF, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def only_json(path):
    return json.loads(next(p for p in path.iterdir() if p.suffix == ".json").read_text(encoding="utf-8"))


def unique_sources(spark, folder):
    """Stored sources without the deliberate duplicates, which the key check would refuse."""
    src = {}
    for name, df in T.sources(spark, SF).items():
        df.coalesce(1).write.parquet(f"{folder}/{name}")
        src[name] = spark.read.parquet(f"{folder}/{name}")
    single = F.regexp_extract("num_convenio", r"^0*(\d+)", 1)
    src["licitacao"] = src["licitacao"].withColumn("num_convenio", single)
    src["pbi"] = src["pbi"].where("instrumento <> ''")
    return src


def test_daily_contract_runs(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    src = unique_sources(spark, tmp_path / "in")
    paths = daily.DailyPaths.under(str(tmp_path / "out"), "1998-11-01")
    assert daily.run_contracts(src, store, paths, "1998-11-01", T.SETTINGS) is None
    first = only_json(tmp_path / "out" / "summary")
    assert first["snapshot_anterior"] is None and first["resumo"] is None and first["total_atual"] > 900
    assert files.read_snapshot(spark, paths.changes).columns == D.LOG_COLUMNS

    later = dataclasses.replace(T.SETTINGS, as_of=dt.date(1998, 12, 1))
    src["saci"] = src["saci"].where("cod_tci <> '1-2'")
    paths = daily.DailyPaths.under(str(tmp_path / "out"), "1998-12-01")
    assert daily.run_contracts(src, store, paths, "1998-12-01", later) == "1998-11-01"
    doc = only_json(tmp_path / "out" / "summary")
    detail = files.read_snapshot(spark, paths.detail)
    assert doc["resumo"]["exited"] == detail.where("tipo_alteracao = 'saiu'").count() == first["total_atual"] - doc["total_atual"]
    changed = detail.where("tipo_alteracao = 'alterado'").select("num_convenio", "cod_saci").distinct().count()
    assert doc["resumo"]["changed_records"] == changed > 0
    assert doc["resumo"]["changed_data_records"] == 0
    log = files.read_snapshot(spark, paths.changes)
    assert log.count() == detail.count()
    sources = only_json(tmp_path / "out" / "freshness")["sources"]
    assert [s["key"] for s in sources] == ["tci_mcid", "transferegov", "bdgestores", "power_bi_caixa", "dmp"]
    assert next(s for s in sources if s["key"] == "dmp")["updated_at"] == "1998-12-01"

    rows = panel.panel_rows(store.at("1998-12-01"), later)
    top = panel.top_rows(rows, C.Selection(query="prefeitura", secretaria=["BUILDING"]))
    before = panel.top_previous(panel.panel_rows(store.at("1998-11-01"), later), rows, C.Selection(secretaria=["BUILDING"]))
    assert 0 < top.count() <= before.count()


def test_daily_legacy_runs(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    sheet = lambda pct, day: spark.createDataFrame(
        [("1", "SP", pct, day), ("2", "RJ", "5", day), ("", "RJ", "1", day)],
        "`OPERAÇÃO` string, UF string, `% FÍSICO REALIZADO` string, dt_atualizacao string",
    )
    paths = daily.DailyPaths.under(str(tmp_path / "out"), "x")
    assert daily.run_legacy(sheet("10", "12/06/2026"), store, paths, "2026-01-01") == "2026-06-12"
    first = only_json(tmp_path / "out" / "summary")
    assert (first["total_atual"], first["total_anterior"], first["delta_total"], first["resumo"]["changed_records"]) == (3, None, 0, 0)
    assert daily.run_legacy(sheet("20", "25/06/2026"), store, paths, "2026-01-01") == "2026-06-25"
    second = only_json(tmp_path / "out" / "summary")
    assert second["resumo"] == {"entered": 0, "exited": 0, "changed_records": 1}
    row = files.read_snapshot(spark, paths.changes).first()
    assert (row.tipo, row.operacao, row.campo, row.valor_anterior, row.valor_atual) == ("Alterado", "1", "pct_fisico", "10", "20")
