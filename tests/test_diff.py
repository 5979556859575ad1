"""Snapshot comparison against a plain pairwise comparison in Python."""

import glob
import os
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from milemark import config as C
from milemark.operators import diff as D
from milemark.operators.aggregates import status_counters
from milemark.sources import files, naming
from milemark.sources.store import SnapshotStore, merge

FIELDS = [
    "num_convenio_saci", "cod_tci_saci", "txt_uf_saci", "txt_sigla_secretaria_saci", "vlr_repasse_saci", "dte_aio_tdb",
    "status_regra_casa_civil_calc", "prazo_homolog_licitacao_calc", "fase_atual_calc", "urgencia_suspensiva_calc",
]


def frame(spark, rows, names=FIELDS):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def compare(prev, cur, prev_names, cur_names, spec=C.CONTRACT_DIFF):
    """Reference comparison: dicts by key, one field at a time."""

    def index(rows, names):
        out = {}
        for r in rows:
            d = dict(zip(names, r))
            key = next((v for c in spec.key_candidates if (v := (d.get(c) or "").strip())), None)
            out[key] = {naming.canonical_name(n): v for n, v in d.items()}
        return out

    text = lambda v: (v or "").strip()
    p, c = index(prev, prev_names), index(cur, cur_names)
    order = D.canonical_header(cur_names)
    fields = [f for f in order if f in D.canonical_header(prev_names) and f not in spec.never_compared]
    out = []
    for k in c.keys() - p.keys():
        out.append((1, 0, k, "novo_registro", "vlr_repasse_saci", "", text(c[k].get("vlr_repasse_saci"))))
    for k in p.keys() - c.keys():
        out.append((2, 0, k, "registro_removido", "vlr_repasse_saci", text(p[k].get("vlr_repasse_saci")), ""))
    for k in p.keys() & c.keys():
        moved = []
        for i, f in enumerate(fields, 1):
            a, b = text(p[k].get(f)), text(c[k].get(f))
            hidden = f in spec.ignored or (f == "prazo_homolog_licitacao_calc" and "2026-06-01" in (a, b))
            if a != b and not hidden:
                moved.append((i, f, a, b))
        kinds = {f in spec.source_fields for _, f, _, _ in moved}
        category = {frozenset({True, False}): "dados_e_derivados", frozenset({True}): "dados"}.get(frozenset(kinds), "derivados_tempo")
        out += [(3, i, k, category, f, a, b) for i, f, a, b in moved]
    return sorted(out)


def events(df):
    cols = ["secao", "pos", "num_convenio", "categoria", "campo", "valor_anterior", "valor_atual"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def random_history(seed, names_of, days=4, keys=25):
    rng = random.Random(seed)
    out = {}
    for d in range(days):
        rows = []
        for k in range(keys):
            if rng.random() < 0.25:
                continue
            values = {
                "num_convenio_saci": f"c{k}" if k % 5 else rng.choice(["", " "]), "cod_tci_saci": f"t{k}", "cod_saci": f"t{k}",
                "vlr_repasse_saci": rng.choice(["1", "1 ", "2"]), "dte_aio_tdb": rng.choice(["", None, "2026-01-01"]),
                "prazo_homolog_licitacao_calc": rng.choice(["2026-06-01", "2026-07-01", "2026-08-01"]),
                "fase_atual_calc": rng.choice(["AIO", "LAE"]), "status_regra_casa_civil_calc": rng.choice(["a", "b"]),
            }
            # Blank numbers make the code the key, so the key is the code there.
            rows.append(tuple(values.get(naming.canonical_name(n), rng.choice(["x", "y"])) for n in names_of(d)))
        out[f"2026-0{d + 1}-01"] = (rows, names_of(d))
    return out



@pytest.mark.parametrize("seed", [1, 2])
def test_history_equals_pairwise_comparison(spark, seed):
    old = ["num_convenio", "cod_tci", "txt_uf_tci", "vlr_repasse", "dte_aio", "fase_atual", "prazo_homolog_licitacao"]

    def names_of(day):
        if day == 0:
            return old
        return FIELDS if day < 3 else [*FIELDS[:4], *reversed(FIELDS[4:]), "tipo_doc_suspensiva"]

    data = random_history(seed, names_of)
    merged, headers = merge({d: frame(spark, rows, names) for d, (rows, names) in data.items()})
    got = D.diff_history(merged, headers)
    days = sorted(data)
    for before, day in zip(days, days[1:]):
        want = compare(data[before][0], data[day][0], data[before][1], data[day][1])
        assert events(got.where(F.col("data") == day)) == want
        pair = D.diff_pair(frame(spark, *data[before]), frame(spark, *data[day]))
        assert events(pair) == want
    assert sum(1 for _ in got.collect()) > 20


def test_history_needs_one_exchange_by_key(spark):
    data = random_history(3, lambda d: FIELDS)
    merged, headers = merge({d: frame(spark, *v) for d, v in data.items()})
    df = D.diff_history(merged, headers)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_record_that_vanishes_and_comes_back(spark):
    row = lambda v: [("1", "t", "SP", "S", v, "", "", "", "", "")]
    data = {"d1": row("5"), "d2": [("2", "u", "SP", "S", "1", "", "", "", "", "")], "d3": row("6")}
    merged, headers = merge({d: frame(spark, r) for d, r in data.items()})
    log = D.change_log(D.diff_history(merged, headers))
    got = sorted((r.data, r.tipo, r.num_convenio, r.valor_anterior, r.valor_atual) for r in log.collect())
    assert got == [
        ("d2", "Novo", "2", "", "1"), ("d2", "Removido", "1", "5", ""),
        ("d3", "Novo", "1", "", "6"), ("d3", "Removido", "2", "1", ""),
    ]


def test_code_falls_back_to_the_row_before(spark):
    prev = frame(spark, [("1", "t", "SP", "S", "5", "", "", "", "", "")])
    cur = frame(spark, [("1", "", "SP", "S", "6", "", "", "", "", "")])
    assert [r.cod_saci for r in D.diff_detail(prev, cur).collect()] == ["t"]


def test_repeated_and_missing_keys_fail(spark):
    row = ("1", "t", "SP", "S", "5", "", "", "", "", "")
    for rows, message in (([row, row], "duplicated snapshot key: 1"), ([(" ", "", *row[2:])], "without a key")):
        merged, headers = merge({"d1": frame(spark, rows), "d2": frame(spark, [row])})
        with pytest.raises(PySparkException, match=message):
            D.diff_history(merged, headers).collect()


def test_identical_snapshots_have_no_changes(spark):
    rows = [("1", "t", "SP", "S", "5", "", "", "", "", "")]
    assert D.diff_detail(frame(spark, rows), frame(spark, rows)).count() == 0


def test_first_run_summary(spark):
    cur = frame(spark, [("1", "t", "SP", "S", "5", "", "", "", "", "")])
    row = D.diff_summary(None, cur, {"atual": "d1", "anterior": None, "primeiro": "d1"}).first()
    assert row.total_atual == 1 and row.total_anterior is None and row.resumo is None and row.mudancas_status is None


def test_alias_collision_keeps_first_place_and_last_value(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], "cod_tci string, cod_tci_tci string, txt_uf_tci string, cod_saci string")
    out = naming.canonicalize(df)
    assert out.columns == ["cod_saci", "cod_tci_saci", "txt_uf_saci"]
    assert tuple(out.first()) == ("a", "d", "c")
    assert naming.canonical_name("desconhecida") == "desconhecida"


def test_change_view_markers(spark):
    log = spark.createDataFrame(
        [("2026-06-24", "Alterado", "dados", "dados_origem", "", "1-2", "SP", None, "vlr_repasse_saci", "1234.5", ""),
         ("bad", "Novo", "", "", "9", "", "", "", "outro", None, "x")],
        ", ".join(f"{c} string" for c in D.LOG_COLUMNS),
    )
    a, b = D.newest_first(D.change_view(log)).collect()
    assert (a.data_fmt, a.campo, a.anterior, a.atual, a.num_convenio, a.natureza) == (
        "24/06/2026", "Repasse (SACI)", "1.234,50", "(vazio)", "—", "Mudança de dado")
    assert (b.data, b.data_fmt, b.campo, b.anterior, b.natureza, b.natureza_raw) == (
        None, "(vazio)", "outro", "(vazio)", "Mudança derivada", "derivado_regra")


ARCHIVE = os.environ.get("MILEMARK_ARCHIVE", "")


@pytest.mark.skipif(not ARCHIVE, reason="MILEMARK_ARCHIVE names no folder of archived details and reports")
def test_archived_reports_equal_the_recount(spark):
    details = sorted(glob.glob(f"{ARCHIVE}/detalhe_*.csv"))
    assert details
    for path in details:
        report = open(path.replace("detalhe_", "relatorio_").replace(".csv", ".md"), encoding="utf-8").read()
        numbers = [int(n) for n in re.findall(r"\*\*(\d+)\*\*", report)][2:]
        detail = files.read_snapshot(spark, path)
        if "cod_tci" in detail.columns:
            detail = detail.withColumnRenamed("cod_tci", "cod_saci")
        head = D.headline(detail).first()
        counts = [r.mudancas for r in status_counters(detail).orderBy("pos").collect()]
        assert [*head, *counts] == numbers, path


def test_published_row_order(spark):
    shuffled = [(3, "2", 0), (1, "b", 0), (3, "10", 2), (2, "a", 0), (3, "10", 1), (1, "B", 0)]
    detail = spark.createDataFrame(shuffled, "secao int, num_convenio string, pos int").repartition(4)
    got = [tuple(r) for r in D.order_detail(detail).collect()]
    assert got == [(1, "B", 0), (1, "b", 0), (2, "a", 0), (3, "10", 1), (3, "10", 2), (3, "2", 0)]


def test_history_row_order(spark):
    names = FIELDS[:2] + ["fase_atual_calc"]
    days = {"2026-01-01": [("1", "a", "x"), ("2", "b", "x")], "2026-01-02": [("2", "b", "y"), ("3", "c", "x")], "2026-01-03": [("3", "c", "z")]}
    rows, headers = merge({d: frame(spark, r, names) for d, r in days.items()})
    log = D.order_history(D.diff_history(rows, headers)).collect()
    keys = [(r["data"], r["secao"]) for r in log]
    assert [d for d, _ in keys] == sorted((d for d, _ in keys), reverse=keys[0][0] > keys[-1][0])
    for day in set(d for d, _ in keys):
        own = [s for d, s in keys if d == day]
        assert own == sorted(own)


@pytest.mark.parametrize("bad", [[("1", "a"), (None, None)], [("1", "a"), (" 1", "b")]])
def test_pair_refuses_missing_and_repeated_keys(spark, bad):
    names = FIELDS[:2]
    good, wrong = frame(spark, [("1", "a")], names), frame(spark, bad, names)
    for prev, cur in ((good, wrong), (wrong, good)):
        with pytest.raises(PySparkException, match="snapshot"):
            D.diff_detail(prev, cur).collect()
        with pytest.raises(PySparkException, match="snapshot"):
            D.diff_summary(prev, cur, {"atual": "d2", "anterior": "d1", "primeiro": "d1"}).collect()
