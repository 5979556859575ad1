"""Filters, facets, searches, pages, indicators and profiles on small tables."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions.text import br_month, br_month_from_code, iso_from_text, norm, num_or_null, num_or_zero, parse_date, squish
from milemark.operators import aggregates as A
from milemark.operators import explore as E
from milemark.plans import legacy, panel
from milemark.plans import selection as S

FACETS = {c: F for c in ("secretaria", "modalidade", "ano")}


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("1", "S1", "M1", "2024"), ("2", "S1", "M2", "2025"), ("3", "S2", "M1", "2025"), ("4", "S2", "M3", None), ("5", "", "M1", "2024"),
    ]
    return spark.createDataFrame(data, "id string, secretaria string, modalidade string, ano string")


def columns():
    return {c: F.col(c) for c in FACETS}


def brute_facets(rows, chosen):
    data = [r.asDict() for r in rows.collect()]
    out = Counter()
    for f in FACETS:
        for r in data:
            if r[f] and all(not chosen[o] or r[o] in chosen[o] for o in FACETS if o != f):
                out[f, r[f]] += 1
    return out


@pytest.mark.parametrize("chosen", [
    {"secretaria": [], "modalidade": [], "ano": []},
    {"secretaria": ["S1"], "modalidade": [], "ano": ["2025"]},
    {"secretaria": ["S2"], "modalidade": ["M1", "M3"], "ano": []},
])
def test_facets(rows, chosen):
    got = {(r.faceta, r.opcao): r.qtd for r in E.facets(rows, columns(), chosen).collect()}
    assert got == dict(brute_facets(rows, chosen))


def test_sanitize(rows):
    chosen = {"secretaria": ["S1", "GONE"], "modalidade": [], "ano": ["2024", "2025"]}
    options = E.facets(rows, columns(), chosen)
    # Under S1 both years are chosen, which is every year offered, hence no restriction.
    assert E.sanitized_choices(options, chosen) == {"secretaria": ["S1"], "modalidade": [], "ano": []}


def test_text_search(spark):
    df = spark.createDataFrame([("São Paulo", "1-23"), ("Paulista", "45"), ("x (a+b)", "1")], "nome string, cod string")
    find = lambda q: [r.nome for r in E.text_search(df, ["nome", "cod"], q).collect()]
    assert find("PAULO") == ["São Paulo"] and find("paul") == ["São Paulo", "Paulista"]
    assert find("são 1") == ["São Paulo"] and find("aulo") == [] and find("") == ["São Paulo", "Paulista", "x (a+b)"]
    assert find("(a+b)") == ["x (a+b)"] and find("23") == []


def test_table_page(spark):
    df = spark.createDataFrame([(i, f"nome {i % 3}", dt.date(2026, 1, 1 + i % 28)) for i in range(60)], "i int, n string, d date")
    q = E.TableQuery(text="NOME 1", exact={"n": "nome 1"}, sort=[("d", False), ("i", True)], page=2, size=10)
    got = [r.i for r in E.table_page(df, q, ["i", "n", "d"]).collect()]
    want = sorted((i for i in range(60) if i % 3 == 1), key=lambda i: (-(i % 28), i))[10:20]
    assert got == want
    with pytest.raises(ValueError, match="page size"):
        E.table_page(df, E.TableQuery(size=7), ["i"])


def test_filter_options_in_order(spark):
    df = spark.createDataFrame([("Évora",), ("Zeta",), ("Alfa",), ("",), (None,)], "t string")
    shown = E.order_options(E.filter_options(df, "t", F.col("t")), by_value=False)
    assert [r.texto for r in shown.collect()] == ["Alfa", "Évora", "Zeta"]
    days = spark.createDataFrame([(dt.date(2026, 2, 3),), (dt.date(2025, 12, 1),), (dt.date(2026, 2, 1),), (None,)], "d date")
    shown = E.order_options(E.filter_options(days, "d", br_month(F.col("d"))), by_value=True)
    assert [r.texto for r in shown.where("ordem is not null").collect()] == ["12/2025", "02/2026"]


def test_top_lists(spark):
    counts = spark.createDataFrame([(f"m{i:02}", 20 - i) for i in range(17)] + [("ém", 4)], "label string, qtd long")
    top = {r.label: r.qtd for r in E.topk_other(counts, 15).collect()}
    # Ties go by Portuguese order, where the accented label comes before m16.
    assert len(top) == 16 and top["Outros municípios"] == 4 + 5 + 4
    assert E.topk_other(counts.limit(3), 15).count() == 3


def test_domain_order(spark):
    df = spark.createDataFrame([("b",), ("x",), ("a",)], "v string")
    assert {r.v: r.pos for r in E.domain_order(df, "v", ["a", "b"]).collect()} == {"a": 1, "b": 2, "x": 999}


def test_scoped_rows_match_blank_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, k string")
    visible = df.where("i < 3")
    assert sorted(r.i for r in E.scoped_rows(df, visible, [], ["k"]).collect()) == [1, 2]
    assert E.scoped_rows(df, visible, ["01/2026"], ["k"]).count() == 3 and E.scoped_rows(df, None, [], ["k"]).count() == 3


def test_delta_without_previous(spark):
    df = spark.createDataFrame([(1, 5)], "x int, vlr_repasse int")
    row = A.kpi_delta(df, None, {"n": F.col("x") == 1}).first()
    assert (row.qtd, row.anterior, row.delta, row.tom) == (1, None, None, "neutral")
    empty = A.kpi(df.where("x > 1"), {"n": F.col("x") == 1}).first()
    assert (empty.qtd, empty.vlr, empty.pct) == (0, 0, 0.0)


def test_width_and_column_profiles(spark):
    df = spark.createDataFrame([("a" * (i + 1), f"v{i % 3}", "x" * 40, i) for i in range(20)], "t string, s string, l string, n int")
    widths = {r.coluna: (r.p90, r.largura) for r in A.width_profile(df, {"t": "T", "s": "S", "l": "L", "n": "N"}).collect()}
    assert widths == {"t": (19, 21), "s": (2, 8), "l": (40, 24), "n": (None, 14)}
    profile = {r.coluna: (r.valores, r.max_len, r.filtro) for r in A.column_profile(df, ["t", "s", "l"], ["l"]).collect()}
    assert profile == {"t": (20, 20, "select"), "s": (3, 2, "select"), "l": (None, 40, "select")}
    one = {r.coluna: r.filtro for r in A.column_profile(df.withColumn("c", F.lit("k")), ["c"]).collect()}
    assert one == {"c": "text"}


def test_stoppage_rounds_half_up(spark):
    df = spark.createDataFrame([("Obra Paralisada", 1, " ", None), ("Obra Paralisada", 2, "p", None)],
                               "situacao_obra string, dias_sem_bm int, plano_acao string, previsao_retomada date").withColumn("vlr_repasse", F.lit(1))
    row = A.stoppage_kpis(df).first()
    assert (row.dias_medio_sem_bm, row.com_plano, row.com_previsao) == (2, 1, 0)
    assert A.stoppage_kpis(df.where("false")).first().dias_medio_sem_bm is None


def test_reference_and_snapshot_dates(spark):
    meta = lambda *v: spark.createDataFrame([v], "snapshot_atual string, snapshot_anterior string, snapshot_primeiro string")
    shown = lambda *v: A.reference_date(meta(*v)).first()[0]
    assert shown("2026-06-26", None, None) == "26/06/2026" and shown(None, "2026-06-25", "2026-04-07") == "25/06/2026"
    assert shown(None, None, None) == "—"
    df = spark.createDataFrame([("",), (None,)], "d string")
    assert A.snapshot_date(df, "d", dt.date(2026, 1, 2)).first()[0] == "2026-01-02"


def test_text_values(spark):
    df = spark.createDataFrame([("3/4/24",), (" 13/04/2024",), ("2024-1-2T10",), ("a   b",), ("2024-02-30",), (None,)], "v string")
    v = F.col("v")
    got = [tuple(r) for r in df.select(iso_from_text(v), squish(v), norm(v), parse_date(v), num_or_zero(v), num_or_null(v)).collect()]
    assert [g[0] for g in got] == ["2024-04-03", "2024-04-13", "2024-01-02", "a   b", "2024-02-30", ""]
    assert got[3][1] == "a b" and got[5][1:3] == ("", "") and got[4][3] is None
    assert all(g[4] == 0 and g[5] is None for g in got)
    codes = spark.createDataFrame([("202403",), ("x",), ("",)], "c string").select(br_month_from_code(F.col("c")))
    assert [r[0] for r in codes.collect()] == ["03/2024", "x", "—"]


def test_legacy_extract_and_rows(spark):
    sheet = spark.createDataFrame([(" 12 ", "sp", "1/2/26", "50", "10.5", "")], "`OPERAÇÃO` string, UF string, `DATA DA ASSINATURA` string, `% FÍSICO REALIZADO` string, `VALOR DE REPASSE/EMPRÉSTIMO` string, Modalidade string")
    row = legacy.works_rows(legacy.extract(sheet)).first()
    assert (row.operacao, row.uf, row.regiao, row.dt_assinatura, row.faixa_fisica) == ("12", "SP", "Sudeste", dt.date(2026, 2, 1), "26–50%")
    assert (float(row.vlr_repasse), row.modalidade, row.situacao_obra) == (10.5, "Não informado", "Não informado")


def test_selection_defaults_keep_every_row(spark):
    sel = C.Selection()
    df = spark.createDataFrame([("a", None)], "situacao string, secretaria string").withColumns(
        {c: F.lit(None).cast("string") for c in ("modalidade", "situacao_suspensiva", "regiao", "uf", "municipio", "status_inicio_obra")}
    ).withColumn("dt_assinatura", F.lit(None).cast("date"))
    cfg = C.Settings(as_of=dt.date(2026, 6, 1))
    assert df.where(S.top_match(sel) & S.chart_match(sel) & S.geo_match(sel) & S.final_match(sel, cfg)).count() == 1
    assert S.drill_dim(C.Selection(secretaria=["A"])) == "modalidade" and S.drill_dim(sel) == "secretaria"
    assert panel.SEARCH_COLUMNS == ["num_convenio", "cod_tci", "proponente"]


@pytest.mark.parametrize("sort", [[("a", True), ("b", False), ("i", True)], [("b", False), ("a", False), ("i", False)], [("i", True)]])
def test_deep_pages(spark, sort):
    """Every page as the whole order gives it, with nulls and many equal values, and the page behind its last row."""
    rows = [(i, None if i % 7 == 0 else i * 37 % 11, None if i % 5 == 0 else "x" if i % 3 else f"t{i % 40}") for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, a int, b string").repartition(4)
    order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in sort]
    want = [tuple(r) for r in df.orderBy(*order).select("i", "a", "b").collect()]
    for page in (1, 3, 57, 100, 199, 200, 201):
        query = E.TableQuery(sort=sort, page=page, size=10)
        got = [tuple(r) for r in E.deep_page(df, query, ["i", "a", "b"], rows_at_once=60).collect()]
        assert got == want[10 * page - 10 : 10 * page]
        if page == 57:
            last = [dict(zip("iab", got[-1], strict=True))[c] for c, _ in sort]
            assert [tuple(r) for r in E.next_page(df, query, ["i", "a", "b"], last).collect()] == want[570:580]


def test_deep_page_sorts_few_rows(spark, monkeypatch):
    """Of 20,000 rows the page is cut out of some hundreds; equal sort values can't be cut and still give a page."""
    df = spark.range(20_000).select(F.col("id").alias("i"), (F.col("id") * 7919 % 20_011).alias("a"), F.lit(1).alias("b"))
    query = E.TableQuery(sort=[("a", True)], page=1500, size=10)
    page = E.deep_page(df, query, ["i", "a", "b"], rows_at_once=300)
    want = sorted(k * 7919 % 20_011 for k in range(20_000))[14_990:15_000]
    assert [r["a"] for r in page.collect()] == want
    skipped = int(page._jdf.queryExecution().optimizedPlan().toString().split("Offset ")[1].split()[0])
    assert skipped < 2_000
    same = E.deep_page(df, E.TableQuery(sort=[("b", True)], page=1500, size=10), ["i", "b"], rows_at_once=300)
    assert same.count() == 10
