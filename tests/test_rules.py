"""Rules at their boundaries, calendar forms against enumeration."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions import rules as R
from milemark.functions.calendar import month_urgency, nth_weekday_after, weekdays_between

D = dt.date
CFG = C.Settings(as_of=D(2026, 6, 10), exempt_before=D(2025, 10, 21), fixed_cutoff=D(2026, 7, 17))
COLUMNS = (
    "dt_assinatura date, dt_vencimento_suspensiva date, dt_retirada_suspensiva date, dt_lae date, dt_pub_licitacao date, "
    "dt_homolog_licitacao date, dt_vrpl date, dt_aio date, dt_inicio_obra date, situacao string, situacao_suspensiva string, "
    "vlr_repasse decimal(18,2)"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


@pytest.fixture(scope="module")
def derive(spark):
    def run(**values):
        row = tuple(values.get(n) for n in NAMES)
        return R.with_contract_rules(spark.createDataFrame([row], COLUMNS), CFG).first()

    return run


def test_publication_deadline_is_not_overdue_on_its_day(derive):
    due = lambda day: derive(dt_assinatura=D(2026, 1, 1), dt_lae=day - dt.timedelta(60)).status_pub_licitacao
    assert due(CFG.as_of) == "Próximos 30 dias"
    assert due(CFG.as_of - dt.timedelta(1)) == "Vencida"
    assert due(CFG.as_of + dt.timedelta(30)) == "Próximos 30 dias"
    assert due(CFG.as_of + dt.timedelta(31)) == "No prazo"


def test_unsigned_contract_is_not_exempt(derive):
    row = derive(dt_lae=D(2026, 1, 1))
    assert row.prazo_pub_licitacao == D(2026, 3, 2) and row.status_pub_licitacao == "Vencida"
    early = derive(dt_assinatura=D(2025, 10, 20), dt_lae=D(2026, 1, 1))
    assert early.prazo_pub_licitacao is None and early.status_pub_licitacao is None
    assert early.dt_lae_mais_60 == D(2026, 5, 1) and early.pos_72 == "Antiga PC 32"


def test_inconsistency_is_told_before_cancellation(derive):
    row = derive(dt_homolog_licitacao=D(2026, 1, 1), situacao=C.CANCELADO)
    assert row.status_homolog_licitacao == "Inconsistência de base"
    assert row.status_regra_casa_civil == "Fora do escopo"
    published = derive(dt_homolog_licitacao=D(2026, 1, 1), dt_pub_licitacao=D(2025, 12, 1), situacao=C.CANCELADO)
    assert published.status_homolog_licitacao is None


def test_homologation_deadline_is_never_null_nor_before_the_cutoff(derive):
    assert derive().prazo_homolog_licitacao == CFG.fixed_cutoff
    assert derive(dt_pub_licitacao=D(2026, 6, 1)).prazo_homolog_licitacao == D(2026, 9, 29)


@pytest.mark.parametrize(
    ("days", "level"),
    [(-1, "Vencida"), (0, "Próximos 30 dias"), (30, "Próximos 30 dias"), (31, "31–90 dias"), (90, "31–90 dias"), (91, "Mais de 90 dias")],
)
def test_suspension_urgency_bounds(derive, days, level):
    assert derive(dt_vencimento_suspensiva=CFG.as_of + dt.timedelta(days)).urgencia_suspensiva == level


def test_empty_contract(derive):
    row = derive()
    assert row.urgencia_suspensiva == "Sem data" and row.fase_atual == "SEM ANDAMENTO"
    assert row.faixa_repasse == "ACIMA DE 10 MI" and row.status_suspensiva == "SEM SUSPENSIVA"
    assert row.status_regra_casa_civil == "Pendente" and row.ultima_data_relevante is None


@pytest.mark.parametrize(("aio", "due"), [(D(2026, 6, 5), D(2026, 6, 19)), (D(2026, 6, 6), D(2026, 6, 19)), (D(2026, 6, 7), D(2026, 6, 19)), (D(2026, 6, 8), D(2026, 6, 22))])
def test_works_deadline_around_weekends(derive, aio, due):
    assert derive(dt_aio=aio).prazo_inicio_obra == due


def test_works_status(derive):
    assert derive(dt_aio=D(2026, 6, 10)).status_inicio_obra == "Próximos 10 dias úteis"
    assert derive(dt_aio=D(2026, 6, 11)).status_inicio_obra == "No prazo"
    assert derive(dt_aio=D(2026, 5, 26)).status_inicio_obra == "Prazo vencido"
    assert derive(dt_aio=D(2026, 5, 1), dt_inicio_obra=D(2026, 5, 15)).status_inicio_obra == "Iniciada no prazo"
    assert derive(dt_aio=D(2026, 5, 1), dt_inicio_obra=D(2026, 5, 18)).status_inicio_obra == "Iniciada em atraso"


def test_withdrawn_reason_order(derive):
    reason = lambda **kw: derive(**kw).motivo_suspensiva_retirada_dmp
    assert reason(situacao=C.EM_CONTRATACAO, dt_aio=D(2026, 1, 1)) == "Não se aplica"
    assert reason(situacao_suspensiva=C.SUSPENSIVA_RETIRADA, dt_aio=D(2026, 1, 1)) == "situacao_da_analise_suspensiva_pbi"
    assert reason(dt_aio=D(2026, 1, 1), dt_inicio_obra=D(2026, 1, 2)) == "dte_aio_tdb"
    assert reason() is None


def test_weekdays_against_enumeration(spark):
    rng = random.Random(7)
    start = D(1995, 1, 1)
    pairs = [(start + dt.timedelta(rng.randrange(9000)), rng.randrange(-40, 400)) for _ in range(800)]
    rows = [(a, a + dt.timedelta(n)) for a, n in pairs]
    df = spark.createDataFrame(rows, "a date, b date")
    out = df.select("a", "b", weekdays_between(F.col("a"), F.col("b")).alias("n"), *[nth_weekday_after(F.col("a"), n).alias(f"d{n}") for n in (1, 5, 10, 13)])

    def count(a, b):
        return sum((a + dt.timedelta(i)).weekday() < 5 for i in range(1, (b - a).days + 1))

    for r in out.collect():
        assert r.n == count(r.a, r.b)
        for n in (1, 5, 10, 13):
            assert count(r.a, r[f"d{n}"]) == n and r[f"d{n}"].weekday() < 5


def test_month_urgency(spark):
    df = spark.createDataFrame([(D(2026, 5, 31),), (D(2026, 6, 1),), (D(2026, 8, 1),), (D(2027, 1, 1),), (None,)], "d date")
    got = [r[0] for r in df.select(month_urgency(F.col("d"), D(2026, 6, 15))).collect()]
    assert got == ["Vencida", "Próximos 30 dias", "31–90 dias", "Mais de 90 dias", "Sem data"]


def test_progress_bands(spark):
    values = [None, -1.0, 0.0, 0.5, 25.9, 26.0, 50.9, 51.0, 76.0, 99.9, 100.0, 120.0]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    got = [r[0] for r in df.select(R.progress_band(F.col("p"))).collect()]
    assert got == ["Sem dado", "0%", "0%", "1–25%", "1–25%", "26–50%", "26–50%", "51–75%", "76–99%", "76–99%", "100%", "100%"]


def test_days_and_bands_are_settings(spark):
    """Other day counts and bands change the rules that name them."""
    cfg = C.Settings(
        as_of=D(2026, 6, 10), near_days=5, middle_days=6, projections=(1, 2), value_bands=((10, "low"), (None, "high")),
    )
    row = dict.fromkeys(NAMES) | {"dt_vencimento_suspensiva": D(2026, 6, 16), "dt_lae": D(2026, 6, 1), "vlr_repasse": Decimal(10), "situacao": "x"}
    got = R.with_contract_rules(spark.createDataFrame([tuple(row.values())], COLUMNS), cfg).first()
    assert got.urgencia_suspensiva == "31–90 dias" and got.faixa_repasse == "high"
    assert (got.dt_lae_mais_60, got.dt_lae_mais_60_mais_120) == (D(2026, 6, 2), D(2026, 6, 3))
