"""Legacy works: extract, typed rows, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions import rules as R
from milemark.functions.text import MONEY, iso_from_text, num_or_null, num_or_zero, parse_date, region_of, squish
from milemark.operators import explore
from milemark.plans import selection as S
from milemark.sources import naming


def extract(sheet: DataFrame) -> DataFrame:
    """Sheet rows under field names, texts cleaned and dates in ISO form."""
    renamed = naming.rename(sheet, C.LEGACY_COLUMNS)
    return renamed.select(
        *[(iso_from_text(F.col(c)) if c in C.LEGACY_DATES else squish(F.col(c))).alias(c) for c in renamed.columns]
    )


DEFAULTED = ["tipo_operacao", "repassador", "modalidade", "modalidade_cc", "situacao_obra"]


def _or_default(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(C.NAO_INFORMADO))


def works_rows(base: DataFrame) -> DataFrame:
    """Typed rows from the published legacy base."""
    typed = base.withColumns(
        {
            "uf": F.upper(F.btrim(F.coalesce("uf", F.lit("")))),
            "pct_fisico": num_or_null(F.col("pct_fisico"), "double"),
            "dias_sem_bm": num_or_null(F.col("dias_sem_bm"), "double"),
            "dt_assinatura": parse_date(F.col("dt_assinatura")),
            "previsao_retomada": parse_date(F.col("previsao_retomada")),
            **{m: num_or_zero(F.col(m), MONEY) for m in C.LEGACY_MONEY_FIELDS},
            **{d: _or_default(F.col(d)) for d in DEFAULTED},
        }
    )
    return typed.withColumns(
        {"regiao": region_of(F.col("uf")), "faixa_fisica": R.progress_band(F.col("pct_fisico"))}
    )


SEARCH_COLUMNS = ["operacao", "recebedor", "municipio", "ente"]


def works_charts(obra: str | None, tipo: str | None, drill: str | None, drill_column: str) -> list[explore.Chart]:
    return [
        explore.Chart("situacao_obra", C.SITUACAO_OBRA_ORDER, obra),
        explore.Chart("tipo_operacao", C.TIPO_OPERACAO_ORDER, tipo),
        explore.Chart(drill_column, None, drill),
    ]


def detail_rows(rows: DataFrame, faixa: str | None = None, motivo: str | None = None) -> DataFrame:
    """Rows under the progress-band and stoppage-reason selections."""
    out = rows.where(S.equals(F.col("faixa_fisica"), faixa))
    if motivo is None:
        return out
    return out.where(R.work_flags(F.col("situacao_obra"))["paralisada"] & (F.col("motivo_paralisacao") == motivo))
