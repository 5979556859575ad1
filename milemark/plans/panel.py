"""The analytic panel: published base to typed rows, then block after block of narrowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions import rules as R
from milemark.functions.text import MONEY, num_or_null, num_or_zero, parse_date, pick_field
from milemark.operators import explore, joins
from milemark.plans import selection as S

# Earlier column names still accepted, newest first.
GENERATIONS = {
    "cod_tci": ["cod_tci_saci", "cod_tci_tci", "cod_saci", "cod_tci"],
    "num_convenio": ["num_convenio_saci", "num_convenio_tci", "num_convenio"],
    "uf": ["txt_uf_saci", "txt_uf_tci", "txt_uf"],
    "regiao": ["txt_regiao_saci", "txt_regiao_tci", "txt_regiao"],
    "cod_ibge": ["cod_ibge_7dig_saci", "cod_ibge_7dig_tci", "cod_ibge_7dig"],
    "municipio": ["txt_municipio_saci", "txt_municipio_tci", "txt_municipio"],
    "proponente": ["txt_tomador_saci", "txt_tomador_tci", "txt_tomador"],
    "objeto": ["dsc_objeto_instrumento_saci", "dsc_objeto_instrumento_tci", "dsc_objeto_instrumento"],
    "secretaria": ["txt_sigla_secretaria_saci", "txt_sigla_secretaria_tci", "txt_sigla_secretaria"],
    "fase": ["dsc_fase_pac_saci", "dsc_fase_pac_tci", "dsc_fase_pac"],
    "modalidade": ["txt_modalidade_saci", "txt_modalidade_tci", "txt_modalidade"],
    "situacao": ["dsc_situacao_contrato_mcid_saci", "dsc_situacao_contrato_mcid_tci", "dsc_situacao_contrato_mcid"],
    "situacao_suspensiva": ["situacao_da_analise_suspensiva_pbi", "situacao_da_analise_suspensiva"],
    "perspectiva_de_retirada_da_suspensiva": [
        "perspectiva_de_retirada_da_suspensiva", "pespectiva_de_retirada_da_suspensiva",
    ],
    "motivo_suspensiva_retirada_dmp": ["motivo_suspensiva_retirada_dmp", "motivo_suspensiva_retirada_cgpac"],
    "status_suspensiva": ["status_suspensiva_calc", "status_suspensiva"],
    "flag_publicacao_licitacao": ["flag_publicacao_licitacao_calc", "flag_publicacao_licitacao"],
    "flag_homologacao_licitacao": ["flag_homologacao_licitacao_calc", "flag_homologacao_licitacao"],
    "fase_atual": ["fase_atual_calc", "fase_atual"],
    "faixa_repasse": ["faixa_repasse_calc", "faixa_repasse"],
    "status_pub_licitacao": ["status_pub_licitacao_calc", "status_pub_licitacao"],
    "status_homolog_licitacao": ["status_homolog_licitacao_calc", "status_homolog_licitacao"],
    "status_inicio_obra": ["status_inicio_obra_calc", "status_inicio_obra"],
    "status_regra_casa_civil": ["status_regra_casa_civil_calc", "status_regra_casa_civil"],
    "urgencia_suspensiva": ["urgencia_suspensiva_calc", "urgencia_suspensiva"],
    "tipo_doc_suspensiva": ["tipo_doc_suspensiva"],
} | {doc: [doc] for doc in C.DOC_LABELS}
DATE_GENERATIONS = {
    "dt_assinatura": ["dte_assinatura_contrato_saci", "dte_assinatura_contrato_tci", "dte_assinatura_contrato"],
    "dt_vencimento_suspensiva": ["vencimento_da_suspensiva_pbi", "vencimento_da_suspensiva"],
    "dt_retirada_suspensiva": ["dte_retirada_suspensiva_tgov", "dte_retirada_suspensiva"],
    "dt_lae": ["dte_primeira_data_lae_tdb", "dte_primeira_data_lae"],
    "dt_pub_licitacao": ["dte_publicacao_licitacao_tgov", "dte_publicacao_licitacao"],
    "dt_homolog_licitacao": ["dte_homologacao_licitacao_tgov", "dte_homologacao_licitacao"],
    "dt_vrpl": ["dte_vrpl_tdb", "dte_vrpl"],
    "dt_aio": ["dte_aio_tdb", "dte_aio"],
    "dt_inicio_obra": ["dte_inicio_obra_mcid_saci", "dte_inicio_obra_mcid_tci", "dte_inicio_obra_mcid"],
    "ultima_data_relevante": ["ultima_data_relevante_calc", "ultima_data_relevante"],
    "prazo_pub_licitacao": ["prazo_pub_licitacao_calc", "prazo_pub_licitacao"],
    "prazo_homolog_licitacao": ["prazo_homolog_licitacao_calc", "prazo_homolog_licitacao"],
    "prazo_inicio_obra": ["prazo_inicio_obra_calc", "prazo_inicio_obra"],
    "data_limite_licitacao_casa_civil": ["data_limite_licitacao_casa_civil_const", "data_limite_licitacao_casa_civil"],
}
COUNT_GENERATIONS = {
    "dias_ate_publicacao": ["dias_ate_publicacao_calc", "dias_ate_publicacao"],
    "dias_publicacao_ate_homologacao": ["dias_publicacao_ate_homologacao_calc", "dias_publicacao_ate_homologacao"],
    "dias_homologacao_ate_vrpl": ["dias_homologacao_ate_vrpl_calc", "dias_homologacao_ate_vrpl"],
    "dias_vrpl_ate_aio": ["dias_vrpl_ate_aio_calc", "dias_vrpl_ate_aio"],
    "dias_aio_ate_inicio_obra": ["dias_aio_ate_inicio_obra_calc", "dias_aio_ate_inicio_obra"],
}


def with_pending_docs(df: DataFrame) -> DataFrame:
    pending = R.pending_docs(F.col("tipo_doc_suspensiva"), {d: F.col(d) for d in C.DOC_LABELS})
    return df.withColumn("docs_suspensiva_pendentes", pending).withColumns(
        {
            "docs_suspensiva_resumo": F.array_join("docs_suspensiva_pendentes", ", "),
            "docs_suspensiva_qtd": F.size("docs_suspensiva_pendentes"),
        }
    )


def panel_rows(base: DataFrame, cfg: C.Settings) -> DataFrame:
    """Typed rows from a published base of any generation of column names."""
    date = lambda names: parse_date(pick_field(base, *names))
    lae120 = F.coalesce(date(["prazo_lae_mais_60_calc"]), F.date_add(date(DATE_GENERATIONS["dt_lae"]), 120))
    lae300 = F.coalesce(date(["prazo_lae_mais_60_mais_120_calc"]), F.date_add(lae120, 180))
    typed = base.select(
        *[pick_field(base, *names).alias(n) for n, names in GENERATIONS.items()],
        *[date(names).alias(n) for n, names in DATE_GENERATIONS.items()],
        *[num_or_null(pick_field(base, *names), "double").alias(n) for n, names in COUNT_GENERATIONS.items()],
        num_or_zero(pick_field(base, "vlr_repasse_saci", "vlr_repasse_tci", "vlr_repasse"), MONEY).alias("vlr_repasse"),
        lae120.alias("dt_lae_mais_60"),
        lae300.alias("dt_lae_mais_60_mais_120"),
    )
    return with_pending_docs(typed).withColumns(
        {
            "pos_72": R.era(F.col("dt_assinatura"), cfg.exempt_before),
            "ano": R.signature_year(F.col("dt_assinatura")),
        }
    )


SEARCH_COLUMNS = ["num_convenio", "cod_tci", "proponente"]


def top_rows(rows: DataFrame, sel: C.Selection) -> DataFrame:
    """Search box and top filters."""
    return explore.text_search(rows, SEARCH_COLUMNS, sel.query).where(S.top_match(sel))


def top_previous(previous: DataFrame, rows: DataFrame, sel: C.Selection) -> DataFrame:
    """Previous rows of the contracts the search box left, under the same top filters."""
    found = explore.text_search(rows, SEARCH_COLUMNS, sel.query)
    return joins.restrict_previous(previous, found).where(S.top_match(sel))


def scoped(rows: DataFrame, sel: C.Selection) -> DataFrame:
    """Chart and territorial selections; the blocks below all start from here."""
    return rows.where(S.chart_match(sel) & S.geo_match(sel))


def detail_rows(rows: DataFrame, sel: C.Selection, cfg: C.Settings) -> DataFrame:
    """Rows of the detail table under every selection."""
    return scoped(top_rows(rows, sel), sel).where(S.final_match(sel, cfg))


def situation_flags(sit: Column, analysis: Column, assin: Column, cfg: C.Settings) -> dict[str, Column]:
    return {
        "suspensiva_retirada": R.is_withdrawn(analysis),
        "com_suspensiva_ativa": R.active_suspension(sit, analysis),
        "sem_suspensiva": R.no_suspension(sit, analysis),
        "contrato_normal": R.is_normal(sit),
        "sem_prazo_pc72": R.exempt(assin, cfg.exempt_before),
        "inativo": R.is_inactive(sit),
    }
