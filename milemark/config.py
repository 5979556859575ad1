"""Parameters and fixed values.

Everything a deployment may change is a field of ``Settings`` or ``DiffSpec``;
the lists below are the values results are expected to carry.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column


@dataclass(frozen=True)
class Settings:
    """Dates and day counts the contract rules depend on.

    ``as_of`` may also be a date column, for rows of several days in one frame.
    """

    as_of: dt.date | Column
    exempt_before: dt.date = dt.date(2025, 10, 21)
    fixed_cutoff: dt.date = dt.date(2026, 7, 17)
    publication_days: int = 60
    homologation_days: int = 120
    start_weekdays: int = 10
    # Days left up to which a deadline is near, and a suspension's due date is in its middle range.
    near_days: int = 30
    middle_days: int = 90
    # Days from LAE to the two projected dates.
    projections: tuple[int, int] = (120, 300)
    # Value bands: (below, name), the last one without a limit.
    value_bands: tuple[tuple[int | None, str], ...] = (
        (1_000_000, "ATE 1 MI"), (5_000_000, "1 A 5 MI"), (10_000_000, "5 A 10 MI"), (None, "ACIMA DE 10 MI"),
    )
    fonte: str = "OGU"
    fase: str = "NOVO PAC - Seleção"
    secretaria_excluida: str = "SNH"


# Contract situations.
CANCELADO = "Cancelado ou Distratado"
EM_CONTRATACAO = "Em Contratação"
COM_SUSPENSIVA = "Contratado - Suspensiva"
NORMAL = "Contratado - Normal"
PRESTACAO_CONTAS = "Contratado - Em Prestação de Contas"
INATIVAS = [EM_CONTRATACAO, CANCELADO, PRESTACAO_CONTAS]
SUSPENSIVA_RETIRADA = "Suspensiva retirada"

# Display orders of the categorical columns.
SITUACAO_ORDER = [
    "Em Contratação",
    "Contratado - Suspensiva",
    "Contratado - Normal",
    "Contratado - Em Prestação de Contas",
    "Cancelado ou Distratado",
    "Não Identificado",
]
SUSPENSIVA_ORDER = [
    "Doc. não enviada p/ análise",
    "Análise não iniciada",
    "Análise iniciada",
    "Analisada e rejeitada",
    "Analisada com pendências",
    "Analisada e aceita",
    "Suspensiva retirada",
]
URGENCIA_ORDER = ["Vencida", "Próximos 30 dias", "31–90 dias", "Mais de 90 dias", "Sem data"]
PRAZO_ORDER = ["Vencida", "Próximos 30 dias", "No prazo", "Sem prazo (PC 72)", "Sem prazo calculado"]
INICIO_OBRA_ORDER = [
    "Iniciada no prazo",
    "Iniciada em atraso",
    "No prazo",
    "Próximos 10 dias úteis",
    "Prazo vencido",
]
CASA_CIVIL_ORDER = ["Cumpriu o prazo", "Pendente", "Fora do escopo"]
REGIAO_ORDER = ["Norte", "Nordeste", "Sudeste", "Sul", "Centro-Oeste", "Não informado"]
SITUACAO_OBRA_ORDER = [
    "Obra em andamento",
    "Obra concluída",
    "Obra Paralisada",
    "Não iniciada",
    "Não executada - Contrato Encerrado",
    "Não informado",
]
TIPO_OPERACAO_ORDER = ["REPASSE", "FINANCIAMENTO", "Não informado"]
FAIXA_FISICA_ORDER = ["0%", "1–25%", "26–50%", "51–75%", "76–99%", "100%", "Sem dado"]

NAO_INFORMADO = "Não informado"
OUTROS_MUNICIPIOS = "Outros municípios"

# Suspension documents and the text that marks each as pending.
DOC_APRESENTADOS = "Documentos apresentados"
DOC_NAO_APRESENTADOS = "Documentos não apresentados"
DOC_PENDENTE = {DOC_APRESENTADOS: "Não Apresentado", DOC_NAO_APRESENTADOS: "NÃO"}
DOC_LABELS = {
    "doc_titularidade": "Titularidade",
    "doc_viabilidade_terreno": "Viabilidade do Terreno",
    "doc_sondagem": "Estudos de Sondagem",
    "doc_orcamento": "Orçamento",
    "doc_projetos_implantacao": "Projetos de Implantação",
    "doc_projetos_complementares": "Projetos Complementares",
    "doc_ambiental": "Órgão Ambiental",
    "doc_vigilancia_sanitaria": "Vigilância Sanitária",
    "doc_bombeiros": "Bombeiros",
    "doc_trabalho_social": "Trabalho Social",
}
# Document column of the base -> column of the source tabs.
DOC_SOURCE_COLUMNS = {
    "doc_titularidade": "titularidade",
    "doc_viabilidade_terreno": "viabilidade_do_terreno",
    "doc_sondagem": "estudos_de_sondagem",
    "doc_orcamento": "orcamento",
    "doc_projetos_implantacao": "elaboracao_de_projetos_de_implantacao",
    "doc_projetos_complementares": "projetos_complementares",
    "doc_ambiental": "manifestacao_do_orgao_ambiental",
    "doc_vigilancia_sanitaria": "aprovacao_vigilancia_sanitaria",
    "doc_bombeiros": "aprovacao_bombeiros",
    "doc_trabalho_social": "projeto_de_trabalho_social",
}

# State -> region.
UF_REGIAO = {
    "AC": "Norte", "AP": "Norte", "AM": "Norte", "PA": "Norte", "RO": "Norte", "RR": "Norte", "TO": "Norte",
    "AL": "Nordeste", "BA": "Nordeste", "CE": "Nordeste", "MA": "Nordeste", "PB": "Nordeste",
    "PE": "Nordeste", "PI": "Nordeste", "RN": "Nordeste", "SE": "Nordeste",
    "ES": "Sudeste", "MG": "Sudeste", "RJ": "Sudeste", "SP": "Sudeste",
    "PR": "Sul", "RS": "Sul", "SC": "Sul",
    "DF": "Centro-Oeste", "GO": "Centro-Oeste", "MT": "Centro-Oeste", "MS": "Centro-Oeste",
}

# Short working name -> published name of the wide base, in published order.
BASE_COLUMNS = {
    "cod_tci": "cod_tci_saci",
    "cod_saci": "cod_saci",
    "num_convenio": "num_convenio_saci",
    "uf": "txt_uf_saci",
    "regiao": "txt_regiao_saci",
    "cod_ibge": "cod_ibge_7dig_saci",
    "municipio": "txt_municipio_saci",
    "proponente": "txt_tomador_saci",
    "objeto": "dsc_objeto_instrumento_saci",
    "secretaria": "txt_sigla_secretaria_saci",
    "fase": "dsc_fase_pac_saci",
    "modalidade": "txt_modalidade_saci",
    "situacao": "dsc_situacao_contrato_mcid_saci",
    "dt_assinatura": "dte_assinatura_contrato_saci",
    "situacao_suspensiva": "situacao_da_analise_suspensiva_pbi",
    "dt_vencimento_suspensiva": "vencimento_da_suspensiva_pbi",
    "dt_retirada_suspensiva": "dte_retirada_suspensiva_tgov",
    "dt_lae": "dte_primeira_data_lae_tdb",
    "dt_pub_licitacao": "dte_publicacao_licitacao_tgov",
    "dt_homolog_licitacao": "dte_homologacao_licitacao_tgov",
    "dt_vrpl": "dte_vrpl_tdb",
    "dt_aio": "dte_aio_tdb",
    "dt_inicio_obra": "dte_inicio_obra_mcid_saci",
    "vlr_repasse": "vlr_repasse_saci",
    "perspectiva_de_retirada_da_suspensiva": "perspectiva_de_retirada_da_suspensiva",
    "doc_titularidade": "doc_titularidade",
    "doc_viabilidade_terreno": "doc_viabilidade_terreno",
    "doc_sondagem": "doc_sondagem",
    "doc_orcamento": "doc_orcamento",
    "doc_projetos_implantacao": "doc_projetos_implantacao",
    "doc_projetos_complementares": "doc_projetos_complementares",
    "doc_ambiental": "doc_ambiental",
    "doc_vigilancia_sanitaria": "doc_vigilancia_sanitaria",
    "doc_bombeiros": "doc_bombeiros",
    "doc_trabalho_social": "doc_trabalho_social",
    "tipo_doc_suspensiva": "tipo_doc_suspensiva",
    "status_suspensiva": "status_suspensiva_calc",
    "flag_publicacao_licitacao": "flag_publicacao_licitacao_calc",
    "flag_homologacao_licitacao": "flag_homologacao_licitacao_calc",
    "ultima_data_relevante": "ultima_data_relevante_calc",
    "fase_atual": "fase_atual_calc",
    "dias_ate_publicacao": "dias_ate_publicacao_calc",
    "dias_publicacao_ate_homologacao": "dias_publicacao_ate_homologacao_calc",
    "dias_homologacao_ate_vrpl": "dias_homologacao_ate_vrpl_calc",
    "dias_vrpl_ate_aio": "dias_vrpl_ate_aio_calc",
    "dias_aio_ate_inicio_obra": "dias_aio_ate_inicio_obra_calc",
    "faixa_repasse": "faixa_repasse_calc",
    "prazo_pub_licitacao": "prazo_pub_licitacao_calc",
    "dt_lae_mais_60": "prazo_lae_mais_60_calc",
    "dt_lae_mais_60_mais_120": "prazo_lae_mais_60_mais_120_calc",
    "prazo_homolog_120d": "prazo_homolog_licitacao_120d",
    "prazo_inicio_obra": "prazo_inicio_obra_calc",
    "data_limite_licitacao_casa_civil": "data_limite_licitacao_casa_civil_const",
    "status_regra_casa_civil": "status_regra_casa_civil_calc",
    "prazo_homolog_licitacao": "prazo_homolog_licitacao_calc",
    "status_pub_licitacao": "status_pub_licitacao_calc",
    "status_homolog_licitacao": "status_homolog_licitacao_calc",
    "status_inicio_obra": "status_inicio_obra_calc",
    "urgencia_suspensiva": "urgencia_suspensiva_calc",
    "motivo_suspensiva_retirada_dmp": "motivo_suspensiva_retirada_dmp",
}

# Earlier header names still accepted when two snapshots are compared.
FIELD_ALIASES = {
    "cod_saci": "cod_tci_saci",
    "num_convenio": "num_convenio_saci",
    "txt_uf": "txt_uf_saci",
    "txt_regiao": "txt_regiao_saci",
    "cod_ibge_7dig": "cod_ibge_7dig_saci",
    "txt_municipio": "txt_municipio_saci",
    "txt_tomador": "txt_tomador_saci",
    "dsc_objeto_instrumento": "dsc_objeto_instrumento_saci",
    "txt_sigla_secretaria": "txt_sigla_secretaria_saci",
    "dsc_fase_pac": "dsc_fase_pac_saci",
    "txt_modalidade": "txt_modalidade_saci",
    "dsc_situacao_contrato_mcid": "dsc_situacao_contrato_mcid_saci",
    "dte_assinatura_contrato": "dte_assinatura_contrato_saci",
    "situacao_da_analise_suspensiva": "situacao_da_analise_suspensiva_pbi",
    "motivo_suspensiva_retirada_cgpac": "motivo_suspensiva_retirada_dmp",
    "vencimento_da_suspensiva": "vencimento_da_suspensiva_pbi",
    "dte_retirada_suspensiva": "dte_retirada_suspensiva_tgov",
    "dte_primeira_data_lae": "dte_primeira_data_lae_tdb",
    "dte_publicacao_licitacao": "dte_publicacao_licitacao_tgov",
    "dte_homologacao_licitacao": "dte_homologacao_licitacao_tgov",
    "dte_vrpl": "dte_vrpl_tdb",
    "dte_aio": "dte_aio_tdb",
    "dte_inicio_obra_mcid": "dte_inicio_obra_mcid_saci",
    "vlr_repasse": "vlr_repasse_saci",
    "status_suspensiva": "status_suspensiva_calc",
    "flag_publicacao_licitacao": "flag_publicacao_licitacao_calc",
    "flag_homologacao_licitacao": "flag_homologacao_licitacao_calc",
    "ultima_data_relevante": "ultima_data_relevante_calc",
    "fase_atual": "fase_atual_calc",
    "dias_ate_publicacao": "dias_ate_publicacao_calc",
    "dias_publicacao_ate_homologacao": "dias_publicacao_ate_homologacao_calc",
    "dias_homologacao_ate_vrpl": "dias_homologacao_ate_vrpl_calc",
    "dias_vrpl_ate_aio": "dias_vrpl_ate_aio_calc",
    "dias_aio_ate_inicio_obra": "dias_aio_ate_inicio_obra_calc",
    "faixa_repasse": "faixa_repasse_calc",
    "prazo_pub_licitacao": "prazo_pub_licitacao_calc",
    "prazo_homolog_licitacao": "prazo_homolog_licitacao_calc",
    "prazo_inicio_obra": "prazo_inicio_obra_calc",
    "data_limite_licitacao_casa_civil": "data_limite_licitacao_casa_civil_const",
    "status_regra_casa_civil": "status_regra_casa_civil_calc",
    "status_pub_licitacao": "status_pub_licitacao_calc",
    "status_homolog_licitacao": "status_homolog_licitacao_calc",
    "status_inicio_obra": "status_inicio_obra_calc",
    "urgencia_suspensiva": "urgencia_suspensiva_calc",
}
OLD_SUFFIX, NEW_SUFFIX = "_tci", "_saci"

# Fields that come straight from a source.
SOURCE_FIELDS = [
    "cod_tci_saci",
    "num_convenio_saci",
    "txt_uf_saci",
    "txt_regiao_saci",
    "cod_ibge_7dig_saci",
    "txt_municipio_saci",
    "txt_tomador_saci",
    "dsc_objeto_instrumento_saci",
    "txt_sigla_secretaria_saci",
    "dsc_fase_pac_saci",
    "txt_modalidade_saci",
    "dsc_situacao_contrato_mcid_saci",
    "dte_assinatura_contrato_saci",
    "situacao_da_analise_suspensiva_pbi",
    "vencimento_da_suspensiva_pbi",
    "dte_retirada_suspensiva_tgov",
    "dte_primeira_data_lae_tdb",
    "dte_publicacao_licitacao_tgov",
    "dte_homologacao_licitacao_tgov",
    "dte_vrpl_tdb",
    "dte_aio_tdb",
    "dte_inicio_obra_mcid_saci",
    "vlr_repasse_saci",
    "motivo_suspensiva_retirada_dmp",
    "doc_titularidade",
    "doc_viabilidade_terreno",
    "doc_sondagem",
    "doc_orcamento",
    "doc_projetos_implantacao",
    "doc_projetos_complementares",
    "doc_ambiental",
    "doc_vigilancia_sanitaria",
    "doc_bombeiros",
    "doc_trabalho_social",
    "tipo_doc_suspensiva",
]
# Derived fields that move with the calendar alone.
TIME_FIELDS = [
    "prazo_pub_licitacao_calc",
    "prazo_lae_mais_60_calc",
    "prazo_lae_mais_60_mais_120_calc",
    "prazo_homolog_licitacao_120d",
    "prazo_homolog_licitacao_calc",
    "prazo_inicio_obra_calc",
    "status_pub_licitacao_calc",
    "status_homolog_licitacao_calc",
    "status_inicio_obra_calc",
    "urgencia_suspensiva_calc",
]
# Status fields counted in the diff summary, in report order.
STATUS_FIELDS = [
    "status_suspensiva_calc",
    "status_pub_licitacao_calc",
    "status_homolog_licitacao_calc",
    "status_inicio_obra_calc",
    "status_regra_casa_civil_calc",
    "urgencia_suspensiva_calc",
    "fase_atual_calc",
]


@dataclass(frozen=True)
class DiffSpec:
    """What identifies a record, what is compared and how changes are named."""

    key_candidates: tuple[str, ...]
    key_output: str
    key_source: str | None
    code_field: str | None = None
    carried: tuple[tuple[str, str], ...] = ()
    never_compared: tuple[str, ...] = ()
    tracked: tuple[str, ...] | None = None
    ignored: tuple[str, ...] = ()
    systemic: tuple[tuple[str, str], ...] = ()
    source_fields: tuple[str, ...] = ()
    time_fields: tuple[str, ...] = ()
    value_field: str | None = None
    skip_blank_keys: bool = False


CONTRACT_DIFF = DiffSpec(
    key_candidates=(
        "num_convenio_saci", "num_convenio_tci", "num_convenio",
        "cod_tci_saci", "cod_tci_tci", "cod_saci", "cod_tci",
    ),
    key_output="num_convenio",
    key_source="num_convenio_saci",
    code_field="cod_tci_saci",
    carried=(("uf", "txt_uf_saci"), ("secretaria", "txt_sigla_secretaria_saci")),
    never_compared=("num_convenio_saci", "cod_tci_saci"),
    ignored=("data_limite_licitacao_casa_civil_const", "status_regra_casa_civil_calc"),
    systemic=(("prazo_homolog_licitacao_calc", "2026-06-01"),),
    source_fields=tuple(SOURCE_FIELDS),
    time_fields=tuple(TIME_FIELDS),
    value_field="vlr_repasse_saci",
)

# Legacy-works fields whose changes are logged.
LEGACY_TRACKED = [
    "ativo",
    "situacao_obra",
    "pct_fisico",
    "vlr_repasse",
    "vlr_contrapartida",
    "vlr_desembolsado",
    "mes_ultimo_desbloqueio",
    "situacao_contrato",
    "situacao_compl",
    "dias_sem_bm",
    "motivo_paralisacao",
    "detalhamento_motivo",
    "principal_entrave",
    "plano_acao",
    "previsao_retomada",
]
LEGACY_DIFF = DiffSpec(
    key_candidates=("operacao",),
    key_output="operacao",
    key_source=None,
    carried=(("uf", "uf"), ("municipio", "municipio"), ("recebedor", "recebedor"), ("modalidade", "modalidade")),
    tracked=tuple(LEGACY_TRACKED),
    source_fields=tuple(LEGACY_TRACKED),
    skip_blank_keys=True,
)

# Spreadsheet heading -> legacy-works field.
LEGACY_COLUMNS = {
    "ATIVO_INATIVO": "ativo",
    "TIPO DE OPERAÇÃO": "tipo_operacao",
    "PROPOSTA": "proposta",
    "OPERAÇÃO": "operacao",
    "DV": "dv",
    "INSTRUMENTO": "instrumento",
    "REPASSADOR": "repassador",
    "UF": "uf",
    "RECEBEDOR": "recebedor",
    "ENTE DE VINCULAÇÃO": "ente",
    "MUNICÍPIO BENEFICIADO": "municipio",
    "OBJETO": "objeto",
    "Modalidade": "modalidade",
    "Modalidade - classificação Casa Civil": "modalidade_cc",
    "SITUAÇÃO DA OBRA CASA CIVIL": "situacao_obra",
    "% FÍSICO REALIZADO": "pct_fisico",
    "DATA DA ASSINATURA": "dt_assinatura",
    "VALOR DE REPASSE/EMPRÉSTIMO": "vlr_repasse",
    "VALOR DE CONTRAPARTIDA ATUAL": "vlr_contrapartida",
    "VALOR DESBLOQUEADO/DESEMBOLSADO": "vlr_desembolsado",
    "MES ÚLTIMO DESBLOQUEIO/DESEMBOLSO": "mes_ultimo_desbloqueio",
    "SITUAÇÃO DO CONTRATO": "situacao_contrato",
    "Situação Contrato Complemento": "situacao_compl",
    "Dias sem Apresentação de BM": "dias_sem_bm",
    "PRINCIPAL MOTIVO DE PARALISAÇÃO": "motivo_paralisacao",
    "DETALHAMENTO DO MOTIVO": "detalhamento_motivo",
    "DESCRIÇÃO DO MOTIVO": "descricao_motivo",
    "PRINCIPAL ENTRAVE": "principal_entrave",
    "PLANO DE AÇÃO": "plano_acao",
    "PREVISÃO DE RETOMADA": "previsao_retomada",
    "dt_atualizacao": "dt_atualizacao",
}
LEGACY_DATES = ["dt_assinatura", "dt_atualizacao", "previsao_retomada"]

# Fields whose change marks a row of the panel as altered.
ROW_LABEL_FIELDS = [
    "situacao", "situacao_suspensiva", "status_suspensiva", "fase_atual",
    "dt_retirada_suspensiva", "dt_lae", "dt_pub_licitacao", "dt_homolog_licitacao",
    "dt_vrpl", "dt_aio", "dt_inicio_obra", "vlr_repasse",
    "status_pub_licitacao", "status_homolog_licitacao", "status_inicio_obra",
    "status_regra_casa_civil", "urgencia_suspensiva",
]

# Labels of the change log.
NATURE_LABELS = {
    "dados_origem": "Mudança de dado",
    "derivado_regra": "Mudança derivada",
    "derivado_tempo": "Prazo/status automático",
    "novo_registro": "Novo registro",
    "registro_removido": "Registro removido",
}
CHANGE_FIELD_LABELS = {
    "dsc_situacao_contrato_mcid_saci": "Situação Contrato (SACI)",
    "dsc_situacao_contrato_mcid_tci": "Situação Contrato (SACI)",
    "situacao_da_analise_suspensiva_pbi": "Situação Suspensiva (PBI)",
    "situacao_contrato_dmp": "Situação Contrato (DMP)",
    "situacao_da_analise_suspensiva_dmp": "Situação Suspensiva (DMP)",
    "situacao_da_analise_suspensiva_cgpac": "Situação Suspensiva (DMP)",
    "motivo_suspensiva_retirada_dmp": "Motivo Retirada (DMP)",
    "motivo_suspensiva_retirada_cgpac": "Motivo Retirada (DMP)",
    "status_suspensiva_calc": "Status Suspensiva",
    "fase_atual_calc": "Fase Atual",
    "dte_retirada_suspensiva_tgov": "Retirada Suspensiva (TGOV)",
    "dte_primeira_data_lae_tdb": "LAE (TDB)",
    "dte_publicacao_licitacao_tgov": "Pub. Licitação (TGOV)",
    "dte_homologacao_licitacao_tgov": "Homolog. Licitação (TGOV)",
    "dte_vrpl_tdb": "VRPL (TDB)",
    "dte_aio_tdb": "AIO (TDB)",
    "dte_inicio_obra_mcid_saci": "Início Obra (SACI)",
    "dte_inicio_obra_mcid_tci": "Início Obra (SACI)",
    "vlr_repasse_saci": "Repasse (SACI)",
    "vlr_repasse_tci": "Repasse (SACI)",
    "prazo_pub_licitacao_calc": "Prazo Publicação (CALC)",
    "prazo_homolog_licitacao_calc": "Prazo Homolog. (CALC)",
    "prazo_homolog_licitacao_120d": "Prazo Homolog. 120d",
    "prazo_inicio_obra_calc": "Prazo Início Obra (CALC)",
    "status_pub_licitacao_calc": "Status Publicação (CALC)",
    "status_homolog_licitacao_calc": "Status Homolog. (CALC)",
    "status_inicio_obra_calc": "Status Início Obra (CALC)",
    "status_regra_casa_civil_calc": "Cumprimento Regra Casa Civil (CALC)",
    "urgencia_suspensiva_calc": "Urgência Susp.",
}
MONEY_FIELDS = ["vlr_repasse_saci", "vlr_repasse_tci"]
LEGACY_FIELD_LABELS = {
    "ativo": "Ativo/Inativo",
    "situacao_obra": "Situação da Obra (Casa Civil)",
    "pct_fisico": "% Físico Realizado",
    "vlr_repasse": "Repasse/Empréstimo",
    "vlr_contrapartida": "Contrapartida Atual",
    "vlr_desembolsado": "Desembolsado",
    "mes_ultimo_desbloqueio": "Mês Últ. Desbloqueio",
    "situacao_contrato": "Situação do Contrato",
    "situacao_compl": "Sit. Contrato Complemento",
    "dias_sem_bm": "Dias sem BM",
    "motivo_paralisacao": "Principal Motivo de Paralisação",
    "detalhamento_motivo": "Detalhamento do Motivo",
    "principal_entrave": "Principal Entrave",
    "plano_acao": "Plano de Ação",
    "previsao_retomada": "Previsão de Retomada",
}
LEGACY_MONEY_FIELDS = ["vlr_repasse", "vlr_contrapartida", "vlr_desembolsado"]

# Ingest columns that stay text whatever they look like.
FORCED_TEXT = ["proposta_nu", "convenio_co", "operacao_nu"]


@dataclass
class Selection:
    """The reader's current choices; empty means no restriction."""

    query: str = ""
    secretaria: list[str] = field(default_factory=list)
    modalidade: list[str] = field(default_factory=list)
    ano: list[str] = field(default_factory=list)
    situacao: str | None = None
    situacao_suspensiva: str | None = None
    drill: str | None = None
    regiao: str | None = None
    uf: str | None = None
    municipio: str | None = None
    suspensiva: str | None = None
    urgencia: str | None = None
    meses: list[str] = field(default_factory=list)
    pub_etapa: str | None = None
    pub_prazo: str | None = None
    homolog_etapa: str | None = None
    homolog_prazo: str | None = None
    casa_civil: str | None = None
    documento: str | None = None
    inicio_obra: str | None = None
