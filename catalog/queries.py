"""Every registered query: a name and a function of (session, table directory)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import tables as T
from milemark import config as C
from milemark.functions import rules as R
from milemark.functions.calendar import weekdays_between
from milemark.functions.text import (
    br_month,
    iso_from_text,
    num_or_null,
    num_or_zero,
    parse_date,
    pick_field,
    region_of,
    squish,
)
from milemark.operators import aggregates as A
from milemark.operators import diff as D
from milemark.operators import explore as E
from milemark.operators import joins as J
from milemark.operators.factored import FactoredJoin
from milemark.plans import contract_base, panel
from milemark.plans import selection as S
from milemark.sources import files, naming
from milemark.sources.buckets import BucketedSnapshots
from milemark.sources.changelog import ChangeLog
from milemark.sources.digests import DigestedSnapshots
from milemark.sources.store import SnapshotStore
from milemark.sources.textindex import TextIndex, logged_keys
from milemark.sources.validity import ValidityStore

Query = Callable[[SparkSession, str], DataFrame]
CFG = T.SETTINGS

RULE_COLUMNS = {
    "suspension_status": ["status_suspensiva"],
    "milestone_flags": ["flag_publicacao_licitacao", "flag_homologacao_licitacao"],
    "latest_milestone": ["ultima_data_relevante"],
    "phase": ["fase_atual"],
    "milestone_gaps": [
        "dias_ate_publicacao", "dias_publicacao_ate_homologacao", "dias_homologacao_ate_vrpl",
        "dias_vrpl_ate_aio", "dias_aio_ate_inicio_obra",
    ],
    "value_band": ["vlr_repasse", "faixa_repasse"],
    "publication_deadline": ["prazo_pub_licitacao"],
    "lae_projections": ["dt_lae_mais_60", "dt_lae_mais_60_mais_120"],
    "homologation_deadline": ["prazo_homolog_120d", "prazo_homolog_licitacao"],
    "works_start_deadline": ["dt_aio", "prazo_inicio_obra"],
    "cutoff_status": ["status_regra_casa_civil"],
    "publication_status": ["status_pub_licitacao"],
    "homologation_status": ["status_homolog_licitacao"],
    "works_start_status": ["status_inicio_obra"],
    "suspension_urgency": ["urgencia_suspensiva"],
    "withdrawn_reason": ["motivo_suspensiva_retirada_dmp"],
    "era_and_year": ["pos_72", "ano"],
}


def _rule(columns: list[str]) -> Query:
    return lambda spark, sf: T.panel(spark, sf).select("cod_tci", *columns)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts and value per phase and publication status as of a day."""
    return (
        T.panel(spark, sf)
        .groupBy("fase_atual", "status_pub_licitacao")
        .agg(F.count("*").alias("qtd"), F.sum("vlr_repasse").cast("decimal(18,2)").alias("vlr"))
    )


def base_filter(spark, sf):
    return T.selected(spark, sf).select("cod_tci", "fonte", "fase", "secretaria")


def weekday_count(spark, sf):
    days = weekdays_between(F.col("dt_assinatura"), F.col("dt_vencimento_suspensiva"))
    back = weekdays_between(F.col("dt_vencimento_suspensiva"), F.col("dt_assinatura"))
    return T.contracts(spark, sf).select("cod_tci", days.alias("dias_uteis"), back.alias("dias_invertidos"))


def doc_type(spark, sf):
    return T.with_docs(T.selected(spark, sf)).select(
        "cod_tci", "tipo_doc_suspensiva", "doc_titularidade", "doc_trabalho_social"
    )


def pending_docs(spark, sf):
    df = panel.with_pending_docs(T.with_docs(T.selected(spark, sf)))
    return df.select("cod_tci", "docs_suspensiva_resumo", "docs_suspensiva_qtd")


def situation_flags(spark, sf):
    flags = panel.situation_flags(F.col("situacao"), F.col("situacao_suspensiva"), F.col("dt_assinatura"), CFG)
    return T.selected(spark, sf).select("cod_tci", *[c.alias(n) for n, c in flags.items()])


def display_status(spark, sf):
    c = F.col
    shown = {
        "exibe_publicacao": R.display_status(c("dt_pub_licitacao"), c("dt_assinatura"), c("status_pub_licitacao"), CFG.exempt_before),
        "exibe_homologacao": R.display_status(c("dt_homolog_licitacao"), c("dt_assinatura"), c("status_homolog_licitacao"), CFG.exempt_before),
    }
    return T.panel(spark, sf).select("cod_tci", *[v.alias(n) for n, v in shown.items()])


def _pending(spark, sf, sel: C.Selection | None = None):
    scope = S.suspension_match(sel or C.Selection(), with_months=False)
    return T.panel(spark, sf).where(scope & R.is_pending(F.col("dt_retirada_suspensiva"), F.col("situacao_suspensiva")))


def pending_by_month(spark, sf):
    return A.month_calendar(_pending(spark, sf), CFG.as_of)


def progress_band(spark, sf):
    return A.progress_counts(T.works(spark, sf))


def work_flags(spark, sf):
    flags = R.work_flags(F.col("situacao_obra"))
    return T.works(spark, sf).select("operacao", *[c.alias(n) for n, c in flags.items()])


def due_by_cutoff(spark, sf):
    pub, hom = F.col("dt_pub_licitacao"), F.col("dt_homolog_licitacao")
    due = R.due_by_cutoff(F.col("prazo_homolog_licitacao"), F.col("data_limite_licitacao_casa_civil"))
    return T.panel(spark, sf).where(pub.isNotNull() & hom.isNull() & due).select("cod_tci", "prazo_homolog_licitacao")


def tolerant_join(spark, sf):
    src = T.sources(spark, sf)
    left = src["saci"].select("cod_tci", "num_convenio")
    right = src["pbi"].select("instrumento", "vencimento_da_suspensiva")
    return J.tolerant_join(left, right, "num_convenio", "instrumento")


def tolerant_join_empty(spark, sf):
    """No row on the right: every contract stays."""
    src = T.sources(spark, sf)
    right = src["pbi"].where("instrumento = 'none such'").select("instrumento", "vencimento_da_suspensiva")
    return J.tolerant_join(src["saci"].select("cod_tci", "num_convenio"), right, "num_convenio", "instrumento")


def tolerant_join_null_keys(spark, sf):
    """Two contracts of three without a key; blank keys match nothing."""
    src = T.sources(spark, sf)
    key = F.when(F.col("cod_tci").cast("string").endswith("0"), F.col("num_convenio"))
    left = src["saci"].select("cod_tci", key.alias("num_convenio"))
    right = src["pbi"].select("instrumento", "vencimento_da_suspensiva")
    return J.tolerant_join(left, right, "num_convenio", "instrumento", blank_is_missing=True)


def _factored(spark, sf):
    src = T.sources(spark, sf)
    right = src["licitacao"].select(F.col("num_convenio").alias("instrumento"), "dte_publicacao_licitacao")
    return FactoredJoin(src["saci"].select("cod_tci", "num_convenio", F.col("txt_uf").alias("uf"), "vlr_repasse"), right, "num_convenio", "instrumento")


def factored_keys(spark, sf):
    """Keys of contracts and tender rows with the rows of either side and of their join."""
    return _factored(spark, sf).keys().select("linhas_esquerda", "linhas_direita", "linhas", F.regexp_replace("chave", r"^.:|\.$", "").alias("chave"))


def factored_totals(spark, sf):
    """Rows and value of the joined contracts by state, without the joined rows."""
    return _factored(spark, sf).totals(["uf"], {"vlr_repasse": F.col("vlr_repasse")})


def factored_rows(spark, sf):
    """The joined rows, with keys of more than three rows cut."""
    return _factored(spark, sf).unfold(3).select("cod_tci", "num_convenio", "instrumento", "dte_publicacao_licitacao")


def infer_types(spark, sf):
    """Types found for text columns whose deciding values come late, one row a column."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    texts = T.read(spark, sf, "orders").select(
        F.when(k % 97 == 0, F.concat(k.cast("string"), F.lit(",5"))).otherwise(k.cast("string")).alias("virgula"),
        k.cast("string").alias("inteiro"),
        F.when(k % 89 == 0, F.concat(k.cast("string"), F.lit(".25"))).otherwise(k.cast("string")).alias("real"),
        F.when(k % 83 == 0, F.date_format(d, "dd/MM/yyyy")).alias("dia"),
        F.when(k % 79 == 0, "x").otherwise(k.cast("string")).alias("misto"),
    )
    typed = naming.infer_types(texts)
    counts = typed.agg(*[F.count(c).alias(c) for c in typed.columns])
    kinds = dict(typed.dtypes)
    rows = [F.struct(F.lit(c).alias("coluna"), F.lit(kinds[c]).alias("tipo"), F.col(c).alias("valores")) for c in typed.columns]
    return counts.select(F.inline(F.array(*rows)))


def diff_report(spark, sf):
    """The text report of a pair of snapshots, line by line."""
    dates = {"atual": T.SNAPSHOTS[1], "anterior": T.SNAPSHOTS[0], "primeiro": T.SNAPSHOTS[0]}
    return files.summary_report(D.diff_summary(T.snapshot(spark, sf, 1), T.snapshot(spark, sf, 2), dates))


def plain_join(spark, sf):
    src = T.sources(spark, sf)
    return J.plain_join(
        src["saci"].select("cod_tci", "num_convenio"),
        src["s29"].withColumnRenamed("instrumento", "instrumento_s29"),
        "num_convenio", "instrumento_s29",
    )


def enrich(spark, sf):
    return contract_base.enrich(T.sources(spark, sf), CFG)


def enrich_split(spark, sf):
    """``enrich`` with every key of more than three rows, among the contracts or in a source, cut over several tasks."""
    return contract_base.enrich(T.sources(spark, sf), CFG, 3)


def doc_union(spark, sf):
    src = T.sources(spark, sf)
    return contract_base.doc_union(src["sda"], src["sdn"])


def first_match(spark, sf):
    src = T.sources(spark, sf)
    docs = contract_base.doc_union(src["sda"], src["sdn"]).select("tipo_doc_suspensiva", "instrumento")
    return J.first_match(docs, src["saci"], "instrumento", "num_convenio", "cod_tci", "cod_saci")


def _flagged_docs(spark, sf):
    src = T.sources(spark, sf)
    docs = contract_base.doc_union(src["sda"], src["sdn"])
    return J.membership_flag(docs, T.selected(spark, sf), "instrumento", "num_convenio", "consta_base_pc32")


def membership_flag(spark, sf):
    return _flagged_docs(spark, sf).select("tipo_doc_suspensiva", "instrumento", "consta_base_pc32")


def doc_kpis(spark, sf):
    return A.doc_kpis(_flagged_docs(spark, sf))


def freshness(spark, sf):
    return A.freshness(T.sources(spark, sf), "1998-11-16", CFG)


def match_snapshots(spark, sf):
    return J.match_snapshots(T.snapshot(spark, sf, 1), T.snapshot(spark, sf, 2), C.CONTRACT_DIFF.key_candidates)


def key_diff(spark, sf):
    return J.key_diff(T.snapshot(spark, sf, 1), T.snapshot(spark, sf, 2), C.CONTRACT_DIFF.key_candidates, "entrou")


def row_labels(spark, sf):
    labelled = D.label_changes(T.panel(spark, sf), T.previous_panel(spark, sf))
    return labelled.select("cod_tci", "alteracao", F.array_join("campos", ",").alias("campos"))


def key_check(spark, sf):
    k = F.col("k")
    base = T.contracts(spark, sf).select(
        "k", F.col("num_convenio").alias("num_convenio_saci"),
        F.when(k % 202 != 0, F.col("cod_tci")).alias("cod_tci_saci"),
    )
    repeated = base.unionByName(base.where(k % 97 == 0)).drop("k")
    return J.key_report(repeated, C.CONTRACT_DIFF.key_candidates, "carteira")


def restrict_previous(spark, sf):
    current = T.panel(spark, sf).where(F.col("secretaria") == "BUILDING")
    return J.restrict_previous(T.previous_panel(spark, sf), current).select("cod_tci", "num_convenio")


def first_events(spark, sf):
    return A.first_events(T.sources(spark, sf)["licitacao"])


def breakdown(spark, sf):
    return A.breakdown(T.panel(spark, sf), "situacao", C.SITUACAO_ORDER)


def domain_order(spark, sf):
    counts = A.geo_breakdown(T.panel(spark, sf), "regiao")
    return E.domain_order(counts, "label", ["AMERICA", "EUROPE", "ASIA"])


def group_totals(spark, sf):
    return A.group_totals(T.panel(spark, sf), "modalidade")


def kpi(spark, sf):
    return A.kpi(T.panel(spark, sf), A.overview_indicators())


def kpi_delta(spark, sf):
    return A.kpi_delta(T.panel(spark, sf), T.previous_panel(spark, sf), A.overview_indicators())


TENDER = C.Selection(pub_etapa="Publicada", casa_civil="Pendente")


def tender_kpis(spark, sf):
    return A.tender_kpis(T.panel(spark, sf), T.previous_panel(spark, sf), C.Selection(), CFG)


def works_kpis(spark, sf):
    return A.works_kpis(T.panel(spark, sf), T.previous_panel(spark, sf), C.Selection())


def tender_flow(spark, sf):
    return A.tender_flow(T.panel(spark, sf), C.Selection(), CFG)


def suspension_cascade(spark, sf):
    return A.suspension_cascade(T.panel(spark, sf), C.Selection())


def doc_pending_counts(spark, sf):
    return A.doc_pending_counts(panel.with_pending_docs(T.with_docs(T.selected(spark, sf))))


def geo_breakdown(spark, sf):
    return A.geo_breakdown(T.panel(spark, sf), "municipio")


def _history(spark, sf):
    return D.diff_history(*T.history(spark, sf))


def daily_log(spark, sf):
    """The log kept by day: the second day is stored twice, at first with other rows, and the third arrives after the fourth."""
    root = T.scratch(spark)
    store = SnapshotStore(spark, f"{root}/store")
    log = ChangeLog(store, f"{root}/log")
    contracts = T.stored_contracts(spark, sf)
    for rows, day in ((1, 1), (3, 2), (4, 4)):
        store.write(T.snapshot(spark, sf, rows, contracts), T.SNAPSHOTS[day - 1])
    log.update()
    for day in (3, 2):
        store.write(T.snapshot(spark, sf, day, contracts), T.SNAPSHOTS[day - 1])
        log.update()
    return log.events()


def diff_history(spark, sf):
    return _history(spark, sf)


def change_view(spark, sf):
    return D.change_view(D.change_log(_history(spark, sf)))


def change_kpis(spark, sf):
    return A.change_kpis(change_view(spark, sf))


def change_events(spark, sf):
    return A.change_events(change_view(spark, sf))


def diff_detail(spark, sf):
    return D.diff_detail(T.snapshot(spark, sf, 1), T.snapshot(spark, sf, 2))


def _bucketed(spark, sf):
    """The first two snapshots as they lie in a store with four buckets."""
    store = BucketedSnapshots(spark, T.scratch(spark), 4)
    for k in (1, 2):
        store.write(T.snapshot(spark, sf, k), T.SNAPSHOTS[k - 1])
    return [store.at(day) for day in T.SNAPSHOTS[:2]]


def bucketed_diff(spark, sf):
    return D.diff_detail(*_bucketed(spark, sf))


def bucketed_match(spark, sf):
    return J.match_snapshots(*_bucketed(spark, sf), C.CONTRACT_DIFF.key_candidates)


def digest_diff(spark, sf):
    """The first two snapshots in 16 parts; only parts that differ are read."""
    store = DigestedSnapshots(spark, T.scratch(spark), 16)
    for k in (1, 2):
        store.write(T.snapshot(spark, sf, k), T.SNAPSHOTS[k - 1])
    return D.diff_detail(*store.pair(*T.SNAPSHOTS[:2]))


def _validity(spark, sf):
    """Two days taken over, two added; the third is stored twice, at first with the rows of the first day."""
    store = ValidityStore(spark, T.scratch(spark))
    contracts = T.stored_contracts(spark, sf)
    rows, headers = T.history(spark, sf, (1, 2), contracts)
    store.build(rows, headers)
    for k, day in ((1, 3), (3, 3), (4, 4)):
        store.extend(T.snapshot(spark, sf, k, contracts), T.SNAPSHOTS[day - 1])
    return store


def validity_runs(spark, sf):
    """Runs of days on which a contract did not change."""
    return _validity(spark, sf).intervals().select(F.col("_chave").alias("chave"), "desde", "ate")


def base_as_of(spark, sf):
    """The base of the second day, out of the runs of four."""
    base = _validity(spark, sf).at(T.SNAPSHOTS[1])
    return base.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in base.columns])


def status_counters(spark, sf):
    return A.status_counters(diff_detail(spark, sf))


def diff_summary(spark, sf):
    dates = {"atual": T.SNAPSHOTS[1], "anterior": T.SNAPSHOTS[0], "primeiro": T.SNAPSHOTS[0]}
    contracts = T.stored_contracts(spark, sf)
    out = D.diff_summary(T.snapshot(spark, sf, 1, contracts), T.snapshot(spark, sf, 2, contracts), dates)
    return out.select("*", "resumo.*", "mudancas_status.*").drop("resumo", "mudancas_status")


def first_run_summary(spark, sf):
    day = T.SNAPSHOTS[0]
    out = D.diff_summary(None, T.snapshot(spark, sf, 1), {"atual": day, "anterior": None, "primeiro": day})
    return out.drop("resumo", "mudancas_status")


def legacy_diff(spark, sf):
    return D.legacy_log(D.diff_history(*T.works_history(spark, sf), C.LEGACY_DIFF))


def legacy_change_kpis(spark, sf):
    return A.legacy_change_kpis(D.legacy_change_view(legacy_diff(spark, sf)))


def legacy_change_view(spark, sf):
    return D.legacy_change_view(legacy_diff(spark, sf))


def legacy_summary(spark, sf):
    rows, headers = T.works_history(spark, sf)
    out = D.legacy_summary(D.diff_history(rows, headers, C.LEGACY_DIFF), rows, list(headers))
    return out.select("*", "resumo.*").drop("resumo")


def works_overview(spark, sf):
    return A.works_overview(T.works(spark, sf))


def execution_kpis(spark, sf):
    return A.execution_kpis(T.works(spark, sf))


def stoppage_kpis(spark, sf):
    return A.stoppage_kpis(T.works(spark, sf))


PROFILED = ["uf", "situacao", "secretaria", "modalidade", "num_convenio", "municipio"]


def column_profile(spark, sf):
    return A.column_profile(T.panel(spark, sf), PROFILED, forced=["municipio"])


WIDTHS = {
    "uf": "UF", "situacao": "Situação", "proponente": "Proponente (SACI)", "num_convenio": "Convênio",
    "dt_assinatura": "Assinatura", "vlr_repasse": "Repasse",
}


def width_profile(spark, sf):
    return A.width_profile(T.panel(spark, sf), WIDTHS)


def snapshot_date(spark, sf):
    return A.snapshot_date(T.works(spark, sf), "previsao_retomada", dt.date(2026, 6, 25))


FACET_STATE = {"secretaria": ["BUILDING", "FURNITURE"], "modalidade": [], "ano": ["1997", "1998"]}
FACET_COLUMNS = ["secretaria", "modalidade", "ano"]


def facets(spark, sf):
    return E.facets(T.panel(spark, sf), {c: F.col(c) for c in FACET_COLUMNS}, FACET_STATE)


def sanitize(spark, sf):
    chosen = {"secretaria": ["BUILDING", "SEM VALOR"], "modalidade": ["5-LOW"], "ano": [str(y) for y in range(1990, 2000)]}
    return E.sanitize(E.facets(T.panel(spark, sf), {c: F.col(c) for c in FACET_COLUMNS}, chosen), chosen)


def text_search(spark, sf):
    return E.text_search(T.panel(spark, sf), panel.SEARCH_COLUMNS, "PREFEITURA 12").select("cod_tci", "proponente")


def indexed_search(spark, sf):
    """The same through an inverted table."""
    rows = T.panel(spark, sf)
    index = TextIndex(spark, T.scratch(spark), panel.SEARCH_COLUMNS, ["cod_tci", "num_convenio"], rows_per_part=20_000)
    index.build(rows)
    return index.search(rows, "PREFEITURA 12").select("cod_tci", "proponente")


INDEXED = ["num_convenio_saci", "txt_tomador_saci", "fase_atual_calc"]


def indexed_search_updated(spark, sf):
    """An inverted table of the first day, brought to the second by the change log."""
    root = T.scratch(spark)
    store = SnapshotStore(spark, f"{root}/store")
    log = ChangeLog(store, f"{root}/log")
    index = TextIndex(spark, f"{root}/index", INDEXED, rows_per_part=20_000)
    for k in (1, 2):
        store.write(T.snapshot(spark, sf, k), T.SNAPSHOTS[k - 1])
    index.build(store.at(T.SNAPSHOTS[0]))
    log.update()
    index.update(store.at(T.SNAPSHOTS[1]), logged_keys(log.events()))
    return index.search(store.at(T.SNAPSHOTS[1]), "prefeitura homolog").select(*INDEXED)


CROSS = C.Selection(situacao=C.NORMAL, secretaria=["BUILDING"], drill="5-LOW")


def cross_filter(spark, sf):
    rows = T.panel(spark, sf).where(S.top_match(CROSS))
    return E.cross_filter(rows, E.panel_charts(CROSS))


def geo_filter(spark, sf):
    sel = C.Selection(regiao="AMERICA", municipio=C.NAO_INFORMADO)
    return E.geo_filter(T.panel(spark, sf), sel).select("cod_tci", "regiao", "uf", "municipio")


CASCADE = C.Selection(urgencia="31–90 dias", meses=["01/1999"])


def cascade_filter(spark, sf):
    rows = T.panel(spark, sf)
    return rows.where(S.suspension_match(CASCADE)).select("cod_tci", "situacao_suspensiva", "dt_vencimento_suspensiva")


def tender_filter(spark, sf):
    scope = R.is_normal(F.col("situacao")) & S.tender_match(TENDER, CFG)
    return T.panel(spark, sf).where(scope).select("cod_tci", "dt_pub_licitacao", "status_regra_casa_civil")


FINAL = C.Selection(pub_etapa="Publicada", documento="Titularidade", inicio_obra="Iniciada no prazo", ano=["1996", "1997"])


def final_filter(spark, sf):
    rows = panel.with_pending_docs(T.with_docs(T.panel(spark, sf)))
    return panel.detail_rows(rows, FINAL, CFG).select("cod_tci", "status_inicio_obra")


PAGE = E.TableQuery(
    text="homologa BUILDING", exact={"fase_atual": "HOMOLOGACAO"}, contains={"modalidade": "low"},
    sort=[("dt_assinatura", False), ("cod_tci", True)], page=2, size=10,
)
PAGE_COLUMNS = ["cod_tci", "secretaria", "modalidade", "fase_atual", "dt_assinatura"]


def table_page(spark, sf):
    return E.table_page(T.panel(spark, sf), PAGE, PAGE_COLUMNS)


DEEP = E.TableQuery(sort=[("dt_assinatura", False), ("cod_tci", True)], page=21, size=25)


def deep_page(spark, sf):
    """A page far down in all monitored contracts; ranges of a hundred rows, as on a table of millions."""
    return E.deep_page(T.panel(spark, sf), DEEP, PAGE_COLUMNS, rows_at_once=100)


def next_page(spark, sf):
    """The page behind the last contract of a day."""
    return E.next_page(T.panel(spark, sf), DEEP, PAGE_COLUMNS, (dt.date(1997, 1, 1), None))


def scoped_rows(spark, sf):
    visible = T.panel(spark, sf).where(F.col("secretaria") == "BUILDING")
    return E.scoped_rows(_pending(spark, sf), visible, [], ["cod_tci"]).select("cod_tci", "dt_vencimento_suspensiva")


def filter_options(spark, sf):
    due = F.col("dt_vencimento_suspensiva")
    return E.filter_options(T.panel(spark, sf), "dt_vencimento_suspensiva", br_month(due))


def topk_other(spark, sf):
    return E.topk_other(E.municipality_counts(T.panel(spark, sf), C.Selection(regiao="ASIA", uf="NATION_7")))


def group_topk(spark, sf):
    return E.group_topk(A.group_totals(T.works(spark, sf), "modalidade"))


def reason_topk(spark, sf):
    return E.reason_topk(T.works(spark, sf))


def clean_text(spark, sf):
    docs = T.read(spark, sf, "documents")
    picked = pick_field(docs, "titulo", "lang", "source")
    return docs.select("doc_id", squish(F.col("text")).alias("limpo"), picked.alias("campo"))


def parse_values(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = (
        F.when(k % 5 == 0, F.date_format(d, "d/M/yyyy"))
        .when(k % 5 == 1, F.date_format(d, "d/M/yy"))
        .when(k % 5 == 2, F.date_format(d, "yyyy-M-d"))
        .when(k % 5 == 3, F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd")))
        .otherwise("sem data")
    )
    number = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).otherwise("n/d")
    iso = iso_from_text(F.col("texto"))
    return T.read(spark, sf, "orders").select(k.alias("k"), text.alias("texto"), number.alias("numero")).select(
        "k", iso.alias("iso"), parse_date(iso).alias("dia"),
        num_or_zero(F.col("numero")).alias("valor"), num_or_null(F.col("numero"), "decimal(18,2)").alias("valor_ou_nulo"),
    )


def region_lookup(spark, sf):
    return T.works(spark, sf).select("operacao", "uf", region_of(F.concat(F.lit(" "), F.lower("uf"))).alias("regiao"))


OLD_NAMES = {
    "num_convenio": "num_convenio", "cod_tci_tci": "cod_tci", "txt_uf_tci": "uf", "vlr_repasse": "vlr_repasse",
    "fase_atual": "fase_atual", "observacao": "modalidade", "cod_saci": "situacao",
}


def canonical_names(spark, sf):
    old = naming.rename(T.panel(spark, sf), {v: n for n, v in OLD_NAMES.items()})
    return naming.canonicalize(old)


def panel_rows(spark, sf):
    rows = panel.panel_rows(T.snapshot(spark, sf, 3), CFG)
    return rows.select(
        "cod_tci", "num_convenio", "uf", "situacao", "dt_assinatura", "dt_lae_mais_60", "dt_lae_mais_60_mais_120",
        "vlr_repasse", "dias_ate_publicacao", "pos_72", "ano", "docs_suspensiva_qtd",
    )


def queries() -> dict[str, Query]:
    named = [
        flagship, base_filter, weekday_count, doc_type, pending_docs, situation_flags, display_status,
        pending_by_month, progress_band, work_flags, due_by_cutoff, tolerant_join,
        tolerant_join_empty, tolerant_join_null_keys, infer_types, plain_join, enrich, enrich_split, doc_union,
        first_match, membership_flag, doc_kpis, freshness, match_snapshots, key_diff, row_labels, key_check,
        restrict_previous, first_events, breakdown, domain_order, group_totals, kpi, kpi_delta, tender_kpis,
        works_kpis, tender_flow, suspension_cascade, doc_pending_counts, geo_breakdown, diff_history, daily_log, bucketed_diff, bucketed_match, change_view,
        digest_diff, validity_runs, base_as_of, factored_keys, factored_totals, factored_rows,
        change_kpis, change_events, diff_detail, status_counters, diff_summary, diff_report, first_run_summary, legacy_diff,
        legacy_change_view, legacy_change_kpis, legacy_summary, works_overview, execution_kpis, stoppage_kpis,
        column_profile, width_profile, snapshot_date, facets, sanitize, text_search, indexed_search, indexed_search_updated, cross_filter, geo_filter,
        cascade_filter, tender_filter, final_filter, table_page, deep_page, next_page, scoped_rows, filter_options, topk_other, group_topk,
        reason_topk, clean_text, parse_values, region_lookup, canonical_names, panel_rows,
    ]
    out = {f.__name__: f for f in named}
    out.update({name: _rule(columns) for name, columns in RULE_COLUMNS.items()})
    return out
