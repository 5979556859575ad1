"""Indicators, breakdowns and profiles.

Where a report has a fixed list of lines, all of them are conditional counters of one
aggregate over one scan, turned into rows afterwards; nothing but the counters is shuffled.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milemark import config as C
from milemark.functions import rules as R
from milemark.functions.calendar import month_key, month_label, month_urgency
from milemark.functions.text import MONEY, br_date, label_or, norm, parse_date, squish
from milemark.operators import joins
from milemark.plans.selection import suspension_match, tender_match


def _money_sum(c: Column) -> Column:
    return F.coalesce(F.sum(c).cast(MONEY), F.lit(0).cast(MONEY))


def _rows(df: DataFrame, *structs: Column) -> DataFrame:
    return df.select(F.inline(F.array(*structs)))


def first_events(lic: DataFrame) -> DataFrame:
    """Earliest publication and homologation per contract number as written."""
    return lic.groupBy("num_convenio").agg(
        F.min("dte_publicacao_licitacao").alias("dte_publicacao_licitacao"),
        F.min("dte_homologacao_licitacao").alias("dte_homologacao_licitacao"),
    )


# --- breakdowns ---------------------------------------------------------------


def breakdown(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows per listed value, in list order; unlisted and empty groups are left out."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column)).cast("int")
    return (
        df.where(F.col(column).isin(list(order)))
        .groupBy(column)
        .agg(F.count("*").alias("qtd"))
        .select(position.alias("pos"), F.col(column).alias("valor"), "qtd")
    )


def group_totals(df: DataFrame, column: str, value: str = "vlr_repasse") -> DataFrame:
    """Rows and value per non-blank group; ``largest_first`` orders it."""
    return (
        df.where(F.col(column).isNotNull() & (F.col(column) != ""))
        .groupBy(F.col(column).alias("grupo"))
        .agg(F.count("*").alias("contratos"), _money_sum(F.col(value)).alias("vlr_repasse"))
    )


def largest_first(totals: DataFrame) -> DataFrame:
    return totals.orderBy(F.desc("contratos"), F.desc("vlr_repasse"), "grupo")


def geo_breakdown(df: DataFrame, level: str) -> DataFrame:
    """Rows per place label, blanks under their own label."""
    return df.groupBy(label_or(F.col(level)).alias("label")).agg(F.count("*").alias("qtd"))


def doc_pending_counts(df: DataFrame) -> DataFrame:
    """Contracts per pending document, none-pending documents left out."""
    labels = list(C.DOC_LABELS.values())
    pending = F.col("docs_suspensiva_pendentes")
    counts = df.agg(*[F.count_if(F.array_contains(pending, v)).alias(f"d{i}") for i, v in enumerate(labels)])
    lines = [F.struct(F.lit(v).alias("doc"), F.col(f"d{i}").alias("qtd")) for i, v in enumerate(labels)]
    return _rows(counts, *lines).where(F.col("qtd") > 0)


def month_calendar(df: DataFrame, as_of: dt.date, months: Sequence[str] = ()) -> DataFrame:
    """Pending suspensions per due month, with value; a month list keeps only those months."""
    due = F.col("dt_vencimento_suspensiva")
    grouped = df.groupBy(
        month_key(due).alias("chave"), month_label(due).alias("rotulo"), month_urgency(due, as_of).alias("urgencia")
    ).agg(F.count("*").alias("qtd"), _money_sum(F.col("vlr_repasse")).alias("vlr"))
    return grouped.where(F.col("rotulo").isin(list(months))) if months else grouped


# --- indicators ---------------------------------------------------------------


def kpi(df: DataFrame, indicators: Mapping[str, Column]) -> DataFrame:
    """Count, value and share of all rows for each predicate."""
    vlr = F.col("vlr_repasse")
    aggs = [F.count("*").alias("n")]
    for i, pred in enumerate(indicators.values()):
        aggs += [F.count_if(pred).alias(f"q{i}"), _money_sum(F.when(pred, vlr)).alias(f"v{i}")]
    share = lambda q: F.coalesce(F.try_divide(F.col(q), F.col("n")), F.lit(0.0))
    lines = [
        F.struct(
            F.lit(name).alias("indicador"), F.col(f"q{i}").alias("qtd"), F.col(f"v{i}").alias("vlr"),
            share(f"q{i}").alias("pct"),
        )
        for i, name in enumerate(indicators)
    ]
    return _rows(df.agg(*aggs), *lines)


def kpi_delta(current: DataFrame, previous: DataFrame | None, indicators: Mapping[str, Column]) -> DataFrame:
    """``kpi`` counts and values next to the count of the previous snapshot.

    Both snapshots go through one aggregate. Without a previous snapshot the change is null
    and its tone neutral.
    """
    names = list(indicators)

    def flags(df: DataFrame, is_current: bool) -> DataFrame:
        return df.select(
            F.lit(is_current).alias("cur"),
            F.col("vlr_repasse").alias("vlr"),
            *[F.coalesce(p, F.lit(False)).alias(f"p{i}") for i, p in enumerate(indicators.values())],
        )

    both = flags(current, True)
    if previous is not None:
        both = both.unionByName(flags(previous, False))
    aggs = []
    for i in range(len(names)):
        hit, cur = F.col(f"p{i}"), F.col("cur")
        aggs += [
            F.count_if(hit & cur).alias(f"q{i}"),
            _money_sum(F.when(hit & cur, F.col("vlr"))).alias(f"v{i}"),
            F.count_if(hit & ~cur).alias(f"b{i}"),
        ]
    known = F.lit(previous is not None)
    lines = [
        F.struct(
            F.lit(n).alias("indicador"), F.col(f"q{i}").alias("qtd"), F.col(f"v{i}").alias("vlr"),
            F.when(known, F.col(f"b{i}")).alias("anterior"),
            F.when(known, F.col(f"q{i}") - F.col(f"b{i}")).alias("delta"),
        )
        for i, n in enumerate(names)
    ]
    tone = F.when(F.col("delta") > 0, "positive").when(F.col("delta") < 0, "negative").otherwise("neutral")
    return _rows(both.agg(*aggs), *lines).withColumn("tom", tone)


def overview_indicators() -> dict[str, Column]:
    sit, analysis = F.col("situacao"), F.col("situacao_suspensiva")
    return {
        "Total selecionadas": F.lit(True),
        "Com suspensiva": R.active_suspension(sit, analysis),
        "Sem suspensiva": R.no_suspension(sit, analysis),
        "Contratos inativos": R.is_inactive(sit),
    }


def _pub_display(cfg: C.Settings) -> Column:
    return R.display_status(F.col("dt_pub_licitacao"), F.col("dt_assinatura"), F.col("status_pub_licitacao"), cfg.exempt_before)


def _hom_display(cfg: C.Settings) -> Column:
    return R.display_status(F.col("dt_homolog_licitacao"), F.col("dt_assinatura"), F.col("status_homolog_licitacao"), cfg.exempt_before)


def tender_indicators(cfg: C.Settings) -> dict[str, Column]:
    waiting = F.col("dt_pub_licitacao").isNull()
    open_hom = ~waiting & F.col("dt_homolog_licitacao").isNull()
    pub, hom = _pub_display(cfg), _hom_display(cfg)
    by_cutoff = R.due_by_cutoff(F.col("prazo_homolog_licitacao"), F.col("data_limite_licitacao_casa_civil"))
    return {
        "Contratado - Normal": F.lit(True),
        "Aguardando publicação": waiting,
        "Sem prazo (PC 72)": waiting & (pub == "Sem prazo (PC 72)"),
        "Publicação vencida": waiting & (pub == "Vencida"),
        "Publicação nos próximos 30 dias": waiting & (pub == "Próximos 30 dias"),
        "Homologação vencida": open_hom & (hom == "Vencida"),
        "Homologação nos próximos 30 dias": open_hom & (hom == "Próximos 30 dias"),
        "Homologação até a data limite": open_hom & by_cutoff,
    }


def tender_kpis(current: DataFrame, previous: DataFrame | None, sel: C.Selection, cfg: C.Settings) -> DataFrame:
    """Tender indicators among contracts under way that match the tender selection."""
    scope = R.is_normal(F.col("situacao")) & tender_match(sel, cfg)
    before = None if previous is None else previous.where(scope)
    return kpi_delta(current.where(scope), before, tender_indicators(cfg))


def works_kpis(current: DataFrame, previous: DataFrame | None, sel: C.Selection) -> DataFrame:
    """Works-start indicators among contracts with an authorisation that are not cancelled."""
    status = F.col("status_inicio_obra")
    scope = F.col("dt_aio").isNotNull() & ~R.cancelled(F.col("situacao"))
    if sel.inicio_obra is not None:
        scope = scope & (status == sel.inicio_obra)
    indicators = {"Com AIO": F.lit(True)} | {s: status.eqNullSafe(s) for s in C.INICIO_OBRA_ORDER}
    before = None if previous is None else previous.where(scope)
    return kpi_delta(current.where(scope), before, indicators)


def _levels(df: DataFrame, levels: Mapping[str, tuple[Column, Mapping[str, Column]]]) -> DataFrame:
    """Counts of labelled predicates within the rows of each level, with their share in percent."""
    aggs, lines = [], []
    for li, (level, (scope, labels)) in enumerate(levels.items()):
        aggs.append(F.count_if(scope).alias(f"t{li}"))
        for i, (label, pred) in enumerate(labels.items()):
            aggs.append(F.count_if(scope & pred).alias(f"q{li}_{i}"))
            lines.append(
                F.struct(
                    F.lit(level).alias("nivel"), F.lit(i + 1).alias("pos"), F.lit(label).alias("rotulo"),
                    F.col(f"q{li}_{i}").alias("qtd"), F.col(f"t{li}").alias("total"),
                )
            )
    return (
        _rows(df.agg(*aggs), *lines)
        .where(F.col("qtd") > 0)
        .withColumn("pct", F.col("qtd") / F.col("total") * 100)
    )


def tender_flow(df: DataFrame, sel: C.Selection, cfg: C.Settings) -> DataFrame:
    """Publication stage, its urgency, homologation stage, its urgency."""
    waiting, published = F.col("dt_pub_licitacao").isNull(), F.col("dt_pub_licitacao").isNotNull()
    open_hom = F.col("dt_homolog_licitacao").isNull()
    scope = df.where(R.is_normal(F.col("situacao")) & tender_match(sel, cfg))
    return _levels(
        scope,
        {
            "publicacao": (F.lit(True), {"Aguardando publicação": waiting, "Publicada": published}),
            "prazo_publicacao": (waiting, {s: _pub_display(cfg) == s for s in C.PRAZO_ORDER}),
            "homologacao": (published, {"Homologação pendente": open_hom, "Homologada": ~open_hom}),
            "prazo_homologacao": (published & open_hom, {s: _hom_display(cfg) == s for s in C.PRAZO_ORDER}),
        },
    )


def suspension_cascade(df: DataFrame, sel: C.Selection) -> DataFrame:
    """Suspended contracts by analysis, then the pending ones by urgency; the alert counts follow."""
    analysis, urgency = F.col("situacao_suspensiva"), F.col("urgencia_suspensiva")
    ret = F.col("dt_retirada_suspensiva")
    chart = _levels(
        df.where(suspension_match(sel, with_months=False)),
        {
            "analise": (F.lit(True), {s: analysis == s for s in C.SUSPENSIVA_ORDER}),
            "urgencia": (R.is_pending(ret, analysis), {s: urgency == s for s in C.URGENCIA_ORDER}),
        },
    )
    # The alert looks at the withdrawal date only and ignores the chart's own selection.
    alert = _levels(
        df.where(F.col("situacao") == C.COM_SUSPENSIVA),
        {"alerta": (ret.isNull(), {s: urgency == s for s in C.URGENCIA_ORDER[:2]})},
    )
    return chart.unionByName(alert)


def doc_kpis(docs: DataFrame) -> DataFrame:
    tipo = F.col("tipo_doc_suspensiva")
    return docs.agg(
        F.count("*").alias("instrumentos"),
        F.count_if(tipo == C.DOC_APRESENTADOS).alias("apresentados"),
        F.count_if(tipo == C.DOC_NAO_APRESENTADOS).alias("nao_apresentados"),
        F.count_if(F.col("consta_base_pc32") == "SIM").alias("constam_na_base"),
    )


# --- legacy works -------------------------------------------------------------


def works_overview(df: DataFrame) -> DataFrame:
    flags = R.work_flags(F.col("situacao_obra"))
    return kpi(
        df,
        {
            "Obras selecionadas": F.lit(True), "Concluídas": flags["concluida"],
            "Em andamento": flags["andamento"], "Paralisadas": flags["paralisada"],
        },
    )


def execution_kpis(df: DataFrame) -> DataFrame:
    pct = F.col("pct_fisico")
    money = ["vlr_repasse", "vlr_desembolsado", "vlr_contrapartida"]
    base = df.agg(
        F.count("*").alias("obras"),
        F.count(pct).alias("com_dado_fisico"),
        F.coalesce(F.avg(pct) / 100, F.lit(0.0)).alias("pct_fisico_medio"),
        *[_money_sum(F.col(m)).alias(m) for m in money],
    )
    spent = F.col("vlr_desembolsado").cast("double") / F.col("vlr_repasse").cast("double")
    return base.withColumn("pct_desembolsado", F.when(F.col("vlr_repasse") > 0, spent).otherwise(0.0))


def stoppage_kpis(df: DataFrame) -> DataFrame:
    days = F.col("dias_sem_bm")
    return df.where(R.work_flags(F.col("situacao_obra"))["paralisada"]).agg(
        F.count("*").alias("paralisadas"),
        _money_sum(F.col("vlr_repasse")).alias("vlr_repasse"),
        F.count(days).alias("com_dias"),
        F.floor(F.avg(days) + 0.5).cast("bigint").alias("dias_medio_sem_bm"),
        F.count_if(norm(F.col("plano_acao")) != "").alias("com_plano"),
        F.count_if(F.col("previsao_retomada").isNotNull()).alias("com_previsao"),
    )


def progress_counts(df: DataFrame) -> DataFrame:
    banded = df.withColumn("faixa_fisica", R.progress_band(F.col("pct_fisico")))
    return breakdown(banded, "faixa_fisica", C.FAIXA_FISICA_ORDER)


# --- change log ---------------------------------------------------------------


def change_kpis(view: DataFrame) -> DataFrame:
    """Headline of the change page, from the displayed log: counts per record first, then over the records."""
    record = F.when(F.col("num_convenio") != "—", F.col("num_convenio")).otherwise(F.col("cod_tci"))
    altered = F.col("tipo") == "Alterado"
    nature = F.col("natureza_raw")
    counts = {
        "campos_alterados": F.count("*"),
        "mudancas_de_dado": F.count_if(altered & (nature == "dados_origem")),
        "mudancas_derivadas": F.count_if(altered & (nature == "derivado_regra")),
        "mudancas_automaticas": F.count_if(altered & (nature == "derivado_tempo")),
    }
    per_record = view.groupBy(record.alias("_r")).agg(
        *[c.alias(n) for n, c in counts.items()], F.max(F.col("tipo") == "Novo").alias("_novo")
    )
    known = F.col("_r").isNotNull()
    return per_record.agg(
        F.count("_r").alias("empreendimentos"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts],
        F.count_if(known & F.col("_novo")).alias("contratos_novos"),
    )


def change_events(view: DataFrame) -> DataFrame:
    """Distinct (day, record, type) events."""
    record = F.when(F.col("num_convenio") != "—", F.col("num_convenio")).otherwise(F.col("cod_tci"))
    day = F.coalesce(F.col("data").cast("string"), F.lit("sem-data"))
    return view.select(day.alias("dia"), record.alias("registro"), "tipo").distinct()


def legacy_change_kpis(view: DataFrame) -> DataFrame:
    tipo, known = F.col("tipo"), F.col("operacao").isNotNull()
    per_work = view.groupBy("operacao").agg(
        F.count_if(tipo == "Alterado").alias("n"), F.max(tipo == "Novo").alias("nova"), F.max(tipo == "Removido").alias("removida")
    )
    return per_work.agg(
        F.count("operacao").alias("obras"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("campos_alterados"),
        F.count_if(known & F.col("nova")).alias("obras_novas"),
        F.count_if(known & F.col("removida")).alias("obras_removidas"),
    )


def status_counters(detail: DataFrame, fields: Sequence[str] = tuple(C.STATUS_FIELDS)) -> DataFrame:
    """Changes per status field, zeros kept."""
    altered = F.col("tipo_alteracao") == "alterado"
    counts = detail.agg(*[F.count_if(altered & (F.col("campo") == f)).alias(f) for f in fields])
    lines = [
        F.struct(F.lit(i + 1).alias("pos"), F.lit(f).alias("campo"), F.col(f).alias("mudancas"))
        for i, f in enumerate(fields)
    ]
    return _rows(counts, *lines)


# --- freshness and dates ------------------------------------------------------

# The five freshness lines.
FRESHNESS = {
    "tci_mcid": ("SACI/ Ministério das Cidades", "TCI/MCID", "max(dte_carga)"),
    "transferegov": (
        "Transferegov",
        "TGOV",
        "greatest(max(tab_convenios.dte_carga), max(tab_licitacao.dte_carga))",
    ),
    "bdgestores": ("BDGestores", "TDB", "max(dte_posicao)"),
    "power_bi_caixa": ("Power BI Caixa", "PBI", "max(data_atualizacao)"),
}
DMP_NOTE = "Fallback: nenhuma tabela/coluna de carga dedicada da DMP foi identificada no pipeline atual."


def freshness(sources: Mapping[str, DataFrame], snapshot: str, cfg: C.Settings) -> DataFrame:
    """Latest load date of each source among the monitored contracts, one row per source."""
    saci = sources["saci"].where(
        R.base_filter(F.col("txt_fonte"), F.col("dsc_fase_pac"), F.col("txt_sigla_secretaria"), cfg)
    )
    keys = joins.distinct_keys(saci, "num_convenio")

    def latest(name: str, key: str, stamp: str, tolerant: bool = True) -> DataFrame:
        # One row per key before the match: only the latest load of a key can count.
        per_key = sources[name].groupBy(key).agg(F.max(stamp).alias("t"))
        return joins.restrict_to(per_key, key, keys, "num_convenio", tolerant).select("t")

    stamps = {
        "tci_mcid": saci.select(F.col("dte_carga").alias("t")),
        "transferegov": latest("tcon", "num_convenio", "dte_carga").unionByName(
            latest("licitacao", "num_convenio", "dte_carga")
        ),
        "bdgestores": latest("tdb", "cod_convenio_siafi", "dte_posicao", tolerant=False),
        "power_bi_caixa": latest("pbi", "instrumento", "data_atualizacao"),
    }
    rows = []
    for key, frame in stamps.items():
        label, sigla, method = FRESHNESS[key]
        rows.append(
            frame.agg(F.max("t").cast("date").cast("string").alias("updated_at")).select(
                F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(sigla).alias("sigla"), "updated_at",
                F.lit(method).alias("method"), F.lit(False).alias("fallback"), F.lit(None).cast("string").alias("note"),
            )
        )
    constant = rows[0].select(
        F.lit("dmp").alias("key"), F.lit("Diretoria de Monitoramento de Projetos").alias("label"),
        F.lit("DMP").alias("sigla"), F.lit(snapshot).alias("updated_at"), F.lit("snapshot_atual").alias("method"),
        F.lit(True).alias("fallback"), F.lit(DMP_NOTE).alias("note"),
    )
    return reduce(DataFrame.unionByName, [*rows, constant])


def restamp(freshness_rows: DataFrame, snapshot: str) -> DataFrame:
    """Freshness rows all carrying the snapshot date."""
    return freshness_rows.withColumn("updated_at", F.lit(snapshot))


def snapshot_date(df: DataFrame, column: str, today: dt.date) -> DataFrame:
    """Latest non-blank date text of a load, else today."""
    latest = F.max(F.nullif(F.col(column).cast("string"), F.lit("")))
    return df.agg(F.coalesce(latest, F.lit(today.isoformat())).alias("snapshot_date"))


def reference_date(summary: DataFrame) -> DataFrame:
    """Displayed date: the current snapshot, else the later of the known ones."""
    day = lambda c: parse_date(F.col(c))
    known = F.greatest(day("snapshot_anterior"), day("snapshot_primeiro"))
    return summary.select(br_date(F.coalesce(day("snapshot_atual"), known)).alias("atualizado_em"))


# --- profiles -----------------------------------------------------------------

SELECT_LIMIT, SELECT_LENGTH = 30, 24


def column_profile(df: DataFrame, columns: Sequence[str], forced: Sequence[str] = ()) -> DataFrame:
    """Filter type of each column: select for 2 to 30 short values (or when forced), else text.

    A value longer than a select may hold takes its column out, so only shorter ones are counted. A column with a
    longer value reports no count.
    """
    text = df.select(*[F.nullif(squish(F.col(c)), F.lit("")).alias(c) for c in columns])
    sizes = text.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)).alias(f"l{i}") for i, c in enumerate(columns)])
    stats = sizes.select(
        F.array(*[F.col(f"l{i}") for i in range(len(columns))]).alias("l"),
        F.array(*[F.col(f"l{i}") <= SELECT_LENGTH for i in range(len(columns))]).alias("ok"),
    )
    short = lambda c: F.when(F.length(c) <= SELECT_LENGTH, F.col(c))
    cells = [F.struct(F.lit(i).alias("i"), short(c).alias("v")) for i, c in enumerate(columns)]
    distinct = text.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull()).distinct()
    counts = distinct.groupBy("i").agg(F.count("*").alias("n"))
    lines = [
        F.struct(
            F.lit(i).alias("i"), F.lit(c).alias("coluna"), F.get("l", F.lit(i)).alias("max_len"),
            F.get("ok", F.lit(i)).alias("ok"), F.lit(c in forced).alias("forced"),
        )
        for i, c in enumerate(columns)
    ]
    n = F.when(F.col("ok"), F.coalesce(F.col("n"), F.lit(0)))
    short_list = F.coalesce(n.between(2, SELECT_LIMIT), F.lit(False))
    return (
        _rows(stats, *lines)
        .join(counts, "i", "left")
        .select(
            "coluna",
            F.when(n <= SELECT_LIMIT, n).alias("valores"),
            "max_len",
            F.when(F.col("forced") | short_list, "select").otherwise("text").alias("filtro"),
        )
    )


def width_profile(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Column widths: fixed for dates and numbers, else from the 90th percentile of text lengths."""
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name in headers}
    texts = [c for c in headers if isinstance(kinds[c], T.StringType)]
    cells = [F.struct(F.lit(c).alias("coluna"), F.length(F.nullif(F.col(c), F.lit(""))).alias("n")) for c in texts]
    # A histogram of lengths is small whatever the row count, so the exact rank is cheap.
    hist = df.select(F.inline(F.array(*cells))).where(F.col("n").isNotNull()).groupBy("coluna", "n").agg(F.count("*").alias("q"))
    running = Window.partitionBy("coluna").orderBy("n")
    total = F.sum("q").over(Window.partitionBy("coluna"))
    rank = F.least(total - 1, F.floor(total * F.lit(0.9).cast("decimal(2,1)")))
    p90 = (
        hist.select("coluna", "n", F.sum("q").over(running).alias("upto"), rank.alias("rank"))
        .where(F.col("upto") > F.col("rank"))
        .groupBy("coluna")
        .agg(F.min("n").alias("p90"))
    )
    fixed = {c: 12 if isinstance(kinds[c], (T.DateType, T.TimestampType)) else 14 for c in headers if c not in texts}
    lines = [
        F.struct(F.lit(c).alias("coluna"), F.lit(len(h)).alias("titulo"), F.lit(fixed.get(c)).cast("int").alias("fixa"))
        for c, h in headers.items()
    ]
    listed = _rows(df.sparkSession.range(1), *lines)
    wanted = F.greatest("titulo", F.coalesce("p90", F.lit(0))) + 2
    width = F.coalesce("fixa", F.least(F.greatest(wanted, F.lit(8)), F.lit(24)))
    return listed.join(p90, "coluna", "left").select("coluna", "p90", width.alias("largura"))
