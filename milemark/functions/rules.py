"""Contract rules as column expressions; the order of the tests is part of each rule."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions.calendar import nth_weekday_after, weekdays_between
from milemark.functions.text import blank_to_null


def base_filter(fonte: Column, fase: Column, secretaria: Column, cfg: C.Settings) -> Column:
    return (fonte == cfg.fonte) & (fase == cfg.fase) & (secretaria != cfg.secretaria_excluida)


def suspension_status(venc: Column, ret: Column) -> Column:
    return (
        F.when(ret.isNotNull(), "RETIRADA").when(venc.isNotNull(), "PENDENTE").otherwise("SEM SUSPENSIVA")
    )


def presence_flag(c: Column) -> Column:
    return F.when(c.isNotNull(), "SIM").otherwise("NAO")


def latest_milestone(*dates: Column) -> Column:
    return F.greatest(*dates)


def phase(inicio: Column, aio: Column, vrpl: Column, hom: Column, pub: Column, lae: Column, ret: Column, venc: Column) -> Column:
    """The furthest milestone reached."""
    steps = [
        (inicio, "OBRA INICIADA"),
        (aio, "AIO"),
        (vrpl, "VRPL"),
        (hom, "HOMOLOGACAO"),
        (pub, "PUBLICACAO LICITACAO"),
        (lae, "LAE"),
        (ret, "SUSPENSIVA RETIRADA"),
        (venc, "SUSPENSIVA"),
    ]
    return F.coalesce(*[F.when(d.isNotNull(), F.lit(name)) for d, name in steps], F.lit("SEM ANDAMENTO"))


def value_band(vlr: Column, bands: Sequence[tuple[int | None, str]] = C.Settings.value_bands) -> Column:
    """A missing value falls in the last band."""
    *limited, (_, last) = bands
    return F.coalesce(*[F.when(vlr < below, name) for below, name in limited], F.lit(last))


def exempt(assin: Column, exempt_before: dt.date) -> Column:
    """Signed before the rule took effect; an unsigned contract is not exempt."""
    return F.coalesce(assin < F.lit(exempt_before), F.lit(False))


def cancelled(sit: Column) -> Column:
    return sit.eqNullSafe(C.CANCELADO)


def publication_deadline(lae: Column, assin: Column, cfg: C.Settings) -> Column:
    return F.when(~exempt(assin, cfg.exempt_before), F.date_add(lae, cfg.publication_days))


def lae_plus(lae: Column, days: int) -> Column:
    return F.date_add(lae, days)


def homologation_window(pub: Column, assin: Column, cfg: C.Settings) -> Column:
    return F.when(~exempt(assin, cfg.exempt_before), F.date_add(pub, cfg.homologation_days))


def homologation_deadline(window: Column, cfg: C.Settings) -> Column:
    """Never before the fixed cutoff and never null."""
    return F.greatest(window, F.lit(cfg.fixed_cutoff))


def cutoff_status(sit: Column, pub: Column, hom: Column, inicio: Column, cutoff: dt.date) -> Column:
    in_time = (pub <= F.lit(cutoff)) & (hom <= F.lit(cutoff)) & (inicio <= F.lit(cutoff))
    return F.when(cancelled(sit), "Fora do escopo").when(in_time, "Cumpriu o prazo").otherwise("Pendente")


def _deadline_status(done: Column, deadline: Column, cfg: C.Settings) -> Column:
    left = F.datediff(deadline, F.lit(cfg.as_of))
    return (
        F.when(done <= deadline, "Concluída no prazo")
        .when(done.isNotNull(), "Concluída em atraso")
        .when(left < 0, "Vencida")
        .when(left <= cfg.near_days, "Próximos 30 dias")
        .otherwise("No prazo")
    )


def publication_status(assin: Column, lae: Column, sit: Column, pub: Column, deadline: Column, cfg: C.Settings) -> Column:
    not_due = exempt(assin, cfg.exempt_before) | lae.isNull() | cancelled(sit)
    return F.when(~not_due, _deadline_status(pub, deadline, cfg))


def homologation_status(assin: Column, sit: Column, pub: Column, hom: Column, deadline: Column, cfg: C.Settings) -> Column:
    """A homologation without publication is reported even when the contract is cancelled."""
    inconsistent = hom.isNotNull() & pub.isNull()
    not_due = pub.isNull() | cancelled(sit)
    return F.when(
        ~exempt(assin, cfg.exempt_before),
        F.when(inconsistent, "Inconsistência de base").when(~not_due, _deadline_status(hom, deadline, cfg)),
    )


def works_start_deadline(aio: Column, cfg: C.Settings) -> Column:
    return nth_weekday_after(aio, cfg.start_weekdays)


def works_start_status(aio: Column, sit: Column, inicio: Column, deadline: Column, cfg: C.Settings) -> Column:
    as_of = F.lit(cfg.as_of)
    status = (
        F.when(inicio <= deadline, "Iniciada no prazo")
        .when(inicio.isNotNull(), "Iniciada em atraso")
        .when(deadline < as_of, "Prazo vencido")
        .when(weekdays_between(as_of, deadline) <= cfg.start_weekdays, "Próximos 10 dias úteis")
        .otherwise("No prazo")
    )
    return F.when(aio.isNotNull() & ~cancelled(sit), status)


def suspension_urgency(ret: Column, sit: Column, venc: Column, cfg: C.Settings) -> Column:
    left = F.datediff(venc, F.lit(cfg.as_of))
    level = (
        F.when(venc.isNull(), "Sem data")
        .when(left < 0, "Vencida")
        .when(left <= cfg.near_days, "Próximos 30 dias")
        .when(left <= cfg.middle_days, "31–90 dias")
        .otherwise("Mais de 90 dias")
    )
    return F.when(ret.isNull() & ~cancelled(sit), level)


def withdrawn_reason(sit: Column, analysis: Column, aio: Column, inicio: Column) -> Column:
    """Name of the first field that shows the suspension was lifted."""
    return (
        F.when(sit.isin(C.INATIVAS), "Não se aplica")
        .when(analysis == C.SUSPENSIVA_RETIRADA, "situacao_da_analise_suspensiva_pbi")
        .when(aio.isNotNull(), "dte_aio_tdb")
        .when(inicio.isNotNull(), "dte_inicio_obra_mcid_saci")
    )


def doc_type(in_presented: Column, in_missing: Column) -> Column:
    return F.when(in_presented, C.DOC_APRESENTADOS).when(in_missing, C.DOC_NAO_APRESENTADOS)


def era(assin: Column, cutoff: dt.date) -> Column:
    return F.when(assin >= F.lit(cutoff), "Nova PC 32").when(assin.isNotNull(), "Antiga PC 32")


def signature_year(d: Column) -> Column:
    return F.year(d).cast("string")


def pending_docs(tipo: Column, docs: dict[str, Column]) -> Column:
    """Labels of the pending documents, in the fixed document order."""
    marker = F.when(tipo == C.DOC_APRESENTADOS, C.DOC_PENDENTE[C.DOC_APRESENTADOS]).when(
        tipo == C.DOC_NAO_APRESENTADOS, C.DOC_PENDENTE[C.DOC_NAO_APRESENTADOS]
    )
    return F.array_compact(F.array(*[F.when(docs[k] == marker, F.lit(label)) for k, label in C.DOC_LABELS.items()]))


def is_withdrawn(analysis: Column) -> Column:
    return analysis.eqNullSafe(C.SUSPENSIVA_RETIRADA)


def active_suspension(sit: Column, analysis: Column) -> Column:
    return sit.eqNullSafe(C.COM_SUSPENSIVA) & ~is_withdrawn(analysis)


def no_suspension(sit: Column, analysis: Column) -> Column:
    return sit.eqNullSafe(C.NORMAL) | is_withdrawn(analysis)


def is_normal(sit: Column) -> Column:
    return sit.eqNullSafe(C.NORMAL)


def is_inactive(sit: Column) -> Column:
    return F.coalesce(sit.isin(C.INATIVAS), F.lit(False))


def display_status(done: Column, assin: Column, status: Column, exempt_before: dt.date) -> Column:
    return (
        F.when(done.isNull() & exempt(assin, exempt_before), "Sem prazo (PC 72)")
        .when(done.isNull() & blank_to_null(status).isNull(), "Sem prazo calculado")
        .otherwise(F.coalesce(status, F.lit("")))
    )


def is_pending(ret: Column, analysis: Column) -> Column:
    return ret.isNull() & ~is_withdrawn(analysis)


def due_by_cutoff(deadline: Column, cutoff: Column) -> Column:
    return F.coalesce(deadline <= cutoff, F.lit(False))


def progress_band(pct: Column) -> Column:
    return (
        F.when(pct.isNull(), "Sem dado")
        .when(pct <= 0, "0%")
        .when(pct < 26, "1–25%")
        .when(pct < 51, "26–50%")
        .when(pct < 76, "51–75%")
        .when(pct < 100, "76–99%")
        .otherwise("100%")
    )


def work_flags(situacao_obra: Column) -> dict[str, Column]:
    return {
        "paralisada": situacao_obra.eqNullSafe("Obra Paralisada"),
        "concluida": situacao_obra.eqNullSafe("Obra concluída"),
        "andamento": situacao_obra.eqNullSafe("Obra em andamento"),
    }


# Rules that look at the suspension's analysis or due date; the others do without the source of these.
SUSPENSION_RULES = ["status_suspensiva", "fase_atual", "urgencia_suspensiva", "motivo_suspensiva_retirada_dmp"]


def with_contract_rules(df: DataFrame, cfg: C.Settings) -> DataFrame:
    """Adds every derived contract column to a frame that has the milestone columns."""
    return _with_deadlines(df, cfg).withColumns(_statuses(cfg))


def with_milestone_rules(df: DataFrame, cfg: C.Settings) -> DataFrame:
    """``with_contract_rules`` but for the ``SUSPENSION_RULES``, whose columns ``df`` need not have."""
    return _with_deadlines(df, cfg).withColumns({n: rule for n, rule in _statuses(cfg).items() if n not in SUSPENSION_RULES})


def with_suspension_rules(df: DataFrame, cfg: C.Settings) -> DataFrame:
    """What ``with_milestone_rules`` has left out."""
    return df.withColumns({n: rule for n, rule in _statuses(cfg).items() if n in SUSPENSION_RULES})


def _with_deadlines(df: DataFrame, cfg: C.Settings) -> DataFrame:
    c = F.col
    assin, lae, pub = c("dt_assinatura"), c("dt_lae"), c("dt_pub_licitacao")
    return df.withColumns(
        {
            "prazo_pub_licitacao": publication_deadline(lae, assin, cfg),
            "dt_lae_mais_60": lae_plus(lae, cfg.projections[0]),
            "dt_lae_mais_60_mais_120": lae_plus(lae, cfg.projections[1]),
            "prazo_homolog_120d": homologation_window(pub, assin, cfg),
            "prazo_inicio_obra": works_start_deadline(c("dt_aio"), cfg),
            "data_limite_licitacao_casa_civil": F.lit(cfg.fixed_cutoff),
        }
    ).withColumn("prazo_homolog_licitacao", homologation_deadline(c("prazo_homolog_120d"), cfg))


def _statuses(cfg: C.Settings) -> dict[str, Column]:
    c = F.col
    assin, venc, ret = c("dt_assinatura"), c("dt_vencimento_suspensiva"), c("dt_retirada_suspensiva")
    lae, pub, hom = c("dt_lae"), c("dt_pub_licitacao"), c("dt_homolog_licitacao")
    vrpl, aio, inicio = c("dt_vrpl"), c("dt_aio"), c("dt_inicio_obra")
    sit, analysis = c("situacao"), c("situacao_suspensiva")
    return {
        "status_suspensiva": suspension_status(venc, ret),
        "flag_publicacao_licitacao": presence_flag(pub),
        "flag_homologacao_licitacao": presence_flag(hom),
        "ultima_data_relevante": latest_milestone(inicio, aio, vrpl, hom, pub, lae),
        "fase_atual": phase(inicio, aio, vrpl, hom, pub, lae, ret, venc),
        "dias_ate_publicacao": F.datediff(pub, lae),
        "dias_publicacao_ate_homologacao": F.datediff(hom, pub),
        "dias_homologacao_ate_vrpl": F.datediff(vrpl, hom),
        "dias_vrpl_ate_aio": F.datediff(aio, vrpl),
        "dias_aio_ate_inicio_obra": F.datediff(inicio, aio),
        "faixa_repasse": value_band(c("vlr_repasse"), cfg.value_bands),
        "status_regra_casa_civil": cutoff_status(sit, pub, hom, inicio, cfg.fixed_cutoff),
        "status_pub_licitacao": publication_status(assin, lae, sit, pub, c("prazo_pub_licitacao"), cfg),
        "status_homolog_licitacao": homologation_status(assin, sit, pub, hom, c("prazo_homolog_licitacao"), cfg),
        "status_inicio_obra": works_start_status(aio, sit, inicio, c("prazo_inicio_obra"), cfg),
        "urgencia_suspensiva": suspension_urgency(ret, sit, venc, cfg),
        "motivo_suspensiva_retirada_dmp": withdrawn_reason(sit, analysis, aio, inicio),
        "pos_72": era(assin, cfg.exempt_before),
        "ano": signature_year(assin),
    }
