"""Predicates for the reader's selections, one per block of the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions import rules as R
from milemark.functions.calendar import month_label
from milemark.functions.text import label_or


def everything() -> Column:
    return F.lit(True)


def in_list(c: Column, values: Sequence[str]) -> Column:
    """True for every row when nothing is chosen."""
    return F.coalesce(c.isin(list(values)), F.lit(False)) if values else everything()


def equals(c: Column, value: str | None) -> Column:
    return everything() if value is None else c.eqNullSafe(value)


def top_match(sel: C.Selection) -> Column:
    return (
        in_list(F.col("secretaria"), sel.secretaria)
        & in_list(F.col("modalidade"), sel.modalidade)
        & in_list(R.signature_year(F.col("dt_assinatura")), sel.ano)
    )


def drill_dim(sel: C.Selection) -> str:
    """Modality when exactly one secretariat is chosen, else secretariat."""
    return "modalidade" if len(sel.secretaria) == 1 else "secretaria"


def chart_match(sel: C.Selection) -> Column:
    return (
        equals(F.col("situacao"), sel.situacao)
        & equals(F.col("situacao_suspensiva"), sel.situacao_suspensiva)
        & equals(F.col(drill_dim(sel)), sel.drill)
    )


def geo_match(sel: C.Selection) -> Column:
    levels = {"regiao": sel.regiao, "uf": sel.uf, "municipio": sel.municipio}
    out = everything()
    for name, value in levels.items():
        out = out & (everything() if value is None else label_or(F.col(name)) == value)
    return out


def suspension_match(sel: C.Selection, with_months: bool = True) -> Column:
    ret, analysis = F.col("dt_retirada_suspensiva"), F.col("situacao_suspensiva")
    out = F.col("situacao").eqNullSafe(C.COM_SUSPENSIVA) & equals(analysis, sel.suspensiva)
    if sel.urgencia is not None:
        out = out & ret.isNull() & F.col("urgencia_suspensiva").eqNullSafe(sel.urgencia)
    if with_months and sel.meses:
        due = month_label(F.col("dt_vencimento_suspensiva"))
        out = out & R.is_pending(ret, analysis) & due.isin(sel.meses)
    return out


def tender_match(sel: C.Selection, cfg: C.Settings) -> Column:
    """Tender stages plus the fixed-cutoff choice."""
    pub, hom, assin = F.col("dt_pub_licitacao"), F.col("dt_homolog_licitacao"), F.col("dt_assinatura")
    open_hom = pub.isNotNull() & hom.isNull()
    out = everything()
    if sel.pub_etapa is not None:
        out = out & (pub.isNull() if sel.pub_etapa == "Aguardando publicação" else pub.isNotNull())
    if sel.pub_prazo is not None:
        shown = R.display_status(pub, assin, F.col("status_pub_licitacao"), cfg.exempt_before)
        out = out & pub.isNull() & (shown == sel.pub_prazo)
    if sel.homolog_etapa is not None:
        out = out & (open_hom if sel.homolog_etapa == "Homologação pendente" else hom.isNotNull())
    if sel.homolog_prazo is not None:
        shown = R.display_status(hom, assin, F.col("status_homolog_licitacao"), cfg.exempt_before)
        out = out & open_hom & (shown == sel.homolog_prazo)
    return out & equals(F.col("status_regra_casa_civil"), sel.casa_civil)


def final_match(sel: C.Selection, cfg: C.Settings) -> Column:
    """Everything below the territorial block, combined."""
    out = equals(F.col("status_inicio_obra"), sel.inicio_obra)
    if sel.suspensiva is not None or sel.urgencia is not None or sel.meses:
        out = out & suspension_match(sel)
    tender = [sel.pub_etapa, sel.pub_prazo, sel.homolog_etapa, sel.homolog_prazo, sel.casa_civil]
    if any(v is not None for v in tender):
        out = out & R.is_normal(F.col("situacao")) & tender_match(sel, cfg)
    if sel.documento:
        out = out & F.array_contains(F.col("docs_suspensiva_pendentes"), sel.documento)
    return out
