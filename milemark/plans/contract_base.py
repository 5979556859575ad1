"""The wide contract base: sources joined on loosely written keys, rules applied."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions import rules as R
from milemark.functions.keys import canonical_key
from milemark.operators import aggregates, joins, skew

# Working name -> column of the contract source.
_SACI = {
    "cod_tci": "cod_tci",
    "num_convenio": "num_convenio",
    "uf": "txt_uf",
    "regiao": "txt_regiao",
    "cod_ibge": "cod_ibge_7dig",
    "municipio": "txt_municipio",
    "proponente": "txt_tomador",
    "objeto": "dsc_objeto_instrumento",
    "secretaria": "txt_sigla_secretaria",
    "fase": "dsc_fase_pac",
    "modalidade": "txt_modalidade",
    "situacao": "dsc_situacao_contrato_mcid",
    "dt_assinatura": "dte_assinatura_contrato",
    "dt_inicio_obra": "dte_inicio_obra_mcid",
    "vlr_repasse": "vlr_repasse",
}


# The key column of each source that contracts meet, and those whose text has to be equal as well.
SOURCE_KEYS = {
    "pbi": "instrumento", "tdb": "cod_convenio_siafi", "tcon": "num_convenio", "s29": "instrumento", "sda": "instrumento", "sdn": "instrumento",
}
SAME_TEXT = ("tdb", "s29")


def same_text(a: Column, b: Column) -> Column:
    """Text equality that stays a residual condition of the join.

    Equal texts have equal canonical keys, so the rows already meet there; as a further join
    key the equality would only force another exchange of the contracts.
    """
    return F.coalesce(a.cast("string") == b.cast("string"), F.lit(False))


def join_sources(sources: Mapping[str, DataFrame], cfg: C.Settings, rows_per_split: int | None = None) -> DataFrame:
    """Monitored contracts with the milestones and documents of the other sources.

    All sources meet the contracts on (canonical key, salt): the contracts are exchanged once for the whole chain, and
    missing and blank keys are spread over many tasks. ``rows_per_split`` counts the keys of contracts and sources first (for
    stored tables): a hot contract key is cut by its contracts and a hot source key by the rows of the source, the
    other side repeated. Duplicate source keys multiply rows; ``joins.check_keys`` tells afterwards.
    """
    return _joined(sources, cfg, rows_per_split, lambda df: df).select(
        *_SACI, "situacao_suspensiva", "dt_vencimento_suspensiva", "dt_retirada_suspensiva", "dt_lae",
        "dt_pub_licitacao", "dt_homolog_licitacao", "dt_vrpl", "dt_aio", "perspectiva_de_retirada_da_suspensiva",
        *C.DOC_SOURCE_COLUMNS, "tipo_doc_suspensiva",
    )


def _joined(
    sources: Mapping[str, DataFrame], cfg: C.Settings, rows_per_split: int | None, before_last: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``join_sources`` with more columns; what ``before_last`` adds is made before the last source multiplies contracts."""
    saci = sources["saci"]
    chosen = R.base_filter(F.col("txt_fonte"), F.col("dsc_fase_pac"), F.col("txt_sigla_secretaria"), cfg)
    base = saci.where(chosen).select(
        canonical_key(F.col("num_convenio")).alias("_key"), *[F.col(s).alias(n) for n, s in _SACI.items()]
    )
    hot = None
    if rows_per_split is not None:
        keys = {
            tag: (sources[tag].select(canonical_key(F.col(c)).alias("_key"), F.col(c).cast("string").alias("_text")), "_text" if tag in SAME_TEXT else None)
            for tag, c in SOURCE_KEYS.items()
        }
        hot = skew.hot_grid(base.select("_key"), keys, "_key", rows_per_split)
    limit = rows_per_split or skew.ROWS_PER_SPLIT
    out = skew.spread_left(base, "_key", hot, "_salt", F.col("num_convenio").cast("string"), limit)

    def side(tag: str, columns: Mapping[str, str]) -> DataFrame:
        df, key = sources[tag], SOURCE_KEYS[tag]
        picked = df.select(
            canonical_key(F.col(key)).alias("_key"), F.col(key).cast("string").alias(f"_{tag}"),
            *[F.col(s).alias(n) for n, s in columns.items()],
        )
        return skew.spread_right(picked, "_key", hot, "_salt", tag, F.col(f"_{tag}"), limit)

    def attach(left: DataFrame, right: DataFrame, tag: str) -> DataFrame:
        on = (left["_key"] == right["_key"]) & (left["_salt"] == right["_salt"])
        if tag in SAME_TEXT:
            on = on & same_text(left["num_convenio"], right[f"_{tag}"])
        joined = left.join(right, on, "left")
        if hot is not None:
            joined = skew.matched(joined, tag, right["_key"].isNotNull())
        return joined.drop(right["_key"]).drop(right["_salt"])

    # One row a canonical key: the events of each written form of it, of which there are a few.
    event = {"dt_pub_licitacao": "dte_publicacao_licitacao", "dt_homolog_licitacao": "dte_homologacao_licitacao"}
    events = aggregates.first_events(sources["licitacao"]).withColumn("_key", canonical_key(F.col("num_convenio")))
    # Dealt out before they are grouped, so that the exchange of the grouping is that of the join.
    events = skew.spread_right(events, "_key", hot, "_salt", rows_per_split=limit).groupBy("_key", "_salt").agg(F.collect_list(F.struct(*[F.col(s).alias(n) for n, s in event.items()])).alias("_events"))
    docs = {n: c for n, c in C.DOC_SOURCE_COLUMNS.items()}
    nine = {n: c for n, c in docs.items() if n != "doc_trabalho_social"}
    out = attach(out, side("tdb", {
        "dt_lae": "dte_primeira_data_lae", "dt_vrpl": "dte_vrpl", "dt_aio": "dte_aio",
    }), "tdb")
    # Joined once; publication and homologation are then unfolded on their own, as two sources would match.
    out = attach(out, events, "licitacao")
    for name in event:
        out = out.withColumn(name, F.explode_outer(F.col("_events").getField(name)))
    out = out.drop("_events")
    out = attach(out, side("tcon", {"dt_retirada_suspensiva": "dte_retirada_suspensiva"}), "tcon")
    out = attach(out, side("s29", {
        "perspectiva_de_retirada_da_suspensiva": "pespectiva_de_retirada_da_suspensiva",
    }), "s29")
    out = attach(out, side("sda", {f"a_{n}": c for n, c in docs.items()}), "sda")
    out = attach(out, side("sdn", {f"b_{n}": c for n, c in nine.items()}), "sdn")
    out = before_last(out.select(
        *[c for c in out.columns if not c.startswith(("a_", "b_")) and c not in ("_sda", "_sdn")],
        *[(F.coalesce(f"a_{n}", f"b_{n}") if n in nine else F.col(f"a_{n}")).alias(n) for n in docs],
        R.doc_type(F.col("_sda").isNotNull(), F.col("_sdn").isNotNull()).alias("tipo_doc_suspensiva"),
    ))
    # Last: of the sources with blank keys, which multiply contracts without a number, it is the one that matches them.
    return attach(out, side("pbi", {
        "situacao_suspensiva": "situacao_da_analise_suspensiva",
        "dt_vencimento_suspensiva": "vencimento_da_suspensiva",
    }), "pbi")


def enrich(sources: Mapping[str, DataFrame], cfg: C.Settings, rows_per_split: int | None = None) -> DataFrame:
    """The wide base under its published column names."""
    # A contract without a number meets every blank row of the last source; its other rules are worked out once, before.
    joined = _joined(sources, cfg, rows_per_split, lambda df: R.with_milestone_rules(df, cfg))
    derived = R.with_suspension_rules(joined, cfg)
    return derived.withColumn("cod_saci", F.col("cod_tci")).select(
        *[F.col(n).alias(published) for n, published in C.BASE_COLUMNS.items()]
    )


# Columns both document tabs carry besides the documents.
DOC_COMMON = [
    "proposta", "operacao", "recebedor", "uf", "municipio_beneficiado", "unidade_caixa", "programa",
    "valor_repasse", "situacao_da_analise",
]


def doc_union(presented: DataFrame, missing: DataFrame) -> DataFrame:
    """Rows of both document tabs; the second has no tenth document."""

    def tab(df: DataFrame, tipo: str) -> DataFrame:
        docs = [F.col(s).alias(n) for n, s in C.DOC_SOURCE_COLUMNS.items() if s in df.columns]
        return df.select(F.lit(tipo).alias("tipo_doc_suspensiva"), "instrumento", *DOC_COMMON, *docs, "dt_atualizacao")

    both = tab(presented, C.DOC_APRESENTADOS).unionByName(
        tab(missing, C.DOC_NAO_APRESENTADOS), allowMissingColumns=True
    )
    return both.select("tipo_doc_suspensiva", "instrumento", *DOC_COMMON, *C.DOC_LABELS, "dt_atualizacao")


def doc_detail(sources: Mapping[str, DataFrame], base: DataFrame) -> DataFrame:
    """Every document row with its contract code and whether the contract is monitored."""
    union = doc_union(sources["sda"], sources["sdn"])
    coded = joins.first_match(union, sources["saci"], "instrumento", "num_convenio", "cod_tci", "cod_saci")
    flagged = joins.membership_flag(coded, base, "instrumento", "num_convenio_saci", "consta_base_pc32")
    return flagged.select(
        "tipo_doc_suspensiva", "instrumento", "cod_saci", *DOC_COMMON, *C.DOC_LABELS, "dt_atualizacao", "consta_base_pc32"
    )
