"""Contract, source, snapshot and works tables derived from the star-schema test tables."""

from __future__ import annotations

import dataclasses
import datetime as dt
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions import rules as R

SETTINGS = C.Settings(
    as_of=dt.date(1998, 11, 1),
    exempt_before=dt.date(1998, 1, 1),
    fixed_cutoff=dt.date(1998, 7, 17),
    secretaria_excluida="MACHINERY",
)
SNAPSHOTS = ["1998-11-01", "1998-11-02", "1998-11-16", "1998-11-17"]


# Declared so that opening a table starts no job to look into its files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def tender_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    ship = F.col("l_shipdate").cast("date")
    return line.groupBy("l_orderkey").agg(
        F.min(F.when(F.col("l_returnflag") == "A", ship)).alias("dt_pub_licitacao"),
        F.min(F.when(F.col("l_returnflag") == "R", ship)).alias("dt_homolog_licitacao"),
    )


def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract per order, with its milestones but without its place."""
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").join(tender_dates(spark, sf_dir), k == F.col("l_orderkey"), "left")
    text = k.cast("string")
    d = F.col("o_orderdate").cast("date")
    number = (
        F.when(k % 101 == 0, "")
        .when(k % 4 == 0, F.concat(text, F.lit(".0")))
        .when(k % 4 == 1, F.concat(F.lit("0"), text))
        .otherwise(text)
    )
    status = (
        F.when(k % 37 == 0, C.CANCELADO)
        .when(k % 41 == 0, C.PRESTACAO_CONTAS)
        .when(F.col("o_orderstatus") == "P", C.COM_SUSPENSIVA)
        .when(F.col("o_orderstatus") == "F", C.NORMAL)
        .otherwise(C.EM_CONTRATACAO)
    )
    analysis = F.element_at(F.array(*[F.lit(v) for v in C.SUSPENSIVA_ORDER]), (k % 7 + 1).cast("int"))
    base = orders.select(
        k.alias("k"),
        "o_custkey",
        number.alias("num_convenio"),
        F.concat(F.lit("1-"), text).alias("cod_tci"),
        F.when(k % 20 == 0, "FIN").otherwise("OGU").alias("fonte"),
        F.when(k % 43 == 0, "OUTRA SELECAO").otherwise(SETTINGS.fase).alias("fase"),
        F.col("o_orderpriority").alias("modalidade"),
        status.alias("situacao"),
        F.when(k % 47 != 0, d).alias("dt_assinatura"),
        F.when(k % 11 != 0, analysis).alias("situacao_suspensiva"),
        F.when(k % 7 != 0, F.date_add(d, (180 + k % 120).cast("int"))).alias("dt_vencimento_suspensiva"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(d, (90 + k % 60).cast("int"))).alias("dt_retirada_suspensiva"),
        F.when(k % 3 != 0, F.date_add(d, (100 + k % 45).cast("int"))).alias("dt_lae"),
        "dt_pub_licitacao",
        "dt_homolog_licitacao",
        F.when(k % 2 == 0, F.date_add("dt_homolog_licitacao", (20 + k % 30).cast("int"))).alias("dt_vrpl"),
        F.when(k % 61 != 0, (F.col("o_totalprice").cast(DEC) * 30).cast(DEC)).alias("vlr_repasse"),
    )
    with_aio = base.withColumn("dt_aio", F.when(F.col("k") % 5 != 0, F.date_add("dt_vrpl", 15)))
    return with_aio.withColumn(
        "dt_inicio_obra", F.when(F.col("k") % 3 == 0, F.date_add("dt_aio", (F.col("k") % 25).cast("int")))
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``milestones`` with secretariat, region, state, municipality and proponent."""
    places = (
        read(spark, sf_dir, "customer")
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    k = F.col("k")
    placed = milestones(spark, sf_dir).join(places, F.col("o_custkey") == F.col("c_custkey"))
    named = placed.withColumns(
        {
            "secretaria": F.when(k % 53 != 0, F.col("c_mktsegment")),
            "regiao": F.col("r_name"),
            "uf": F.col("n_name"),
            "municipio": F.when(k % 59 == 0, " ").otherwise(F.col("c_name")),
            "proponente": F.concat(F.lit("Prefeitura de "), F.col("c_name")),
        }
    )
    return named.drop("o_custkey", *places.columns)


DEC = "decimal(18,2)"


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of the monitored programme."""
    c = F.col
    return contracts(spark, sf_dir).where(R.base_filter(c("fonte"), c("fase"), c("secretaria"), SETTINGS))


def with_docs(df: DataFrame) -> DataFrame:
    """Document columns: k%6=0 has the presented tab, k%6=1 the other one."""
    k = F.col("k")
    tipo = R.doc_type(k % 6 == 0, k % 6 == 1)
    docs = {}
    for i, name in enumerate(C.DOC_LABELS):
        missing = k % (i + 3) == 0
        presented = F.when(k % 6 == 0, F.when(missing, "Não Apresentado").otherwise("Apresentado"))
        if name != "doc_trabalho_social":
            presented = presented.when(k % 6 == 1, F.when(missing, "NÃO").otherwise("SIM"))
        docs[name] = presented
    return df.withColumns({"tipo_doc_suspensiva": tipo, **docs})


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows the analytic operators work on: monitored contracts with every derived column."""
    return R.with_contract_rules(selected(spark, sf_dir), SETTINGS)


def previous_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same a month earlier: fewer rows, some milestones not reached yet."""
    k = F.col("k")
    earlier = selected(spark, sf_dir).where(k % 97 != 1)
    edited = earlier.withColumns(
        {
            "dt_aio": F.when(k % 13 != 0, F.col("dt_aio")),
            "dt_pub_licitacao": F.when(k % 19 != 0, F.col("dt_pub_licitacao")),
            "situacao": F.when(k % 17 == 0, C.EM_CONTRATACAO).otherwise(F.col("situacao")),
            "vlr_repasse": F.when(k % 23 == 0, (F.col("vlr_repasse") - 100).cast(DEC)).otherwise(F.col("vlr_repasse")),
        }
    )
    return R.with_contract_rules(edited, dataclasses.replace(SETTINGS, as_of=dt.date(1998, 10, 1)))


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The contract table split into its sources, each writing the key in its own way."""
    base, dates = contracts(spark, sf_dir), milestones(spark, sf_dir)
    k, text = F.col("k"), F.col("k").cast("string")
    order_day = F.coalesce(F.col("dt_assinatura"), F.lit(dt.date(1995, 1, 1)))
    raw = {
        "txt_uf": "uf", "txt_regiao": "regiao", "txt_municipio": "municipio", "txt_tomador": "proponente",
        "txt_sigla_secretaria": "secretaria", "dsc_fase_pac": "fase", "txt_modalidade": "modalidade",
        "dsc_situacao_contrato_mcid": "situacao", "dte_assinatura_contrato": "dt_assinatura",
        "dte_inicio_obra_mcid": "dt_inicio_obra", "vlr_repasse": "vlr_repasse", "txt_fonte": "fonte",
    }
    saci = base.select(
        "cod_tci", "num_convenio",
        F.lpad((k % 9999999).cast("string"), 7, "0").alias("cod_ibge_7dig"),
        F.concat(F.lit("Obra "), text).alias("dsc_objeto_instrumento"),
        *[F.col(v).alias(n) for n, v in raw.items()],
        F.date_add(order_day, 3).alias("dte_carga"),
    )
    pbi = dates.select(
        F.when(k % 1009 == 0, "").otherwise(text).alias("instrumento"),
        F.col("situacao_suspensiva").alias("situacao_da_analise_suspensiva"),
        F.col("dt_vencimento_suspensiva").alias("vencimento_da_suspensiva"),
        F.date_add(order_day, 5).alias("data_atualizacao"),
    )
    tdb = dates.select(
        F.col("num_convenio").alias("cod_convenio_siafi"),
        F.col("dt_lae").alias("dte_primeira_data_lae"),
        F.col("dt_vrpl").alias("dte_vrpl"),
        F.col("dt_aio").alias("dte_aio"),
        F.date_add(order_day, 7).alias("dte_posicao"),
    ).where(F.col("cod_convenio_siafi") != "")
    tcon = dates.select(
        F.concat(text, F.lit(".00")).alias("num_convenio"),
        F.col("dt_retirada_suspensiva").alias("dte_retirada_suspensiva"),
        F.date_add(order_day, 9).alias("dte_carga"),
    )
    ship = F.col("l_shipdate").cast("date")
    okey = F.col("l_orderkey")
    licitacao = read(spark, sf_dir, "lineitem").select(
        F.when((okey % 23 == 0) & (F.col("l_linenumber") % 2 == 0), F.concat(okey.cast("string"), F.lit(".0")))
        .otherwise(F.concat(F.lit("00"), okey.cast("string")))
        .alias("num_convenio"),
        F.when(F.col("l_returnflag") == "A", ship).alias("dte_publicacao_licitacao"),
        F.when(F.col("l_returnflag") == "R", ship).alias("dte_homologacao_licitacao"),
        F.date_add(ship, 1).alias("dte_carga"),
    )
    s29 = dates.where(k % 9 == 0).select(
        F.col("num_convenio").alias("instrumento"),
        F.concat(F.lit("mês "), (k % 12 + 1).cast("string")).alias("pespectiva_de_retirada_da_suspensiva"),
    ).where(F.col("instrumento") != "")
    docs = with_docs(base)
    tab_columns = [
        text.alias("instrumento"), F.concat(F.lit("P"), text).alias("proposta"), text.alias("operacao"),
        F.col("proponente").alias("recebedor"), F.col("uf"), F.col("municipio").alias("municipio_beneficiado"),
        F.concat(F.lit("GIGOV "), F.col("uf")).alias("unidade_caixa"), F.col("modalidade").alias("programa"),
        F.col("vlr_repasse").alias("valor_repasse"), F.col("situacao_suspensiva").alias("situacao_da_analise"),
    ]
    doc_columns = [F.col(a).alias(b) for a, b in C.DOC_SOURCE_COLUMNS.items()]
    updated = F.date_add(order_day, 11).alias("dt_atualizacao")
    sda = docs.where(k % 6 == 0).select(*tab_columns, *doc_columns, updated)
    sdn = docs.where(k % 6 == 1).select(*tab_columns, *doc_columns[:-1], updated)
    return {
        "saci": saci, "pbi": pbi, "tdb": tdb, "tcon": tcon, "licitacao": licitacao,
        "s29": s29, "sda": sda, "sdn": sdn,
    }


SNAPSHOT_COLUMNS = [n for n in C.BASE_COLUMNS if n not in ("cod_saci", "cod_ibge", "objeto", "perspectiva_de_retirada_da_suspensiva")]


SNAPSHOT_AS_OF = [dt.date(1998, 11, 1), dt.date(1998, 11, 2), dt.date(1998, 11, 16), dt.date(1998, 11, 16)]


def stored_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitored contracts, joined once and stored: for queries that make several snapshots of them."""
    found, path = selected(spark, sf_dir), scratch(spark)
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def _snapshot_rows(contracts: DataFrame, ords: list[int]) -> DataFrame:
    """The wanted snapshots of the monitored contracts by ``ord``, every column as text."""
    k, o = F.col("k"), F.col("ord")
    base = with_docs(contracts).withColumn("ord", F.explode(F.array(*[F.lit(i) for i in ords])))
    kept = base.where(F.when(o == 1, k % 89 != 1).otherwise(k % 97 != 1))
    first = o == 1
    venc, vlr = F.col("dt_vencimento_suspensiva"), F.col("vlr_repasse")
    edited = kept.withColumns(
        {
            "dt_aio": F.when(~first | (k % 11 != 0), F.col("dt_aio")),
            "vlr_repasse": F.when(first & (k % 13 == 0), (vlr - 100).cast(DEC)).otherwise(vlr),
            "situacao": F.when(first & (k % 17 == 0), C.EM_CONTRATACAO).otherwise(F.col("situacao")),
            "dt_vencimento_suspensiva": F.when((o >= 3) & (k % 19 == 0), F.date_add(venc, 1)).otherwise(venc),
            "as_of": F.element_at(F.array(*[F.lit(d) for d in SNAPSHOT_AS_OF]), o),
        }
    )
    derived = R.with_contract_rules(edited, dataclasses.replace(SETTINGS, as_of=F.col("as_of")))
    texts = [F.col(n).cast("string").alias(C.BASE_COLUMNS[n]) for n in SNAPSHOT_COLUMNS]
    return derived.select("ord", *texts)


def _header(ord_: int) -> list[str]:
    return [C.BASE_COLUMNS[n] for n in SNAPSHOT_COLUMNS if ord_ >= 3 or n != "tipo_doc_suspensiva"]


def snapshot(spark: SparkSession, sf_dir: str, ord_: int, contracts: DataFrame | None = None) -> DataFrame:
    """One snapshot, of ``stored_contracts`` if given."""
    return _snapshot_rows(selected(spark, sf_dir) if contracts is None else contracts, [ord_]).select(*_header(ord_))


def history(
    spark: SparkSession, sf_dir: str, ords: Sequence[int] = (1, 2, 3, 4), contracts: DataFrame | None = None
) -> tuple[DataFrame, dict[str, list[str]]]:
    """All snapshots (or some) in one frame with ``snapshot_date``, and the header of each.

    Stored contracts are read for each snapshot, as rules for a day that is a literal are far cheaper.
    """
    if contracts is not None:
        dated = [snapshot(spark, sf_dir, o, contracts).withColumn("snapshot_date", F.lit(SNAPSHOTS[o - 1])) for o in ords]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dated), {SNAPSHOTS[o - 1]: _header(o) for o in ords}
    day = F.element_at(F.array(*[F.lit(d) for d in SNAPSHOTS]), F.col("ord"))
    rows = _snapshot_rows(selected(spark, sf_dir), list(ords))
    return rows.withColumn("snapshot_date", day).drop("ord"), {SNAPSHOTS[o - 1]: _header(o) for o in ords}


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One legacy work per part, typed."""
    p = F.col("p_partkey")
    ufs = F.array(*[F.lit(u) for u in [*C.UF_REGIAO, "XX"]])
    kinds = F.array(F.lit("REPASSE"), F.lit("FINANCIAMENTO"), F.lit(""))
    states = F.array(*[F.lit(s) for s in C.SITUACAO_OBRA_ORDER])
    base = read(spark, sf_dir, "part").select(
        p.cast("string").alias("operacao"),
        p.alias("p"),
        F.element_at(ufs, (p % 28 + 1).cast("int")).alias("uf"),
        F.element_at(kinds, (p % 3 + 1).cast("int")).alias("tipo_operacao"),
        F.col("p_brand").alias("modalidade"),
        F.concat(F.lit("CC "), F.substring("p_brand", -1, 1)).alias("modalidade_cc"),
        F.col("p_name").alias("recebedor"),
        F.concat(F.lit("Cidade "), (p % 40).cast("string")).alias("municipio"),
        F.element_at(states, (F.col("p_size") % 6 + 1)).alias("situacao_obra"),
        F.when(p % 9 != 0, F.least(p * 7 % 120, F.lit(100)).cast("int")).alias("pct_fisico"),
        F.date_add(F.lit(dt.date(2010, 1, 1)), (p % 4000).cast("int")).alias("dt_assinatura"),
        (F.col("p_retailprice").cast(DEC) * 1000).cast(DEC).alias("vlr_repasse"),
        (F.col("p_retailprice").cast(DEC) * 100).cast(DEC).alias("vlr_contrapartida"),
        F.when(p % 4 != 1, F.col("p_size") * 10).alias("dias_sem_bm"),
        F.when(p % 31 != 0, F.col("p_type")).alias("motivo_paralisacao"),
        F.when(p % 4 == 0, F.col("p_name")).otherwise("").alias("plano_acao"),
        F.when(p % 5 == 0, F.date_add(F.lit(dt.date(1998, 12, 1)), F.col("p_size"))).alias("previsao_retomada"),
    )
    disbursed = (F.col("vlr_repasse") * F.coalesce(F.col("pct_fisico"), F.lit(0)) / 100).cast(DEC)
    return base.withColumn("vlr_desembolsado", disbursed)


def works_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """Two dated copies of the works as text: some enter, some leave, some change."""
    p = F.col("p")
    base = works(spark, sf_dir)
    first = base.where(p % 29 != 3).withColumns(
        {
            "pct_fisico": F.when(p % 10 == 0, F.lit(5)).otherwise(F.col("pct_fisico")),
            "plano_acao": F.when(p % 6 == 0, "revisar").otherwise(F.col("plano_acao")),
        }
    )
    second = base.where(p % 31 != 4).withColumn("operacao", F.when(p % 77 == 0, " ").otherwise(F.col("operacao")))
    days = {"2026-06-12": first, "2026-06-25": second}
    text = {d: df.drop("p").select(*[F.col(n).cast("string").alias(n) for n in df.columns if n != "p"]) for d, df in days.items()}
    headers = {d: df.columns for d, df in text.items()}
    dated = [df.withColumn("snapshot_date", F.lit(d)) for d, df in text.items()]
    return reduce(DataFrame.unionByName, dated), headers


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, a temporary one for a local session without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="milemark-")
    return f"{root}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
