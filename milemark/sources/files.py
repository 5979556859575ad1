"""CSV, Parquet, JSON and text readers and writers."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milemark import config as C

SEPARATORS = ",;\t|"


def _first_line(spark: SparkSession, path: str) -> str:
    lines = spark.read.text(path).where(F.regexp_replace("value", "^\ufeff", "").rlike(r"\S"))
    for row in lines.take(1):
        return row["value"].lstrip("\ufeff")
    raise ValueError(f"no header line in {path}")


def sniff_separator(header: str) -> str:
    """The candidate that cuts the header into most fields, quoted text left whole."""
    fields = {sep: len(next(csv.reader([header], delimiter=sep))) for sep in SEPARATORS}
    return max(SEPARATORS, key=lambda sep: fields[sep])


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line is not valid UTF-8, then Latin-1; the check runs on the executors."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return "ISO-8859-1" if broken.take(1) else "UTF-8"


def has_quoted_breaks(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether some line holds an odd number of quotes: so does the first line of a value that goes on in the next."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).take(1))


def read_csv_any(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with every column as text; separator, encoding and quoted line breaks are found when not given.

    Only files with a line break inside quotes are read in one task each; all others are split.
    """
    encoding = encoding or detect_encoding(spark, path)
    multi_line = has_quoted_breaks(spark, path) if multi_line is None else multi_line
    sep = sep or sniff_separator(_first_line(spark, path))
    return (
        spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
        .csv(path, sep=sep, encoding=encoding, multiLine=multi_line)
    )


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by file extension."""
    lower = path.lower()
    if lower.endswith(".csv"):
        return read_csv_any(spark, path)
    if lower.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def read_snapshot(spark: SparkSession, path: str | Sequence[str], multi_line: bool | None = None) -> DataFrame:
    """Quoted ``;`` CSV with a header; every value is text and a missing one is ''.

    Quoted line breaks are looked for when ``multi_line`` isn't given, as in ``read_csv_any``.
    """
    multi_line = has_quoted_breaks(spark, path) if multi_line is None else multi_line
    df = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .csv(path, sep=";", encoding="UTF-8", multiLine=multi_line)
    )
    if not df.columns:
        raise ValueError(f"CSV without a header: {path}")
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def write_quoted_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``;`` CSV with every field quoted and null written as an empty field."""
    text = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.write.mode(mode).csv(
        path, sep=";", header=True, quoteAll=True, emptyValue="", escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_summary_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row frame as one JSON document, nulls kept."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


# The order of the published sources.
FRESHNESS_ORDER = ["tci_mcid", "transferegov", "bdgestores", "power_bi_caixa", "dmp"]


def freshness_document(rows: DataFrame, snapshot: str) -> DataFrame:
    """The five freshness rows nested into the document that is published, in the published order."""
    source = F.struct("key", "label", "sigla", "updated_at", "method", "fallback", "note")
    place = F.array_position(F.array(*[F.lit(k) for k in FRESHNESS_ORDER]), F.col("key"))
    placed = F.sort_array(F.collect_list(F.struct(place.alias("place"), source.alias("source"))))
    return rows.agg(F.lit(snapshot).alias("snapshot_atual"), F.transform(placed, lambda p: p["source"]).alias("sources"))


# Wording of the text report.
REPORT_HEADLINE = {
    "entered": "Entraram na base",
    "exited": "Saíram da base",
    "changed_records": "Registros com alguma alteração",
    "changed_data_records": "Registros com mudança de dados de origem",
    "changed_time_records": "Registros com mudança apenas em campos derivados/status",
}


REPORT_GUIDE = [
    "",
    "## Leitura recomendada",
    "",
    "- `categoria_alteracao = dados_e_derivados`: mudou dado de origem e isso também repercutiu em campos calculados.",
    "- `categoria_alteracao = dados`: mudou apenas dado de origem, sem alterar status calculado.",
    "- `categoria_alteracao = derivados_tempo`: o dado-base ficou igual; a alteração veio só de regra derivada/data corrente.",
]


def summary_report(summary: DataFrame, base: str = "") -> DataFrame:
    """The text report of a diff as ``linha, texto``: totals, headline, status counters and a reading guide.

    ``base`` names the base in the title.
    """
    label = f" {base}" if base else ""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- {label}: **"), value.cast("string"), F.lit("**"))

    texts = [
        F.concat(F.lit(f"# Diferença da base{label} - "), F.col("snapshot_atual")),
        F.lit(""),
        F.concat(F.lit("- Snapshot atual: `"), F.col("snapshot_atual"), F.lit("`")),
        F.concat(F.lit("- Snapshot anterior: `"), F.coalesce("snapshot_anterior", F.lit("—")), F.lit("`")),
        line("Total anterior", F.col("total_anterior")),
        line("Total atual", F.col("total_atual")),
        F.lit(""),
        F.lit("## Resumo"),
        F.lit(""),
        *[line(label, F.col(f"resumo.{n}")) for n, label in REPORT_HEADLINE.items()],
        F.lit(""),
        F.lit("## Mudanças por status"),
        F.lit(""),
        *[line(f"`{f}`", F.col(f"mudancas_status.{f}")) for f in C.STATUS_FIELDS],
        *[F.lit(text) for text in REPORT_GUIDE],
    ]
    rows = [F.struct(F.lit(i + 1).alias("linha"), t.alias("texto")) for i, t in enumerate(texts)]
    return summary.select(F.inline(F.array(*rows)))


def write_report(summary: DataFrame, path: str, base: str = "") -> None:
    report = summary_report(summary, base).where(F.col("texto").isNotNull())
    report.coalesce(1).sortWithinPartitions("linha").select("texto").write.mode("overwrite").text(path)
