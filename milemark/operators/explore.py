"""Filters, facets, cross-filtered charts, searches, pages and top lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cmp_to_key, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions.text import label_or, squish
from milemark.plans import selection as S

# Fixed value: page sizes offered by the table.
PAGE_SIZES = [10, 25, 50, 100]


def facets(df: DataFrame, columns: Mapping[str, Column], chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """Options of every facet under the filters of the other facets: ``faceta, opcao, qtd``.

    The rows are first counted per combination of facet values, so only combinations are
    looked at once per facet.
    """
    names = list(columns)
    combos = df.groupBy(*[columns[n].alias(n) for n in names]).agg(F.count("*").alias("n"))
    cells = []
    for name in names:
        others = F.lit(True)
        for other in names:
            if other != name:
                others = others & S.in_list(F.col(other), chosen.get(other, []))
        offered = others & F.col(name).isNotNull() & (F.col(name) != "")
        cells.append(F.struct(F.lit(name).alias("faceta"), F.when(offered, F.col(name)).alias("opcao"), F.col("n")))
    return (
        combos.select(F.inline(F.array(*cells)))
        .where(F.col("opcao").isNotNull())
        .groupBy("faceta", "opcao")
        .agg(F.sum("n").alias("qtd"))
    )


def sanitize(options: DataFrame, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    """Choices still offered, as ``faceta, escolha``; a facet chosen in full keeps none."""
    picked = F.lit(False)
    for name, values in chosen.items():
        if values:
            picked = picked | ((F.col("faceta") == name) & F.col("opcao").isin(list(values)))
    full = options.groupBy("faceta").agg(F.bool_and(picked).alias("todas"))
    return (
        options.where(picked)
        .join(full.where(~F.col("todas")), "faceta")
        .select("faceta", F.col("opcao").alias("escolha"))
    )


def sanitized_choices(options: DataFrame, chosen: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """``sanitize`` as plain lists; at most as long as what the reader chose."""
    out: dict[str, list[str]] = {name: [] for name in chosen}
    for row in sanitize(options, chosen).orderBy("faceta", "escolha").collect():
        out[row["faceta"]].append(row["escolha"])
    return out


def text_search(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    """Rows where every term of the query starts a word in some column, ignoring case."""
    for term in query.split():
        quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        pattern = rf"(?iu)(^|[^\p{{L}}-]){quoted}"
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(pattern)
        df = df.where(hit)
    return df


@dataclass(frozen=True)
class Chart:
    """One of several charts that filter each other; ``order`` fixes its bars."""

    column: str
    order: Sequence[str] | None = None
    selected: str | None = None


def cross_filter(df: DataFrame, charts: Sequence[Chart], value: str = "vlr_repasse") -> DataFrame:
    """Bars of every chart under the selections of the others: ``grafico, grupo, qtd, vlr``."""
    names = [c.column for c in charts]
    combos = df.groupBy(*names).agg(F.count("*").alias("n"), F.sum(value).alias("v"))
    cells = []
    for chart in charts:
        label = F.col(chart.column)
        keep = label.isNotNull() & (label != "")
        if chart.order is not None:
            keep = keep & label.isin(list(chart.order))
        for other in charts:
            if other is not chart:
                keep = keep & S.equals(F.col(other.column), other.selected)
        cells.append(
            F.struct(F.lit(chart.column).alias("grafico"), F.when(keep, label).alias("grupo"), F.col("n"), F.col("v"))
        )
    return (
        combos.select(F.inline(F.array(*cells)))
        .where(F.col("grupo").isNotNull())
        .groupBy("grafico", "grupo")
        .agg(F.sum("n").alias("qtd"), F.coalesce(F.sum("v").cast("decimal(18,2)"), F.lit(0)).cast("decimal(18,2)").alias("vlr"))
    )


def panel_charts(sel: C.Selection) -> list[Chart]:
    return [
        Chart("situacao", C.SITUACAO_ORDER, sel.situacao),
        Chart("situacao_suspensiva", C.SUSPENSIVA_ORDER, sel.situacao_suspensiva),
        Chart(S.drill_dim(sel), None, sel.drill),
    ]


def geo_filter(df: DataFrame, sel: C.Selection) -> DataFrame:
    return df.where(S.geo_match(sel))


def scoped_rows(pending: DataFrame, visible: DataFrame | None, months: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows of the month chart: those visible in the table unless months are chosen."""
    if months or visible is None:
        return pending
    shown = visible.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]  # blank keys find each other
    return pending.join(shown, reduce(lambda a, b: a & b, same), "left_semi")


@dataclass(frozen=True)
class TableQuery:
    """What the reader typed into the detail table."""

    text: str = ""
    exact: Mapping[str, str] = field(default_factory=dict)
    contains: Mapping[str, str] = field(default_factory=dict)
    sort: Sequence[tuple[str, bool]] = ()
    page: int = 1
    size: int = 25


def table_rows(df: DataFrame, query: TableQuery, columns: Sequence[str], shown: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows that match the table's searches; texts are compared as displayed."""
    display = {c: squish((shown or {}).get(c, F.col(c))) for c in columns}
    line = F.lower(F.concat_ws("  ", *display.values()))
    for word in query.text.lower().split():
        df = df.where(F.contains(line, F.lit(word)))
    for c, v in query.exact.items():
        df = df.where(display[c] == v)
    for c, v in query.contains.items():
        for word in v.lower().split():
            df = df.where(F.contains(F.lower(display[c]), F.lit(word)))
    return df


def table_page(df: DataFrame, query: TableQuery, columns: Sequence[str], shown: Mapping[str, Column] | None = None) -> DataFrame:
    """One page of the table, typed columns sorted by value."""
    if query.size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in query.sort]
    rows = table_rows(df, query, columns, shown)
    return rows.orderBy(*order).offset((query.page - 1) * query.size).limit(query.size).select(*columns)


# Rows that one task may skip and sort to cut out a page, and ranges into which the order is cut at a time.
ROWS_PER_PAGE_TASK = 100_000
RANGES = 32


def _after(sort: Sequence[tuple[str, bool]], values: Sequence, equal: bool = False) -> Column:
    """Whether a row stands after the given sort values (or with ``equal`` at them); null comes first upward, last downward."""
    out = F.lit(equal)
    for (c, up), v in reversed(list(zip(sort, values, strict=True))):
        if v is None:
            beyond = F.col(c).isNotNull() if up else F.lit(False)
        elif up:
            beyond = F.coalesce(F.col(c) > F.lit(v), F.lit(False))
        else:
            beyond = F.coalesce(F.col(c) < F.lit(v), F.lit(True))
        out = beyond | (F.col(c).eqNullSafe(F.lit(v)) & out)
    return out


def _place(sort: Sequence[tuple[str, bool]]):
    """The same order for values on the driver."""

    def compare(a: Sequence, b: Sequence) -> int:
        for (_, up), x, y in zip(sort, a, b, strict=True):
            if x != y:
                less = x is None or (y is not None and x < y)
                return -1 if less == up else 1
        return 0

    return cmp_to_key(compare)


def deep_page(
    df: DataFrame, query: TableQuery, columns: Sequence[str], shown: Mapping[str, Column] | None = None,
    rows_at_once: int = ROWS_PER_PAGE_TASK,
) -> DataFrame:
    """``table_page`` for pages far down: no task sorts or skips more than ``rows_at_once`` rows, but for rows that are
    equal in all sort values.

    A hashed sample of the sort values cuts the order into ranges, the ranges are counted, and the one in which the page
    begins (with those it reaches into) is cut on until it holds few rows. ``df`` is read for each cut, its other columns
    for the page alone.
    """
    if query.size not in PAGE_SIZES or not query.sort:
        raise ValueError(f"a deep page needs a sort order and one of {PAGE_SIZES} as its size")
    sort, skip, place = list(query.sort), (query.page - 1) * query.size, _place(query.sort)
    keys = [c for c, _ in sort]
    rows = table_rows(df, query, columns, shown)
    low, left, total = None, rows, None
    while skip > min(rows_at_once, 10 * query.size):
        total = left.count() if total is None else total
        if total <= rows_at_once:
            break
        # About as many values whatever the number of rows; which they are decides how well the cut is balanced only.
        asked = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) * float(total) <= float(RANGES * 64) * (1 << 30)
        some = sorted({tuple(r) for r in left.where(asked).select(*keys).distinct().limit(RANGES * 256).collect()}, key=place)
        bounds = [b for b in some[:: max(1, len(some) // RANGES)] if low is None or place(low) < place(b)]
        which = sum((_after(sort, b, True).cast("int") for b in bounds), F.lit(0))
        counts = dict(left.groupBy(which.alias("r")).agg(F.count("*").alias("n")).collect())
        sizes = [counts.get(r, 0) for r in range(len(bounds) + 1)]
        first, before = 0, 0
        while first < len(bounds) and before + sizes[first] <= skip:
            before, first = before + sizes[first], first + 1
        last, held = first, sizes[first]
        while last < len(bounds) and before + held < skip + query.size:
            last, held = last + 1, held + sizes[last + 1]
        if held == total:
            break  # rows that are equal in all sort values
        left = left if first == 0 else left.where(_after(sort, low := bounds[first - 1], True))
        left = left if last == len(bounds) else left.where(~_after(sort, bounds[last], True))
        skip, total = skip - before, held
    order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in sort]
    return left.orderBy(*order).offset(skip).limit(query.size).select(*columns)


def next_page(
    df: DataFrame, query: TableQuery, columns: Sequence[str], last: Sequence, shown: Mapping[str, Column] | None = None
) -> DataFrame:
    """The page behind a row with the sort values ``last``, which must be unique: nothing before it is sorted."""
    order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in query.sort]
    rows = table_rows(df, query, columns, shown).where(_after(query.sort, last))
    return rows.orderBy(*order).limit(query.size).select(*columns)


def filter_options(df: DataFrame, column: str, shown: Column) -> DataFrame:
    """Distinct displayed texts of a column with the raw value they are ordered by."""
    return (
        df.select(F.nullif(squish(shown), F.lit("")).alias("texto"), F.col(column).alias("_raw"))
        .where(F.col("texto").isNotNull())
        .groupBy("texto")
        .agg(F.min("_raw").alias("ordem"))
    )


def order_options(options: DataFrame, by_value: bool) -> DataFrame:
    """Dates by value, other texts in Portuguese order."""
    return options.orderBy("ordem") if by_value else options.orderBy(F.collate("texto", "pt"))


# --- top lists ----------------------------------------------------------------


def by_count_then_label(counts: DataFrame) -> list[Column]:
    return [F.desc("qtd"), F.collate("label", "pt"), F.col("label")]


def topk_other(counts: DataFrame, k: int = 15, other: str = C.OUTROS_MUNICIPIOS) -> DataFrame:
    """The k largest groups and one line for the rest, which is left out when it is zero.

    ``counts`` has ``label`` and ``qtd``. The rest is the total less the listed groups, so no
    global ranking of all groups is needed.
    """
    top = counts.orderBy(*by_count_then_label(counts)).limit(k)
    listed = top.agg(F.coalesce(F.sum("qtd"), F.lit(0)).alias("q"))
    rest = counts.agg((F.coalesce(F.sum("qtd"), F.lit(0)) - listed.scalar()).alias("qtd"))
    return top.select("label", "qtd").unionByName(rest.select(F.lit(other).alias("label"), "qtd").where(F.col("qtd") > 0))


def group_topk(totals: DataFrame, k: int = 12) -> DataFrame:
    """The k groups with most contracts, then most value."""
    return totals.orderBy(F.desc("contratos"), F.desc("vlr_repasse"), "grupo").limit(k)


def reason_topk(df: DataFrame, k: int = 12) -> DataFrame:
    """The k most frequent stoppage reasons of stopped works."""
    stopped = df.where(
        (F.col("situacao_obra") == "Obra Paralisada")
        & F.col("motivo_paralisacao").isNotNull()
        & (F.col("motivo_paralisacao") != "")
    )
    counts = stopped.groupBy(F.col("motivo_paralisacao").alias("motivo")).agg(F.count("*").alias("qtd"))
    return counts.orderBy(F.desc("qtd"), "motivo").limit(k)


def domain_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Adds ``pos``: the place in a given order, 999 for labels outside it."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column)).cast("int")
    return df.withColumn("pos", F.coalesce(F.nullif(place, F.lit(0)), F.lit(999)))


def municipality_counts(df: DataFrame, sel: C.Selection) -> DataFrame:
    """Contracts per municipality of the chosen region and state."""
    scope = df.where(S.geo_match(C.Selection(regiao=sel.regiao, uf=sel.uf)))
    return scope.groupBy(label_or(F.col("municipio")).alias("label")).agg(F.count("*").alias("qtd"))
