"""Snapshot comparison: one pair, a whole history, summaries and displayed views.

Snapshots are frames of text columns under canonical names, each row carrying its record
key. A history is compared with one exchange by key: each row looks at the same record's
neighbouring snapshots through a window, so no snapshot is read twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milemark import config as C
from milemark.functions.keys import KEY, record_key
from milemark.functions.text import br_date, br_number, label_map, norm, parse_date, strip_sql
from milemark.operators import joins
from milemark.sources.marks import list_digest
from milemark.sources.naming import canonical_name, canonicalize

ENTERED, EXITED, CHANGED = 1, 2, 3

# How the detail and the cumulative log name the three kinds of change.
DETAIL_TYPES = {ENTERED: "entrou", EXITED: "saiu", CHANGED: "alterado"}
LOG_TYPES = {ENTERED: "Novo", EXITED: "Removido", CHANGED: "Alterado"}
DETAIL_COLUMNS = [
    "tipo_alteracao", "categoria_alteracao", "natureza_campo", "num_convenio", "cod_saci", "campo",
    "valor_anterior", "valor_atual",
]
LOG_COLUMNS = [
    "data", "tipo", "categoria", "natureza", "num_convenio", "cod_saci", "uf", "secretaria", "campo",
    "valor_anterior", "valor_atual",
]
LEGACY_LOG_COLUMNS = [
    "data", "tipo", "natureza", "operacao", "uf", "municipio", "recebedor", "modalidade", "campo",
    "valor_anterior", "valor_atual",
]


def prepare(df: DataFrame, spec: C.DiffSpec) -> DataFrame:
    """Record key from the original header, unless the rows carry it already, then canonical names."""
    keyed = df if KEY in df.columns else df.withColumn(KEY, record_key(df, spec.key_candidates))
    if spec.skip_blank_keys:
        keyed = keyed.where(F.col(KEY).isNotNull())
    return canonicalize(keyed)


def comparable_fields(current: Sequence[str], previous: Sequence[str], spec: C.DiffSpec) -> list[str]:
    """Fields to compare, in the order of the current header."""
    if spec.tracked is not None:
        return list(spec.tracked)
    known = set(previous)
    return [f for f in current if f in known and f not in spec.never_compared]


def field_nature(field: str, spec: C.DiffSpec) -> str:
    if field in spec.source_fields:
        return "dados_origem"
    return "derivado_tempo" if field in spec.time_fields else "derivado_regra"


def _needed(spec: C.DiffSpec, fields: Sequence[str]) -> list[str]:
    extra = [spec.key_source, spec.code_field, spec.value_field, *[s for _, s in spec.carried]]
    return list(dict.fromkeys([*fields, *[e for e in extra if e]]))


def _values(df: DataFrame, names: Sequence[str]) -> Column:
    """The named fields as one array of texts; null and an absent column read as ''.

    Values are stripped later, where two of them differ: nearly all are equal as they stand.
    """
    texts = [f"coalesce(cast(`{n}` as string), '')" if n in df.columns else "''" for n in names]
    return F.expr("array(" + ", ".join(texts) + ")")


_PROFILE_TYPE = "array<struct<i:int,pos:int,campo:string,natureza:string,fonte:boolean>>"


def _profile(fields: Sequence[str], names: Sequence[str], spec: C.DiffSpec) -> str:
    """What is compared, as a literal array: index into the values, position, field, nature."""
    items = [
        f"named_struct('i', {names.index(f)}, 'pos', {n}, 'campo', '{f}', "
        f"'natureza', '{field_nature(f, spec)}', 'fonte', {str(f in spec.source_fields).lower()})"
        for n, f in enumerate(fields, 1)
        if f not in spec.ignored
    ]
    return f"cast(array({', '.join(items)}) as {_PROFILE_TYPE})"


def _with_changes(df: DataFrame, profile: str, spec: C.DiffSpec) -> DataFrame:
    """Adds ``mudancas``, the profile entries whose value moved from ``p`` to ``c``, and their category.

    Rows whose values are all equal skip the field-by-field comparison.
    """
    before, after = strip_sql("p[m.i]"), strip_sql("c[m.i]")
    moved = f"p[m.i] <> c[m.i] and {before} <> {after}"
    for field, literal in spec.systemic:
        moved += f" and not (m.campo = '{field}' and ('{literal}' in ({before}, {after})))"
    changes = f"case when p <> c then filter({profile}, m -> {moved}) else cast(array() as {_PROFILE_TYPE}) end"
    category = """case when not exists(mudancas, x -> x.fonte) then 'derivados_tempo'
        when exists(mudancas, x -> not x.fonte) then 'dados_e_derivados' else 'dados' end"""
    return df.withColumn("mudancas", F.expr(changes)).withColumn("categoria", F.expr(category))


def _one_sided(section: int, values: str, names: Sequence[str], spec: C.DiffSpec) -> str:
    name = "novo_registro" if section == ENTERED else "registro_removido"
    value = strip_sql(f"{values}[{names.index(spec.value_field)}]") if spec.value_field else "''"
    before, after = ("''", value) if section == ENTERED else (value, "''")
    return (
        f"named_struct('secao', {section}, 'pos', 0, 'categoria', '{name}', 'natureza', '{name}', "
        f"'campo', '{spec.value_field or ''}', 'valor_anterior', {before}, 'valor_atual', {after})"
    )


_FIELD_EVENTS = f"""transform(mudancas, m -> named_struct('secao', {CHANGED}, 'pos', m.pos, 'categoria', categoria,
    'natureza', m.natureza, 'campo', m.campo,
    'valor_anterior', {strip_sql("p[m.i]")}, 'valor_atual', {strip_sql("c[m.i]")}))"""


def _identity(row: str, other: str, names: Sequence[str], spec: C.DiffSpec) -> list[Column]:
    """Key, code and carried fields; a blank code falls back to the other row's."""
    at = lambda values, field: strip_sql(f"{values}[{names.index(field)}]")
    number = KEY if spec.key_source is None else f"coalesce(nullif({at(row, spec.key_source)}, ''), {KEY})"
    out = [f"{number} as {spec.key_output}"]
    if spec.code_field is not None:
        code = f"coalesce(nullif({at(row, spec.code_field)}, ''), {at(other, spec.code_field)}, '')"
        out.append(f"{code} as cod_saci")
    return [F.expr(e) for e in [*out, *[f"{at(row, source)} as {name}" for name, source in spec.carried]]]


def _unique(df: DataFrame, spec: C.DiffSpec, values: Column, stored: bool = False) -> DataFrame:
    """Key and values; the check for repeated keys shares the exchange of the join that follows.

    Rows ``stored`` with their key have one, and the key stays as it lies, so that nothing is exchanged.
    """
    missing = f"raise_error('snapshot row without a key ({', '.join(spec.key_candidates)})')"
    keyed = df.select(KEY if stored else F.expr(f"coalesce({KEY}, {missing})").alias(KEY), values)
    counted = keyed.withColumn("_n", F.count("*").over(Window.partitionBy(KEY)))
    once = f"case when _n > 1 then raise_error(concat('duplicated snapshot key: ', {KEY})) else true end"
    return counted.where(F.expr(once)).drop("_n")


def diff_pair(previous: DataFrame, current: DataFrame, spec: C.DiffSpec = C.CONTRACT_DIFF) -> DataFrame:
    """Events between two snapshots: secao, pos, record identity, category, nature, field, values.

    A missing or repeated key in either fails when the plan runs, as in ``diff_history``. Days of ``BucketedSnapshots`` with
    as many buckets meet without an exchange.
    """
    prev, cur = prepare(previous, spec), prepare(current, spec)
    fields = [f for f in comparable_fields(cur.columns, prev.columns, spec) if f != KEY]
    names = _needed(spec, fields)
    p = _unique(prev, spec, _values(prev, names).alias("p"), KEY in previous.columns)
    c = _unique(cur, spec, _values(cur, names).alias("c"), KEY in current.columns)
    both = c.join(p, KEY, "full")
    events = f"""case when p is null then array({_one_sided(ENTERED, "c", names, spec)})
        when c is null then array({_one_sided(EXITED, "p", names, spec)}) else {_FIELD_EVENTS} end"""
    flat = _with_changes(both, _profile(fields, names, spec), spec).select(KEY, "c", "p", F.expr(f"inline({events})"))
    shown = flat.withColumn("r", F.expr("coalesce(c, p)"))
    return shown.select(
        KEY, *_identity("r", "p", names, spec), "secao", "pos", "categoria", "natureza", "campo",
        "valor_anterior", "valor_atual",
    )


def diff_detail(previous: DataFrame, current: DataFrame, spec: C.DiffSpec = C.CONTRACT_DIFF) -> DataFrame:
    """Change detail of a pair; ``secao``, ``num_convenio`` and ``pos`` give the published order."""
    events = diff_pair(previous, current, spec)
    return events.select(
        "secao", "pos",
        _named(F.col("secao"), DETAIL_TYPES).alias("tipo_alteracao"),
        F.col("categoria").alias("categoria_alteracao"),
        F.col("natureza").alias("natureza_campo"),
        F.col(spec.key_output), "cod_saci", "campo", "valor_anterior", "valor_atual",
    )


def order_detail(detail: DataFrame) -> DataFrame:
    """Entered, exited, then changed records, by key in binary order and field position."""
    return detail.orderBy("secao", "num_convenio", "pos")


def _named(section: Column, names: Mapping[int, str]) -> Column:
    return F.when(section == ENTERED, names[ENTERED]).when(section == EXITED, names[EXITED]).otherwise(names[CHANGED])


def diff_history(
    snapshots: DataFrame, headers: Mapping[str, Sequence[str]], spec: C.DiffSpec = C.CONTRACT_DIFF
) -> DataFrame:
    """Events between every two consecutive snapshots.

    ``snapshots`` holds all of them with ``snapshot_date``; ``headers`` gives the columns each
    one had, in date order, so that a column absent from a snapshot is not compared with it.
    """
    days = sorted(headers)
    prepared = _prepare_history(snapshots, headers, spec)
    pairs, fields = _compared(headers, spec)
    names = _needed(spec, fields)
    known = ", ".join(f"'{d}'" for d in days)
    rows = prepared.select(*_placed(days, spec), _values(prepared, names).alias("c"))
    w = Window.partitionBy(KEY).orderBy("ord")
    seen = rows.select(
        KEY, "ord", "c",
        F.lag(F.struct("ord", "c")).over(w).alias("l"),
        F.lead("ord").over(w).alias("next"),
    )
    # Part of the filter, so that no row escapes the check by being filtered first.
    repeated = f"raise_error(concat('duplicated snapshot key: ', {KEY}))"
    leaves = f"(ord < {len(days)} and coalesce(next <> ord + 1, true))"
    checked = seen.where(f"case when l.ord = ord then {repeated} else ord > 1 or {leaves} end")
    paired = checked.select(
        KEY, "ord", "c",
        F.expr("case when l.ord = ord - 1 then l.c end").alias("p"),
        F.expr(leaves).alias("leaves"),
    )
    # Days that compare the same fields share one profile.
    profiles = list(dict.fromkeys(tuple(f) for f in pairs.values())) or [()]
    which = ", ".join(["1"] + [str(profiles.index(tuple(pairs[d])) + 1) for d in days[1:]])
    literals = ", ".join(_profile(f, names, spec) for f in profiles)
    profile = f"element_at(array({literals}), element_at(array({which}), ord))"
    nothing = "cast(array() as array<struct<secao:int,pos:int,categoria:string,natureza:string,campo:string,valor_anterior:string,valor_atual:string>>)"
    events = f"""concat(
        case when p is null and ord > 1 then array({_one_sided(ENTERED, "c", names, spec)}) else {nothing} end,
        case when leaves then array({_one_sided(EXITED, "c", names, spec)}) else {nothing} end,
        {_FIELD_EVENTS})"""
    changed = _with_changes(paired, profile, spec)
    flat = changed.select(KEY, "ord", "c", "p", F.expr(f"inline({events})"))
    # Only a changed record borrows a missing code from the row before it.
    flat = flat.withColumn("o", F.expr(f"case when secao = {CHANGED} then p end"))
    at_day = f"element_at(array({known}), ord + if(secao = {EXITED}, 1, 0))"
    return flat.select(
        F.expr(at_day).alias("data"), "secao", "pos", *_identity("c", "o", names, spec), "categoria", "natureza",
        "campo", "valor_anterior", "valor_atual",
    )


def _compared(headers: Mapping[str, Sequence[str]], spec: C.DiffSpec) -> tuple[dict[str, list[str]], list[str]]:
    """The fields in which each day is compared with the one before, and all of them."""
    days = sorted(headers)
    canon = {d: canonical_header(headers[d]) for d in days}
    pairs = {d: comparable_fields(canon[d], canon[p], spec) for p, d in zip(days, days[1:])}
    return pairs, list(dict.fromkeys(f for d in reversed(days[1:]) for f in pairs[d]))


def _placed(days: Sequence[str], spec: C.DiffSpec) -> list[Column]:
    """Key and number of the day; a row without a key fails before anything is shuffled."""
    known = ", ".join(f"'{d}'" for d in days)
    missing = f"raise_error('snapshot row without a key ({', '.join(spec.key_candidates)})')"
    day = f"cast(array_position(array({known}), cast(snapshot_date as string)) as int)"
    return [F.expr(f"coalesce({KEY}, {missing})").alias(KEY), F.expr(day).alias("ord")]


def record_digests(
    snapshots: DataFrame, headers: Mapping[str, Sequence[str]], spec: C.DiffSpec, more: Sequence[str] = ()
) -> DataFrame:
    """Key, ``ord`` (number of the day), ``digest_0`` and so on, and ``more``.

    There is a digest for each list of fields that days are compared by, null on days that are not compared by it. Where each
    of them is equal on all days of a record that have it, no field that ``diff_history`` compares has changed.
    """
    days = sorted(headers)
    prepared = _prepare_history(snapshots, headers, spec, more)
    by_list: dict[tuple[str, ...], set[int]] = {}
    for d, fields in _compared(headers, spec)[0].items():
        n = days.index(d)
        by_list.setdefault(tuple(sorted(set(fields) - set(spec.ignored))), set()).update((n, n + 1))
    key, ord_ = _placed(days, spec)
    digests = []
    for i, (fields, ords) in enumerate(by_list.items()):
        own = list_digest(F.array(F.lit(""), *[F.expr(f"coalesce(cast(`{f}` as string), '')") for f in fields if f in prepared.columns]))
        digests.append((own if len(ords) == len(days) else F.when(ord_.isin(sorted(ords)), own)).alias(f"digest_{i}"))
    return prepared.select(key, ord_, *digests, *more)


def canonical_header(header: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(canonical_name(h) for h in header))


def _prepare_history(
    snapshots: DataFrame, headers: Mapping[str, Sequence[str]], spec: C.DiffSpec, more: Sequence[str] = ()
) -> DataFrame:
    """``prepare`` for merged snapshots: each row takes a field from the column its own snapshot had."""
    keyed = snapshots.withColumn(KEY, record_key(snapshots, spec.key_candidates))
    if spec.skip_blank_keys:
        keyed = keyed.where(F.col(KEY).isNotNull())
    winners: dict[str, dict[str, list[str]]] = {}
    for day, header in headers.items():
        for name, source in {canonical_name(h): h for h in header}.items():
            winners.setdefault(name, {}).setdefault(source, []).append(day)
    columns = []
    for name, by_source in winners.items():
        if len(by_source) == 1:
            value = F.col(f"`{next(iter(by_source))}`")
        else:
            value = F.coalesce(
                *[
                    F.when(F.col("snapshot_date").cast("string").isin(days), F.coalesce(F.col(f"`{source}`"), F.lit("")))
                    for source, days in by_source.items()
                ]
            )
        columns.append(value.alias(name))
    return keyed.select(KEY, "snapshot_date", *columns, *more)


def change_log(history: DataFrame) -> DataFrame:
    """Cumulative log of a contract history with its published columns."""
    return history.withColumn("tipo", _named(F.col("secao"), LOG_TYPES)).select(*LOG_COLUMNS)


def legacy_log(history: DataFrame) -> DataFrame:
    return history.withColumn("tipo", _named(F.col("secao"), LOG_TYPES)).select(*LEGACY_LOG_COLUMNS)


def order_history(history: DataFrame) -> DataFrame:
    return history.orderBy("data", "secao", "num_convenio", "pos")


# --- summaries ----------------------------------------------------------------


def headline(detail: DataFrame) -> DataFrame:
    """Records entered, exited and changed; changed ones split by whether source data moved."""
    return _counted(detail, ()).select(*HEADLINE)


HEADLINE = ["entered", "exited", "changed_records", "changed_data_records", "changed_time_records"]


def _counted(detail: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The headline and ``s0``, ``s1`` ... (changes of each field) in one row: per record first, then over the records."""
    key = F.coalesce(F.nullif(F.col("num_convenio"), F.lit("")), F.col("cod_saci"))
    kind, category, n = F.col("tipo_alteracao"), F.col("categoria_alteracao"), F.col("n")
    altered = kind == "alterado"
    per_record = detail.groupBy(kind, category, key.alias("k")).agg(
        F.count("*").alias("n"), *[F.count_if(altered & (F.col("campo") == f)).alias(f"s{i}") for i, f in enumerate(fields)]
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_record.agg(
        total(F.when(kind == "entrou", n)).alias("entered"),
        total(F.when(kind == "saiu", n)).alias("exited"),
        F.count_if(altered).alias("changed_records"),
        F.count_if(altered & (category != "derivados_tempo")).alias("changed_data_records"),
        F.count_if(altered & (category == "derivados_tempo")).alias("changed_time_records"),
        *[total(F.col(f"s{i}")).alias(f"s{i}") for i in range(len(fields))],
    )


def diff_summary(
    previous: DataFrame | None,
    current: DataFrame,
    dates: Mapping[str, str | None],
    detail: DataFrame | None = None,
) -> DataFrame:
    """One nested row: dates, totals, headline and status counters; nulls on a first run.

    ``dates`` has the keys atual, anterior and primeiro.
    """
    head = current.agg(F.count("*").alias("total_atual"))
    days = [
        F.lit(dates.get(k)).cast("string").alias(f"snapshot_{k}") for k in ("atual", "anterior", "primeiro")
    ]
    if previous is None:
        empty = F.lit(None).cast("bigint")
        stats = F.lit(None).cast("struct<" + ",".join(f"{n}:bigint" for n in HEADLINE) + ">")
        status = F.lit(None).cast("struct<" + ",".join(f"{n}:bigint" for n in C.STATUS_FIELDS) + ">")
        return head.select(
            *days, "total_atual", empty.alias("total_anterior"), empty.alias("delta_total"),
            stats.alias("resumo"), status.alias("mudancas_status"),
        )
    detail = diff_detail(previous, current) if detail is None else detail
    # The detail is read once; the two totals are counts of one column each.
    now, before = head.scalar(), previous.agg(F.count("*").alias("n")).scalar()
    status = F.struct(*[F.col(f"s{i}").alias(f) for i, f in enumerate(C.STATUS_FIELDS)])
    return _counted(detail, C.STATUS_FIELDS).select(
        *days, now.alias("total_atual"), before.alias("total_anterior"), (now - before).alias("delta_total"),
        F.struct(*HEADLINE).alias("resumo"), status.alias("mudancas_status"),
    )


def legacy_summary(history: DataFrame, snapshots: DataFrame, days: Sequence[str]) -> DataFrame:
    """Headline of the last pair of a legacy history; zeros when there is no pair."""
    days = sorted(days)
    last, before = days[-1], days[-2] if len(days) > 1 else None
    per_record = history.where(F.col("data") == last).select("secao", "operacao").distinct()
    stats = per_record.agg(
        F.struct(
            F.count_if(F.col("secao") == ENTERED).alias("entered"),
            F.count_if(F.col("secao") == EXITED).alias("exited"),
            F.count_if(F.col("secao") == CHANGED).alias("changed_records"),
        )
    ).scalar()
    day = F.col("snapshot_date").cast("string")
    totals = snapshots.agg(
        F.count_if(day == last).alias("total_atual"),
        (F.count_if(day == before) if before else F.first(F.lit(None).cast("bigint"))).alias("total_anterior"),
    )
    return totals.select(
        F.lit(last).alias("snapshot_atual"), F.lit(before).cast("string").alias("snapshot_anterior"),
        F.lit(days[0]).alias("snapshot_primeiro"), "total_atual", "total_anterior",
        F.coalesce(F.col("total_atual") - F.col("total_anterior"), F.lit(0)).alias("delta_total"),
        stats.alias("resumo"),
    )


# --- row labels and views -----------------------------------------------------


def label_changes(current: DataFrame, previous: DataFrame, fields: Sequence[str] = tuple(C.ROW_LABEL_FIELDS)) -> DataFrame:
    """Current rows with ``alteracao`` (Novo, Alterado, Sem alteração) and the fields that changed."""
    joined = joins.previous_row(current, previous, fields)
    prev = F.col("prev")
    changed = F.array_compact(
        F.array(*[F.when(norm(F.col(f)) != norm(prev[f]), F.lit(f)) for f in fields])
    )
    fields_out = F.when(prev.isNull(), F.array().cast("array<string>")).otherwise(changed)
    label = F.when(F.col("prev").isNull(), "Novo").when(F.size("campos") > 0, "Alterado").otherwise("Sem alteração")
    return joined.withColumn("campos", fields_out).withColumn("alteracao", label).drop("prev")


def _or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))


def _shown(value: Column, field: Column, money: Sequence[str], dates: Sequence[str] = ()) -> Column:
    number = value.try_cast("decimal(38,6)")
    day = parse_date(value)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "(vazio)")
        .when(field.isin(list(money)) & number.isNotNull(), br_number(number))
        .when(field.isin(list(dates)) & day.isNotNull(), br_date(day))
        .otherwise(value)
    )


def change_view(log: DataFrame) -> DataFrame:
    """Displayed change log: labels for fields and natures, markers for blanks."""
    nature, field = F.col("natureza"), F.col("campo")
    code = F.col("cod_saci") if "cod_saci" in log.columns else F.col("cod_tci")
    day = parse_date(F.col("data"))
    return log.select(
        day.alias("data"),
        br_date(day, "(vazio)").alias("data_fmt"),
        _or_dash(F.col("categoria")).alias("categoria"),
        F.coalesce(F.nullif(nature, F.lit("")), F.lit("derivado_regra")).alias("natureza_raw"),
        label_map(nature, C.NATURE_LABELS, F.lit("Mudança derivada")).alias("natureza"),
        _or_dash(F.col("num_convenio")).alias("num_convenio"),
        _or_dash(code).alias("cod_tci"),
        _or_dash(F.col("uf")).alias("uf"),
        _or_dash(F.col("secretaria")).alias("secretaria"),
        _or_dash(F.col("tipo")).alias("tipo"),
        label_map(field, C.CHANGE_FIELD_LABELS, _or_dash(field)).alias("campo"),
        _shown(F.col("valor_anterior"), field, C.MONEY_FIELDS).alias("anterior"),
        _shown(F.col("valor_atual"), field, C.MONEY_FIELDS).alias("atual"),
    )


def legacy_change_view(log: DataFrame) -> DataFrame:
    nature, field = F.col("natureza"), F.col("campo")
    day = parse_date(F.col("data"))
    natures = {k: v for k, v in C.NATURE_LABELS.items() if not k.startswith("derivado")}
    shown = lambda c: _shown(F.col(c), field, C.LEGACY_MONEY_FIELDS, ["previsao_retomada"])
    return log.select(
        day.alias("data"),
        br_date(day, "(vazio)").alias("data_fmt"),
        F.coalesce(F.nullif(nature, F.lit("")), F.lit("dados_origem")).alias("natureza_raw"),
        label_map(nature, natures, F.lit("Mudança de dado")).alias("natureza"),
        *[_or_dash(F.col(c)).alias(c) for c in ("operacao", "uf", "municipio", "recebedor", "modalidade", "tipo")],
        label_map(field, C.LEGACY_FIELD_LABELS, _or_dash(field)).alias("campo"),
        shown("valor_anterior").alias("anterior"),
        shown("valor_atual").alias("atual"),
    )


def newest_first(view: DataFrame) -> DataFrame:
    """Latest day first; record and field after it keep one busy day from filling one task."""
    record = "operacao" if "operacao" in view.columns else "num_convenio"
    return view.orderBy(F.desc_nulls_last("data"), record, "campo")
