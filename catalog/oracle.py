"""DuckDB SQL for every registered query, over the same test tables.

The SQL takes other roads than the plans where it can: weekdays are counted one by one,
keys are compared as decimals, snapshots are compared pair by pair in long form.
"""

from __future__ import annotations

from milemark import config as C

AS_OF, EXEMPT, CUTOFF = "DATE '1998-11-01'", "DATE '1998-01-01'", "DATE '1998-07-17'"
DEC = "DECIMAL(18,2)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


CONTRACTS = f"""
lic AS (
  SELECT l_orderkey AS lk,
         min(l_shipdate::DATE) FILTER (WHERE l_returnflag = 'A') AS pub,
         min(l_shipdate::DATE) FILTER (WHERE l_returnflag = 'R') AS hom
  FROM lineitem GROUP BY l_orderkey),
ord AS (
  SELECT o.o_orderkey AS k, o.o_orderkey::VARCHAR AS kt, o.o_orderdate::DATE AS d, o.*, c.*, n.n_name, r.r_name, lic.pub, lic.hom
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN lic ON lic.lk = o.o_orderkey),
c1 AS (
  SELECT k,
    CASE WHEN k % 101 = 0 THEN '' WHEN k % 4 = 0 THEN kt || '.0' WHEN k % 4 = 1 THEN '0' || kt ELSE kt END AS num_convenio,
    '1-' || kt AS cod_tci,
    CASE WHEN k % 20 = 0 THEN 'FIN' ELSE 'OGU' END AS fonte,
    CASE WHEN k % 43 = 0 THEN 'OUTRA SELECAO' ELSE 'NOVO PAC - Seleção' END AS fase,
    CASE WHEN k % 53 <> 0 THEN c_mktsegment END AS secretaria,
    r_name AS regiao, n_name AS uf, CASE WHEN k % 59 = 0 THEN ' ' ELSE c_name END AS municipio,
    'Prefeitura de ' || c_name AS proponente, o_orderpriority AS modalidade,
    CASE WHEN k % 37 = 0 THEN 'Cancelado ou Distratado' WHEN k % 41 = 0 THEN 'Contratado - Em Prestação de Contas'
         WHEN o_orderstatus = 'P' THEN 'Contratado - Suspensiva' WHEN o_orderstatus = 'F' THEN 'Contratado - Normal'
         ELSE 'Em Contratação' END AS situacao,
    CASE WHEN k % 47 <> 0 THEN d END AS dt_assinatura,
    CASE WHEN k % 11 <> 0 THEN ({_list(C.SUSPENSIVA_ORDER)})[(k % 7 + 1)::INT] END AS situacao_suspensiva,
    CASE WHEN k % 7 <> 0 THEN d + (180 + k % 120)::INT END AS dt_vencimento_suspensiva,
    CASE WHEN o_orderstatus = 'F' THEN d + (90 + k % 60)::INT END AS dt_retirada_suspensiva,
    CASE WHEN k % 3 <> 0 THEN d + (100 + k % 45)::INT END AS dt_lae,
    pub AS dt_pub_licitacao, hom AS dt_homolog_licitacao,
    CASE WHEN k % 2 = 0 THEN hom + (20 + k % 30)::INT END AS dt_vrpl,
    CASE WHEN k % 61 <> 0 THEN (o_totalprice::{DEC} * 30)::{DEC} END AS vlr_repasse
  FROM ord),
c2 AS (SELECT *, CASE WHEN k % 5 <> 0 THEN dt_vrpl + 15 END AS dt_aio FROM c1),
contracts AS (SELECT *, CASE WHEN k % 3 = 0 THEN dt_aio + (k % 25)::INT END AS dt_inicio_obra FROM c2),
selected AS (
  SELECT * FROM contracts
  WHERE fonte = 'OGU' AND fase = 'NOVO PAC - Seleção' AND secretaria IS NOT NULL AND secretaria <> 'MACHINERY')"""


def weekdays(a: str, b: str) -> str:
    """Days in (a, b] one by one."""
    return (
        f"len(list_filter(generate_series(1, greatest(date_diff('day', {a}, {b}), 0)), "
        f"lambda i: isodow({a} + i::INT) < 6))"
    )


def derived(src: str, as_of: str = AS_OF, extra: str = "") -> str:
    """Every derived column over a frame of contracts."""
    cancelled = "coalesce(situacao = 'Cancelado ou Distratado', false)"
    exempt = f"coalesce(dt_assinatura < {EXEMPT}, false)"

    def status(done: str, due: str) -> str:
        return (
            f"if({done} <= {due}, 'Concluída no prazo', if({done} IS NOT NULL, 'Concluída em atraso', "
            f"if({as_of} > {due}, 'Vencida', if({due} - {as_of} <= 30, 'Próximos 30 dias', 'No prazo'))))"
        )

    return f"""
SELECT *,
  CASE WHEN dt_retirada_suspensiva IS NOT NULL THEN 'RETIRADA' WHEN dt_vencimento_suspensiva IS NOT NULL THEN 'PENDENTE'
       ELSE 'SEM SUSPENSIVA' END AS status_suspensiva,
  if(dt_pub_licitacao IS NULL, 'NAO', 'SIM') AS flag_publicacao_licitacao,
  if(dt_homolog_licitacao IS NULL, 'NAO', 'SIM') AS flag_homologacao_licitacao,
  greatest(dt_inicio_obra, dt_aio, dt_vrpl, dt_homolog_licitacao, dt_pub_licitacao, dt_lae) AS ultima_data_relevante,
  CASE WHEN dt_inicio_obra IS NOT NULL THEN 'OBRA INICIADA' WHEN dt_aio IS NOT NULL THEN 'AIO'
       WHEN dt_vrpl IS NOT NULL THEN 'VRPL' WHEN dt_homolog_licitacao IS NOT NULL THEN 'HOMOLOGACAO'
       WHEN dt_pub_licitacao IS NOT NULL THEN 'PUBLICACAO LICITACAO' WHEN dt_lae IS NOT NULL THEN 'LAE'
       WHEN dt_retirada_suspensiva IS NOT NULL THEN 'SUSPENSIVA RETIRADA'
       WHEN dt_vencimento_suspensiva IS NOT NULL THEN 'SUSPENSIVA' ELSE 'SEM ANDAMENTO' END AS fase_atual,
  (dt_pub_licitacao - dt_lae)::BIGINT AS dias_ate_publicacao,
  (dt_homolog_licitacao - dt_pub_licitacao)::BIGINT AS dias_publicacao_ate_homologacao,
  (dt_vrpl - dt_homolog_licitacao)::BIGINT AS dias_homologacao_ate_vrpl,
  (dt_aio - dt_vrpl)::BIGINT AS dias_vrpl_ate_aio,
  (dt_inicio_obra - dt_aio)::BIGINT AS dias_aio_ate_inicio_obra,
  CASE WHEN vlr_repasse >= 10000000 OR vlr_repasse IS NULL THEN 'ACIMA DE 10 MI' WHEN vlr_repasse >= 5000000 THEN '5 A 10 MI'
       WHEN vlr_repasse >= 1000000 THEN '1 A 5 MI' ELSE 'ATE 1 MI' END AS faixa_repasse,
  if({exempt}, NULL, dt_lae + 60) AS prazo_pub_licitacao,
  dt_lae + 120 AS dt_lae_mais_60, dt_lae + 300 AS dt_lae_mais_60_mais_120,
  if({exempt}, NULL, dt_pub_licitacao + 120) AS prazo_homolog_120d,
  {CUTOFF} AS data_limite_licitacao_casa_civil,
  greatest(if({exempt}, NULL, dt_pub_licitacao + 120), {CUTOFF}) AS prazo_homolog_licitacao,
  CASE WHEN dt_aio IS NOT NULL THEN
    dt_aio + list_filter(generate_series(1, 16), lambda i: isodow(dt_aio + i::INT) < 6)[10]::INT END AS prazo_inicio_obra,
  CASE WHEN {cancelled} THEN 'Fora do escopo'
       WHEN greatest(dt_pub_licitacao, dt_homolog_licitacao, dt_inicio_obra) <= {CUTOFF} AND dt_pub_licitacao IS NOT NULL
        AND dt_homolog_licitacao IS NOT NULL AND dt_inicio_obra IS NOT NULL THEN 'Cumpriu o prazo'
       ELSE 'Pendente' END AS status_regra_casa_civil,
  if({exempt} OR dt_lae IS NULL OR {cancelled}, NULL, {status('dt_pub_licitacao', '(dt_lae + 60)')}) AS status_pub_licitacao,
  CASE WHEN {exempt} THEN NULL
       WHEN dt_homolog_licitacao IS NOT NULL AND dt_pub_licitacao IS NULL THEN 'Inconsistência de base'
       WHEN dt_pub_licitacao IS NULL OR {cancelled} THEN NULL
       ELSE {status('dt_homolog_licitacao', f'greatest(dt_pub_licitacao + 120, {CUTOFF})')} END AS status_homolog_licitacao,
  CASE WHEN dt_aio IS NULL OR {cancelled} THEN NULL
       WHEN dt_inicio_obra <= prazo_inicio_obra THEN 'Iniciada no prazo'
       WHEN dt_inicio_obra IS NOT NULL THEN 'Iniciada em atraso'
       WHEN {as_of} > prazo_inicio_obra THEN 'Prazo vencido'
       WHEN {weekdays(as_of, 'prazo_inicio_obra')} <= 10 THEN 'Próximos 10 dias úteis'
       ELSE 'No prazo' END AS status_inicio_obra,
  CASE WHEN dt_retirada_suspensiva IS NOT NULL OR {cancelled} THEN NULL
       WHEN dt_vencimento_suspensiva IS NULL THEN 'Sem data' WHEN dt_vencimento_suspensiva < {as_of} THEN 'Vencida'
       WHEN dt_vencimento_suspensiva - {as_of} <= 30 THEN 'Próximos 30 dias'
       WHEN dt_vencimento_suspensiva - {as_of} <= 90 THEN '31–90 dias' ELSE 'Mais de 90 dias' END AS urgencia_suspensiva,
  CASE WHEN situacao IN {_in(C.INATIVAS)} THEN 'Não se aplica'
       WHEN situacao_suspensiva = 'Suspensiva retirada' THEN 'situacao_da_analise_suspensiva_pbi'
       WHEN dt_aio IS NOT NULL THEN 'dte_aio_tdb' WHEN dt_inicio_obra IS NOT NULL THEN 'dte_inicio_obra_mcid_saci'
       END AS motivo_suspensiva_retirada_dmp,
  if(dt_assinatura >= {EXEMPT}, 'Nova PC 32', if(dt_assinatura IS NOT NULL, 'Antiga PC 32', NULL)) AS pos_72,
  year(dt_assinatura)::VARCHAR AS ano{extra}
FROM {src}"""


PREVIOUS = f"""
SELECT * REPLACE (
  CASE WHEN k % 13 <> 0 THEN dt_aio END AS dt_aio, CASE WHEN k % 19 <> 0 THEN dt_pub_licitacao END AS dt_pub_licitacao,
  if(k % 17 = 0, 'Em Contratação', situacao) AS situacao,
  if(k % 23 = 0, (vlr_repasse - 100)::{DEC}, vlr_repasse) AS vlr_repasse)
FROM selected WHERE k % 97 <> 1"""

DOCS = list(C.DOC_LABELS)


def _docs(src: str) -> str:
    cells = []
    for i, name in enumerate(DOCS):
        other = "NULL" if name == "doc_trabalho_social" else f"if(k % {i + 3} = 0, 'NÃO', 'SIM')"
        cells.append(
            f"CASE k % 6 WHEN 0 THEN if(k % {i + 3} = 0, 'Não Apresentado', 'Apresentado') WHEN 1 THEN {other} END AS {name}"
        )
    return (
        "SELECT *, CASE k % 6 WHEN 0 THEN 'Documentos apresentados' WHEN 1 THEN 'Documentos não apresentados' END "
        f"AS tipo_doc_suspensiva, {', '.join(cells)} FROM {src}"
    )


PANEL = f"{CONTRACTS},\npanel AS ({derived('selected')})"
BOTH = f"{PANEL},\nprev0 AS ({PREVIOUS}),\nprev AS ({derived('prev0', 'DATE ' + q('1998-10-01'))})"
DOCPANEL = f"{PANEL},\ndocs AS ({_docs('panel')})"
PENDING_LIST = "list_filter([" + ", ".join(
    f"if({n} = CASE tipo_doc_suspensiva WHEN 'Documentos apresentados' THEN 'Não Apresentado' ELSE 'NÃO' END, {q(label)}, NULL)"
    for n, label in C.DOC_LABELS.items()
) + "], lambda x: x IS NOT NULL)"


def key(c: str) -> str:
    """Numeric texts as one decimal, others as text."""
    return f"CASE WHEN regexp_full_match({c}, '[0-9]+(\\.[0-9]+)?') THEN 'N' || ({c}::DECIMAL(30,6))::VARCHAR ELSE 'T' || {c} END"


ORDER_DAY = "coalesce(dt_assinatura, DATE '1995-01-01')"
SOURCES = f"""{CONTRACTS},
saci AS (SELECT *, lpad((k % 9999999)::VARCHAR, 7, '0') AS cod_ibge, 'Obra ' || k AS objeto, {ORDER_DAY} + 3 AS dte_carga FROM contracts),
pbi AS (SELECT if(k % 1009 = 0, '', k::VARCHAR) AS instrumento, situacao_suspensiva, dt_vencimento_suspensiva,
        {ORDER_DAY} + 5 AS data_atualizacao FROM contracts),
tdb AS (SELECT num_convenio AS siafi, dt_lae, dt_vrpl, dt_aio, {ORDER_DAY} + 7 AS dte_posicao FROM contracts WHERE num_convenio <> ''),
tcon AS (SELECT k || '.00' AS nc, dt_retirada_suspensiva, {ORDER_DAY} + 9 AS dte_carga FROM contracts),
licit AS (SELECT if(l_orderkey % 23 = 0 AND l_linenumber % 2 = 0, l_orderkey || '.0', '00' || l_orderkey) AS nc,
          if(l_returnflag = 'A', l_shipdate::DATE, NULL) AS pub, if(l_returnflag = 'R', l_shipdate::DATE, NULL) AS hom,
          l_shipdate::DATE + 1 AS dte_carga FROM lineitem),
s29 AS (SELECT num_convenio AS instrumento, 'mês ' || (k % 12 + 1) AS perspectiva FROM contracts WHERE k % 9 = 0 AND num_convenio <> ''),
tabs AS ({_docs('contracts')}),
firsts AS (SELECT nc, min(pub) AS pub, min(hom) AS hom FROM licit GROUP BY nc)"""

_doc_fields = ", ".join(DOCS)
DOC_UNION = f"""{SOURCES},
du AS (SELECT tipo_doc_suspensiva, k::VARCHAR AS instrumento, 'P' || k AS proposta, k::VARCHAR AS operacao, proponente AS recebedor, uf,
       municipio AS municipio_beneficiado, 'GIGOV ' || uf AS unidade_caixa, modalidade AS programa, vlr_repasse AS valor_repasse,
       situacao_suspensiva AS situacao_da_analise, {_doc_fields}, {ORDER_DAY} + 11 AS dt_atualizacao
       FROM tabs WHERE tipo_doc_suspensiva IS NOT NULL)"""

ENRICH_SOURCE = f"""
SELECT s.cod_tci, s.num_convenio, s.uf, s.regiao, s.cod_ibge, s.municipio, s.proponente, s.objeto, s.secretaria, s.fase, s.modalidade,
  s.situacao, s.dt_assinatura, p.situacao_suspensiva, p.dt_vencimento_suspensiva, t.dt_retirada_suspensiva, b.dt_lae,
  f1.pub AS dt_pub_licitacao, f2.hom AS dt_homolog_licitacao, b.dt_vrpl, b.dt_aio, s.dt_inicio_obra, s.vlr_repasse,
  s29.perspectiva AS perspectiva_de_retirada_da_suspensiva, {', '.join('x.' + n for n in DOCS)}, x.tipo_doc_suspensiva
FROM saci s LEFT JOIN pbi p ON {key('s.num_convenio')} = {key('p.instrumento')}
LEFT JOIN tdb b ON s.num_convenio = b.siafi
LEFT JOIN firsts f1 ON {key('s.num_convenio')} = {key('f1.nc')}
LEFT JOIN firsts f2 ON {key('s.num_convenio')} = {key('f2.nc')}
LEFT JOIN tcon t ON {key('s.num_convenio')} = {key('t.nc')}
LEFT JOIN s29 ON s.num_convenio = s29.instrumento
LEFT JOIN (SELECT * FROM tabs WHERE tipo_doc_suspensiva IS NOT NULL) x ON {key('s.num_convenio')} = {key('x.k::VARCHAR')}
WHERE s.fonte = 'OGU' AND s.fase = 'NOVO PAC - Seleção' AND s.secretaria <> 'MACHINERY'"""

# --- snapshots ----------------------------------------------------------------

SNAP_FIELDS = [
    n for n in C.BASE_COLUMNS if n not in ("cod_saci", "cod_ibge", "objeto", "perspectiva_de_retirada_da_suspensiva")
]


def _snap(i: int) -> str:
    edits = {
        1: f"SELECT * REPLACE (if(k % 11 = 0, NULL, dt_aio) AS dt_aio, if(k % 13 = 0, (vlr_repasse - 100)::{DEC}, vlr_repasse) AS vlr_repasse, "
           "if(k % 17 = 0, 'Em Contratação', situacao) AS situacao) FROM docs0 WHERE k % 89 <> 1",
        2: "SELECT * FROM docs0 WHERE k % 97 <> 1",
    }
    moved = "SELECT * REPLACE (if(k % 19 = 0, dt_vencimento_suspensiva + 1, dt_vencimento_suspensiva) AS dt_vencimento_suspensiva) FROM docs0 WHERE k % 97 <> 1"
    return edits.get(i, moved)


def _header(i: int) -> list[str]:
    return [C.BASE_COLUMNS[n] for n in SNAP_FIELDS if i >= 3 or n != "tipo_doc_suspensiva"]


def _snapshots(ids: list[int]) -> str:
    parts = [f"{CONTRACTS},\ndocs0 AS ({_docs('selected')})"]
    for i in ids:
        as_of = "DATE " + q(["1998-11-01", "1998-11-02", "1998-11-16", "1998-11-16"][i - 1])
        parts.append(f"e{i} AS ({_snap(i)})")
        parts.append(f"d{i} AS ({derived(f'e{i}', as_of)})")
        cols = ", ".join(f"coalesce({n}::VARCHAR, '') AS {C.BASE_COLUMNS[n]}" for n in SNAP_FIELDS)
        parts.append(
            f"s{i} AS (SELECT coalesce(nullif(num_convenio, ''), cod_tci) AS chave, {cols} FROM d{i})"
        )
    return ",\n".join(parts)


def _pair(p: int, c: int) -> str:
    """Long-form comparison of two snapshots."""
    header = [h for h in _header(c) if h in _header(p)]
    fields = [h for h in header if h not in ("num_convenio_saci", "cod_tci_saci")]
    compared = [f for f in fields if f not in C.CONTRACT_DIFF.ignored]
    cells = ", ".join(
        f"{{'pos': {fields.index(f) + 1}, 'campo': {q(f)}, 'a': p.{f}, 'b': c.{f}, "
        f"'src': {str(f in C.SOURCE_FIELDS).lower()}, "
        f"'nat': {q('dados_origem' if f in C.SOURCE_FIELDS else 'derivado_tempo' if f in C.TIME_FIELDS else 'derivado_regra')}}}"
        for f in compared
    )
    data = q(["1998-11-01", "1998-11-02", "1998-11-16", "1998-11-17"][c - 1])
    ident = "{0}.num_convenio_saci AS nc, {0}.cod_tci_saci AS cod_saci, {0}.txt_uf_saci AS uf, {0}.txt_sigla_secretaria_saci AS secretaria"
    return f"""
w{c} AS (SELECT c.chave, {ident.format('c')}, unnest([{cells}], recursive := true) FROM s{c} c JOIN s{p} p USING (chave)),
x{c} AS (SELECT *, max(src::INT) OVER (PARTITION BY chave) AS has_src, min(src::INT) OVER (PARTITION BY chave) AS all_src
         FROM w{c} WHERE a <> b AND NOT (campo = 'prazo_homolog_licitacao_calc' AND (a = '2026-06-01' OR b = '2026-06-01'))),
ev{c} AS (
  SELECT {data} AS data, 1 AS secao, 0 AS pos, coalesce(nullif(nc, ''), chave) AS num_convenio, cod_saci, uf, secretaria,
         'novo_registro' AS categoria, 'novo_registro' AS natureza, 'vlr_repasse_saci' AS campo, '' AS valor_anterior, vlr AS valor_atual
  FROM (SELECT c.chave, {ident.format('c')}, c.vlr_repasse_saci AS vlr FROM s{c} c ANTI JOIN s{p} p USING (chave))
  UNION ALL
  SELECT {data}, 2, 0, coalesce(nullif(nc, ''), chave), cod_saci, uf, secretaria, 'registro_removido', 'registro_removido', 'vlr_repasse_saci', vlr, ''
  FROM (SELECT p.chave, {ident.format('p')}, p.vlr_repasse_saci AS vlr FROM s{p} p ANTI JOIN s{c} c USING (chave))
  UNION ALL
  SELECT {data}, 3, pos, coalesce(nullif(nc, ''), chave), cod_saci, uf, secretaria,
         CASE WHEN has_src = 1 AND all_src = 0 THEN 'dados_e_derivados' WHEN has_src = 1 THEN 'dados' ELSE 'derivados_tempo' END,
         nat, campo, a, b FROM x{c})"""


PAIR = _snapshots([1, 2]) + "," + _pair(1, 2)
HISTORY = (
    _snapshots([1, 2, 3, 4]) + "," + ",".join(_pair(i - 1, i) for i in (2, 3, 4))
    + ",\nhist AS (SELECT * FROM ev2 UNION ALL SELECT * FROM ev3 UNION ALL SELECT * FROM ev4)"
)


def _runs() -> str:
    """Runs of unchanged days: a row begins one unless the day before has the record with the same text."""
    whole = lambda i: "concat_ws(chr(1), " + ", ".join(h if h in _header(i) else "''" for h in _header(4)) + ")"
    days = " UNION ALL ".join(f"SELECT chave, {i} AS o, {whole(i)} AS t FROM s{i}" for i in (1, 2, 3, 4))
    return f"""days AS ({days}),
begun AS (SELECT *, coalesce(lag(o) OVER w = o - 1 AND lag(t) OVER w = t, false) AS same FROM days WINDOW w AS (PARTITION BY chave ORDER BY o)),
runs AS (SELECT chave, o, sum((NOT same)::INT) OVER (PARTITION BY chave ORDER BY o) AS run FROM begun)"""


def _case(c: str, labels: dict[str, str], default: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in labels.items()) + f" ELSE {default} END"


def br_money(c: str) -> str:
    """1234.5 -> 1.234,50"""
    return f"translate(format('{{:,.2f}}', ({c})::DOUBLE), ',.', '.,')"


def _shown(c: str, money: list[str], dates: tuple[str, ...] = ()) -> str:
    out = f"CASE WHEN {c} = '' THEN '(vazio)' WHEN campo IN {_in(money)} AND TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN {br_money(f'TRY_CAST({c} AS DOUBLE)')} "
    if dates:
        out += f"WHEN campo IN {_in(dates)} AND TRY_CAST({c} AS DATE) IS NOT NULL THEN strftime(TRY_CAST({c} AS DATE), '%d/%m/%Y') "
    return out + f"ELSE {c} END"


def _dash(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '—')"


TIPO = "CASE secao WHEN 1 THEN 'Novo' WHEN 2 THEN 'Removido' ELSE 'Alterado' END"
VIEW = f"""{HISTORY},
view AS (SELECT data::DATE AS data, strftime(data::DATE, '%d/%m/%Y') AS data_fmt, categoria, natureza AS natureza_raw,
  {_case('natureza', C.NATURE_LABELS, q('Mudança derivada'))} AS natureza, {_dash('num_convenio')} AS num_convenio,
  {_dash('cod_saci')} AS cod_tci, {_dash('uf')} AS uf, {_dash('secretaria')} AS secretaria, {TIPO} AS tipo,
  {_case('campo', C.CHANGE_FIELD_LABELS, 'campo')} AS campo,
  {_shown('valor_anterior', C.MONEY_FIELDS)} AS anterior, {_shown('valor_atual', C.MONEY_FIELDS)} AS atual FROM hist)"""
RECORD = "CASE WHEN num_convenio <> '—' THEN num_convenio ELSE cod_tci END"

# --- works --------------------------------------------------------------------

WORKS = f"""
w0 AS (SELECT p_partkey AS p, p_partkey::VARCHAR AS operacao, ({_list([*C.UF_REGIAO, 'XX'])})[(p_partkey % 28 + 1)::INT] AS uf,
  (['REPASSE', 'FINANCIAMENTO', ''])[(p_partkey % 3 + 1)::INT] AS tipo_operacao, p_brand AS modalidade,
  'CC ' || right(p_brand, 1) AS modalidade_cc, p_name AS recebedor, 'Cidade ' || (p_partkey % 40) AS municipio,
  ({_list(C.SITUACAO_OBRA_ORDER)})[p_size % 6 + 1] AS situacao_obra,
  CASE WHEN p_partkey % 9 <> 0 THEN least(p_partkey * 7 % 120, 100)::INT END AS pct_fisico,
  DATE '2010-01-01' + (p_partkey % 4000)::INT AS dt_assinatura,
  (p_retailprice::{DEC} * 1000)::{DEC} AS vlr_repasse, (p_retailprice::{DEC} * 100)::{DEC} AS vlr_contrapartida,
  CASE WHEN p_partkey % 4 <> 1 THEN p_size * 10 END AS dias_sem_bm, CASE WHEN p_partkey % 31 <> 0 THEN p_type END AS motivo_paralisacao,
  CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '' END AS plano_acao,
  CASE WHEN p_partkey % 5 = 0 THEN DATE '1998-12-01' + p_size END AS previsao_retomada FROM part),
works AS (SELECT *, (vlr_repasse * coalesce(pct_fisico, 0) / 100)::{DEC} AS vlr_desembolsado FROM w0)"""

BAND = (
    "CASE WHEN pct_fisico IS NULL THEN 'Sem dado' WHEN pct_fisico >= 100 THEN '100%' WHEN pct_fisico >= 76 THEN '76–99%' "
    "WHEN pct_fisico >= 51 THEN '51–75%' WHEN pct_fisico >= 26 THEN '26–50%' WHEN pct_fisico > 0 THEN '1–25%' ELSE '0%' END"
)


def _legacy() -> str:
    known = [
        "situacao_obra", "pct_fisico", "vlr_repasse", "vlr_contrapartida", "vlr_desembolsado", "dias_sem_bm",
        "motivo_paralisacao", "plano_acao", "previsao_retomada",
    ]
    cells = ", ".join(f"{{'campo': {q(f)}, 'a': coalesce(p.{f}::VARCHAR, ''), 'b': coalesce(c.{f}::VARCHAR, '')}}" for f in known)
    none = "'' AS campo, '' AS valor_anterior, '' AS valor_atual"
    ident = "{0}.operacao, {0}.uf, {0}.municipio, {0}.recebedor, {0}.modalidade"
    day = "'2026-06-25' AS data"
    return f"""{WORKS},
l1 AS (SELECT * REPLACE (if(p % 10 = 0, 5, pct_fisico) AS pct_fisico, if(p % 6 = 0, 'revisar', plano_acao) AS plano_acao) FROM works WHERE p % 29 <> 3),
l2 AS (SELECT * FROM works WHERE p % 31 <> 4 AND p % 77 <> 0),
llog AS (
  SELECT {day}, 'Novo' AS tipo, 'novo_registro' AS natureza, {ident.format('c')}, {none} FROM l2 c ANTI JOIN l1 p USING (operacao)
  UNION ALL SELECT {day}, 'Removido', 'registro_removido', {ident.format('p')}, {none} FROM l1 p ANTI JOIN l2 c USING (operacao)
  UNION ALL SELECT {day}, 'Alterado', 'dados_origem', operacao, uf, municipio, recebedor, modalidade, campo, a, b FROM (
    SELECT {ident.format('c')}, unnest([{cells}], recursive := true) FROM l2 c JOIN l1 p USING (operacao)) WHERE a <> b)"""


LEGACY = _legacy()
LEGACY_VIEW = f"""{LEGACY},
lview AS (SELECT data::DATE AS data, strftime(data::DATE, '%d/%m/%Y') AS data_fmt, natureza AS natureza_raw,
  {_case('natureza', C.NATURE_LABELS, q('Mudança de dado'))} AS natureza, operacao, {_dash('uf')} AS uf, {_dash('municipio')} AS municipio,
  {_dash('recebedor')} AS recebedor, {_dash('modalidade')} AS modalidade, tipo,
  if(campo = '', '—', {_case('campo', C.LEGACY_FIELD_LABELS, 'campo')}) AS campo,
  {_shown('valor_anterior', C.LEGACY_MONEY_FIELDS, ('previsao_retomada',))} AS anterior,
  {_shown('valor_atual', C.LEGACY_MONEY_FIELDS, ('previsao_retomada',))} AS atual FROM llog)"""

# --- indicators ---------------------------------------------------------------

ACTIVE = "(situacao = 'Contratado - Suspensiva' AND coalesce(situacao_suspensiva, '') <> 'Suspensiva retirada')"
NONE = "(situacao = 'Contratado - Normal' OR coalesce(situacao_suspensiva, '') = 'Suspensiva retirada')"
INACTIVE = f"situacao IN {_in(C.INATIVAS)}"
OVERVIEW = {"Total selecionadas": "true", "Com suspensiva": ACTIVE, "Sem suspensiva": NONE, "Contratos inativos": INACTIVE}
PENDING = "(situacao = 'Contratado - Suspensiva' AND dt_retirada_suspensiva IS NULL AND coalesce(situacao_suspensiva, '') <> 'Suspensiva retirada')"


def display(done: str, status: str) -> str:
    return (
        f"CASE WHEN {done} IS NULL AND dt_assinatura < {EXEMPT} THEN 'Sem prazo (PC 72)' "
        f"WHEN {done} IS NULL AND {status} IS NULL THEN 'Sem prazo calculado' ELSE coalesce({status}, '') END"
    )


PUB_SHOWN = display("dt_pub_licitacao", "status_pub_licitacao")
HOM_SHOWN = display("dt_homolog_licitacao", "status_homolog_licitacao")
OPEN_HOM = "dt_pub_licitacao IS NOT NULL AND dt_homolog_licitacao IS NULL"
TENDER = {
    "Contratado - Normal": "true",
    "Aguardando publicação": "dt_pub_licitacao IS NULL",
    "Sem prazo (PC 72)": f"dt_pub_licitacao IS NULL AND {PUB_SHOWN} = 'Sem prazo (PC 72)'",
    "Publicação vencida": f"dt_pub_licitacao IS NULL AND {PUB_SHOWN} = 'Vencida'",
    "Publicação nos próximos 30 dias": f"dt_pub_licitacao IS NULL AND {PUB_SHOWN} = 'Próximos 30 dias'",
    "Homologação vencida": f"{OPEN_HOM} AND {HOM_SHOWN} = 'Vencida'",
    "Homologação nos próximos 30 dias": f"{OPEN_HOM} AND {HOM_SHOWN} = 'Próximos 30 dias'",
    "Homologação até a data limite": f"{OPEN_HOM} AND prazo_homolog_licitacao <= data_limite_licitacao_casa_civil",
}


def _vlr(pred: str, src: str) -> str:
    return f"coalesce((SELECT sum(vlr_repasse) FROM {src} WHERE {pred}), 0)::{DEC}"


def deltas(indicators: dict[str, str], scope: str) -> str:
    lines = []
    for name, pred in indicators.items():
        full = f"({scope}) AND ({pred})"
        cur, prev = (f"(SELECT count(*) FROM {t} WHERE {full})" for t in ("panel", "prev"))
        lines.append(f"SELECT {q(name)} AS indicador, {cur} AS qtd, {_vlr(full, 'panel')} AS vlr, {prev} AS anterior")
    return (
        f"WITH {BOTH}, t AS ({' UNION ALL '.join(lines)}) SELECT *, qtd - anterior AS delta, "
        "CASE sign(qtd - anterior) WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS tom FROM t"
    )


def levels(src: str, spec: dict[str, tuple[str, dict[str, str]]]) -> str:
    lines = []
    for level, (scope, labels) in spec.items():
        for i, (label, pred) in enumerate(labels.items()):
            lines.append(
                f"SELECT {q(level)} AS nivel, {i + 1} AS pos, {q(label)} AS rotulo, "
                f"(SELECT count(*) FROM {src} WHERE ({scope}) AND ({pred})) AS qtd, (SELECT count(*) FROM {src} WHERE {scope}) AS total"
            )
    return f"SELECT *, qtd / total * 100 AS pct FROM ({' UNION ALL '.join(lines)}) WHERE qtd > 0"


def _kpis(src: str, indicators: dict[str, str]) -> str:
    lines = [
        f"SELECT {q(n)} AS indicador, (SELECT count(*) FROM {src} WHERE {p}) AS qtd, {_vlr(p, src)} AS vlr, "
        f"(SELECT count(*) FROM {src} WHERE {p}) / (SELECT count(*) FROM {src}) AS pct"
        for n, p in indicators.items()
    ]
    return " UNION ALL ".join(lines)


def _blank_label(c: str) -> str:
    return f"coalesce(nullif(trim({c}), ''), 'Não informado')"


FRESH = [
    ("tci_mcid", "SACI/ Ministério das Cidades", "TCI/MCID", "max(dte_carga)"),
    ("transferegov", "Transferegov", "TGOV", "greatest(max(tab_convenios.dte_carga), max(tab_licitacao.dte_carga))"),
    ("bdgestores", "BDGestores", "TDB", "max(dte_posicao)"),
    ("power_bi_caixa", "Power BI Caixa", "PBI", "max(data_atualizacao)"),
]


def _freshness() -> str:
    keys = f"(SELECT {key('num_convenio')} FROM sel)"
    best = {
        "tci_mcid": "(SELECT max(dte_carga) FROM sel)",
        "transferegov": f"greatest((SELECT max(dte_carga) FROM tcon WHERE {key('nc')} IN {keys}), (SELECT max(dte_carga) FROM licit WHERE {key('nc')} IN {keys}))",
        "bdgestores": "(SELECT max(dte_posicao) FROM tdb WHERE siafi IN (SELECT num_convenio FROM sel))",
        "power_bi_caixa": f"(SELECT max(data_atualizacao) FROM pbi WHERE {key('instrumento')} IN {keys})",
    }
    rows = [
        f"SELECT {q(k)} AS key, {q(label)} AS label, {q(sigla)} AS sigla, ({best[k]})::VARCHAR AS updated_at, {q(m)} AS method, false AS fallback, NULL::VARCHAR AS note"
        for k, label, sigla, m in FRESH
    ]
    rows.append(
        "SELECT 'dmp', 'Diretoria de Monitoramento de Projetos', 'DMP', '1998-11-16', 'snapshot_atual', true, "
        "'Fallback: nenhuma tabela/coluna de carga dedicada da DMP foi identificada no pipeline atual.'"
    )
    chosen = "sel AS (SELECT * FROM saci WHERE fonte = 'OGU' AND fase = 'NOVO PAC - Seleção' AND secretaria <> 'MACHINERY')"
    return f"WITH {SOURCES}, {chosen} " + " UNION ALL ".join(rows)


def _facets(state: dict[str, list[str]], having: str = "") -> str:
    names = ["secretaria", "modalidade", "ano"]
    parts = []
    for n in names:
        others = " AND ".join(["true"] + [f"{o} IN {_in(state[o])}" for o in names if o != n and state[o]])
        parts.append(
            f"SELECT {q(n)} AS faceta, {n} AS opcao, count(*) AS qtd FROM panel WHERE {n} IS NOT NULL AND {n} <> '' AND {others} GROUP BY {n}"
        )
    return " UNION ALL ".join(parts)


def _row_labels() -> str:
    text = lambda t, f: f"trim(coalesce({t}.{f}::VARCHAR, ''))"
    cells = ", ".join(f"if({text('c', f)} <> {text('p', f)}, {q(f)}, NULL)" for f in C.ROW_LABEL_FIELDS)
    rk = "coalesce(nullif(num_convenio, ''), cod_tci)"
    return f"""WITH {BOTH}, pv AS (SELECT *, {rk} AS rk FROM prev), cu AS (SELECT *, {rk} AS rk FROM panel),
m AS (SELECT c.cod_tci, p.rk IS NULL AS novo, list_filter([{cells}], lambda x: x IS NOT NULL) AS ch FROM cu c LEFT JOIN pv p USING (rk))
SELECT cod_tci, if(novo, 'Novo', if(len(ch) > 0, 'Alterado', 'Sem alteração')) AS alteracao,
  if(novo, '', array_to_string(ch, ',')) AS campos FROM m"""


SELECTED_KEY = "coalesce(nullif(trim(num_convenio_saci), ''), nullif(trim(cod_tci_saci), ''))"
WS = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def oracle_sql() -> dict[str, str]:
    from catalog.queries import RULE_COLUMNS

    out = {n: f"WITH {PANEL} SELECT cod_tci, {', '.join(cols)} FROM panel" for n, cols in RULE_COLUMNS.items()}
    out |= {
        "flagship": f"WITH {PANEL} SELECT fase_atual, status_pub_licitacao, count(*) AS qtd, sum(vlr_repasse)::{DEC} AS vlr FROM panel GROUP BY ALL",
        "base_filter": f"WITH {CONTRACTS} SELECT cod_tci, fonte, fase, secretaria FROM selected",
        "weekday_count": f"WITH {CONTRACTS} SELECT cod_tci, coalesce({weekdays('dt_assinatura', 'dt_vencimento_suspensiva')}, 0) AS dias_uteis, 0 AS dias_invertidos FROM contracts",
        "doc_type": f"WITH {DOCPANEL} SELECT cod_tci, tipo_doc_suspensiva, doc_titularidade, doc_trabalho_social FROM docs",
        "pending_docs": f"WITH {DOCPANEL} SELECT cod_tci, array_to_string({PENDING_LIST}, ', ') AS docs_suspensiva_resumo, len({PENDING_LIST}) AS docs_suspensiva_qtd FROM docs",
        "situation_flags": f"WITH {CONTRACTS} SELECT cod_tci, coalesce(situacao_suspensiva, '') = 'Suspensiva retirada' AS suspensiva_retirada, {ACTIVE} AS com_suspensiva_ativa, "
        f"{NONE} AS sem_suspensiva, situacao = 'Contratado - Normal' AS contrato_normal, coalesce(dt_assinatura < {EXEMPT}, false) AS sem_prazo_pc72, {INACTIVE} AS inativo FROM selected",
        "display_status": f"WITH {PANEL} SELECT cod_tci, {PUB_SHOWN} AS exibe_publicacao, {HOM_SHOWN} AS exibe_homologacao FROM panel",
        "pending_by_month": f"""WITH {PANEL}, m AS (SELECT *, date_trunc('month', dt_vencimento_suspensiva)::DATE + 14 - {AS_OF} AS rest FROM panel WHERE {PENDING})
SELECT (year(dt_vencimento_suspensiva) * 100 + month(dt_vencimento_suspensiva)) AS chave, coalesce(strftime(dt_vencimento_suspensiva, '%m/%Y'), 'Sem data') AS rotulo,
CASE WHEN rest IS NULL THEN 'Sem data' WHEN rest < 0 THEN 'Vencida' WHEN rest <= 30 THEN 'Próximos 30 dias' WHEN rest <= 90 THEN '31–90 dias' ELSE 'Mais de 90 dias' END AS urgencia,
count(*) AS qtd, coalesce(sum(vlr_repasse), 0)::{DEC} AS vlr FROM m GROUP BY 1, 2, 3""",
        "progress_band": f"WITH {WORKS} SELECT list_position({_list(C.FAIXA_FISICA_ORDER)}, valor) AS pos, valor, count(*) AS qtd FROM (SELECT {BAND} AS valor FROM works) GROUP BY valor",
        "work_flags": f"WITH {WORKS} SELECT operacao, situacao_obra = 'Obra Paralisada' AS paralisada, situacao_obra = 'Obra concluída' AS concluida, situacao_obra = 'Obra em andamento' AS andamento FROM works",
        "due_by_cutoff": f"WITH {PANEL} SELECT cod_tci, prazo_homolog_licitacao FROM panel WHERE {OPEN_HOM} AND prazo_homolog_licitacao <= {CUTOFF}",
        "tolerant_join": f"WITH {SOURCES} SELECT s.cod_tci, s.num_convenio, p.instrumento, p.dt_vencimento_suspensiva AS vencimento_da_suspensiva FROM saci s LEFT JOIN pbi p ON {key('s.num_convenio')} = {key('p.instrumento')}",
        "tolerant_join_empty": f"WITH {SOURCES} SELECT cod_tci, num_convenio, NULL::VARCHAR AS instrumento, NULL::DATE AS vencimento_da_suspensiva FROM saci",
        "tolerant_join_null_keys": f"WITH {SOURCES}, l AS (SELECT cod_tci, CASE WHEN ends_with(cod_tci::VARCHAR, '0') THEN num_convenio END AS num_convenio FROM saci) SELECT l.cod_tci, l.num_convenio, p.instrumento, p.dt_vencimento_suspensiva AS vencimento_da_suspensiva FROM l LEFT JOIN pbi p ON trim(l.num_convenio) <> '' AND {key('l.num_convenio')} = {key('p.instrumento')}",
        "infer_types": "SELECT * FROM (VALUES ('virgula', 'double', (SELECT count(*) FROM orders)), ('inteiro', 'bigint', (SELECT count(*) FROM orders)), ('real', 'double', (SELECT count(*) FROM orders)), ('dia', 'date', (SELECT count(*) FROM orders WHERE o_orderkey % 83 = 0)), ('misto', 'string', (SELECT count(*) FROM orders))) v(coluna, tipo, valores)",
        "plain_join": f"WITH {SOURCES} SELECT s.cod_tci, s.num_convenio, s29.instrumento AS instrumento_s29, perspectiva AS pespectiva_de_retirada_da_suspensiva FROM saci s LEFT JOIN s29 ON s.num_convenio = s29.instrumento",
        "enrich": f"WITH {SOURCES}, ej AS ({ENRICH_SOURCE}), ed AS ({derived('ej')}) SELECT "
        + ", ".join(f"{'cod_tci' if n == 'cod_saci' else n} AS {p}" for n, p in C.BASE_COLUMNS.items()) + " FROM ed",
        "doc_union": f"WITH {DOC_UNION} SELECT * FROM du",
        "first_match": f"WITH {DOC_UNION}, one AS (SELECT {key('num_convenio')} AS ck, min(cod_tci) AS cod_saci FROM saci GROUP BY 1) SELECT tipo_doc_suspensiva, instrumento, cod_saci FROM du LEFT JOIN one ON ck = {key('instrumento')}",
        "membership_flag": f"WITH {DOC_UNION} SELECT tipo_doc_suspensiva, instrumento, if(instrumento IN (SELECT num_convenio FROM selected), 'SIM', 'NÃO') AS consta_base_pc32 FROM du",
        "doc_kpis": f"WITH {DOC_UNION} SELECT count(*) AS instrumentos, count(*) FILTER (tipo_doc_suspensiva = 'Documentos apresentados') AS apresentados, "
        "count(*) FILTER (tipo_doc_suspensiva = 'Documentos não apresentados') AS nao_apresentados, count(*) FILTER (instrumento IN (SELECT num_convenio FROM selected)) AS constam_na_base FROM du",
        "freshness": _freshness(),
        "match_snapshots": f"WITH {_snapshots([1, 2])} SELECT coalesce(a.chave, b.chave) AS chave, CASE WHEN a.chave IS NULL THEN 'entrou' WHEN b.chave IS NULL THEN 'saiu' ELSE 'comum' END AS presenca FROM s1 a FULL JOIN s2 b ON a.chave = b.chave",
        "key_diff": f"WITH {_snapshots([1, 2])} SELECT chave FROM s2 EXCEPT SELECT chave FROM s1",
        "row_labels": _row_labels(),
        "key_check": f"""WITH {CONTRACTS}, b AS (SELECT k, num_convenio AS num_convenio_saci, if(k % 202 <> 0, cod_tci, NULL) AS cod_tci_saci FROM contracts),
r AS (SELECT {SELECTED_KEY} AS ch FROM (SELECT * FROM b UNION ALL SELECT * FROM b WHERE k % 97 = 0)), g AS (SELECT ch, count(*) AS n FROM r GROUP BY ch)
SELECT 'carteira' AS rotulo, (SELECT count(*) FROM r WHERE ch IS NULL) AS sem_chave, (SELECT count(*) FROM g WHERE n > 1 AND ch IS NOT NULL) AS chaves_duplicadas,
array_to_string((SELECT list(ch ORDER BY ch) FROM (SELECT ch FROM g WHERE n > 1 AND ch IS NOT NULL ORDER BY ch LIMIT 5)), ', ') AS exemplos""",
        "restrict_previous": f"WITH {BOTH} SELECT cod_tci, num_convenio FROM prev WHERE (num_convenio, cod_tci) IN (SELECT (num_convenio, cod_tci) FROM panel WHERE secretaria = 'BUILDING')",
        "first_events": f"WITH {SOURCES} SELECT nc AS num_convenio, pub AS dte_publicacao_licitacao, hom AS dte_homologacao_licitacao FROM firsts",
        "breakdown": f"WITH {PANEL} SELECT list_position({_list(C.SITUACAO_ORDER)}, situacao) AS pos, situacao AS valor, count(*) AS qtd FROM panel GROUP BY situacao",
        "domain_order": f"WITH {PANEL} SELECT regiao AS label, count(*) AS qtd, CASE regiao WHEN 'AMERICA' THEN 1 WHEN 'EUROPE' THEN 2 WHEN 'ASIA' THEN 3 ELSE 999 END AS pos FROM panel GROUP BY regiao",
        "group_totals": f"WITH {PANEL} SELECT modalidade AS grupo, count(*) AS contratos, sum(vlr_repasse)::{DEC} AS vlr_repasse FROM panel GROUP BY modalidade",
        "kpi": f"WITH {PANEL} {_kpis('panel', OVERVIEW)}",
        "kpi_delta": deltas(OVERVIEW, "true"),
        "tender_kpis": deltas(TENDER, "situacao = 'Contratado - Normal'"),
        "works_kpis": deltas(
            {"Com AIO": "true"} | {s: f"coalesce(status_inicio_obra, '') = {q(s)}" for s in C.INICIO_OBRA_ORDER},
            "dt_aio IS NOT NULL AND situacao <> 'Cancelado ou Distratado'",
        ),
        "tender_flow": f"WITH {PANEL}, tn AS (SELECT * FROM panel WHERE situacao = 'Contratado - Normal') "
        + levels("tn", {
            "publicacao": ("true", {"Aguardando publicação": "dt_pub_licitacao IS NULL", "Publicada": "dt_pub_licitacao IS NOT NULL"}),
            "prazo_publicacao": ("dt_pub_licitacao IS NULL", {s: f"{PUB_SHOWN} = {q(s)}" for s in C.PRAZO_ORDER}),
            "homologacao": ("dt_pub_licitacao IS NOT NULL", {"Homologação pendente": "dt_homolog_licitacao IS NULL", "Homologada": "dt_homolog_licitacao IS NOT NULL"}),
            "prazo_homologacao": (OPEN_HOM, {s: f"{HOM_SHOWN} = {q(s)}" for s in C.PRAZO_ORDER}),
        }),
        "suspension_cascade": f"WITH {PANEL}, su AS (SELECT * FROM panel WHERE situacao = 'Contratado - Suspensiva') "
        + levels("su", {
            "analise": ("true", {s: f"situacao_suspensiva = {q(s)}" for s in C.SUSPENSIVA_ORDER}),
            "urgencia": (PENDING, {s: f"urgencia_suspensiva = {q(s)}" for s in C.URGENCIA_ORDER}),
            "alerta": ("dt_retirada_suspensiva IS NULL", {s: f"urgencia_suspensiva = {q(s)}" for s in C.URGENCIA_ORDER[:2]}),
        }),
        "doc_pending_counts": f"WITH {DOCPANEL} SELECT doc, count(*) AS qtd FROM (SELECT unnest({PENDING_LIST}) AS doc FROM docs) GROUP BY doc",
        "geo_breakdown": f"WITH {PANEL} SELECT {_blank_label('municipio')} AS label, count(*) AS qtd FROM panel GROUP BY 1",
        "validity_runs": f"WITH {_snapshots([1, 2, 3, 4])}, {_runs()} SELECT chave, ['1998-11-01', '1998-11-02', '1998-11-16', '1998-11-17'][min(o)] AS desde, ['1998-11-01', '1998-11-02', '1998-11-16', '1998-11-17'][max(o)] AS ate FROM runs GROUP BY chave, run",
        "base_as_of": f"WITH {_snapshots([2])} SELECT {', '.join(_header(2))} FROM s2",
        "factored_keys": f"""WITH {SOURCES}, l AS (SELECT {key('num_convenio')} AS k, count(*) AS n FROM saci WHERE num_convenio IS NOT NULL GROUP BY 1),
r AS (SELECT {key('nc')} AS k, count(*) AS n FROM licit GROUP BY 1)
SELECT if(c[1] = 'N', c[2:]::DECIMAL(30,6)::BIGINT::VARCHAR, c[2:]) AS chave, a AS linhas_esquerda, b AS linhas_direita, a * greatest(b, 1) AS linhas
FROM (SELECT coalesce(l.k, r.k) AS c, coalesce(l.n, 0) AS a, coalesce(r.n, 0) AS b FROM l FULL JOIN r ON l.k = r.k)""",
        "factored_totals": f"WITH {SOURCES} SELECT s.uf, count(*) AS linhas, sum(s.vlr_repasse) AS vlr_repasse FROM saci s LEFT JOIN licit p ON {key('s.num_convenio')} = {key('p.nc')} GROUP BY 1",
        "factored_rows": f"WITH {SOURCES} SELECT s.cod_tci, s.num_convenio, p.nc AS instrumento, p.pub AS dte_publicacao_licitacao FROM saci s LEFT JOIN licit p ON {key('s.num_convenio')} = {key('p.nc')}",
        "diff_history": f"WITH {HISTORY} SELECT * FROM hist",
        "daily_log": f"WITH {HISTORY} SELECT * FROM hist",
        "change_view": f"WITH {VIEW} SELECT * FROM view",
        "change_kpis": f"WITH {VIEW} SELECT count(DISTINCT {RECORD}) AS empreendimentos, count(*) AS campos_alterados, "
        + ", ".join(f"count(*) FILTER (tipo = 'Alterado' AND natureza_raw = {q(n)}) AS {a}" for n, a in (("dados_origem", "mudancas_de_dado"), ("derivado_regra", "mudancas_derivadas"), ("derivado_tempo", "mudancas_automaticas")))
        + f", count(DISTINCT {RECORD}) FILTER (tipo = 'Novo') AS contratos_novos FROM view",
        "change_events": f"WITH {VIEW} SELECT DISTINCT data::VARCHAR AS dia, {RECORD} AS registro, tipo FROM view",
        "diff_detail": f"WITH {PAIR} SELECT secao, pos, CASE secao WHEN 1 THEN 'entrou' WHEN 2 THEN 'saiu' ELSE 'alterado' END AS tipo_alteracao, categoria AS categoria_alteracao, "
        "natureza AS natureza_campo, num_convenio, cod_saci, campo, valor_anterior, valor_atual FROM ev2",
        "status_counters": f"WITH {PAIR} SELECT s.pos, s.campo, count(e.campo) AS mudancas FROM (VALUES "
        + ", ".join(f"({i + 1}, {q(f)})" for i, f in enumerate(C.STATUS_FIELDS))
        + ") s(pos, campo) LEFT JOIN (SELECT * FROM ev2 WHERE secao = 3) e USING (campo) GROUP BY ALL",
        "diff_summary": f"""WITH {PAIR}, rec AS (SELECT DISTINCT secao, num_convenio, categoria FROM ev2)
SELECT '1998-11-02' AS snapshot_atual, '1998-11-01' AS snapshot_anterior, '1998-11-01' AS snapshot_primeiro,
(SELECT count(*) FROM s2) AS total_atual, (SELECT count(*) FROM s1) AS total_anterior, (SELECT count(*) FROM s2) - (SELECT count(*) FROM s1) AS delta_total,
count(*) FILTER (secao = 1) AS entered, count(*) FILTER (secao = 2) AS exited, count(*) FILTER (secao = 3) AS changed_records,
count(*) FILTER (secao = 3 AND categoria <> 'derivados_tempo') AS changed_data_records, count(*) FILTER (secao = 3 AND categoria = 'derivados_tempo') AS changed_time_records, """
        + ", ".join(f"(SELECT count(*) FROM ev2 WHERE secao = 3 AND campo = {q(f)}) AS {f}" for f in C.STATUS_FIELDS) + " FROM rec",
        "first_run_summary": f"WITH {_snapshots([1])} SELECT '1998-11-01' AS snapshot_atual, NULL::VARCHAR AS snapshot_anterior, '1998-11-01' AS snapshot_primeiro, count(*) AS total_atual, NULL::BIGINT AS total_anterior, NULL::BIGINT AS delta_total FROM s1",
        "legacy_diff": f"WITH {LEGACY} SELECT * FROM llog",
        "legacy_change_view": f"WITH {LEGACY_VIEW} SELECT * FROM lview",
        "legacy_change_kpis": f"WITH {LEGACY} SELECT count(DISTINCT operacao) AS obras, count(*) FILTER (tipo = 'Alterado') AS campos_alterados, count(DISTINCT operacao) FILTER (tipo = 'Novo') AS obras_novas, count(DISTINCT operacao) FILTER (tipo = 'Removido') AS obras_removidas FROM llog",
        "legacy_summary": f"""WITH {LEGACY} SELECT '2026-06-25' AS snapshot_atual, '2026-06-12' AS snapshot_anterior, '2026-06-12' AS snapshot_primeiro,
(SELECT count(*) FROM works WHERE p % 31 <> 4) AS total_atual, (SELECT count(*) FROM l1) AS total_anterior, (SELECT count(*) FROM works WHERE p % 31 <> 4) - (SELECT count(*) FROM l1) AS delta_total,
count(DISTINCT operacao) FILTER (tipo = 'Novo') AS entered, count(DISTINCT operacao) FILTER (tipo = 'Removido') AS exited, count(DISTINCT operacao) FILTER (tipo = 'Alterado') AS changed_records FROM llog""",
        "works_overview": f"WITH {WORKS} " + _kpis("works", {"Obras selecionadas": "true", "Concluídas": "situacao_obra = 'Obra concluída'", "Em andamento": "situacao_obra = 'Obra em andamento'", "Paralisadas": "situacao_obra = 'Obra Paralisada'"}),
        "execution_kpis": f"WITH {WORKS} SELECT count(*) AS obras, count(pct_fisico) AS com_dado_fisico, avg(pct_fisico) / 100 AS pct_fisico_medio, sum(vlr_repasse)::{DEC} AS vlr_repasse, sum(vlr_desembolsado)::{DEC} AS vlr_desembolsado, sum(vlr_contrapartida)::{DEC} AS vlr_contrapartida, sum(vlr_desembolsado)::DOUBLE / sum(vlr_repasse)::DOUBLE AS pct_desembolsado FROM works",
        "stoppage_kpis": f"WITH {WORKS} SELECT count(*) AS paralisadas, coalesce(sum(vlr_repasse), 0)::{DEC} AS vlr_repasse, count(dias_sem_bm) AS com_dias, floor(avg(dias_sem_bm) + 0.5)::BIGINT AS dias_medio_sem_bm, count(*) FILTER (trim(plano_acao) <> '') AS com_plano, count(previsao_retomada) AS com_previsao FROM works WHERE situacao_obra = 'Obra Paralisada'",
        "column_profile": f"WITH {PANEL} " + " UNION ALL ".join(
            f"SELECT {q(c)} AS coluna, CASE WHEN max(length({c})) <= 24 AND count(DISTINCT nullif(trim({c}), '')) <= 30 THEN count(DISTINCT nullif(trim({c}), '')) END AS valores, max(length({c})) AS max_len, "
            + ("'select'" if c == "municipio" else f"if(max(length({c})) <= 24 AND count(DISTINCT nullif(trim({c}), '')) BETWEEN 2 AND 30, 'select', 'text')") + " AS filtro FROM panel"
            for c in ("uf", "situacao", "secretaria", "modalidade", "num_convenio", "municipio")
        ),
        "width_profile": f"WITH {PANEL}, lens AS (" + " UNION ALL ".join(
            f"SELECT {q(c)} AS coluna, {len(h)} AS titulo, list(length({c}) ORDER BY length({c})) FILTER ({c} <> '') AS l FROM panel"
            for c, h in (("uf", "UF"), ("situacao", "Situação"), ("proponente", "Proponente (SACI)"), ("num_convenio", "Convênio"))
        ) + "), p AS (SELECT coluna, titulo, l[least(len(l) - 1, (len(l) * 9) // 10) + 1] AS p90 FROM lens) SELECT coluna, p90, least(greatest(greatest(titulo, p90) + 2, 8), 24) AS largura FROM p "
        "UNION ALL SELECT 'dt_assinatura', NULL, 12 UNION ALL SELECT 'vlr_repasse', NULL, 14",
        "snapshot_date": f"WITH {WORKS} SELECT max(previsao_retomada)::VARCHAR AS snapshot_date FROM works",
        "facets": f"WITH {PANEL} " + _facets({"secretaria": ["BUILDING", "FURNITURE"], "modalidade": [], "ano": ["1997", "1998"]}),
        "sanitize": f"WITH {PANEL}, f AS ({_facets({'secretaria': ['BUILDING', 'SEM VALOR'], 'modalidade': ['5-LOW'], 'ano': [str(y) for y in range(1990, 2000)]})}), "
        "ch AS (SELECT faceta, opcao, (faceta = 'secretaria' AND opcao IN ('BUILDING', 'SEM VALOR')) OR (faceta = 'modalidade' AND opcao = '5-LOW') OR (faceta = 'ano' AND opcao BETWEEN '1990' AND '1999') AS picked FROM f) "
        "SELECT faceta, opcao AS escolha FROM ch a WHERE picked AND EXISTS (SELECT 1 FROM ch b WHERE b.faceta = a.faceta AND NOT b.picked)",
        "text_search": f"WITH {PANEL} SELECT cod_tci, proponente FROM panel WHERE "
        + " AND ".join("(" + " OR ".join(f"regexp_matches({c}, '(?i)(^|[^\\p{{L}}-]){t}')" for c in ("num_convenio", "cod_tci", "proponente")) + ")" for t in ("prefeitura", "12")),
        "indexed_search_updated": f"WITH {_snapshots([1, 2])} SELECT num_convenio_saci, txt_tomador_saci, fase_atual_calc FROM s2 WHERE "
        + " AND ".join("(" + " OR ".join(f"regexp_matches(coalesce({c}, ''), '(?i)(^|[^\\p{{L}}-]){t}')" for c in ("num_convenio_saci", "txt_tomador_saci", "fase_atual_calc")) + ")" for t in ("prefeitura", "homolog")),
        "cross_filter": f"WITH {PANEL}, b AS (SELECT * FROM panel WHERE secretaria = 'BUILDING') "
        + " UNION ALL ".join(
            f"SELECT {q(g)} AS grafico, {g} AS grupo, count(*) AS qtd, coalesce(sum(vlr_repasse), 0)::{DEC} AS vlr FROM b WHERE {g} IS NOT NULL AND {w} GROUP BY {g}"
            for g, w in (("situacao", "modalidade = '5-LOW'"), ("situacao_suspensiva", "situacao = 'Contratado - Normal' AND modalidade = '5-LOW'"), ("modalidade", "situacao = 'Contratado - Normal'"))
        ),
        "geo_filter": f"WITH {PANEL} SELECT cod_tci, regiao, uf, municipio FROM panel WHERE regiao = 'AMERICA' AND {_blank_label('municipio')} = 'Não informado'",
        "cascade_filter": f"WITH {PANEL} SELECT cod_tci, situacao_suspensiva, dt_vencimento_suspensiva FROM panel WHERE {PENDING} AND urgencia_suspensiva = '31–90 dias' AND strftime(dt_vencimento_suspensiva, '%m/%Y') = '01/1999'",
        "tender_filter": f"WITH {PANEL} SELECT cod_tci, dt_pub_licitacao, status_regra_casa_civil FROM panel WHERE situacao = 'Contratado - Normal' AND dt_pub_licitacao IS NOT NULL AND status_regra_casa_civil = 'Pendente'",
        "final_filter": f"WITH {DOCPANEL} SELECT cod_tci, status_inicio_obra FROM docs WHERE ano IN ('1996', '1997') AND situacao = 'Contratado - Normal' AND dt_pub_licitacao IS NOT NULL AND status_inicio_obra = 'Iniciada no prazo' AND list_contains({PENDING_LIST}, 'Titularidade')",
        "table_page": f"WITH {PANEL} SELECT cod_tci, secretaria, modalidade, fase_atual, dt_assinatura FROM panel WHERE fase_atual = 'HOMOLOGACAO' AND secretaria = 'BUILDING' AND modalidade ILIKE '%low%' ORDER BY dt_assinatura DESC NULLS LAST, cod_tci LIMIT 10 OFFSET 10",
        "deep_page": f"WITH {PANEL} SELECT cod_tci, secretaria, modalidade, fase_atual, dt_assinatura FROM panel ORDER BY dt_assinatura DESC NULLS LAST, cod_tci NULLS FIRST LIMIT 25 OFFSET 500",
        "next_page": f"WITH {PANEL} SELECT cod_tci, secretaria, modalidade, fase_atual, dt_assinatura FROM panel WHERE dt_assinatura < DATE '1997-01-01' OR dt_assinatura IS NULL OR (dt_assinatura = DATE '1997-01-01' AND cod_tci IS NOT NULL) ORDER BY dt_assinatura DESC NULLS LAST, cod_tci NULLS FIRST LIMIT 25",
        "scoped_rows": f"WITH {PANEL} SELECT cod_tci, dt_vencimento_suspensiva FROM panel WHERE {PENDING} AND secretaria = 'BUILDING'",
        "filter_options": f"WITH {PANEL} SELECT coalesce(strftime(dt_vencimento_suspensiva, '%m/%Y'), '—') AS texto, min(dt_vencimento_suspensiva) AS ordem FROM panel GROUP BY 1",
        "topk_other": f"""WITH {PANEL}, g AS (SELECT {_blank_label('municipio')} AS label, count(*) AS qtd FROM panel WHERE uf = 'NATION_7' AND regiao = 'ASIA' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY qtd DESC, label) AS rn FROM g)
SELECT label, qtd FROM r WHERE rn <= 15 UNION ALL SELECT 'Outros municípios', sum(qtd)::BIGINT FROM r WHERE rn > 15 HAVING sum(qtd) > 0""",
        "group_topk": f"WITH {WORKS} SELECT modalidade AS grupo, count(*) AS contratos, sum(vlr_repasse)::{DEC} AS vlr_repasse FROM works GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 12",
        "reason_topk": f"WITH {WORKS} SELECT motivo_paralisacao AS motivo, count(*) AS qtd FROM works WHERE situacao_obra = 'Obra Paralisada' AND motivo_paralisacao IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
        "clean_text": f"SELECT doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS limpo, coalesce(nullif(lang, ''), nullif(source, ''), '') AS campo FROM documents",
        "parse_values": f"""WITH v AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_totalprice::{DEC} AS t FROM orders)
SELECT k, if(k % 5 = 4, 'sem data', d2::VARCHAR) AS iso, if(k % 5 = 4, NULL, d2) AS dia, if(k % 3 = 1, t, 0)::{DEC} AS valor, if(k % 3 = 1, t, NULL)::{DEC} AS valor_ou_nulo
FROM (SELECT *, CASE WHEN k % 5 = 1 THEN (('20' || right(year(d)::VARCHAR, 2)) || strftime(d, '-%m-%d'))::DATE ELSE d END AS d2 FROM v)""",
        "region_lookup": f"WITH {WORKS} SELECT operacao, uf, {_case('uf', C.UF_REGIAO, q('Não informado'))} AS regiao FROM works",
        "canonical_names": f"WITH {PANEL} SELECT num_convenio AS num_convenio_saci, situacao AS cod_tci_saci, uf AS txt_uf_saci, vlr_repasse AS vlr_repasse_saci, fase_atual AS fase_atual_calc, modalidade AS observacao FROM panel",
        "panel_rows": f"""WITH {CONTRACTS}, d0 AS ({_docs('selected')}), e AS ({derived('d0')}) SELECT cod_tci, num_convenio, uf, situacao, dt_assinatura, dt_lae_mais_60, dt_lae_mais_60_mais_120,
coalesce(vlr_repasse, 0)::{DEC} AS vlr_repasse, dias_ate_publicacao::DOUBLE AS dias_ate_publicacao, pos_72, ano, len({PENDING_LIST}) AS docs_suspensiva_qtd FROM e WHERE k % 97 <> 1""",
    }
    out["diff_report"] = _report(out["diff_summary"])
    # Other ways to the same rows.
    out |= {other: out[name] for other, name in (("enrich_split", "enrich"), ("bucketed_diff", "diff_detail"), ("bucketed_match", "match_snapshots"), ("digest_diff", "diff_detail"), ("indexed_search", "text_search"))}
    return out


# Wording of the report's lines.
_REPORT = [
    ("# Diferença da base - ", "snapshot_atual", ""), ("", None, ""), ("- Snapshot atual: `", "snapshot_atual", "`"),
    ("- Snapshot anterior: `", "snapshot_anterior", "`"), ("- Total anterior: **", "total_anterior", "**"),
    ("- Total atual: **", "total_atual", "**"), ("", None, ""), ("## Resumo", None, ""), ("", None, ""),
    ("- Entraram na base: **", "entered", "**"), ("- Saíram da base: **", "exited", "**"),
    ("- Registros com alguma alteração: **", "changed_records", "**"),
    ("- Registros com mudança de dados de origem: **", "changed_data_records", "**"),
    ("- Registros com mudança apenas em campos derivados/status: **", "changed_time_records", "**"),
    ("", None, ""), ("## Mudanças por status", None, ""), ("", None, ""),
    *[(f"- `{f}`: **", f, "**") for f in C.STATUS_FIELDS],
    ("", None, ""), ("## Leitura recomendada", None, ""), ("", None, ""),
    ("- `categoria_alteracao = dados_e_derivados`: mudou dado de origem e isso também repercutiu em campos calculados.", None, ""),
    ("- `categoria_alteracao = dados`: mudou apenas dado de origem, sem alterar status calculado.", None, ""),
    ("- `categoria_alteracao = derivados_tempo`: o dado-base ficou igual; a alteração veio só de regra derivada/data corrente.", None, ""),
]


def _report(summary: str) -> str:
    texts = ", ".join(q(a) if c is None else f"{q(a)} || {c}::VARCHAR || {q(b)}" for a, c, b in _REPORT)
    return f"WITH r AS ({summary}), t AS (SELECT [{texts}] AS x FROM r) SELECT unnest(range(1, {len(_REPORT) + 1}))::INTEGER AS linha, unnest(x) AS texto FROM t"
