"""Catalogue: facts, reports, the named query API, reference answers and file round trips."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from salespark.functions.numeric import exact_sum
from salespark.operators import customers, periods, preparation, textnum, variance
from salespark.operators.periods import SalesFilters
from salespark.plans import facts as fact_rows
from salespark.plans import ground_truth, report
from salespark.plans.api import MESSAGES, SalesQueries
from salespark.plans.catalog import DAILY_CTE, query, rounded, with_sales
from salespark.plans.customer_queries import RFM_CTE
from salespark.plans.sales_queries import BOTH, BRIDGE_CTE, CUR, HALF, dates_of
from salespark.session import shared_folder, stage
from salespark.sources import files
from salespark.sources.raw_star import EXCLUDED, GROUPS, STATE_REGION, WINDOW, raw_tables
from salespark.sources.star import sales, table

ALL = ["date", "order_id", "category", "region", "product", "units", "revenue", "cost", "profit", "customer_id"]


def base(spark, sf, columns=ALL):
    """The joined base as a plan: every question prunes its columns, days and segments down to the scans."""
    return sales(spark, sf, columns)


# ---------------------------------------------------------------- facts and reports
def region_facts(spark, sf, parts=fact_rows.PARTS):
    last = dates_of(spark, sf).agg(F.to_date(F.max("date")).alias("last")).scalar()
    return fact_rows.build_facts(base(spark, sf), HALF, ["region"], parts, last, dates_of(spark, sf))


BRL = "CASE WHEN {v} < 0 THEN '-' ELSE '' END || 'R$ ' || translate(format('{{:,.2f}}', abs({v})), ',.', '.,')"
NUM = "translate(format('{{:,.0f}}', {v}), ',.', '.,')"
PCT = "translate(format('{{:,.1f}}', {v}), ',.', '.,') || '%'"
SPCT = "CASE WHEN {v} >= 0 THEN '+' ELSE '' END || " + PCT
FACT_SQL = with_sales(f""", t AS (SELECT {BOTH} AS period, * FROM sales WHERE {BOTH} IS NOT NULL),
k AS (SELECT region AS series, CAST(sum(revenue) FILTER (period = 'current') AS DOUBLE) AS r, CAST(sum(profit) FILTER (period = 'current') AS DOUBLE) AS p,
  CAST(sum(units) FILTER (period = 'current') AS DOUBLE) AS u, CAST(count(DISTINCT order_id) FILTER (period = 'current') AS DOUBLE) AS o,
  CAST(sum(revenue) FILTER (period = 'previous') AS DOUBLE) AS b FROM t GROUP BY 1)
SELECT series, unnest(['Receita total: ' || {BRL.format(v='r')}, 'Lucro total: ' || {BRL.format(v='p')}, 'Margem de lucro: ' || {PCT.format(v='(p / r * 100)')},
  'Pedidos: ' || {NUM.format(v='o')}, 'Unidades vendidas: ' || {NUM.format(v='u')}, 'Ticket médio: ' || {BRL.format(v='(r / o)')},
  'Crescimento da receita vs período anterior de mesma duração: ' || {SPCT.format(v='((r - b) / b * 100)')}]) AS text FROM k""")


@query(FACT_SQL)
def kpi_fact_lines(spark, sf):
    """The KPI lines of every region's facts, without the parts cited in other lines."""
    lines = fact_rows.fact_lines(region_facts(spark, sf, ("kpis",)))
    return lines.where(F.col("position").between(1, 7)).select("series", "text")


@query()
def fact_lines(spark, sf):
    return fact_rows.fact_lines(region_facts(spark, sf))


@query()
def region_reports(spark, sf):
    """One report per region, with every number it cites checked against its facts."""
    facts = stage(region_facts(spark, sf), "facts")
    made = report.sales_report(facts, "Vendas")
    text = report.render_markdown(made, None).join(fact_rows.facts_text(facts), "series", "left")
    checked = textnum.verify(text, "markdown", "facts").select("series", "checked", "verified", "unverified")
    return made.join(checked, "series").withColumns(
        {"risks": F.to_json("risks"), "actions": F.to_json("actions"), "highlights": F.to_json("highlights")}
    )


@query("""SELECT r_name AS series, 'Não há dados de Vendas para o período 01/01/2010 a 31/03/2010 com os filtros atuais.' AS headline,
1 AS risks, 2 AS actions FROM region""")
def empty_reports(spark, sf):
    """A period after the data: every region gets the fixed report."""
    names = table(spark, sf, "region").select(F.col("r_name").alias("series"))
    label = SalesFilters(date(2010, 1, 1), date(2010, 3, 31)).period_label
    sold = sales(spark, sf, ["date", "region"]).where(F.col("date") >= F.lit("2010-01-01").cast("timestamp_ntz"))
    sold = sold.groupBy(F.col("region").alias("series")).agg(F.count(F.lit(1)).alias("lines"))
    facts = names.join(sold, "series", "left").withColumn("period_label", F.lit(label))
    made = report.empty_report(facts, "Vendas")
    return made.select("series", "headline", F.size("risks").alias("risks"), F.size("actions").alias("actions"))


# ---------------------------------------------------------------- named queries
def api(spark, sf):
    return SalesQueries(base(spark, sf), dates=dates_of(spark, sf))


KPI_TEXT = with_sales(f""", w AS (SELECT CASE WHEN date >= TIMESTAMP '2000-07-01' THEN 'c' ELSE 'p' END AS side, * FROM sales
  WHERE date >= TIMESTAMP '1999-12-30' AND date < TIMESTAMP '2001-01-01' AND category IN ('ECONOMY', 'PROMO') AND region = 'ASIA'),
k AS (SELECT CAST(sum(revenue) FILTER (side = 'c') AS DOUBLE) AS r, CAST(sum(profit) FILTER (side = 'c') AS DOUBLE) AS p, CAST(sum(units) FILTER (side = 'c') AS DOUBLE) AS u,
  CAST(count(DISTINCT order_id) FILTER (side = 'c') AS DOUBLE) AS o, CAST(sum(revenue) FILTER (side = 'p') AS DOUBLE) AS b FROM w)
SELECT '01/07/2000 a 31/12/2000' AS periodo, {BRL.format(v='r')} AS receita, {NUM.format(v='o')} AS pedidos, {NUM.format(v='u')} AS unidades,
{BRL.format(v='(r / o)')} AS ticket_medio, {SPCT.format(v='((r - b) / b * 100)')} AS crescimento_vs_periodo_anterior, {BRL.format(v='p')} AS lucro,
{PCT.format(v='(p / r * 100)')} AS margem FROM k""")


@query(KPI_TEXT)
def api_kpis(spark, sf):
    args = {"data_inicio": "2000-07-01", "data_fim": "2000-12-31", "categorias": ["ECONOMY", "PROMO"], "regioes": "ASIA"}
    return api(spark, sf).run("kpis", args)


@query(with_sales(f""", g AS (SELECT product AS nome, CAST(sum(revenue) AS DOUBLE) AS r FROM sales WHERE {CUR} GROUP BY 1)
SELECT '01/07/2000 a 31/12/2000' AS periodo, nome, {BRL.format(v='r')} AS receita, {PCT.format(v='(r / (SELECT sum(r) FROM g) * 100)')} AS participacao
FROM g ORDER BY r DESC, nome LIMIT 20"""))
def api_ranking(spark, sf):
    args = {"data_inicio": "2000-07-01", "data_fim": "2000-12-31", "dimensao": "produto", "limite": 50}
    return api(spark, sf).run("ranking", args)


@query(with_sales(f""", g AS (SELECT date_trunc('month', date) AS m, CAST(sum(revenue) AS DOUBLE) AS r FROM sales GROUP BY 1 ORDER BY 1 DESC LIMIT 36)
SELECT (['jan', 'fev', 'mar', 'abr', 'mai', 'jun', 'jul', 'ago', 'set', 'out', 'nov', 'dez'])[month(m)] || '/' || year(m) AS mes, {BRL.format(v='r')} AS receita FROM g"""))
def api_monthly_revenue(spark, sf):
    return api(spark, sf).run("receita_mensal", {"data_inicio": "1990-01-01", "data_fim": "2030-01-01"})


@query(with_sales(BRIDGE_CTE.replace("product", "category") + f""", s AS (SELECT sum(r0) AS r0, sum(r1) AS r1, sum(volume) AS v, sum(price) AS p, sum(mix) AS m FROM bridge)
SELECT {BRL.format(v='r0')} AS receita_periodo_anterior, {BRL.format(v='r1')} AS receita_periodo, {BRL.format(v='(r1 - r0)')} AS variacao,
{SPCT.format(v='((r1 - r0) / r0 * 100)')} AS variacao_percentual, {BRL.format(v='v')} AS efeito_volume, {BRL.format(v='p')} AS efeito_preco, {BRL.format(v='m')} AS efeito_mix FROM s"""))
def api_compare_previous(spark, sf):
    args = {"data_inicio": "2000-07-01", "data_fim": "2000-12-31"}
    return api(spark, sf).run("comparar_com_periodo_anterior", args).drop("variacao_por_categoria")


@query()
def api_anomalies(spark, sf):
    return api(spark, sf).run("anomalias", {"data_inicio": "1999-01-01", "data_fim": "2000-12-31"})


@query()
def api_forecast(spark, sf):
    return api(spark, sf).run("previsao", {"horizonte_dias": 30})


@query(RFM_CTE + f""", s AS (SELECT segment, count(*) AS c, CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) AS r FROM named GROUP BY 1)
SELECT (SELECT {NUM.format(v='count(*)::DOUBLE')} FROM named) AS clientes, segment AS segmento, {NUM.format(v='c::DOUBLE')} AS clientes_no_segmento,
{PCT.format(v='(r / (SELECT sum(r) FROM s) * 100)')} AS participacao_na_receita FROM s""")
def api_customer_segments(spark, sf):
    rows = api(spark, sf).run("segmentos_de_clientes", {})
    return rows.drop("receita_dos_20pct_melhores_clientes", "acao_sugerida")


# Requests that cannot be answered, and the sentence for each (first and last stand for the ends of the base).
_KPI_PARAMETERS = "data_inicio, data_fim, categorias, regioes"
_YEAR = {"data_inicio": "2000-01-01", "data_fim": "2000-12-31"}
REFUSED = [
    ("lucro", {}, "Consulta 'lucro' não existe. Existem: kpis, ranking, receita_mensal, comparar_com_periodo_anterior, anomalias, previsao, segmentos_de_clientes."),
    ("kpis", {**_YEAR, "loja": "x"}, f"A consulta não tem o parâmetro loja. Ela aceita: {_KPI_PARAMETERS}."),
    ("kpis", {"data_inicio": "2000-01-01"}, "Falta o parâmetro data_fim."),
    ("kpis", {**_YEAR, "data_fim": "31/12/2000"}, "data_fim precisa ser um dia no formato AAAA-MM-DD."),
    ("kpis", {"data_inicio": "2000-05-02", "data_fim": "2000-05-01"}, "O período começa em 2000-05-02 e termina antes, em 2000-05-01."),
    ("kpis", {"data_inicio": "1900-01-01", "data_fim": "1900-12-31"}, "O período não toca a base, que cobre first a last."),
    ("ranking", {**_YEAR, "dimensao": "loja"}, "dimensao precisa ser um destes valores: categoria, regiao, produto."),
    ("ranking", {**_YEAR, "dimensao": "regiao", "limite": "muitos"}, "limite precisa ser um número inteiro."),
    ("previsao", {"horizonte_dias": 45}, "horizonte_dias precisa ser um destes valores: 30, 60, 90."),
    ("kpis", {**_YEAR, "regioes": ["ATLANTIS", "ASIA"]}, "regioes contém nomes que a base não tem: ATLANTIS. Alguns que ela tem: AFRICA, AMERICA, ASIA, EUROPE, MIDDLE EAST."),
]
_REFUSED_SQL = " UNION ALL ".join("SELECT {} AS number, '{}' AS text".format(i, text.replace("'", "''")) for i, (_, _, text) in enumerate(REFUSED))


@query(with_sales(f""", e AS (SELECT CAST(min(CAST(date AS DATE)) AS VARCHAR) AS a, CAST(max(CAST(date AS DATE)) AS VARCHAR) AS z FROM sales)
SELECT number, replace(replace(text, 'first', a), 'last', z) AS erro FROM ({_REFUSED_SQL}) CROSS JOIN e"""))
def api_refusals(spark, sf):
    """What unanswerable requests are told: unknown names, missing and wrong parameters, periods beside the base."""
    tools, found = api(spark, sf), None
    for i, (name, args, _) in enumerate(REFUSED):
        row = tools.run(name, args).select(F.lit(i).alias("number"), "erro")
        found = row if found is None else found.unionByName(row)
    return found


@query(with_sales("SELECT DISTINCT 'Sem vendas em um dos dois períodos, não há o que comparar.' AS erro FROM sales"))
def bridge_without_sales(spark, sf):
    """A comparison with a period that has no sales is refused before anything is joined."""
    now = sales(spark, sf, ["date", "category", "units", "revenue"])
    try:
        variance.revenue_bridge(now, now.where("units > 1000000000"))[1].collect()
        text = None
    except variance.EmptyPeriodError:
        text = MESSAGES["nothing"]
    return now.select(F.lit(text).alias("erro")).distinct()


_LEVELS = "(['alta', 'média', 'baixa'])[{} % 3 + 1]"
_ICON = "CASE {} WHEN 'alta' THEN '{}' WHEN 'média' THEN '{}' ELSE '{}' END".format("level", *[report.ICONS[k] for k in ("alta", "média", "baixa")])


@query(f"""WITH parts AS (SELECT n_nationkey AS k, n_name AS series, i, {_LEVELS.format('(n_nationkey + i * (n_nationkey + 1))')} AS level FROM nation, range(4) r(i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY list_position(['alta', 'média', 'baixa'], level), i) AS place FROM parts),
told AS (SELECT k, series, string_agg('- ' || {_ICON} || ' **risco ' || i || '** (gravidade ' || level || '): ' || k, chr(10) ORDER BY place) AS risks,
  string_agg(place || '. **ação ' || i || '** (prioridade ' || level || ') — ' || k, chr(10) ORDER BY place) AS actions FROM ranked GROUP BY ALL)
SELECT series, concat_ws(chr(10), '**' || series || '**', '', '## Destaques do Período', '', '- chave ' || k, '', '## Diagnóstico de Pontos Críticos / Gargalos', '', risks,
'', '## Plano de Ação Estratégico Sugerido', '', actions) AS markdown FROM told""")
def rendered_reports(spark, sf):
    """Reports of made-up content per nation as text: the gravest risks and actions first, otherwise in their order."""
    key = F.col("n_nationkey")
    level = lambda i: F.element_at(F.array(*[F.lit(x) for x in ("alta", "média", "baixa")]), ((key + i * (key + 1)) % 3 + 1).cast("int"))
    text = key.cast("string")
    risks = F.array(*[F.struct(F.lit(f"risco {i}").alias("title"), text.alias("evidence"), level(i).alias("severity")) for i in range(4)])
    actions = F.array(*[F.struct(F.lit(f"ação {i}").alias("action"), text.alias("rationale"), level(i).alias("priority")) for i in range(4)])
    reports = table(spark, sf, "nation").select(
        F.col("n_name").alias("series"), F.col("n_name").alias("headline"), F.array(F.concat(F.lit("chave "), text)).alias("highlights"), risks.alias("risks"), actions.alias("actions")
    )
    return report.render_markdown(reports, footer=None)


# ---------------------------------------------------------------- reference answers
DIMS = {"category": "ECONOMY", "other_category": "PROMO", "region": "ASIA", "region_profit": "AFRICA"}


def _between(a: str, z: str) -> str:
    return f"CAST(date AS DATE) BETWEEN DATE '{a}' AND DATE '{z}'"


_Y1999, _Y2000 = _between("1999-01-01", "1999-12-31"), _between("2000-01-01", "2000-12-31")
_Q4, _Q3 = _between("2000-10-01", "2000-12-31"), _between("2000-07-01", "2000-09-30")


def _sum(where: str, what: str = "revenue") -> str:
    return f"CAST(coalesce(sum({what}) FILTER ({where}), 0) AS DOUBLE)"


TRUTH_SQL = with_sales(f""", a AS (SELECT {_sum(_Y1999)} AS r99, CAST(count(DISTINCT order_id) FILTER ({_Y2000}) AS DOUBLE) AS o00,
  {_sum(_between('1998-01-01', '1998-12-31'), 'profit')} / {_sum(_between('1998-01-01', '1998-12-31'))} * 100 AS m98, {_sum(_Q4)} AS q4, {_sum(_Q3)} AS q3,
  count(DISTINCT order_id) FILTER ({_Q4}) AS oq4, {_sum(_Y2000 + " AND category = 'ECONOMY'")} AS c1, {_sum(_Y2000 + " AND category = 'PROMO'")} AS c2,
  {_sum(_between('1999-01-01', '1999-06-30') + " AND region = 'ASIA'")} AS g, {_sum(_Y1999 + " AND region = 'AFRICA'", 'profit')} AS l,
  {_sum(_between('2000-03-01', '2000-03-31'))} AS m, {_sum("CAST(date AS DATE) = CAST((SELECT max(date) FROM sales) AS DATE) - 1")} AS y FROM sales)
SELECT id, round(value, 4) AS value FROM (SELECT unnest([{{'id': 'receita_1999', 'value': r99}}, {{'id': 'pedidos_2000', 'value': o00}}, {{'id': 'margem_1998', 'value': m98}},
{{'id': 'ticket_q4_2000', 'value': q4 / oq4}}, {{'id': 'categoria_2000', 'value': c1}}, {{'id': 'regiao_1s_1999', 'value': g}}, {{'id': 'lucro_regiao_1999', 'value': l}},
{{'id': 'outra_categoria_2000', 'value': c2}}, {{'id': 'marco_2000', 'value': m}}, {{'id': 'ontem', 'value': y}}, {{'id': 'crescimento_q4_2000', 'value': (q4 / q3 - 1) * 100}}],
recursive := true) FROM a)""")


@query(TRUTH_SQL)
def truth_numbers(spark, sf):
    return rounded(ground_truth.numbers(base(spark, sf, ["date", "order_id", "category", "region", "revenue", "profit"]), DIMS))


@query(with_sales(BRIDGE_CTE.replace("product", "category").replace(BOTH, f"(CASE WHEN {_Q4} THEN 'current' WHEN {_Q3} THEN 'previous' END)")
                  + " SELECT round(sum(r1) - sum(r0), 2) AS total_change, round(sum(volume), 3) AS volume_effect FROM bridge"))
def truth_why_changed(spark, sf):
    found = ground_truth.why_changed(sales(spark, sf, ["date", "category", "units", "revenue"]))
    return rounded(found, 3, total_change=2)


def _top_sql(id: str, column: str, where: str, order: str, limit: int) -> str:
    return f"""SELECT '{id}' AS id, CAST(row_number() OVER (ORDER BY r {order}, name) AS INTEGER) AS position, name FROM
(SELECT {column} AS name, sum(revenue) AS r FROM sales WHERE {where} GROUP BY 1 ORDER BY r {order}, name LIMIT {limit})"""


@query(with_sales(" UNION ALL ".join([
    _top_sql("menor_regiao_2000", "region", _Y2000, "ASC", 1), _top_sql("maior_categoria_1999", "category", _Y1999, "DESC", 1),
    _top_sql("top3_produtos_2000", "product", _Y2000, "DESC", 3), _top_sql("melhor_mes_1999", "strftime(date, '%m/%Y')", _Y1999, "DESC", 1),
])))
def truth_rankings(spark, sf):
    return ground_truth.rankings(base(spark, sf, ["date", "category", "region", "product", "revenue"]))


@query(RFM_CTE + """SELECT count(*) FILTER (segment = 'Campeões') AS champions,
(SELECT segment FROM named GROUP BY 1 ORDER BY sum(CAST(monetary AS DECIMAL(18,2))) DESC, segment LIMIT 1) AS top_segment FROM named""")
def truth_customers(spark, sf):
    return ground_truth.customer_answers(sales(spark, sf, ["customer_id", "order_id", "date", "revenue"]))


@query()
def truth_unusual_days(spark, sf):
    return rounded(ground_truth.unusual_days(sales(spark, sf, ["date", "order_id"]), 1999), 2)


@query()
def truth_forecast(spark, sf):
    return rounded(ground_truth.next_month_total(sales(spark, sf, ["date", "revenue"])), 2)


# ---------------------------------------------------------------- files
def _folder(spark, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/salespark/{label}-{uuid.uuid4().hex}"


@query(with_sales("SELECT data, pedidos FROM (SELECT ds AS data, CAST(o AS BIGINT) AS pedidos FROM (SELECT ds, orders AS o FROM daily))", DAILY_CTE)
)
def daily_counts_file(spark, sf):
    """Daily order counts written to CSV and read back."""
    path = _folder(spark, "daily")
    ordered = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    orders = table(spark, sf, "orders").join(ordered, "o_orderkey", "left_semi")
    daily = preparation.raw_daily_orders(orders.select(F.col("o_orderdate").alias("order_purchase_timestamp")))
    files.write_daily_counts(daily, path)
    return files.read_daily_counts(spark, path)


@query("""SELECT o_orderstatus AS order_status, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders,
CAST(sum(date_diff('day', o_orderdate, o_orderdate + to_days(CAST(o_orderkey % 45 AS INTEGER)))) AS BIGINT) AS days FROM orders GROUP BY ALL""")
def raw_files(spark, sf):
    """The five raw tables written as CSV with a header and read back with typed dates."""
    folder = _folder(spark, "raw")
    for name, df in raw_tables(spark, sf).items():
        df.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(
            f"{folder}/raw_{name}_dataset.csv"
        )
    raw = files.read_raw(spark, folder)
    bought, delivered = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    return raw["orders"].groupBy("order_status", F.year(bought).alias("year")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.datediff(delivered, bought).cast("bigint")).alias("days"),
    )


@query(with_sales("""SELECT category, region, count(*) AS lines, CAST(sum(revenue) AS DOUBLE) AS revenue, strftime(date, '%Y-%m') AS month FROM sales GROUP BY ALL"""))
def prepared_files(spark, sf):
    """The sales table written per month, loaded and validated again."""
    rows = sales(spark, sf)
    keys = F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("purchased_at")
    orders = table(spark, sf, "orders").select(*keys)
    sales_path, _ = files.save_prepared(rows, orders, _folder(spark, "prepared"))
    loaded = files.load_sales(spark, sales_path)
    return loaded.groupBy("category", "region", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), exact_sum("revenue").alias("revenue")
    )


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, replace(CAST(o_totalprice AS VARCHAR), '.', ',') AS total FROM orders""")
def exported_rows(spark, sf):
    """Export form: empty columns dropped, decimal commas."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("total"), F.lit(None).cast("double").alias("cost")
    )
    return files.export_frame(rows)


@query(with_sales(f"""SELECT order_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, category, replace(CAST(CAST(revenue AS DOUBLE) AS VARCHAR), '.', ',') AS revenue
FROM sales WHERE {CUR}"""))
def exported_sales_file(spark, sf):
    """Filtered sales, newest first, written as semicolon CSV and read back."""
    rows = sales(spark, sf, ["order_id", "date", "category", "revenue"])
    path = _folder(spark, "export")
    files.export_csv(periods.between_days(rows, HALF.start, HALF.end), path, newest_first="date")
    return spark.read.option("header", True).option("sep", ";").csv(path)


@query(RFM_CTE + "SELECT customer_id, CAST(recency AS VARCHAR) AS recency, segment FROM named")
def exported_customers_file(spark, sf):
    """Segmented customers written as semicolon CSV and read back."""
    known = customers.rfm_table(sales(spark, sf, ["customer_id", "order_id", "date", "revenue"]))
    path = _folder(spark, "customers")
    files.export_csv(customers.segment_rows(stage(known, "rfm")).select("customer_id", "recency", "segment"), path)
    return spark.read.option("header", True).option("sep", ";").csv(path)


@query("SELECT count(*) AS rows, 6 AS columns FROM orders")
def table_shape(spark, sf):
    """The shape that a preview shows beside its first rows."""
    return periods.preview(table(spark, sf, "orders"))[1]


@query("""SELECT 'm1' AS model, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS kind, (o_orderkey % 50) / 10.0::DOUBLE AS latency_s,
CASE WHEN o_orderkey % 41 = 0 THEN 'sem cota' END AS error FROM orders""")
def answers_file(spark, sf):
    """Evaluation rows written as JSON lines and read back."""
    folder = _folder(spark, "answers")
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key.cast("string").alias("id"), F.col("o_orderpriority").alias("kind"), ((key % 50) / F.lit(10.0)).alias("latency_s"),
        F.when(key % 41 == 0, "sem cota").alias("error"), F.lit(True).alias("passed"),
    )
    files.write_answers(rows, folder)
    back = files.read_answers(spark, folder)
    return back.select(F.lit("m1").alias("model"), "id", "kind", "latency_s", "error")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "Código do Pedido", 'R$ ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS "Valor Total", o_orderpriority AS "Descrição" FROM orders""")
def text_table_file(spark, sf):
    """A semicolon CSV in Latin-1, read with detected separator and encoding, all columns as text."""
    from salespark.functions.formatting import format_brl

    path = _folder(spark, "typed") + ".csv"
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("Código do Pedido"), format_brl(F.col("o_totalprice")).alias("Valor Total"),
        F.col("o_orderpriority").alias("Descrição"),
    )
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return files.read_table(spark, path)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "Código do Pedido", 'R$ ' || translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS "Valor Total",
CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END AS "Descrição" FROM orders""")
def mixed_table_files(spark, sf):
    """Three kinds of CSV in one folder: semicolons in Latin-1, commas in UTF-8 with other column order, tabs with a column less."""
    from salespark.functions.formatting import format_brl

    path = _folder(spark, "mixed")
    key = F.col("o_orderkey")
    code, total = key.cast("string").alias("Código do Pedido"), format_brl(F.col("o_totalprice")).alias("Valor Total")
    kind = F.col("o_orderpriority").alias("Descrição")
    orders = table(spark, sf, "orders")
    for i, (columns, sep, encoding) in enumerate([((code, total, kind), ";", "ISO-8859-1"), ((kind, code, total), ",", "UTF-8"), ((total, code), "\t", "UTF-8")]):
        orders.where(key % 3 == i).select(*columns).write.option("header", True).option("sep", sep).option("encoding", encoding).csv(f"{path}/{i}")
    return files.read_mixed_tables(spark, f"{path}/*/*.csv").drop("_file")


@query("SELECT CAST(count(*) AS BIGINT) AS lines FROM (SELECT 1 FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def saved_orders(spark, sf):
    """The orders table without its linking code, written and loaded."""
    raw = raw_tables(spark, sf)
    orders = stage(preparation.prepare_orders(raw, WINDOW, EXCLUDED, STATE_REGION), "prepared")
    _, path = files.save_prepared(preparation.prepare_sales(raw, orders, GROUPS), orders, _folder(spark, "orders"), False)
    return files.load_orders(spark, path).agg(F.count(F.lit(1)).alias("lines"))
