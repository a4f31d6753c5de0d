"""Catalogue: imported text tables, validation, formatting, cited numbers and answer scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from salespark.functions import formatting as fmt
from salespark.functions import parsing, text
from salespark.functions.numeric import exact_sum
from salespark.operators import evaluation, importing, schema, textnum
from salespark.plans.catalog import query, rounded, with_sales
from salespark.session import stage
from salespark.sources.star import sales, spread, table


# ---------------------------------------------------------------- import
@query("""WITH t AS (SELECT DISTINCT 'Cód. ' || p_name || ' / ' || p_type AS name FROM part)
SELECT name, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '_', 'g'), '_') AS normalized FROM t""")
def normalized_names(spark, sf):
    names = table(spark, sf, "part").select(F.concat_ws("", F.lit("Cód. "), "p_name", F.lit(" / "), "p_type").alias("name"))
    return names.distinct().withColumn("normalized", text.normalize_name(F.col("name")))


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def folded_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@query("""SELECT o_orderkey, o_totalprice AS brl, o_totalprice AS english, o_totalprice AS plain, floor(o_totalprice) AS grouped,
CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS accounting FROM orders""")
def parsed_numbers(spark, sf):
    total = F.col("o_totalprice")
    written = spread(table(spark, sf, "orders")).select(
        "o_orderkey",
        fmt.format_brl(total).alias("brl_text"),
        F.format_number(total, 2).alias("english_text"),
        total.cast("string").alias("plain_text"),
        fmt.format_number(F.floor(total)).alias("grouped_text"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("("), fmt.format_number(total, 2), F.lit(")")))
        .otherwise(fmt.format_number(total, 2))
        .alias("accounting_text"),
    )
    written = stage(written, "numbers")
    names = ["brl", "english", "plain", "grouped", "accounting"]
    styles = importing.number_styles(written, {n: f"{n}_text" for n in names})
    judged = written.select("*", styles.alias("styles"))
    return judged.select(
        "o_orderkey",
        *[parsing.number_value(F.col(f"{n}_text"), F.col("styles")[n]).alias(n) for n in names],
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def parsed_dates(spark, sf):
    day = F.to_date("o_orderdate")
    form = F.pmod("o_orderkey", F.lit(7))
    written = (
        F.when(form == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(form == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 2, F.concat(F.date_format(day, "yyyy/M/d"), F.lit(" 10:30")))
        .when(form == 3, F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
        .when(form == 4, F.date_format(day, "d-M-yy"))
        .when(form == 5, F.date_format(day, "d MMM yyyy"))
        .otherwise("data ruim")
    )
    rows = table(spark, sf, "orders").select("o_orderkey", written.alias("written"))
    return rows.select("o_orderkey", parsing.date_value(F.col("written")).alias("day"))


def typed_sales(spark, sf):
    """The typed table below, written as the file an import starts from."""
    return stage(_typed_rows(spark, sf), "typed")


def _typed_rows(spark, sf):
    """Order lines as people type them: mixed date styles, Brazilian money, gaps and returns."""
    day, price = F.to_date("o_orderdate"), F.col("l_extendedprice")
    form = F.pmod("l_orderkey", F.lit(4))
    typed_day = (
        F.when(F.pmod("l_orderkey", F.lit(97)) == 0, "data ruim")
        .when(form == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(form == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 2, F.date_format(day, "yyyy.MM.dd"))
        .otherwise(F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"))
    )
    returned = (F.col("l_linenumber") == 7) & (F.col("l_quantity") < 5)
    list_cost = (price.cast("decimal(12,2)") * F.lit("0.65").cast("decimal(4,2)")).cast("decimal(18,2)")
    cost = F.replace(list_cost.cast("string"), F.lit("."), F.lit(","))
    lines = spread(table(spark, sf, "lineitem")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        typed_day.alias("Data da Venda"),
        fmt.format_brl(F.when(returned, -price).otherwise(price)).alias("Valor Total"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("  "), "l_returnflag")).alias("Categoria"),
        F.col("l_linestatus").alias("Estado"),
        F.when(F.col("l_linenumber") != 1, F.col("l_quantity").cast("bigint").cast("string")).alias("Qtd"),
        F.when(F.col("l_tax") == 0.08, F.concat(F.lit("("), cost, F.lit(")"))).otherwise(cost).alias("Custo"),
        F.concat(F.lit(" C-"), F.col("o_custkey")).alias("Cód. Cliente"),
        F.col("l_linenumber").cast("string").alias("Observação"),
    )


TYPED_CTE = """WITH t AS (SELECT l_orderkey % 97 = 0 AS bad_day, l_linenumber = 7 AND l_quantity < 5 AS returned, CAST(o_orderdate AS DATE) AS day,
  CASE WHEN l_returnflag <> 'R' THEN l_returnflag ELSE 'Não informado' END AS category, l_linestatus AS region,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue, CASE WHEN l_linenumber <> 1 THEN CAST(l_quantity AS BIGINT) ELSE 1 END AS units,
  CASE WHEN l_tax <> 0.08 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.65 AS DECIMAL(18,2)) END AS cost, 'C-' || o_custkey AS customer_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT * FROM t WHERE NOT bad_day AND NOT returned) """


@query(TYPED_CTE + """SELECT category, region, 'Não informado' AS product, CAST(year(day) AS INTEGER) AS year, count(*) AS lines, count(cost) AS with_cost,
CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(units) AS BIGINT) AS units, CAST(coalesce(sum(revenue - cost), 0) AS DOUBLE) AS profit,
CAST(count(DISTINCT customer_id) AS BIGINT) AS customers, round(avg(revenue / units), 4) AS mean_price FROM v GROUP BY ALL""")
def imported_sales(spark, sf):
    raw = typed_sales(spark, sf)
    rows = importing.converted(raw, importing.guess_mapping(raw.columns)).where("valid")
    grouped = rows.groupBy("category", "region", "product", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("cost").alias("with_cost"),
        exact_sum("revenue").alias("revenue"),
        F.sum("units").alias("units"),
        exact_sum("profit").alias("profit"),
        F.count_distinct("customer_id").alias("customers"),
        F.avg("unit_price").alias("mean_price"),
    )
    return rounded(grouped, 4, revenue=2, profit=2)


@query(TYPED_CTE + """SELECT count(*) FILTER (NOT bad_day AND NOT returned) AS valid_rows, count(*) FILTER (bad_day OR returned) AS invalid_rows,
count(*) FILTER (cost IS NULL AND NOT bad_day AND NOT returned) = 0 AS has_cost, true AS has_customers FROM t""")
def import_summary(spark, sf):
    raw = typed_sales(spark, sf)
    return importing.conversion_summary(importing.converted(raw, importing.guess_mapping(raw.columns)))


def _damaged(spark, sf):
    """Sales with broken values: lost units, negative revenue, a region that is missing."""
    base = sales(spark, sf, ["date", "category", "region", "product", "units", "unit_price", "revenue", "cost", "profit"])
    return base.withColumns(
        {
            "units": F.when(F.col("units") == 50, "cinquenta").otherwise(F.col("units").cast("string")),
            "revenue": F.col("revenue") - 30000,
            "region": F.when(F.col("region") != "ASIA", F.col("region")),
            "extra": F.lit(1),
        }
    )


_RULES = ["units: bigint", "revenue: greater_than_or_equal_to(0)", "region: not_nullable"]


@query(with_sales(""", b AS (SELECT count(*) FILTER (units = 50) AS u, count(*) FILTER (revenue < 30000) AS r, count(*) FILTER (region = 'ASIA') AS g FROM sales)
SELECT unnest([{'rule': 'units: bigint', 'failing': u}, {'rule': 'revenue: greater_than_or_equal_to(0)', 'failing': r},
{'rule': 'region: not_nullable', 'failing': g}], recursive := true) FROM b"""))
def rule_violations(spark, sf):
    counts = schema.violations(_damaged(spark, sf))
    cells = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("failing")) for c in counts.columns])
    return counts.select(F.inline(cells)).where(F.col("failing") > 0)


@query(with_sales("""SELECT count(*) AS lines, CAST(sum(CASE WHEN units = 50 THEN 0 ELSE units END) AS BIGINT) AS units,
CAST(sum(revenue - 30000) AS DOUBLE) AS revenue, CAST(sum(CASE WHEN region = 'ASIA' THEN 0 ELSE cost END) AS DOUBLE) AS cost FROM sales"""))
def cleaned_sales(spark, sf):
    damaged = _damaged(spark, sf).withColumn("cost", F.when(F.col("region").isNotNull(), F.col("cost")))
    return schema.defensive_clean(damaged).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("units").alias("units"),
        F.round(exact_sum("revenue"), 2).alias("revenue"),
        F.round(exact_sum("cost"), 2).alias("cost"),
    )


# ---------------------------------------------------------------- formatting
BRL = "CASE WHEN {v} < 0 THEN '-' ELSE '' END || 'R$ ' || translate(format('{{:,.2f}}', abs({v})), ',.', '.,')"


@query(f"""SELECT o_orderkey, {BRL.format(v='o_totalprice')} AS brl, {BRL.format(v='(-o_totalprice)')} AS debit,
translate(format('{{:,}}', o_orderkey), ',', '.') AS code,
translate(format('{{:,.2f}}', o_orderkey / 8.0), ',.', '.,') || '%' AS pct,
CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '+' END || translate(format('{{:,.2f}}', (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (o_orderkey + 1) / 4.0), ',.', '.,') || '%' AS signed_pct,
CASE WHEN o_orderkey % 2000 = 0 THEN 'p < 0,001' ELSE 'p = ' || translate(format('{{:.3f}}', (o_orderkey % 2000) / 2048.0 + 0.001), '.', ',') END AS p_value,
strftime(o_orderdate, '%d/%m/%Y') AS day,
(['jan', 'fev', 'mar', 'abr', 'mai', 'jun', 'jul', 'ago', 'set', 'out', 'nov', 'dez'])[month(o_orderdate)] || '/' || year(o_orderdate) AS month,
(['Seg', 'Ter', 'Qua', 'Qui', 'Sex', 'Sáb', 'Dom'])[isodow(o_orderdate)] AS weekday FROM orders""")
def formatted_orders(spark, sf):
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        fmt.format_brl(total).alias("brl"),
        fmt.format_brl(-total).alias("debit"),
        fmt.format_number(key).alias("code"),
        fmt.format_pct(key / F.lit(8.0), 2).alias("pct"),
        fmt.format_pct(F.when(key % 3 == 0, -1).otherwise(1) * (key + 1) / F.lit(4.0), 2, signed=True).alias("signed_pct"),
        fmt.format_p_value(F.when(key % 2000 == 0, 0.0).otherwise((key % 2000) / F.lit(2048.0) + 0.001)).alias("p_value"),
        fmt.format_day(F.col("o_orderdate")).alias("day"),
        fmt.month_label(F.col("o_orderdate")).alias("month"),
        fmt.weekday_label(F.col("o_orderdate")).alias("weekday"),
    )


@query("""SELECT o_orderkey, CASE WHEN v >= 1000000 THEN 'R$ ' || replace(format('{:.2f}', v / 1000000), '.', ',') || ' mi'
WHEN v >= 1000 THEN 'R$ ' || replace(format('{:,.0f}', v / 1000), ',', '.') || ' mil' ELSE 'R$ ' || format('{:.0f}', v) END AS label
FROM (SELECT o_orderkey, o_totalprice * (o_orderkey % 5) * (o_orderkey % 3) / 2 AS v FROM orders)""")
def short_labels(spark, sf):
    value = F.col("o_totalprice") * (F.col("o_orderkey") % 5) * (F.col("o_orderkey") % 3) / 2
    return table(spark, sf, "orders").select("o_orderkey", fmt.short_brl(value).alias("label"))


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS json FROM orders""")
def result_json(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fmt.result_json("o_orderkey", "o_orderstatus").alias("json"))


@query("""SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log1p, round(exp(o_totalprice / 1e6) - 1, 6) AS expm1, round(sqrt(o_totalprice), 6) AS root,
CAST(ceil(o_totalprice) AS BIGINT) AS up, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, last_day(o_orderdate) AS month_end,
CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(o_orderdate + INTERVAL 1 YEAR AS DATE) AS next_year, least(greatest(o_totalprice, 100000), 300000) AS clipped FROM orders""")
def scalar_functions(spark, sf):
    total, day = F.col("o_totalprice"), F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.round(F.log1p(total), 6).alias("log1p"),
        F.round(F.expm1(total / 1e6), 6).alias("expm1"),
        F.round(F.sqrt(total), 6).alias("root"),
        F.ceil(total).alias("up"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"),
        F.last_day(day).alias("month_end"),
        F.to_date(F.trunc(day, "month")).alias("month_start"),
        F.add_months(day, 12).alias("next_year"),
        F.least(F.greatest(total, F.lit(100000.0)), F.lit(300000.0)).alias("clipped"),
    )


# ---------------------------------------------------------------- cited numbers
def answered_orders(spark, sf):
    """An answer and its facts per order: exact total, total in thousands cut down, margin off by 0 to 2 points."""
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    pct = (key % 900 + 100) / F.lit(10.0)
    cited_pct = F.floor(pct) + key % 3
    thousands = F.floor(total / 100) / 10
    said_total = F.when(key % 7 == 0, total * 2).otherwise(total)
    state = (
        F.when(F.col("o_orderstatus") == "F", "situação confirmada")
        .when(F.col("o_orderstatus") == "O", "SITUAÇÃO ABERTA")
        .otherwise("situação pendente")
    )
    robust = F.col("o_orderpriority") == "5-LOW"
    said = F.concat(
        F.lit("Pedido de "), fmt.format_day(F.col("o_orderdate")), F.lit(": "), state,
        F.lit(".\n- Total de "), fmt.format_brl(said_total), F.lit(" (R$ "), fmt.format_number(thousands, 1),
        F.lit(" mil)\n- Margem de "), fmt.format_number(cited_pct), F.lit("%"),
        F.when(key % 31 == 0, " chave AIzaSy").otherwise(""),
    )
    refusal = "Não tenho essa informação nos dados disponíveis."
    return spread(table(spark, sf, "orders"), per_core=4).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", total.alias("total"), pct.alias("pct"),
        cited_pct.cast("double").alias("cited_pct"), (thousands * 1000).alias("cited_thousands"),
        F.when(robust & (key % 2 == 0), refusal).otherwise(said).alias("answer"),
        F.concat(F.lit("Total: "), fmt.format_brl(total), F.lit("; margem "), fmt.format_number(pct, 1), F.lit("%")).alias("facts"),
    )


SAID_CTE = """WITH a AS (SELECT o_orderkey AS k, o_orderstatus, o_orderpriority, o_totalprice AS total, (o_orderkey % 900 + 100) / 10.0::DOUBLE AS pct,
  floor((o_orderkey % 900 + 100) / 10.0::DOUBLE) + o_orderkey % 3 AS cited_pct, floor(o_totalprice / 100) * 100 AS th,
  o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0 AS refused FROM orders),
c AS (SELECT *, abs(th - total) <= least(50, th * 0.05) + 1e-9 AS th_ok, abs(cited_pct - pct) <= 0.5 + 1e-9 AS pct_ok,
  k % 7 <> 0 OR abs(total * 2 - total) <= 0.005 AS total_ok FROM a) """


@query(SAID_CTE + """SELECT k AS o_orderkey, CASE WHEN refused THEN 0 ELSE 3 END AS checked, 2 AS known,
CASE WHEN refused THEN 0 ELSE total_ok::INT + th_ok::INT + pct_ok::INT END AS verified,
refused OR (total_ok AND th_ok AND pct_ok) AS ok FROM c""")
def verified_answers(spark, sf):
    checked = textnum.verify(answered_orders(spark, sf))
    return checked.select("o_orderkey", "checked", "known", "verified", "ok")


@query(SAID_CTE + """SELECT k AS o_orderkey, 0 AS position, round(CASE WHEN k % 7 = 0 THEN total * 2 ELSE total END, 2) AS value, false AS is_percent, 0.005 AS tolerance, false AS signed FROM c WHERE NOT refused
UNION ALL SELECT k, 1, round(th, 2), false, round(least(50, th * 0.05), 6), false FROM c WHERE NOT refused
UNION ALL SELECT k, 2, cited_pct, true, 0.5, false FROM c WHERE NOT refused""")
def cited_numbers(spark, sf):
    rows = textnum.cited_rows(answered_orders(spark, sf), "answer", "o_orderkey").drop("text")
    return rounded(rows, 6, value=2)


@query()
def document_numbers(spark, sf):
    return textnum.cited_rows(spread(table(spark, sf, "documents")), "text", "doc_id")


# ---------------------------------------------------------------- answer scoring
def evaluated_orders(spark, sf):
    """The answers above as evaluation rows of two models, with expected values and stored call details."""
    base = textnum.verify(answered_orders(spark, sf), numbers="cited")
    key = F.col("o_orderkey")
    robust = F.col("o_orderpriority") == "5-LOW"
    number = lambda label, value, percent, near: F.struct(
        F.lit(label).alias("label"), value.alias("value"), F.lit(percent).alias("percent"),
        F.lit(near).cast("string").alias("near"),
    )
    numbers = F.array(number("total", F.col("total"), False, None), number("margem", F.col("pct"), True, "margem"))
    texts = F.array(F.array(F.lit("situacao confirmada"), F.lit("Situação aberta")))
    rows = base.select(
        F.concat(F.lit("q"), key).alias("id"),
        F.when(robust, evaluation.ROBUSTNESS).otherwise(F.col("o_orderpriority")).alias("kind"),
        F.concat(F.lit("Como está o pedido "), key, F.lit("?")).alias("question"),
        F.concat(F.lit("m"), key % 2).alias("model"),
        "answer",
        F.array(F.element_at(F.array(F.lit("kpis"), F.lit("ranking"), F.lit("previsao")), (key % 3 + 1).cast("int"))).alias("tools_called"),
        F.array(F.lit("kpis"), F.lit("ranking")).alias("accepted"),
        F.when(robust, F.array().cast(evaluation.EXPECTED_NUMBERS)).otherwise(numbers).alias("numbers"),
        F.when(robust, F.array().cast("array<array<string>>")).otherwise(texts).alias("texts"),
        F.array(F.lit("AIza")).alias("forbidden"),
        F.col("unverified").alias("hallucinated"),
        ((key % 50) / F.lit(10.0)).alias("latency_s"),
        (key % 4000).alias("tokens_in"),
        (key % 300).alias("tokens_out"),
        F.when(key % 41 == 0, "sem cota").alias("error"),
        "cited",
    )
    return evaluation.score(rows, "cited").drop("cited")


EVAL_CTE = SAID_CTE + """, e AS (SELECT *, o_orderpriority = '5-LOW' AS robust, k % 41 = 0 AS error, 'm' || (k % 2) AS model, k % 3 < 2 AS right_tool,
  CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE (NOT (total_ok OR th_ok))::INT + (NOT pct_ok)::INT END AS missing_n,
  CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE (o_orderstatus = 'P')::INT END AS missing_t,
  CASE WHEN refused THEN 0 ELSE (NOT total_ok)::INT + (NOT th_ok)::INT + (NOT pct_ok)::INT END AS hallucinated,
  (k % 31 = 0 AND NOT refused)::INT AS forbidden_n, CASE WHEN o_orderpriority = '5-LOW' AND NOT refused THEN 3 ELSE 0 END AS unexpected FROM c),
r AS (SELECT *, CASE WHEN robust THEN 'robustez' ELSE o_orderpriority END AS kind,
  NOT error AND right_tool AND missing_n + missing_t + hallucinated + forbidden_n + unexpected = 0 AS passed FROM e) """


@query(EVAL_CTE + """SELECT 'q' || k AS id, kind, model, right_tool, missing_n, missing_t, hallucinated, forbidden_n, unexpected, NOT robust AS expects_numbers, passed FROM r""")
def scored_answers(spark, sf):
    done = evaluated_orders(spark, sf)
    return done.select(
        "id", "kind", "model", "right_tool",
        F.size("missing_numbers").alias("missing_n"), F.size("missing_texts").alias("missing_t"),
        F.size("hallucinated").alias("hallucinated"), F.size("forbidden_found").alias("forbidden_n"),
        F.size("unexpected_numbers").alias("unexpected"), "expects_numbers", "passed",
    )


@query(EVAL_CTE + """SELECT model, count(*) FILTER (NOT error) AS answered, count(*) FILTER (passed) AS passed,
round(avg(passed::INT) FILTER (NOT error) * 100, 4) AS pass_pct, round(avg((missing_n = 0)::INT) FILTER (NOT error AND NOT robust) * 100, 4) AS numbers_pct,
round(avg((hallucinated = 0)::INT) FILTER (NOT error) * 100, 4) AS supported_pct, round(avg(right_tool::INT) FILTER (NOT error) * 100, 4) AS right_tool_pct,
round(median((k % 50) / 10.0::DOUBLE) FILTER (NOT error), 4) AS median_latency_s, round(avg(k % 4000 + k % 300) FILTER (NOT error), 4) AS mean_tokens,
count(*) FILTER (error) AS errors FROM r GROUP BY 1""")
def scoreboard(spark, sf):
    return rounded(evaluation.scoreboard(evaluated_orders(spark, sf)))


@query(EVAL_CTE + """SELECT kind, model, count(*) AS answered, round(avg(passed::INT) * 100, 4) AS pass_pct FROM r WHERE NOT error GROUP BY ALL""")
def scoreboard_by_kind(spark, sf):
    return rounded(evaluation.scoreboard_by_kind(evaluated_orders(spark, sf)))


@query(EVAL_CTE + "SELECT model, count(*) AS failed FROM r WHERE NOT error AND NOT passed GROUP BY 1")
def failed_answers(spark, sf):
    listed = evaluation.failures(evaluated_orders(spark, sf)).where(F.length("problems") > 0)
    return listed.groupBy("model").agg(F.count(F.lit(1)).alias("failed"))


@query(SAID_CTE + """SELECT 'm' || (k % 2) AS model, count(*) FILTER (k % 13 <> 0) AS valid, count(*) FILTER (k % 13 <> 0 OR k % 2 = 0) AS reports,
CAST(coalesce(sum(CASE WHEN refused THEN 0 ELSE 3 END) FILTER (k % 13 <> 0 OR k % 2 = 0), 0) AS BIGINT) AS checked,
CAST(coalesce(sum(CASE WHEN refused THEN 0 ELSE total_ok::INT + th_ok::INT + pct_ok::INT END) FILTER (k % 13 <> 0 OR k % 2 = 0), 0) AS BIGINT) AS verified,
round(100 * sum(CASE WHEN refused THEN 0 ELSE total_ok::INT + th_ok::INT + pct_ok::INT END) FILTER (k % 13 <> 0 OR k % 2 = 0)
  / sum(CASE WHEN refused THEN 0 ELSE 3 END) FILTER (k % 13 <> 0 OR k % 2 = 0), 4) AS verified_pct,
round(avg((k % 50) / 10.0::DOUBLE) FILTER (k % 13 <> 0 OR k % 2 = 0), 4) AS mean_latency_s, count(*) FILTER (k % 13 = 0 AND k % 2 = 1) AS errors FROM c GROUP BY 1""")
def report_scoreboard(spark, sf):
    key = F.col("o_orderkey")
    reports = textnum.verify(answered_orders(spark, sf)).select(
        F.concat(F.lit("m"), key % 2).alias("model"),
        (key % 13 != 0).alias("valid"),
        "checked",
        "verified",
        ((key % 50) / F.lit(10.0)).alias("latency_s"),
        F.when(key % 13 == 0, F.when(key % 2 == 0, "resposta fora do formato").otherwise("sem cota")).alias("error"),
    )
    return rounded(evaluation.report_scoreboard(reports))


def stored_answers(spark, sf):
    """Finished orders as answered cases; the urgent ones ended in an error."""
    finished = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    error = F.when(F.col("o_orderpriority") == "1-URGENT", "erro").alias("error")
    return finished.select(F.concat(F.lit("q"), F.col("o_orderkey")).alias("id"), error)


@query("""SELECT 'q' || o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT')""")
def open_cases(spark, sf):
    cases = table(spark, sf, "orders").select(F.concat(F.lit("q"), F.col("o_orderkey")).alias("id"))
    return evaluation.open_cases(cases, stored_answers(spark, sf))


@query("""SELECT 'q' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice < 250000 OR o_orderpriority <> '1-URGENT')""")
def kept_results(spark, sf):
    asked = table(spark, sf, "orders").where(F.col("o_totalprice") >= 250000)
    asked = asked.select(F.concat(F.lit("q"), F.col("o_orderkey")).alias("id"))
    return evaluation.kept_results(stored_answers(spark, sf), asked).select("id")
