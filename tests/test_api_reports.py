import datetime as dt

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from salespark.operators import textnum
from salespark.operators.periods import SalesFilters
from salespark.plans import facts as fact_rows
from salespark.plans import report
from salespark.plans.api import MESSAGES, PARAMETERS, SalesQueries
from salespark.sources.star import sales

DAYS = 420
CATEGORIES, REGIONS = ["Beleza", "Eletrônicos", "Moda"], ["Norte", "Sul"]


@pytest.fixture(scope="module")
def base(spark):
    """About 14 months of orders; fashion declines, one day is nearly lost."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(DAYS):
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
        count = 12 + (4 if day.weekday() < 5 else 0) + int(rng.integers(0, 3))
        if i == 395:
            count = 1
        for j in range(count):
            category = CATEGORIES[int(rng.integers(0, 3))]
            revenue = round(float(rng.uniform(50, 150)) * (0.3 if category == "Moda" and i > 405 else 1.0), 2)
            rows.append(
                (f"o{i}-{j}", day, category, "Sul" if rng.random() < 0.7 else "Norte", f"item {j % 4}", 1 + j % 3, revenue,
                 round(revenue * 0.9, 2), round(revenue * 0.1, 2), f"c{int(rng.integers(0, 90))}")
            )
    schema = (
        "order_id STRING, date TIMESTAMP_NTZ, category STRING, region STRING, product STRING, units BIGINT, revenue DOUBLE, "
        "cost DOUBLE, profit DOUBLE, customer_id STRING"
    )
    df = spark.createDataFrame(rows, schema).repartition(4).persist()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def tools(base):
    return SalesQueries(base)


FILTERS = SalesFilters(dt.date(2025, 1, 25), dt.date(2025, 2, 23))


@pytest.fixture(scope="module")
def facts(base):
    return fact_rows.build_facts(base, FILTERS).persist()


GOOD = {"data_inicio": "2024-01-01", "data_fim": "2024-03-01", "dimensao": "regiao"}
BAD = {"day": "31/01/2024", "choice": "loja", "count": "trinta", "members": ["Lua"]}


def refused():
    """(query, arguments, code, named parameter) from the parameter table: each rule broken once per query."""
    for name, table in PARAMETERS.items():
        good = {k: v for k, v in GOOD.items() if k in table}
        yield name, good | {"cor": 1}, "unknown", "cor"
        for key, parameter in table.items():
            yield name, good | {key: BAD[parameter.kind]}, parameter.kind, key
            if parameter.required:
                yield name, {k: v for k, v in good.items() if k != key}, "missing", key
        if "data_fim" in table:
            yield name, good | {"data_fim": "2023-12-31"}, "order", "2023-12-31"
            yield name, good | {"data_inicio": "2030-01-01", "data_fim": "2030-02-01"}, "outside", "2024-01-01"


@pytest.mark.parametrize(("name", "args", "code", "named"), list(refused()))
def test_refused_requests_name_the_problem(tools, name, args, code, named):
    text = tools.run(name, args).first().erro
    assert named in text and text.startswith(MESSAGES[code].split("{")[0])


def test_other_problems_become_rows(tools, base, spark):
    assert "kpis" in tools.run("nada", {}).first().erro
    assert tools.run("previsao", {"horizonte_dias": 45}).first().erro.endswith("30, 60, 90.")
    early = {"data_inicio": "2024-01-01", "data_fim": "2024-02-01"}
    assert tools.run("comparar_com_periodo_anterior", early).first().erro == MESSAGES["nothing"]
    odd = SalesQueries(base.drop("units", "customer_id"))
    assert odd.run("kpis", early).first().erro == MESSAGES["failed"]
    assert "segmentos_de_clientes" not in odd.handlers and not odd.has_customers


def test_kpis_and_period_clamp(tools, base):
    row = tools.run("kpis", {"data_inicio": "2000-01-01", "data_fim": "2099-01-01"}).first()
    assert row.periodo == "01/01/2024 a 23/02/2025"
    assert row.crescimento_vs_periodo_anterior == "sem período anterior comparável"
    orders = base.select("order_id").distinct().count()
    assert row.pedidos == f"{orders:,}".replace(",", ".")


def test_ranking_shares(tools):
    args = {"data_inicio": "2024-01-01", "data_fim": "2025-02-23", "dimensao": "regiao"}
    best = tools.run("ranking", args).collect()
    worst = tools.run("ranking", args | {"ordem": "menores", "limite": 1}).collect()
    assert [r.nome for r in best] == ["Sul", "Norte"] and [r.nome for r in worst] == ["Norte"]
    assert sum(float(r.participacao[:-1].replace(",", ".")) for r in best) == pytest.approx(100, abs=0.2)


def test_months_bridge_segments(tools):
    months = tools.run("receita_mensal", {"data_inicio": "2024-01-01", "data_fim": "2025-02-23"}).collect()
    assert [m.mes for m in months][:2] == ["jan/2024", "fev/2024"] and len(months) == 14
    bridge = tools.run("comparar_com_periodo_anterior", {"data_inicio": "2025-01-25", "data_fim": "2025-02-23"}).first()
    assert len(bridge.variacao_por_categoria) == 3 and bridge.variacao_por_categoria[0].nome == "Moda"
    segments = tools.run("segmentos_de_clientes", {"regioes": ["Sul"]}).collect()
    assert segments and all(r.acao_sugerida for r in segments)


def test_anomalies_and_forecast(tools):
    found = tools.run("anomalias", {"data_inicio": "2025-01-01", "data_fim": "2025-02-23"}).collect()
    assert found[0].data == "30/01/2025" and found[0].tipo == "queda"
    made = tools.run("previsao", {"horizonte_dias": 30, "categorias": "Beleza"}).first()
    assert made.receita_prevista.startswith("R$ ") and made.erro_tipico_do_total.startswith("± ")


def test_without_customers(base):
    tools = SalesQueries(base, has_customers=False)
    assert "segmentos_de_clientes" in tools.run("segmentos_de_clientes", {}).first().erro
    assert "ontem = 22/02/2025" in tools.dataset_info() and "Regiões: Norte, Sul." in tools.dataset_info()


def test_fact_lines(facts):
    lines = [r.text for r in fact_rows.fact_lines(facts).orderBy("position").collect()]
    assert lines[0] == "Período analisado: 25/01/2025 a 23/02/2025"
    text = "\n".join(lines)
    for part in ("Receita total: R$ ", "Margem de lucro: 10,0%", "Receita por região: Sul", "Mann-Kendall", "Moda (-", "efeito mix",
                 "30/01/2025 (queda, 1 pedidos", "Previsão de receita para os 30 dias após 23/02/2025", "segmentos RFM"):
        assert part in text


def test_report_rules_and_supported_numbers(facts):
    made = report.sales_report(facts, "Vendas")
    row = made.first()
    assert len(row.highlights) <= 4 and 1 <= len(row.risks) <= 3 and 1 <= len(row.actions) <= 5
    assert row.risks[0].title == "Queda em Moda" and row.actions[0].action.endswith("campanhas de Moda")
    markdown = report.render_markdown(made)
    text = markdown.first().markdown
    assert text.startswith("**Receita de R$ ") and text.index("gravidade alta") < text.index("## Plano")
    checked = textnum.verify(markdown.join(fact_rows.facts_text(facts), "series"), "markdown", "facts").first()
    assert checked.checked > 10
    # the 10-30% reference margin in the rule's own words is the only number that is not a fact
    assert set(checked.unverified) <= {"30%", "-30%", "20-30%", "20", "30"}


def test_facts_of_a_short_base(base, spark):
    few = base.where("date < '2024-01-10'").drop("cost", "profit").withColumns({"cost": F.lit(None).cast("double"), "profit": F.lit(None).cast("double")})
    filters = SalesFilters(dt.date(2024, 1, 1), dt.date(2024, 1, 9))
    parts = tuple(p for p in fact_rows.PARTS if p != "customers")
    lines = "\n".join(r.text for r in fact_rows.fact_lines(fact_rows.build_facts(few, filters, parts=parts)).collect())
    assert "Lucro e margem: não disponíveis" in lines and "não disponível" in lines
    assert "Previsão" not in lines and "Clientes" not in lines and "decomposta" not in lines


def test_empty_selection(base):
    filters = SalesFilters(dt.date(2026, 1, 1), dt.date(2026, 1, 31))
    facts = fact_rows.build_facts(base, filters, parts=("kpis",))
    row = report.sales_report(facts, "Vendas").first()
    assert row.headline == "Não há dados de Vendas para o período 01/01/2026 a 31/01/2026 com os filtros atuais."
    assert row.risks[0].title == "Sem dados" and len(row.actions) == 2


def test_facts_read_the_base_once(spark):
    """the parts read the rows that are written once, not the joined tables."""
    from salespark.plans.report_queries import region_facts

    made = region_facts(spark, SMALL, ("kpis", "breakdown", "trend", "declining", "bridge"))
    assert not [f for f in made.inputFiles() if "lineitem" in f]


def test_region_is_told_per_order(spark):
    """customers meet the orders before the lines do."""
    plan = sales(spark, SMALL, ["region", "date", "category"])._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {key: next(line.index("Join") for line in plan if "Join Inner" in line and key in line) for key in ("l_orderkey", "o_custkey", "l_partkey")}
    assert depth["o_custkey"] > depth["l_orderkey"] > depth["l_partkey"]


def test_kpis_read_the_lines_once(spark):
    """whether the earlier period is covered is told from the dates alone."""
    from salespark.plans.report_queries import api_kpis

    plan = api_kpis(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1


def test_members_are_sought_in_one_scan(base, monkeypatch):
    """names sold in the period need no more than its rows; others are sought in the whole base."""
    tools, scans = SalesQueries(base), []
    plain = type(base).first
    monkeypatch.setattr(type(base), "first", lambda df: scans.append(df) or plain(df))
    days = {"data_inicio": "2024-01-01", "data_fim": "2024-02-01"}
    known = tools.checked(PARAMETERS["kpis"], days | {"categorias": ["Moda", "Beleza"], "regioes": "Sul"})
    assert known["filters"].categories == ("Moda", "Beleza") and len(scans) == 1
    late = base.withColumn("category", F.when(F.col("date") > "2024-06-01", F.col("category")).otherwise("Beleza"))
    found = SalesQueries(late).checked(PARAMETERS["kpis"], {"data_inicio": "2024-01-01", "data_fim": "9999-12-31", "categorias": ["Moda"]})
    assert found["filters"].categories == ("Moda",)
    found = SalesQueries(late).checked(PARAMETERS["kpis"], days | {"categorias": ["Moda"], "regioes": ["Norte"]})
    assert found["filters"].categories == ("Moda",) and found["filters"].regions == ("Norte",)
    wrong = SalesQueries(late).run("kpis", days | {"categorias": ["Moda", "Lua"], "regioes": 5}).first().erro
    assert "Lua" in wrong and "categorias" in wrong
