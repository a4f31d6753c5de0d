"""Rule-based executive report from the facts: headline, highlights, risks and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.functions import formatting as fmt
from salespark.operators.anomalies import DROP
from salespark.operators.trends import DOWN, FLAT, UP
from salespark.plans.facts import _text, _total, segment_named, strongest_anomaly

# Thresholds of the rules and the largest number of entries.
HEALTHY_MARGIN_PCT = 20
CONCENTRATION_PCT = 30
STRONG_CONCENTRATION_PCT = 50
STRONG_DECLINE_PCT = -30
AT_RISK_REVENUE_PCT = 15
MAX_HIGHLIGHTS, MAX_RISKS, MAX_ACTIONS = 4, 3, 5
HIGH, MEDIUM, LOW = "alta", "média", "baixa"
FOOTER = (
    "Relatório gerado pelo motor estatístico local (regressão linear, teste de Mann-Kendall, "
    "decomposição volume/preço/mix e regras de negócio), sem IA generativa nesta execução."
)
ICONS = {HIGH: "🔴", MEDIUM: "🟡", LOW: "🟢"}
LEVEL_ORDER = {HIGH: 0, MEDIUM: 1, LOW: 2}


def _level(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def risk(title: Column, evidence: Column, severity: str | Column) -> Column:
    return F.struct(title.alias("title"), evidence.alias("evidence"), _level(severity).alias("severity"))


def action(what: Column, why: Column, priority: str | Column) -> Column:
    return F.struct(what.alias("action"), why.alias("rationale"), _level(priority).alias("priority"))


def _kept(items: list[Column], limit: int) -> Column:
    return F.slice(F.filter(F.array(*items), lambda x: x.isNotNull()), 1, limit)


def executive_report(facts: DataFrame) -> DataFrame:
    """(series, headline, highlights, risks, actions): one report per group with sales in the period.

    Every rule is a conditional entry; entries keep rule order and are cut to the allowed number.
    """
    brl, num, pct = fmt.format_brl, fmt.format_number, fmt.format_pct
    c = F.col
    prepared = facts.where(c("lines") > 0).withColumns(
        {
            "_category": F.try_element_at("by_category", F.lit(1)),
            "_region": F.try_element_at("by_region", F.lit(1)),
            "_day": strongest_anomaly(),
            "_decline": F.try_element_at("declining", F.lit(1)),
            "_at_risk": segment_named("Em risco"),
        }
    )
    category, region = c("_category.name"), c("_region.name")
    category_pct = pct(c("_category.revenue") / _total() * 100)
    region_share = c("_region.revenue") / _total() * 100
    trend_word = F.when(c("direction") == UP, "crescimento").when(c("direction") == DOWN, "queda")
    trend_word = F.when(c("direction") == FLAT, "estabilidade").otherwise(trend_word)
    growth = F.coalesce(
        _text(pct(c("growth_pct"), signed=True), " vs o ", c("comparison_label")),
        F.lit("sem período anterior comparável"),
    )
    headline = _text("Receita de ", brl(c("revenue")), " no período (", growth, "), com ", trend_word, " da receita diária.")

    sold = _text("Receita de ", brl(c("revenue")), " em ", num(c("orders")), " pedidos (ticket médio de ", brl(c("avg_ticket")), ")")
    earned = _text(", com lucro de ", brl(c("profit")), " e margem de ", pct(c("margin_pct")))
    certainty = F.when(c("significant"), "estatisticamente significativa").otherwise("não significativa")
    bridge = c("bridge")
    highlights = [
        _text(sold, F.coalesce(earned, F.lit("")), "."),
        _text(category, " lidera com ", category_pct, " da receita; ", region, " é a principal região (", pct(region_share), ")."),
        F.when(
            bridge.isNotNull(),
            _text(
                "A variação de ", brl(bridge["total_change"]), " vem de volume (", brl(bridge["volume_effect"]),
                "), preço (", brl(bridge["price_effect"]), ") e mix (", brl(bridge["mix_effect"]), ").",
            ),
        ),
        _text("Tendência diária: ", trend_word, " (Mann-Kendall, ", fmt.format_p_value(c("p_value")), "; ", certainty, ")."),
    ]

    decline, day, at_risk, forecast = c("_decline"), c("_day"), c("_at_risk"), c("forecast")
    change_size = F.abs(F.when(bridge["total_change"] == 0, 1.0).otherwise(bridge["total_change"]))
    bad_mix = (bridge["mix_effect"] < 0) & (F.abs(bridge["mix_effect"]) > 0.1 * change_size)
    thin = c("margin_pct") < HEALTHY_MARGIN_PCT
    day_text = fmt.format_day(day["ds"])
    declined = decline["category"]
    risks = [
        F.when(
            decline.isNotNull(),
            risk(
                _text("Queda em ", declined),
                _text("Receita de ", declined, " variou ", pct(decline["change_pct"], 0), " entre a 1ª e a 2ª metade do período."),
                F.when(decline["change_pct"] < STRONG_DECLINE_PCT, HIGH).otherwise(MEDIUM),
            ),
        ),
        F.when(
            c("direction") == DOWN,
            risk(
                F.lit("Tendência de queda da receita"),
                _text("Queda estatisticamente significativa na receita diária (", fmt.format_p_value(c("p_value")), ")."),
                HIGH,
            ),
        ),
        F.when(
            bad_mix,
            risk(
                F.lit("Mix de vendas menos favorável"),
                _text("A migração entre categorias reduziu a receita em ", brl(F.abs(bridge["mix_effect"])), "."),
                MEDIUM,
            ),
        ),
        F.when(
            day.isNotNull(),
            risk(
                _text("Dia atípico em ", day_text),
                _text(
                    num(day["value"]), " pedidos contra ", num(day["expected"]), " esperados (",
                    pct(day["deviation_pct"], 0, signed=True), ").",
                ),
                F.when(day["kind"] == DROP, HIGH).otherwise(LOW),
            ),
        ),
        F.when(
            thin,
            risk(
                F.lit("Margem abaixo do saudável"),
                _text("Margem de ", pct(c("margin_pct")), ", abaixo da referência de 20-30%."),
                HIGH,
            ),
        ),
        F.when(
            region_share > CONCENTRATION_PCT,
            risk(
                F.lit("Concentração regional"),
                _text(region, " responde por ", pct(region_share), " da receita."),
                F.when(region_share > STRONG_CONCENTRATION_PCT, MEDIUM).otherwise(LOW),
            ),
        ),
    ]
    actions = [
        F.when(
            decline.isNotNull(),
            action(
                _text("Revisar mix de produtos e campanhas de ", declined),
                _text("Foi a categoria com maior queda no período (", pct(decline["change_pct"], 0), ")."),
                HIGH,
            ),
        ),
        F.when(
            bad_mix,
            action(
                F.lit("Reforçar a exposição das categorias de maior preço médio"),
                _text("O efeito mix foi de ", brl(bridge["mix_effect"]), " no período."),
                MEDIUM,
            ),
        ),
        F.when(
            day["kind"] == DROP,
            action(
                _text("Investigar a causa da queda de pedidos em ", day_text),
                F.lit("Quedas bruscas costumam indicar incidente operacional (site, pagamento, estoque)."),
                HIGH,
            ),
        ),
        F.when(
            thin,
            action(
                F.lit("Reavaliar política de custos e descontos"),
                _text("A margem está em ", pct(c("margin_pct")), "."),
                HIGH,
            ),
        ),
        F.when(
            at_risk.isNotNull(),
            action(
                F.lit("Campanha de reativação para clientes 'Em risco'"),
                _text(
                    "São ", num(at_risk["customers"]), " clientes que já geraram ", pct(at_risk["revenue_pct"]),
                    " da receita e pararam de comprar.",
                ),
                F.when(at_risk["revenue_pct"] > AT_RISK_REVENUE_PCT, HIGH).otherwise(MEDIUM),
            ),
        ),
        F.when(
            forecast.isNotNull(),
            action(
                _text("Planejar estoque e metas com base na previsão de ", brl(forecast["total"])),
                _text(
                    "Previsão para os próximos ", forecast["horizon"].cast("string"), " dias, com erro típico de ± ",
                    pct(forecast["total_error"]), ".",
                ),
                MEDIUM,
            ),
        ),
        action(
            _text("Proteger a liderança de ", category),
            _text("A categoria concentra ", category_pct, " da receita."),
            MEDIUM,
        ),
    ]
    calm = risk(
        F.lit("Sem gargalos relevantes"),
        F.lit("Nenhuma queda de categoria, anomalia ou margem baixa identificada no período."),
        LOW,
    )
    report = prepared.select(
        "series",
        headline.alias("headline"),
        _kept(highlights, MAX_HIGHLIGHTS).alias("highlights"),
        _kept(risks, MAX_RISKS).alias("risks"),
        _kept(actions, MAX_ACTIONS).alias("actions"),
    )
    return report.withColumn("risks", F.when(F.size("risks") == 0, F.array(calm)).otherwise(F.col("risks")))


def empty_report(facts: DataFrame, dataset_name: str) -> DataFrame:
    """The fixed report of every group without sales in the period."""
    headline = _text("Não há dados de ", dataset_name, " para o período ", F.col("period_label"), " com os filtros atuais.")
    fixed_risk = risk(F.lit("Sem dados"), F.lit("O recorte não tem vendas para analisar."), LOW)
    fixed_actions = F.array(
        action(F.lit("Ajustar o período ou os filtros"), F.lit("O recorte atual está vazio."), HIGH),
        action(
            F.lit("Verificar a fonte de dados"),
            F.lit("Confirme se a base enviada cobre o período desejado."),
            MEDIUM,
        ),
    )
    without = facts.where(F.coalesce(F.col("lines"), F.lit(0)) == 0)
    return without.select(
        "series",
        headline.alias("headline"),
        F.array(F.lit("Nenhum pedido no recorte selecionado.")).alias("highlights"),
        F.array(fixed_risk).alias("risks"),
        fixed_actions.alias("actions"),
    )


def sales_report(facts: DataFrame, dataset_name: str) -> DataFrame:
    """One report for every group."""
    return executive_report(facts).unionByName(empty_report(facts, dataset_name))


def _by_level(items: str, level: str) -> Column:
    """Entries with the gravest first, otherwise in their order."""
    order = F.create_map(*[F.lit(part) for pair in LEVEL_ORDER.items() for part in pair])
    numbered = F.transform(items, lambda x, i: F.struct(order[x[level]].alias("o"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(numbered), lambda n: n["x"])


def render_markdown(reports: DataFrame, footer: str | None = FOOTER) -> DataFrame:
    """(series, markdown)."""
    icons = F.create_map(*[F.lit(part) for pair in ICONS.items() for part in pair])
    risks = F.transform(
        _by_level("risks", "severity"),
        lambda r: _text(
            "- ", icons[r["severity"]], " **", r["title"], "** (gravidade ", r["severity"], "): ", r["evidence"]
        ),
    )
    actions = F.transform(
        _by_level("actions", "priority"),
        lambda a, i: _text(
            (i + 1).cast("string"), ". **", a["action"], "** (prioridade ", a["priority"], ") — ", a["rationale"]
        ),
    )
    fixed = lambda *lines: F.array(*[F.lit(x) for x in lines])
    lines = F.concat(
        F.array(_text("**", F.col("headline"), "**")),
        fixed("", "## Destaques do Período", ""),
        F.transform("highlights", lambda h: _text("- ", h)),
        fixed("", "## Diagnóstico de Pontos Críticos / Gargalos", ""),
        risks,
        fixed("", "## Plano de Ação Estratégico Sugerido", ""),
        actions,
        fixed("", "---", f"*{footer}*") if footer else fixed(),
    )
    return reports.select("series", F.array_join(lines, "\n").alias("markdown"))
