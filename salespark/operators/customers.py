"""Customer segments: RFM scores by quintile, rule segments, and K-Means groups."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespark.functions.numeric import exact_sum, share_pct
from salespark.operators.clustering import equal_as_one, euclidean_silhouettes, fit_all, nearest
from salespark.operators.ranking import row_positions
from salespark.operators.schema import order_count
from salespark.operators.selection import order_statistics
from salespark.session import stage

# Limits of the segmentation.
MIN_CUSTOMERS = 50
ACTIVE_DAYS = 90
K_VALUES = (2, 3, 4, 5, 6)
MIN_ACTIONABLE_K = 3
SEED = 42

# Segments in rule order with the suggested action.
SEGMENT_ACTIONS = {
    "Campeões": "Recompensar e transformar em promotores (programa de indicação, acesso antecipado).",
    "Clientes fiéis": "Oferecer upgrade e venda cruzada; pedir avaliações.",
    "Potenciais fiéis": "Programa de fidelidade e recomendações personalizadas.",
    "Novos clientes": "Onboarding e incentivo à segunda compra nos primeiros 30 dias.",
    "Precisam de atenção": "Ofertas por tempo limitado baseadas no histórico de compra.",
    "Em risco": "Campanha de reativação personalizada antes que deixem de comprar.",
    "Hibernando": "Reengajar com conteúdo e descontos pontuais; avaliar custo de contato.",
    "Perdidos": "Pesquisa de motivo de saída; reativação só se o custo for baixo.",
}
METRICS = ["recency", "frequency", "monetary"]


class TooFewCustomersError(ValueError):
    """Not enough customers to segment."""


def reference_day(df: DataFrame) -> Column:
    """The day after the base's last sale (also counting rows without customer)."""
    return df.agg(F.date_add(F.to_date(F.max("date")), 1).alias("reference")).scalar()


def rfm_table(df: DataFrame, reference: date | Column | None = None, by: list[str] | None = None) -> DataFrame:
    """(customer_id, recency, frequency, monetary): whole days since the last order, orders, revenue.

    With `by`, one table per group, each measured from the day after its own last sale.
    """
    by = list(by or [])
    known = df.where(F.col("customer_id").isNotNull())
    table = known.groupBy(*by, "customer_id").agg(
        F.to_date(F.max("date")).alias("last"),
        order_count(df.columns).alias("frequency"),
        exact_sum("revenue").alias("monetary"),
    )
    if by:
        ends = df.groupBy(*by).agg(F.date_add(F.to_date(F.max("date")), 1).alias("_reference"))
        table, reference = table.join(ends, by), F.col("_reference")
    elif reference is None:
        reference = reference_day(known.select("date"))
    elif not isinstance(reference, Column):
        reference = F.lit(reference)
    recency = F.datediff(reference, F.col("last")).alias("recency")
    return table.select(*by, "customer_id", recency, "frequency", "monetary")


def quintile_limits(customers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The values at ranks n/5, 2n/5, 3n/5, 4n/5 of each metric (recency newest last), one row per group.

    A score only depends on how many of these order statistics a value exceeds, so customers are neither sorted nor
    joined back to a rank.
    """
    by = list(by or [])
    signed = {"recency": -F.col("recency"), "frequency": F.col("frequency"), "monetary": F.col("monetary")}
    found = order_statistics(customers, signed, [s / 5 for s in (1, 2, 3, 4)], lambda total, f: F.floor(total * F.lit(round(f * 5)) / F.lit(5)), by)
    return found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("stats").alias("limits")))).alias("limits"))


def add_scores(customers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Add r/f/m_score from 1 to 5; equal values share the score of the start of their tie."""
    limits = quintile_limits(customers, by)
    scored = customers.join(limits, by) if by else customers.select("*", limits.scalar().alias("limits"))
    signed = {"recency": -F.col("recency"), "frequency": F.col("frequency"), "monetary": F.col("monetary")}

    def score(metric: str) -> Column:
        value = signed[metric].cast("double")
        above = [(value > F.element_at(F.col("limits")[metric], i)).cast("int") for i in (1, 2, 3, 4)]
        return 1 + above[0] + above[1] + above[2] + above[3]

    return scored.withColumns({f"{m[0]}_score": score(m) for m in METRICS}).drop("limits")


def segment_name(r: Column, f: Column) -> Column:
    """First matching rule on the recency and frequency scores."""
    rules = [
        ("Campeões", (r >= 4) & (f >= 4)),
        ("Clientes fiéis", (r >= 3) & (f >= 4)),
        ("Potenciais fiéis", (r >= 4) & (f >= 2)),
        ("Novos clientes", r >= 4),
        ("Precisam de atenção", r == 3),
        ("Em risco", f >= 3),
        ("Hibernando", r == 2),
    ]
    name = F.lit("Perdidos")
    for label, rule in reversed(rules):
        name = F.when(rule, label).otherwise(name)
    return name


def segment_rows(rfm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """RFM table with scores and segment."""
    return add_scores(rfm, by).withColumn("segment", segment_name(F.col("r_score"), F.col("f_score")))


def _position_of(names: list[str], column: str) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)).cast("int")


def summarize_segments(customers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per segment in rule order, with its weight in customers and revenue and the action."""
    by = by or []
    summary = customers.groupBy(*by, "segment").agg(
        F.count(F.lit(1)).alias("customers"),
        exact_sum("monetary").alias("revenue"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
    )
    everyone = Window.partitionBy(*(by or [F.lit(0)]))  # at most eight segments per group
    actions = F.create_map(*[F.lit(part) for pair in SEGMENT_ACTIONS.items() for part in pair])
    return summary.withColumns(
        {
            "customers_pct": F.col("customers") / F.sum("customers").over(everyone) * 100,
            "revenue_pct": share_pct(F.col("revenue"), F.sum("revenue").over(everyone)),
            "action": actions[F.col("segment")],
            "position": _position_of(list(SEGMENT_ACTIONS), "segment"),
        }
    ).orderBy(*by, "position")


def pareto_share(customers: DataFrame, top_fraction: float = 0.2, by: list[str] | None = None) -> DataFrame:
    """% of revenue from the best-paying share of customers, one row per group.

    The smallest amount still taken is an order statistic; larger amounts count in full, a tie at the border in part.
    """
    by = list(by or [])
    top = lambda total: F.greatest(F.lit(1), F.ceil(total * F.lit(top_fraction)))
    amount = F.col("monetary").cast("double")
    limits = order_statistics(customers, {"monetary": amount}, [1 - top_fraction], lambda total, _: total - top(total) + 1, by)
    limits = stage(limits.select(*by, F.col("stats")[0].alias("least"), top(F.col("total")).alias("top_n")), "pareto-limits")
    amounts = customers.select(*by, amount.alias("value")).where("value IS NOT NULL")
    if by:
        placed = amounts.join(limits, by)
    else:
        placed = amounts.select("*", limits.select(F.struct("least", "top_n")).scalar().alias("limit")).select("value", "limit.*")
    larger = F.col("value") > F.col("least")
    sums = placed.groupBy(*by).agg(
        exact_sum(F.when(larger, F.col("value"))).alias("best"), F.count_if(larger).alias("taken"), exact_sum("value").alias("total"), F.first("least").alias("least"), F.first("top_n").alias("top_n")
    )
    taken = F.coalesce("best", F.lit(0.0)) + F.col("least") * (F.col("top_n") - F.col("taken"))
    return sums.select(*by, (taken / F.nullif(F.col("total"), F.lit(0.0)) * 100).alias("pareto_pct"))


def customer_kpis(customers: DataFrame, top_fraction: float = 0.2) -> DataFrame:
    """One row: customers, % active in 90 days, % with more than one order, revenue share of the best."""
    pareto = pareto_share(customers, top_fraction).scalar()
    base = customers.agg(
        F.count(F.lit(1)).alias("customers"),
        (F.avg((F.col("recency") <= ACTIVE_DAYS).cast("double")) * 100).alias("active_pct"),
        (F.avg((F.col("frequency") > 1).cast("double")) * 100).alias("repeat_pct"),
    )
    return base.select("*", pareto.alias("pareto_pct"))


def score_heatmap(customers: DataFrame) -> DataFrame:
    """5 × 5 counts: one row per frequency score, columns r1…r5; empty cells are zero."""
    counted = customers.groupBy("f_score", "r_score").agg(F.count(F.lit(1)).alias("n"))
    scaffold = customers.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("f_score"))
    grid = counted.groupBy("f_score").pivot("r_score", [1, 2, 3, 4, 5]).agg(F.sum("n"))
    cells = [F.coalesce(F.col(str(r)), F.lit(0)).alias(f"r{r}") for r in range(1, 6)]
    return scaffold.join(grid, "f_score", "left").select("f_score", *cells).orderBy("f_score")


def tie_audit(rfm: DataFrame) -> DataFrame:
    """Champions under tie-broken quintiles against shared-rank quintiles, and how many bought once.

    The old method ranks equal values by row order (here: by customer code) and cuts at the
    interpolated quintiles of the ranks 1…n.
    """
    n = rfm.agg(F.count(F.lit(1)).alias("n")).scalar()
    by_f = row_positions(rfm, ["frequency", "customer_id"], name="f_pos")
    by_r = row_positions(by_f, ["recency", "customer_id"], name="r_pos").withColumn("n", n)

    def old_score(position: str) -> Column:
        edges = [1 + (F.col("n") - 1) * step / F.lit(5.0) for step in (1, 2, 3, 4)]
        above = [(F.col(position) > edge).cast("int") for edge in edges]
        return 1 + above[0] + above[1] + above[2] + above[3]

    old = by_r.select("customer_id", old_score("f_pos").alias("old_f"), (6 - old_score("r_pos")).alias("old_r"))
    both = segment_rows(rfm).join(old, "customer_id")
    once = F.col("frequency") == 1
    old_champion = (F.col("old_r") >= 4) & (F.col("old_f") >= 4)
    champion = F.col("segment") == "Campeões"
    return both.agg(
        F.count_if(old_champion).alias("old_champions"),
        F.count_if(old_champion & once).alias("old_single_purchase"),
        F.count_if(champion).alias("champions"),
        F.count_if(champion & once).alias("single_purchase"),
    )


# ------------------------------------------------------------------ K-Means
def cluster_features(rfm: DataFrame) -> DataFrame:
    """log1p of the three metrics, standardised with the population deviation."""
    logs = {m: F.log1p(F.col(m).cast("double")) for m in METRICS}
    stats = rfm.agg(
        F.struct(
            *[F.avg(logs[m]).alias(f"{m}_mean") for m in METRICS],
            *[F.stddev_pop(logs[m]).alias(f"{m}_std") for m in METRICS],
        ).alias("stats")
    ).scalar()
    with_stats = rfm.select("*", stats.alias("stats"))
    scaled = {
        f"{m}_z": (logs[m] - F.col(f"stats.{m}_mean"))
        / F.when(F.col(f"stats.{m}_std") == 0, 1.0).otherwise(F.col(f"stats.{m}_std"))
        for m in METRICS
    }
    return with_stats.withColumns(scaled).drop("stats")


@dataclass(frozen=True)
class Clustering:
    customers: DataFrame
    silhouette_by_k: DataFrame
    best_k: int


def cluster_customers(rfm: DataFrame, k_values=K_VALUES, restarts: int = 10, seed: int = SEED, silhouette_grain: float | None = 1 / 128) -> Clustering:
    """K-Means for every k (best of `restarts` by cost), k chosen by silhouette among k ≥ 3.

    All fits share one job per round. The silhouette is the Euclidean one over all customers, with coordinates rounded
    to `silhouette_grain` standard deviations (None: not at all). "Grupo 1" is the group with the highest mean revenue
    per customer.
    """
    columns = [f"{m}_z" for m in METRICS]
    points = stage(cluster_features(rfm), "cluster-points")
    coordinates = equal_as_one(points, columns).persist()
    try:
        models = fit_all(coordinates, columns, k_values, restarts, seed)
        silhouettes = euclidean_silhouettes(points, columns, models, silhouette_grain)
    finally:
        coordinates.unpersist()
    usable = [k for k in k_values if k >= MIN_ACTIONABLE_K] or list(k_values)
    best_k = min(usable, key=lambda k: (-silhouettes[k], k))
    predicted = stage(points.withColumn("label", nearest(models[best_k], columns)).drop(*columns), "clusters")
    scores = points.sparkSession.createDataFrame(sorted(silhouettes.items()), "k INT, silhouette DOUBLE")
    by_value = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean"), "label")  # at most six groups
    order = predicted.groupBy("label").agg(F.avg("monetary").alias("mean"))
    order = order.select("label", F.row_number().over(by_value).alias("cluster"))
    customers = predicted.join(F.broadcast(order), "label").drop("label")  # one row per group, k ≤ 6
    return Clustering(customers, scores, best_k)


def summarize_clusters(customers: DataFrame) -> DataFrame:
    """Size, means and revenue share per group, with its most common segment (first name on ties)."""
    summary = customers.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary").alias("avg_monetary"),
        exact_sum("monetary").alias("revenue"),
    )
    mix = customers.groupBy("cluster", "segment").agg(F.count(F.lit(1)).alias("n"))
    main = mix.groupBy("cluster").agg(
        F.min_by("segment", F.struct(-F.col("n"), F.col("segment"))).alias("main_segment"),
        (F.max("n") / F.sum("n") * 100).alias("main_segment_pct"),
    )
    everyone = Window.partitionBy(F.lit(0))
    return (
        summary.join(main, "cluster")
        .withColumn("revenue_pct", share_pct(F.col("revenue"), F.sum("revenue").over(everyone)))
        .withColumn("name", F.concat(F.lit("Grupo "), F.col("cluster")))
        .orderBy("cluster")
    )


@dataclass(frozen=True)
class CustomerSegmentation:
    customers: DataFrame
    segments: DataFrame
    clusters: DataFrame | None
    silhouette_by_k: DataFrame | None
    best_k: int


def segment_customers(
    df: DataFrame,
    reference: date | Column | None = None,
    with_clusters: bool = True,
    restarts: int = 10,
) -> CustomerSegmentation:
    """RFM, rule segments and (optionally) K-Means groups.

    The RFM table is written once: scores, segments and model fits all start from it. `reference`
    defaults to the day after the last sale of `df`, also counting rows without customer.
    """
    wanted = [c for c in ("customer_id", "order_id", "date", "revenue") if c in df.columns]
    df = df.select(*wanted)
    rfm = stage(rfm_table(df, reference_day(df.select("date")) if reference is None else reference), "rfm")
    found = rfm.count()
    if found < MIN_CUSTOMERS:
        raise TooFewCustomersError(
            f"São necessários pelo menos {MIN_CUSTOMERS} clientes para a segmentação (há {found})."
        )
    customers = segment_rows(rfm)
    if not with_clusters:
        return CustomerSegmentation(customers, summarize_segments(customers), None, None, 0)
    grouped = cluster_customers(customers, restarts=restarts)
    return CustomerSegmentation(
        grouped.customers,
        summarize_segments(grouped.customers),
        summarize_clusters(grouped.customers),
        grouped.silhouette_by_k,
        grouped.best_k,
    )
