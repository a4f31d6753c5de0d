"""From five raw order tables to the flat sales table and the orders table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.functions.numeric import exact_sum
from salespark.operators.ranking import surrogate_codes
from salespark.operators.series import fill_gaps
from salespark.session import stage

# Valid window, excluded statuses and defaults for unmapped categories.
WINDOW = (datetime(2017, 1, 1), datetime(2018, 8, 21, 23, 59, 59))
EXCLUDED_STATUS = ("canceled", "unavailable")
OTHER_GROUP, NO_CATEGORY = "Outros", "Sem categoria"
# what one task groups by order; a session's number of shuffle partitions does not grow with the tables
LINES_PER_TASK = 500_000

# Brazilian states of each macro-region.
REGION_STATES = {
    "Norte": ["AC", "AP", "AM", "PA", "RO", "RR", "TO"],
    "Nordeste": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "Centro-Oeste": ["DF", "GO", "MT", "MS"],
    "Sudeste": ["ES", "MG", "RJ", "SP"],
    "Sul": ["PR", "RS", "SC"],
}
STATE_REGION = {state: region for region, states in REGION_STATES.items() for state in states}

# Source categories of each group with their readable names.
CATEGORY_GROUPS = {
    "Beleza e saúde": {
        "beleza_saude": "Beleza e saúde",
        "perfumaria": "Perfumaria",
        "fraldas_higiene": "Fraldas e higiene",
    },
    "Casa e decoração": {
        "cama_mesa_banho": "Cama, mesa e banho",
        "moveis_decoracao": "Móveis e decoração",
        "utilidades_domesticas": "Utilidades domésticas",
        "casa_conforto": "Casa e conforto",
        "casa_conforto_2": "Casa e conforto 2",
        "moveis_sala": "Móveis de sala",
        "moveis_quarto": "Móveis de quarto",
        "moveis_cozinha_area_de_servico_jantar_e_jardim": "Móveis de cozinha e jardim",
        "moveis_colchao_e_estofado": "Colchões e estofados",
        "moveis_escritorio": "Móveis de escritório",
        "la_cuisine": "La Cuisine",
        "flores": "Flores",
        "artigos_de_natal": "Artigos de Natal",
        "artigos_de_festas": "Artigos de festa",
    },
    "Eletrodomésticos": {
        "eletroportateis": "Eletroportáteis",
        "eletrodomesticos": "Eletrodomésticos",
        "eletrodomesticos_2": "Eletrodomésticos 2",
        "portateis_casa_forno_e_cafe": "Fornos e cafeteiras",
        "portateis_cozinha_e_preparadores_de_alimentos": "Preparadores de alimentos",
        "climatizacao": "Climatização",
    },
    "Informática e eletrônicos": {
        "informatica_acessorios": "Informática e acessórios",
        "pcs": "Computadores",
        "pc_gamer": "PC gamer",
        "tablets_impressao_imagem": "Tablets e impressão",
        "eletronicos": "Eletrônicos",
        "telefonia": "Telefonia",
        "telefonia_fixa": "Telefonia fixa",
        "consoles_games": "Consoles e games",
        "audio": "Áudio",
        "cine_foto": "Cine e foto",
    },
    "Esporte e lazer": {
        "esporte_lazer": "Esporte e lazer",
        "instrumentos_musicais": "Instrumentos musicais",
    },
    "Relógios e presentes": {
        "relogios_presentes": "Relógios e presentes",
        "cool_stuff": "Cool stuff",
    },
    "Moda e acessórios": {
        "fashion_bolsas_e_acessorios": "Bolsas e acessórios",
        "fashion_calcados": "Calçados",
        "fashion_roupa_masculina": "Roupa masculina",
        "fashion_roupa_feminina": "Roupa feminina",
        "fashion_underwear_e_moda_praia": "Underwear e moda praia",
        "fashion_esporte": "Moda esporte",
        "fashion_roupa_infanto_juvenil": "Roupa infantojuvenil",
        "malas_acessorios": "Malas e acessórios",
    },
    "Bebês e brinquedos": {
        "bebes": "Bebês",
        "brinquedos": "Brinquedos",
    },
    "Automotivo": {
        "automotivo": "Automotivo",
    },
    "Ferramentas e construção": {
        "ferramentas_jardim": "Ferramentas de jardim",
        "construcao_ferramentas_construcao": "Ferramentas de construção",
        "construcao_ferramentas_jardim": "Construção e jardim",
        "construcao_ferramentas_ferramentas": "Ferramentas",
        "construcao_ferramentas_iluminacao": "Iluminação",
        "construcao_ferramentas_seguranca": "Segurança",
        "casa_construcao": "Casa e construção",
        "sinalizacao_e_seguranca": "Sinalização e segurança",
        "agro_industria_e_comercio": "Agro, indústria e comércio",
        "industria_comercio_e_negocios": "Indústria e negócios",
    },
    "Livros, papelaria e mídia": {
        "papelaria": "Papelaria",
        "livros_tecnicos": "Livros técnicos",
        "livros_interesse_geral": "Livros de interesse geral",
        "livros_importados": "Livros importados",
        "artes": "Artes",
        "artes_e_artesanato": "Artes e artesanato",
        "musica": "Música",
        "cds_dvds_musicais": "CDs e DVDs musicais",
        "dvds_blu_ray": "DVDs e Blu-ray",
    },
    "Alimentos e bebidas": {
        "alimentos_bebidas": "Alimentos e bebidas",
        "alimentos": "Alimentos",
        "bebidas": "Bebidas",
    },
    "Pet shop": {
        "pet_shop": "Pet shop",
    },
    OTHER_GROUP: {
        "market_place": "Marketplace",
        "seguros_e_servicos": "Seguros e serviços",
    },
}


def lookup(column: str, values: Mapping[str, str]):
    """Constant dictionary lookup inside the projection; unknown or null keys give null."""
    entries = [F.lit(part) for pair in values.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), F.col(column))


def valid_orders(orders: DataFrame, window=WINDOW, excluded: Sequence[str] = EXCLUDED_STATUS) -> DataFrame:
    """Orders bought inside the window whose status counts."""
    moment = F.col("order_purchase_timestamp")
    first, last = (F.lit(edge).cast("timestamp_ntz") for edge in window)
    return orders.where(moment.between(first, last) & ~F.col("order_status").isin(list(excluded)))


def items_per_order(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count("order_item_id").alias("items"),
        exact_sum("price").alias("value"),
        exact_sum("freight_value").alias("freight"),
    )


def review_per_order(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))


def prepare_orders(
    raw: Mapping[str, DataFrame],
    window=WINDOW,
    excluded: Sequence[str] = EXCLUDED_STATUS,
    state_region: Mapping[str, str] = STATE_REGION,
) -> DataFrame:
    """One row per valid order with items: customer code, place, dates, value, freight and mean score.

    Orders without items drop out; orders without a known customer or review stay.
    """
    orders = valid_orders(raw["orders"], window, excluded)
    customers = raw["customers"].select("customer_id", "customer_unique_id", "customer_state")
    joined = (
        orders.join(customers, "customer_id", "left")
        .join(items_per_order(raw["order_items"]), "order_id")
        .join(review_per_order(raw["order_reviews"]), "order_id", "left")
    )
    joined = stage(joined, "orders")  # read twice: for the codes and for the table itself
    codes = surrogate_codes(joined, "customer_unique_id", "C", 5, "customer")
    coded = joined.join(codes, "customer_unique_id", "left")
    return coded.select(
        "order_id",
        "customer",
        F.col("customer_state").alias("state"),
        lookup("customer_state", state_region).alias("region"),
        F.col("order_status").alias("status"),
        F.col("order_purchase_timestamp").alias("purchased_at"),
        F.col("order_delivered_customer_date").alias("delivered_at"),
        F.col("order_estimated_delivery_date").alias("estimated_at"),
        "items",
        "value",
        "freight",
        "review_score",
    )


def categorized_items(
    items: DataFrame, products: DataFrame, groups: Mapping[str, Mapping[str, str]] = CATEGORY_GROUPS
) -> DataFrame:
    """Items with group (`category`) and readable name (`product`); defaults for unknown categories."""
    group_of = {source: group for group, members in groups.items() for source in members}
    name_of = {source: name for members in groups.values() for source, name in members.items()}
    named = products.select(
        "product_id",
        F.coalesce(lookup("product_category_name", group_of), F.lit(OTHER_GROUP)).alias("category"),
        F.coalesce(lookup("product_category_name", name_of), F.lit(NO_CATEGORY)).alias("product"),
    )
    # hashed, so that what a task holds follows the products and no lines are sorted
    joined = items.join(named.hint("shuffle_hash"), "product_id", "left")
    return joined.fillna({"category": OTHER_GROUP, "product": NO_CATEGORY})


def tasks_by_order(items: DataFrame) -> int:
    """Into how many tasks the rows of a table are dealt out by order, for `LINES_PER_TASK` in each on average."""
    return max(items.sparkSession.sparkContext.defaultParallelism, -(-items.count() // LINES_PER_TASK))


def items_of(items: DataFrame, orders: DataFrame, tasks: int) -> DataFrame:
    """The items of the given orders (order_id); the orders of a task are hashed, its items only pass by."""
    wanted = orders.select("order_id").repartition(tasks, "order_id").hint("shuffle_hash")
    return items.repartition(tasks, "order_id").join(wanted, "order_id", "left_semi")


def order_lines(items: DataFrame, tasks: int) -> DataFrame:
    """One row per order and group: units, revenue, and the product with most revenue (last name on ties).

    Items are first summed per product, so the second grouping sees few rows per order. They are dealt out by order
    once for both groupings, to so many tasks (`tasks_by_order`) that what each holds does not grow with the table.
    """
    items = items.select("order_id", "category", "product", "order_item_id", "price").repartition(tasks, "order_id")
    by_product = items.groupBy("order_id", "category", "product").agg(
        F.count("order_item_id").alias("n"), exact_sum("price").alias("price")
    )
    return by_product.groupBy("order_id", "category").agg(
        F.sum("n").alias("units"),
        exact_sum("price").alias("revenue"),
        F.max_by("product", F.struct("price", "product")).alias("product"),
    )


def cents(value: Column) -> Column:
    """Two decimals, a half rounded to the even cent."""
    return F.rint(value * 100) / 100.0


def prepare_sales(
    raw: Mapping[str, DataFrame],
    orders: DataFrame,
    groups: Mapping[str, Mapping[str, str]] = CATEGORY_GROUPS,
) -> DataFrame:
    """The flat sales table: one row per valid order and category group.

    `orders` is read three times, so pass the written table (`save_prepared`, or `session.stage`).
    """
    info = orders.select("order_id", "purchased_at", "region", "customer")
    tasks = tasks_by_order(raw["order_items"])
    kept = items_of(raw["order_items"], info, tasks)
    lines = order_lines(categorized_items(kept, raw["products"], groups), tasks).join(info, "order_id", "left")
    codes = surrogate_codes(orders, "order_id", "P", 6, "order_code")
    return lines.join(codes, "order_id").select(
        F.col("order_code").alias("order_id"),
        F.col("purchased_at").alias("date"),
        "category",
        "region",
        "product",
        "units",
        cents(F.col("revenue") / F.col("units")).alias("unit_price"),
        cents(F.col("revenue")).alias("revenue"),
        F.lit(None).cast("double").alias("cost"),
        F.lit(None).cast("double").alias("profit"),
        F.col("customer").alias("customer_id"),
    )


def raw_daily_orders(orders: DataFrame) -> DataFrame:
    """(data, pedidos): all raw orders per calendar day, zero on missing days."""
    daily = orders.where(F.col("order_purchase_timestamp").isNotNull())
    daily = daily.groupBy(F.lit("total").alias("series"), F.to_date("order_purchase_timestamp").alias("ds"))
    filled = fill_gaps(daily.agg(F.count(F.lit(1)).cast("double").alias("y")), ["y"])
    return filled.select(F.col("ds").alias("data"), F.col("y").cast("bigint").alias("pedidos"))


def unmapped_categories(products: DataFrame, groups: Mapping[str, Mapping[str, str]] = CATEGORY_GROUPS) -> DataFrame:
    """Source categories without a group."""
    known = [(source,) for members in groups.values() for source in members]
    mapping = products.sparkSession.createDataFrame(known, "product_category_name STRING")
    found = products.select("product_category_name").where(F.col("product_category_name").isNotNull()).distinct()
    return found.join(mapping, "product_category_name", "left_anti").orderBy("product_category_name")


def preparation_totals(sales: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: orders, sales lines, customers and date bounds."""
    by_orders = orders.agg(
        F.struct(F.count(F.lit(1)).alias("orders"), F.count_distinct("customer").alias("customers")).alias("o")
    ).scalar()
    lines = sales.agg(F.count(F.lit(1)).alias("lines"), F.min("date").alias("first"), F.max("date").alias("last"))
    return lines.select("*", by_orders.alias("o")).select("o.orders", "lines", "o.customers", "first", "last")
