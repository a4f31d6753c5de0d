import datetime as dt
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from salespark.operators import delivery, preparation, schema
from salespark.plans import order_queries
from salespark.sources import files

CSV = {
    "orders": """order_id,customer_id,order_status,order_purchase_timestamp,order_delivered_customer_date,order_estimated_delivery_date
o1,c1,delivered,2017-05-01 10:00:00,2017-05-10 08:00:00,2017-05-12 00:00:00
o2,c2,delivered,2017-05-03 22:30:00,2017-05-20 09:00:00,2017-05-15 00:00:00
o3,c3,canceled,2017-05-04 10:00:00,,2017-05-20 00:00:00
o4,c4,delivered,2018-09-01 10:00:00,2018-09-05 10:00:00,2018-09-10 00:00:00
o5,c5,shipped,2017-06-01 09:00:00,not a date,2017-06-20 00:00:00
""",
    "order_items": """order_id,order_item_id,product_id,price,freight_value
o1,1,p1,75.0,6.0
o1,2,p1,75.0,6.0
o1,3,p2,30.0,6.0
o2,1,p3,40.0,5.0
o3,1,p1,75.0,6.0
o4,1,p1,75.0,6.0
o5,1,p4,10.0,3.0
""",
    "customers": """customer_id,customer_unique_id,customer_state
c1,u1,SP
c2,u2,BA
c3,u3,SP
c4,u4,RS
c5,u1,SP
""",
    "products": """product_id,product_category_name
p1,cama_mesa_banho
p2,pcs
p3,categoria_nova
p4,
p5,pet_shop
""",
    "order_reviews": """review_id,order_id,review_score,review_creation_date
r1,o1,5,2017-05-11 00:00:00
r2,o1,3,2017-05-12 00:00:00
r3,o2,1,2017-05-21 00:00:00
""",
}


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, content in CSV.items():
        (folder / f"shop_{name}_dataset.csv").write_text(content, encoding="utf-8")
    return files.read_raw(spark, str(folder))


@pytest.fixture(scope="module")
def orders(raw):
    return preparation.prepare_orders(raw)


@pytest.fixture(scope="module")
def sales(raw, orders):
    return preparation.prepare_sales(raw, orders)


def test_dates_are_typed(raw):
    kinds = dict(raw["orders"].dtypes)
    assert kinds["order_purchase_timestamp"] == "timestamp_ntz"
    assert raw["orders"].where("order_id = 'o5'").first().order_delivered_customer_date is None


def test_valid_orders(orders):
    rows = {r.order_id: r for r in orders.collect()}
    assert sorted(rows) == ["o1", "o2", "o5"]
    o1 = rows["o1"]
    assert (o1["items"], o1.value, o1.freight, o1.review_score, o1.region) == (3, 180.0, 18.0, 4.0, "Sudeste")
    assert rows["o5"].customer == o1.customer == "C00001" and rows["o2"].customer == "C00002"
    assert rows["o5"].review_score is None and rows["o2"].region == "Nordeste"


def test_sales_lines(sales, orders):
    rows = sales.orderBy("date", "category").collect()
    assert len(rows) == 4 and len({r.order_id for r in rows}) == 3
    home = rows[0]
    assert (home.category, home["product"], home.units, home.revenue, home.unit_price) == (
        "Casa e decoração", "Cama, mesa e banho", 2, 150.0, 75.0,
    )
    assert rows[1].category == "Informática e eletrônicos" and home.order_id == "P000001"
    assert {(r.category, r["product"]) for r in rows[2:]} == {("Outros", "Sem categoria")}
    assert sales.agg(F.sum("revenue")).first()[0] == orders.agg(F.sum("value")).first()[0]
    assert schema.validate(sales, "base").count() == 4


def test_daily_and_unmapped(raw, sales, orders):
    daily = preparation.raw_daily_orders(raw["orders"])
    assert daily.agg(F.sum("pedidos")).first()[0] == 5
    assert daily.where("data = '2017-05-02'").first().pedidos == 0
    assert [r[0] for r in preparation.unmapped_categories(raw["products"]).collect()] == ["categoria_nova"]
    totals = preparation.preparation_totals(sales, orders).first()
    assert (totals.orders, totals.lines, totals.customers) == (3, 4, 2)


def test_save_and_load(spark, sales, orders, tmp_path):
    sales_path, orders_path = files.save_prepared(sales, orders, str(tmp_path))
    assert files.load_sales(spark, sales_path).count() == 4
    assert "order_id" not in files.load_orders(spark, orders_path).columns


def test_export(spark, sales, tmp_path):
    path = str(tmp_path / "export")
    files.export_csv(sales, path, "date")
    back = spark.read.option("header", True).option("sep", ";").csv(path)
    assert "cost" not in back.columns and back.where("revenue = '150,0'").count() == 1


def test_lookup_tables():
    assert len(preparation.STATE_REGION) == 27 and len(preparation.CATEGORY_GROUPS) == 14
    assert sum(len(g) for g in preparation.CATEGORY_GROUPS.values()) == 73


def test_delivery(orders):
    delivered = delivery.delivered_orders(orders)
    rows = {r.order_id: (r.delay, r.days, r.late) for r in delivered.collect()}
    assert rows == {"o1": (-2, 8, False), "o2": (5, 16, True)}
    summary = {r.late: r for r in delivery.late_summary(delivered).collect()}
    assert summary[True].bad_pct == 100.0 and summary[False].mean_score == 4.0 and summary[True].late_pct == 50.0
    bins = delivery.score_by_delay(delivered).collect()
    assert [b.bin for b in bins] == ["0–5 adiantado", "1–5 atrasado"]
    regions = delivery.region_service(delivered).collect()
    assert [r.region for r in regions] == ["Nordeste", "Sudeste"]


@pytest.mark.parametrize(("delay", "label"), [(-10, "10+ dias adiantado"), (-9, "5–10 adiantado"), (0, "0–5 adiantado"), (1, "1–5 atrasado"), (20, "11–20 atrasado"), (21, "20+ atrasado"), (-1000, "10+ dias adiantado"), (1001, "20+ atrasado"), (None, None)])
def test_right_closed_bins(spark, delay, label):
    assert spark.range(1).select(delivery.delay_bin(F.lit(delay).cast("int"))[1]).first()[0] == label


def test_whole_days_round_down(spark):
    moments = [dt.datetime(2020, 1, 1, 1), dt.datetime(2020, 1, 2, 0)]
    df = spark.createDataFrame([tuple(moments)], "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    assert tuple(df.select(delivery.whole_days(F.col("a"), F.col("b")), delivery.whole_days(F.col("b"), F.col("a"))).first()) == (-1, 0)


def test_lines_are_grouped_in_tasks_of_bounded_size(spark, monkeypatch):
    """more items are dealt out to more tasks, whatever the session's shuffle partitions, and no join sorts them."""
    monkeypatch.setattr(preparation, "LINES_PER_TASK", 200)
    lines = order_queries.order_group_lines(spark, SMALL)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(order_id#\d+, (\d+)\)", plan)]
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert tasks == [-(-items // 200)] * 3 and "SortMergeJoin" not in plan
    assert "hashpartitioning(order_id#" not in re.sub(r"hashpartitioning\(order_id#\d+, \d+\)", "", plan)
