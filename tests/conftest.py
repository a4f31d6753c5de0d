from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from salespark.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sales_rows(spark):
    """Four orders: electronics twice, fashion, beauty."""
    rows = [
        ("2025-01-01", "Eletrônicos", "Sudeste", "Notebook Pro", 1, 500.0, 500.0, 300.0, 200.0),
        ("2025-01-01", "Moda", "Sul", "Jaqueta", 2, 100.0, 200.0, 150.0, 50.0),
        ("2025-01-02", "Eletrônicos", "Sudeste", "Fone Bluetooth", 3, 100.0, 300.0, 200.0, 100.0),
        ("2025-01-03", "Beleza", "Norte", "Perfume", 1, 100.0, 100.0, 50.0, 50.0),
    ]
    schema = (
        "date STRING, category STRING, region STRING, product STRING, units BIGINT, unit_price DOUBLE, "
        "revenue DOUBLE, cost DOUBLE, profit DOUBLE"
    )
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("date", df["date"].cast("timestamp_ntz"))


@pytest.fixture
def frame(spark):
    """Rows with text dates turned into timestamps."""

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        for name in ("date", "ds"):
            if dict(df.dtypes).get(name) == "string":
                df = df.withColumn(name, df[name].cast("timestamp_ntz" if name == "date" else "date"))
        return df

    return make


@pytest.fixture
def daily(spark):
    """A daily series from a list of values, starting on a Monday."""

    def make(values, start="2024-01-01", name="total"):
        import datetime as dt

        first = dt.date.fromisoformat(start)
        rows = [(name, first + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "series STRING, ds DATE, y DOUBLE")

    return make
