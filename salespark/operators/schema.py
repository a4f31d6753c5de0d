"""The sales table: types, rules, and what counts as an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# column -> (type, nullable, minimum); Fixed values of the table's contract
SALES_RULES = {
    "date": ("timestamp_ntz", False, None),
    "category": ("string", False, None),
    "region": ("string", False, None),
    "product": ("string", False, None),
    "units": ("bigint", False, 0),
    "unit_price": ("double", False, 0),
    "revenue": ("double", False, 0),
    "cost": ("double", True, 0),
    "profit": ("double", True, None),
    "customer_id": ("string", True, None),
    "order_id": ("string", True, None),
}
OPTIONAL = ("customer_id", "order_id")


class DataValidationError(ValueError):
    """The table breaks the sales contract."""


def coerce(df: DataFrame) -> DataFrame:
    """Known columns only, each cast to its type (an impossible value becomes null)."""
    return df.select(
        *[F.col(c).try_cast(kind).alias(c) for c, (kind, _, _) in SALES_RULES.items() if c in df.columns]
    )


def violations(df: DataFrame) -> DataFrame:
    """One row with the number of failing rows per rule, for the columns that are present."""
    checks = []
    for name, (kind, nullable, minimum) in SALES_RULES.items():
        if name not in df.columns:
            continue
        value = F.col(name).try_cast(kind)
        lost = value.isNull() & F.col(name).isNotNull()
        checks.append(F.count_if(lost).alias(f"{name}: {kind}"))
        if not nullable:
            checks.append(F.count_if(F.col(name).isNull()).alias(f"{name}: not_nullable"))
        if minimum is not None:
            checks.append(F.count_if(value < minimum).alias(f"{name}: greater_than_or_equal_to({minimum})"))
    return df.agg(*checks)


def validate(df: DataFrame, source: str) -> DataFrame:
    """Coerced table, or one error that names every broken rule once. The check is one aggregate."""
    problems = [f"coluna ausente: {c}" for c in SALES_RULES if c not in df.columns and c not in OPTIONAL]
    counts = violations(df).first().asDict()
    problems += [rule for rule, failing in counts.items() if failing]
    if problems:
        raise DataValidationError(f"Dados de {source} inválidos ({'; '.join(problems)})")
    return coerce(df)


def defensive_clean(df: DataFrame) -> DataFrame:
    """Drop rows without date or revenue; unreadable or missing numbers become 0."""
    numbers = {"units": "bigint", "unit_price": "double", "revenue": "double", "cost": "double", "profit": "double"}
    kept = df.dropna(subset=["date", "revenue"])
    cleaned = {c: F.coalesce(F.col(c).try_cast(t), F.lit(0).cast(t)) for c, t in numbers.items() if c in df.columns}
    return kept.withColumns(cleaned)


def order_count(columns: list[str], where: Column | None = None) -> Column:
    """Aggregate: distinct order codes when the table has them, otherwise rows."""
    if "order_id" in columns:
        return F.count_distinct(F.when(where, F.col("order_id")) if where is not None else F.col("order_id"))
    return F.count_if(where) if where is not None else F.count(F.lit(1))
