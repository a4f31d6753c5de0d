"""File sources and sinks: raw order CSVs, prepared Parquet, imported text tables, exports, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salespark.operators import schema
from salespark.session import stage

# Tables and columns of the raw multi-table order source.
RAW_TABLES = {
    "orders": "order_id STRING, customer_id STRING, order_status STRING, order_purchase_timestamp STRING, "
    "order_approved_at STRING, order_delivered_carrier_date STRING, order_delivered_customer_date STRING, "
    "order_estimated_delivery_date STRING",
    "order_items": "order_id STRING, order_item_id INT, product_id STRING, seller_id STRING, "
    "shipping_limit_date STRING, price DOUBLE, freight_value DOUBLE",
    "customers": "customer_id STRING, customer_unique_id STRING, customer_zip_code_prefix STRING, "
    "customer_city STRING, customer_state STRING",
    "products": "product_id STRING, product_category_name STRING",
    "order_reviews": "review_id STRING, order_id STRING, review_score INT, review_comment_title STRING, "
    "review_comment_message STRING, review_creation_date STRING, review_answer_timestamp STRING",
}
DATE_SUFFIXES = ("_timestamp", "_date", "_at")
DATED_TABLES = ("orders", "order_reviews")


class ImportFileError(ValueError):
    """The given file cannot be read as a table."""


def parse_date_columns(df: DataFrame) -> DataFrame:
    """Every text column whose name ends like a date becomes a timestamp; unreadable dates become null."""

    def parsed(name: str):
        text = F.col(name)
        whole = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
        return F.coalesce(whole, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz").alias(name)

    return df.select(*[parsed(c) if c.endswith(DATE_SUFFIXES) and t == "string" else F.col(c) for c, t in df.dtypes])


def read_raw(spark: SparkSession, folder: str, file_name: str = "*_{table}_dataset.csv") -> dict[str, DataFrame]:
    """The five raw CSV tables; columns are matched by header name, so extra ones are ignored."""
    tables = {}
    for name, columns in RAW_TABLES.items():
        path = f"{folder}/{file_name.format(table=name)}"
        header = spark.read.text(path).limit(1).first()
        names = [part.strip().strip('"') for part in header[0].lstrip("﻿").split(",")] if header else []
        known = {field.name: field for field in T.StructType.fromDDL(columns)}
        as_read = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
        df = spark.read.schema(as_read).option("header", True).option("multiLine", name == "order_reviews")
        df = df.option("escape", '"').csv(path).select(*[n for n in names if n in known])
        tables[name] = parse_date_columns(df) if name in DATED_TABLES else df
    return tables


def detect_csv_format(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, encoding): the separator from the header line, UTF-8 unless any line fails to decode."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    encoding = "ISO-8859-1" if broken else "UTF-8"
    header = spark.read.option("encoding", encoding).csv(path, sep="\x01").limit(1).first()
    if header is None:
        raise ImportFileError("Não foi possível ler o arquivo: está vazio.")
    counts = {sep: header[0].count(sep) for sep in (";", ",", "\t")}
    return max(counts, key=counts.get) if any(counts.values()) else ",", encoding


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV typed by people: separator and encoding detected, every column kept as text."""
    if not path.lower().endswith((".csv", ".txt")):
        raise ImportFileError("Formato não suportado. Envie um arquivo .csv.")
    separator, encoding = detect_csv_format(spark, path)
    df = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("encoding", encoding)
        .option("ignoreLeadingWhiteSpace", True)
        .option("escape", '"')
        .csv(path)
    )
    return df.toDF(*[name.lstrip("﻿") for name in df.columns])


SEPARATORS = (";", ",", "\t")


def _fields(line: Column, separator: Column, width: int) -> Column:
    """The parts of a line, as many as it has columns at most; what is missing is null."""
    row = ", ".join(f"c{i} STRING" for i in range(width))
    options = {"ignoreLeadingWhiteSpace": "true", "escape": '"', "mode": "PERMISSIVE"}
    cut = None
    for sign in SEPARATORS:
        parsed = F.from_csv(line, row, options | {"sep": sign})
        listed = F.array(*[parsed[f"c{i}"] for i in range(width)])
        cut = F.when(separator == sign, listed) if cut is None else cut.when(separator == sign, listed)
    return cut


def read_mixed_tables(spark: SparkSession, path: str) -> DataFrame:
    """CSV files typed by different people as one table of text columns, with the file of each row as `_file`.

    Separator and encoding are decided for every file: the separator from its first line that is not blank, UTF-8 unless any
    of its lines fails to decode. Columns are matched by header name; a file without a column has nulls there.
    Files are split by byte ranges as Spark's text source does, so a field must not hold a line break. Blank
    lines and lines that repeat the header are left out.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), at.alias("_at")).where(F.trim("value") != "")
    styles = lines.groupBy("_file").agg(F.bool_or(~F.is_valid_utf8("value")).alias("_latin"), F.min_by("value", "_at").alias("_header"))
    decoded = lambda c: F.when(F.col("_latin"), F.decode(F.col(c).cast("binary"), "ISO-8859-1")).otherwise(F.col(c))
    counts = [F.struct(F.size(F.split("_header", sign)).alias("n"), F.lit(-i).alias("rank"), F.lit(sign).alias("sign")) for i, sign in enumerate(SEPARATORS)]
    styles = stage(styles.withColumn("_best", F.array_max(F.array(*counts))).select("_file", "_latin", "_header", F.col("_best.sign").alias("_separator"), F.col("_best.n").alias("_width")), "file-styles")
    width = styles.agg(F.max("_width")).first()[0]
    if width is None:
        raise ImportFileError("Não foi possível ler os arquivos: estão vazios.")
    header = F.translate(decoded("_header"), "\ufeff", "")
    styles = stage(styles.withColumn("_names", F.transform(F.filter(_fields(header, F.col("_separator"), width), lambda n: n.isNotNull()), lambda n: F.trim(n))), "file-headers")
    names = [r[0] for r in styles.select(F.explode("_names").alias("n")).distinct().orderBy("n").collect()]  # column names, not rows
    rows = lines.join(styles, "_file").where(F.col("value") != F.col("_header"))
    cut = rows.select("_file", "_names", _fields(decoded("value"), F.col("_separator"), width).alias("_fields"))
    return cut.select(*[F.get("_fields", F.array_position("_names", name).cast("int") - 1).alias(name) for name in names], "_file")


def load_sales(spark: SparkSession, path: str) -> DataFrame:
    """A prepared sales table, validated; order rows with `orderBy` only where they leave Spark."""
    return schema.validate(spark.read.parquet(path), source=path)


def load_orders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_prepared(sales: DataFrame, orders: DataFrame, folder: str, by_month: bool = True) -> tuple[str, str]:
    """Write both tables as zstd Parquet; the sales table in one folder per month, so periods prune files.

    The order code only links the tables during preparation and is not kept in the orders table.
    """
    sales_path, orders_path = f"{folder}/sales", f"{folder}/orders"
    writer = sales.withColumn("month", F.date_format("date", "yyyy-MM")) if by_month else sales
    writer = writer.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy("month") if by_month else writer).parquet(sales_path)
    orders.drop("order_id").write.mode("overwrite").option("compression", "zstd").parquet(orders_path)
    return sales_path, orders_path


def write_daily_counts(daily: DataFrame, path: str) -> None:
    daily.write.mode("overwrite").option("header", True).csv(path)


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("data DATE, pedidos BIGINT").option("header", True).csv(path)


def export_frame(df: DataFrame, columns: list[str] | None = None, newest_first: str | None = None) -> DataFrame:
    """Columns with any value, as text with decimal commas. One aggregate decides which columns stay; rows are sorted after it."""
    df = df.select(*columns) if columns else df
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    kinds = dict(df.dtypes)

    def text(name: str):
        value = F.col(name).cast("string")
        if kinds[name] in ("double", "float") or kinds[name].startswith("decimal"):
            value = F.replace(value, F.lit("."), F.lit(","))
        return value.alias(name)

    ordered = df.orderBy(F.desc(newest_first)) if newest_first else df
    return ordered.select(*[text(c) for c in df.columns if filled[c]])


def export_csv(df: DataFrame, path: str, newest_first: str | None = None) -> None:
    """Semicolon CSV with decimal commas; a range sort keeps `newest_first` order across part files."""
    export_frame(df, newest_first=newest_first).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


# Fields of one stored evaluation answer and of one stored report check.
ANSWER_SCHEMA = (
    "id STRING, kind STRING, question STRING, answer STRING, tools_called ARRAY<STRING>, right_tool BOOLEAN, "
    "missing_numbers ARRAY<STRING>, missing_texts ARRAY<STRING>, hallucinated ARRAY<STRING>, "
    "forbidden_found ARRAY<STRING>, unexpected_numbers ARRAY<STRING>, expects_numbers BOOLEAN, latency_s DOUBLE, "
    "tokens_in BIGINT, tokens_out BIGINT, error STRING"
)
REPORT_SCHEMA = "period STRING, valid BOOLEAN, checked BIGINT, verified BIGINT, latency_s DOUBLE, error STRING"


def read_answers(spark: SparkSession, path: str, reports: bool = False) -> DataFrame:
    """Stored rows as JSON lines with their model, taken from the file name; unknown keys are ignored."""
    df = spark.read.schema(REPORT_SCHEMA if reports else ANSWER_SCHEMA).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(_relatorio)?\.jsonl?$", 1)
    return df.withColumn("model", stem)


def write_answers(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def sample_rows(spark: SparkSession) -> DataFrame:
    """The three-row template users fill in; numbers in Brazilian text."""
    # The template's rows.
    rows = [
        ("01/03/2025", "C-001", "Eletrônicos", "Sudeste", "Fone Bluetooth", "2", "398,00", "240,00"),
        ("01/03/2025", "C-002", "Moda", "Sul", "Jaqueta", "1", "189,90", "110,00"),
        ("02/03/2025", "C-001", "Eletrônicos", "Sudeste", "Smart TV 50pol", "1", "2.799,00", "1.950,00"),
    ]
    names = ["data", "cliente", "categoria", "regiao", "produto", "quantidade", "receita", "custo"]
    return spark.createDataFrame(rows, ", ".join(f"{n} STRING" for n in names))
