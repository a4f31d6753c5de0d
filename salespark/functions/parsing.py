"""Numbers and dates typed by people, as pure column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.functions.text import strip

# Fixed patterns: what counts as decimal comma, English grouping and dot grouping.
DECIMAL_COMMA = r",\d+\)?\s*$"
ENGLISH_GROUPING = r",\d{3}\."
DOT_GROUPING = r"^[^\d.,]*-?\d{1,3}(\.\d{3})+[^\d.,]*$"
# Spreadsheet serials 20,000–80,000 count days from 1899-12-30.
SERIAL_EPOCH = "1899-12-30"


def once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """Apply a rule to a value that it uses many times, evaluating the value once.

    It also keeps a large rule out of the surrounding generated method: several of them in one
    projection would make that method too big for the JVM to compile.
    """
    return F.get(F.transform(F.array(value), rule), 0)


def style_evidence(text: Column) -> Column:
    """Aggregate: does this column write a lone dot as a thousands separator?

    A decimal comma, a currency sign, or dots that always close groups of three speak for it;
    English grouping (`1,234.5`) anywhere speaks against it.
    """
    text = strip(text)
    has_dot = F.contains(text, F.lit("."))
    comma = F.coalesce(F.bool_or(F.contains(text, F.lit(",")) & text.rlike(DECIMAL_COMMA)), F.lit(False))
    english = F.coalesce(F.bool_or(text.rlike(ENGLISH_GROUPING)), F.lit(False))
    currency = F.coalesce(F.bool_or(F.contains(text, F.lit("R$"))), F.lit(False))
    grouped = F.coalesce(F.bool_and(F.when(has_dot, text.rlike(DOT_GROUPING))), F.lit(False))
    return ~english & (comma | currency | grouped)


def number_value(text: Column, brazilian: Column) -> Column:
    """One written number as a double; null when nothing readable is left.

    The last separator is the decimal one; without a comma, several dots (or any dot in a Brazilian
    column) separate thousands. Parentheses mean a negative amount.
    """
    return number_of(strip(text), brazilian)


def number_of(raw: Column, brazilian: Column) -> Column:
    """The same of a text without blanks at its ends."""
    kept = F.regexp_replace(raw, r"[^\d,.\-]", "")
    comma, dot = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
    plain = (
        F.when(comma & ~F.contains(F.substring_index(raw, ",", -1), F.lit(".")), F.translate(kept, ",.", "."))
        .when(comma, F.translate(kept, ",", ""))
        .when(brazilian | (dot & raw.rlike(r"\..*\.")), F.translate(kept, ".", ""))
        .otherwise(kept)
    )
    accounting = F.startswith(raw, F.lit("(")) & raw.rlike(r"^\([^-]*\)$")
    return F.concat(F.when(accounting, "-").otherwise(""), plain).try_cast("double")


def parse_numbers(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add `target` with the numbers of the text column `source`, its style judged over all rows."""
    if dict(df.dtypes)[source] != "string":
        return df.withColumn(target, F.col(source).cast("double"))
    style = df.agg(style_evidence(F.col(source)).alias("brazilian")).scalar()
    return df.withColumn(target, number_value(F.col(source), style))


_YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:\D.*)?$"
_DAY_FIRST = r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})(?:\D.*)?$"
_SHORT_YEAR_2000 = r"^(\d{1,2})[-/. ](\d{1,2})[-/. ]([0-6]\d|7[0-5])(?:\D.*)?$"
_SHORT_YEAR_1900 = r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{2})(?:\D.*)?$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_SERIAL = r"^[2-7]\d{4}(\.\d+)?$|^80000(\.0+)?$"
_NAMED_DAY = r"^(\d{1,2}) +([A-Za-z]{3})[a-z]*\.?,? +(\d{4})$"
_NAMED_MONTH = r"^([A-Za-z]{3})[a-z]*\.? +(\d{1,2}),? +(\d{4})$"


def date_value(text: Column) -> Column:
    """One written day: year first, spreadsheet serial, day first, or with an English month name.

    Every numeric style is rewritten to year-month-day and cast once. In a day-first style a month
    above 12 means the two numbers were written the other way round.
    """
    return once(strip(text), _day_of)


def _day_of(text: Column) -> Column:
    numeric = F.lit(None).cast("string")
    for pattern, order in reversed(
        [
            (_YEAR_FIRST, "$1-$2-$3"),
            (_DAY_FIRST, "$3-$2-$1"),
            (_SHORT_YEAR_2000, "20$3-$2-$1"),
            (_SHORT_YEAR_1900, "19$3-$2-$1"),
            (_COMPACT, "$1-$2-$3"),
        ]
    ):
        numeric = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, order)).otherwise(numeric)

    def calendar_day(written: Column) -> Column:
        swapped = F.when(~text.rlike(r"^\d{4}"), F.regexp_replace(written, r"^(\d+)-(\d+)-(\d+)$", "$1-$3-$2"))
        return F.coalesce(written.try_cast("date"), swapped.try_cast("date"))

    named = F.when(text.rlike(_NAMED_DAY), F.regexp_replace(text, _NAMED_DAY, "$1 $2 $3")).when(
        text.rlike(_NAMED_MONTH), F.regexp_replace(text, _NAMED_MONTH, "$2 $1 $3")
    )
    serial = F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(text.try_cast("double")).cast("int"))
    return F.when(text.rlike(_SERIAL), serial).otherwise(
        F.coalesce(once(numeric, calendar_day), F.try_to_date(F.initcap(named), "d MMM yyyy"))
    )


def parse_dates(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add `target` (midnight of the written day; null when unreadable)."""
    kind = dict(df.dtypes)[source]
    column = F.col(source)
    if kind == "string":
        column = date_value(column)
    return df.withColumn(target, F.to_date(column).cast("timestamp_ntz"))
