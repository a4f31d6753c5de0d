"""Numbers cited in a text, and whether the facts support them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.session import stage

# Fixed patterns: a Brazilian number with optional sign, currency, scale and %; and a date.
# The look-ahead names the characters a match can start with, so that all other places are left at once.
NUMBER_PATTERN = (
    r"(?iU)(?=[-+−RU\d])((?:[-−](?=R\$|US\$))?(?:R\$|US\$)\s?)?"
    r"((?:(?<!\w)[-+−])?(?:\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?))"
    r"(\s?(?:mil\b|milh(?:ão|ões)|bilh(?:ão|ões)|mi\b|bi\b))?"
    r"(\s?%)?"
)
DATE_PATTERN = r"(?U)\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b"
# Scale words, the cap on rounding of scaled numbers, and what is vocabulary, not a metric.
SCALES = {"mil": 1e3, "mi": 1e6, "milhão": 1e6, "milhões": 1e6, "bi": 1e9, "bilhão": 1e9, "bilhões": 1e9}
MAX_SCALED_ROUNDING = 0.05
SMALL_INT_LIMIT = 31
YEARS = (1990, 2100)
SLACK = 1e-9
# a band is less than two buckets wide
BAND_BUCKETS = 3


_GROUP, _PIECE = "\u0001", "\u0002"  # where a text holds them itself, another control character stands in


def _unmarked(text: Column) -> Column:
    """Without the control characters that mark matches."""
    held = F.contains(text, F.lit(_GROUP)) | F.contains(text, F.lit(_PIECE))
    return F.when(held, F.translate(text, _GROUP + _PIECE, "\u0003\u0003")).otherwise(text)


def _pieces(text: Column) -> Column:
    """The matches in a text, each with its currency, number, scale and % (the pattern's four adjoining groups)."""
    marked = F.regexp_replace(text, NUMBER_PATTERN, f"{_PIECE}$1{_GROUP}$2{_GROUP}$3{_GROUP}$4{_PIECE}")
    between = F.split(marked, _PIECE)  # every second part is a match
    return F.transform(F.filter(between, lambda _, i: i % 2 == 1), lambda part: F.split(part, _GROUP))


def _parsed(groups: Column) -> Column:
    """Typed fields of one matched piece."""
    currency, raw, scale_word, pct = (F.get(groups, i) for i in range(4))
    comma = F.instr(raw, ",")
    return F.struct(
        F.trim(F.array_join(groups, "")).alias("text"),
        F.translate(raw, ",−.", ".-").try_cast("double").alias("number"),
        raw.alias("raw"),
        F.when(comma > 0, F.length(raw) - comma).otherwise(0).alias("decimals"),
        (F.length(currency) > 0).alias("has_currency"),
        F.substring(currency, 1, 1).isin("-", "−").alias("negative_currency"),
        F.when(scale_word == "", "").otherwise(F.lower(F.regexp_replace(scale_word, r"(?U)\s", ""))).alias("scale_word"),
        (F.length(pct) > 0).alias("is_percent"),
    )


def _scale(word: Column) -> Column:
    factor = F.lit(1.0)
    for name, value in SCALES.items():
        factor = F.when(word == name, value).otherwise(factor)
    return F.when(word == "", 1.0).otherwise(factor)


def _scaled(p: Column) -> Column:
    """What `_cited` uses several times, told once."""
    scale = _scale(p["scale_word"])
    base = F.when(p["negative_currency"], -F.abs(p["number"])).otherwise(p["number"])
    half_step = 0.5 * F.pow(F.lit(10.0), -p["decimals"]) * scale
    signed = p["negative_currency"] | F.substring(p["raw"], 1, 1).isin("+", "-", "−")
    return F.struct(
        p["text"].alias("text"),
        (base * scale).alias("value"),
        p["is_percent"].alias("is_percent"),
        half_step.alias("half_step"),
        (p["scale_word"] != "").alias("has_scale"),
        signed.alias("signed"),
    )


def _cited(p: Column) -> Column:
    """(text, value, is_percent, tolerance, signed) of one parsed number."""
    capped = F.least(p["half_step"], F.abs(p["value"]) * MAX_SCALED_ROUNDING)
    return F.struct(
        p["text"].alias("text"),
        p["value"].alias("value"),
        p["is_percent"].alias("is_percent"),
        F.when(p["has_scale"], capped).otherwise(p["half_step"]).alias("tolerance"),
        p["signed"].alias("signed"),
    )


def _is_metric(p: Column) -> Column:
    size = F.abs(p["number"])
    bare = ~(p["has_currency"] | (p["scale_word"] != "") | p["is_percent"]) & (p["decimals"] == 0)
    vocabulary = (size <= SMALL_INT_LIMIT) | F.floor(size).between(*YEARS)
    return ~(bare & ~F.contains(p["raw"], F.lit(".")) & vocabulary)


def extract_numbers(text: Column) -> Column:
    """ARRAY<STRUCT<text, value, is_percent, tolerance, signed>> of the metrics in a text, in order.

    Dates, years and small counts are vocabulary. The text is searched once; only the matched
    pieces are taken apart.
    """
    text = _unmarked(text)
    without_dates = F.when(F.contains(text, F.lit("/")), F.regexp_replace(text, DATE_PATTERN, " ")).otherwise(text)
    parsed = F.transform(_pieces(without_dates), _parsed)
    return F.transform(F.transform(F.filter(parsed, _is_metric), _scaled), _cited)


def matches(cited: Column, reference: Column) -> Column:
    """Is the reference the cited number up to the rounding it is written with?

    Without a written sign the number may be the absolute value of the fact.
    """
    limit = cited["tolerance"] + SLACK
    near = F.abs(cited["value"] - reference) <= limit
    return near | (~cited["signed"] & (F.abs(cited["value"] - F.abs(reference)) <= limit))


def _supported(cited: Column, known: Column) -> Column:
    """A percentage may match any fact, another number only facts that are not percentages."""
    return F.exists(known, lambda k: (cited["is_percent"] | ~k["is_percent"]) & matches(cited, k["value"]))


def verify(df: DataFrame, answer: str = "answer", facts: str = "facts", numbers: str | None = None) -> DataFrame:
    """Add checked, verified, unverified (distinct texts in order) and ok to every answer.

    Answer and facts of a row are compared inside the row: no shuffle and no pairs across rows. `numbers` names a
    column that keeps the answer's cited numbers, for later steps that need them too.
    """
    with_numbers = df.withColumns(
        {"_cited": extract_numbers(F.col(answer)), "_known": extract_numbers(F.coalesce(F.col(facts), F.lit("")))}
    )
    missing = F.filter("_cited", lambda c: ~_supported(c, F.col("_known")))
    checked = with_numbers.withColumns(
        {
            "checked": F.size("_cited"),
            "known": F.size("_known"),
            "unverified": F.array_distinct(F.transform(missing, lambda c: c["text"])),
        }
    )
    result = checked.withColumns(
        {"verified": F.col("checked") - F.size("unverified"), "ok": F.size("unverified") == 0}
    )
    kept = result.withColumnRenamed("_cited", numbers) if numbers else result.drop("_cited")
    return kept.drop("_known")


def cited_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per cited number."""
    return df.select(*keys, F.posexplode(extract_numbers(F.col(text))).alias("position", "n")).select(
        *keys, "position", "n.*"
    )


def verify_shared(answers: DataFrame, facts: DataFrame, key: list[str], answer: str = "answer") -> DataFrame:
    """Add checked, verified, unverified (distinct texts in order) and ok to answers that share facts by `key`.

    facts has the key, value and is_percent. A cited number accepts a band of values around it. Facts are put into
    buckets whose width is the power of two below the band's: then of each bucket that the band touches only the least
    and the largest fact matter, so facts shrink to one row per bucket before they meet the numbers, and neither
    facts nor numbers of one key ever meet in pairs. A band touches two or three neighbouring buckets; their least and
    largest facts are gathered at the first of them, so every number is looked up once. The rules are those of `verify`;
    repeated answers are answered one by one, answers without numbers are ok, and numbers of a null key are not supported.
    """
    told = stage(answers.withColumns({"_row": F.monotonically_increasing_id(), "_cited": extract_numbers(F.coalesce(F.col(answer), F.lit("")))}), "shared-answers")
    cited = told.select("_row", *key, F.posexplode("_cited").alias("at", "c")).select("_row", *key, "at", "c.value", "c.is_percent", "c.tolerance", "c.signed")
    # a number without a sign is not negative, so it is near a fact only if it is near the fact's absolute value
    cited = cited.select("_row", *key, "at", "value", "is_percent", (F.col("tolerance") + SLACK).alias("limit"), (~F.col("signed")).alias("absolute"))
    cited = cited.withColumn("level", F.floor(F.log2(2 * F.col("limit"))).cast("int"))
    bucket = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("level")))
    reach = F.col("limit") * (1 + 1e-6)
    first, last = bucket(F.col("value") - reach), bucket(F.col("value") + reach)
    # a second look-up only where rounding makes the band reach a fourth bucket
    touched = cited.withColumn("first", F.explode(F.sequence(first, F.greatest(first, F.try_subtract(last, F.lit(BAND_BUCKETS - 1))))))
    # one small row per key and kind of band, written so that its exact size decides how it meets the facts
    levels = stage(cited.select(*key, "level", "absolute").distinct(), "shared-levels")
    known = facts.where("value IS NOT NULL").select(*key, F.coalesce("is_percent", F.lit(False)).alias("is_percent"), "value").distinct()
    sided = known.join(levels, key).withColumn("v", F.when(F.col("absolute"), F.abs("value")).otherwise(F.col("value")))
    plain = F.when(~F.col("is_percent"), F.col("v"))
    bands = sided.withColumn("bucket", bucket(F.col("v"))).groupBy(*key, "level", "absolute", "bucket").agg(
        F.min("v").alias("least"), F.max("v").alias("most"), F.min(plain).alias("least_plain"), F.max(plain).alias("most_plain")
    )
    starts = F.array(*[F.try_subtract("bucket", F.lit(i)) for i in range(BAND_BUCKETS)])
    edges = F.struct("least", "most", "least_plain", "most_plain")
    bands = bands.select(*key, "level", "absolute", F.explode(starts).alias("first"), edges.alias("edges"))
    bands = bands.groupBy(*key, "level", "absolute", "first").agg(F.collect_list("edges").alias("bands"))  # at most BAND_BUCKETS

    def near(band: Column) -> Column:
        pick = lambda side: F.when(F.col("is_percent"), band[side]).otherwise(band[f"{side}_plain"])
        return (F.col("value") - pick("most") <= F.col("limit")) & (pick("least") - F.col("value") <= F.col("limit"))

    supported = touched.join(bands, [*key, "level", "absolute", "first"]).where(F.exists("bands", near)).select("_row", "at")
    found = supported.groupBy("_row").agg(F.collect_set("at").alias("_found"))  # at most the numbers of one answer
    joined = told.join(found, "_row", "left")
    placed = F.transform("_cited", lambda c, i: F.struct(c["text"].alias("text"), F.coalesce(F.array_contains("_found", i), F.lit(False)).alias("ok")))
    unverified = F.array_distinct(F.transform(F.filter(placed, lambda c: ~c["ok"]), lambda c: c["text"]))
    result = joined.withColumns({"checked": F.size("_cited"), "unverified": unverified})
    result = result.withColumns({"verified": F.col("checked") - F.size("unverified"), "ok": F.size("unverified") == 0})
    return result.drop("_row", "_cited", "_found")
