"""Scoring stored answers against expected values, and the scoreboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from salespark.functions.formatting import format_number
from salespark.functions.parsing import once
from salespark.functions.text import fold
from salespark.operators.textnum import extract_numbers, matches

ROBUSTNESS = "robustez"
FORMAT_ERROR = "formato"
# expected values of a case, joined to its answer
EXPECTED_NUMBERS = "ARRAY<STRUCT<label: STRING, value: DOUBLE, percent: BOOLEAN, near: STRING>>"
# where a line or sentence ends
PASSAGE_END = r"\n|;|\.\s"


def numbered_passages(answer: Column, nears: Column) -> Column:
    """array<struct<folded, numbers>> of the passages that contain one of the folded words `nears`."""

    def wanted(nears: Column) -> Column:
        passages = F.when(F.size(nears) > 0, F.split(answer, PASSAGE_END)).otherwise(F.array().cast("array<string>"))
        folded = F.transform(passages, lambda p: F.struct(fold(p).alias("folded"), p.alias("passage")))
        return F.filter(folded, lambda p: F.exists(nears, lambda near: F.contains(p["folded"], near)))

    return F.transform(once(nears, wanted), lambda p: F.struct(p["folded"].alias("folded"), extract_numbers(p["passage"]).alias("numbers")))


def _number_label(n: Column) -> Column:
    suffix = F.when(n["percent"], "%").otherwise("")
    return F.concat(n["label"], F.lit(" ("), format_number(n["value"], 1), suffix, F.lit(")"))


def rescore(df: DataFrame, extracted: str | None = None) -> DataFrame:
    """Compare stored answers with today's expected values.

    Needs answer, kind, numbers (label, value, percent, near), texts (groups of alternatives) and
    forbidden; adds missing_numbers, missing_texts, forbidden_found, unexpected_numbers and
    expects_numbers. `hallucinated` is kept as stored. `extracted` names a column that holds the answer's numbers
    already (as `textnum.verify` keeps them).
    """
    answer, cited = F.col("answer"), F.col("_cited")

    def among(numbers: Column, n: Column) -> Column:
        return F.exists(numbers, lambda c: (c["is_percent"] == n["percent"]) & matches(c, n["value"]))

    def found(s: Column, passages: Column) -> Column:
        nearby = F.exists(passages, lambda part: F.contains(part["folded"], s["near"]) & among(part["numbers"], s["n"]))
        return F.when(s["near"].isNull(), among(cited, s["n"])).otherwise(nearby)

    def not_found(sought: Column) -> Column:
        nears = F.transform(F.filter(sought, lambda s: s["near"].isNotNull()), lambda s: s["near"])
        return once(numbered_passages(answer, nears), lambda passages: F.filter(sought, lambda s: ~found(s, passages)))

    def not_said(folded: Column) -> Column:
        return F.filter("texts", lambda group: ~F.exists(group, lambda t: F.contains(folded, fold(t))))

    # what is looked up in the elements of an array is told once per answer: as a column of its own the optimizer would
    # write it into the look-up, and so tell it anew for every element
    sought = F.transform("numbers", lambda n: F.struct(n.alias("n"), fold(n["near"]).alias("near")))
    missing_numbers = F.transform(once(sought, not_found), lambda s: _number_label(s["n"]))
    missing_texts = F.transform(once(fold(answer), not_said), lambda group: F.array_join(group, " ou "))
    forbidden = once(F.lower(answer), lambda said: F.filter("forbidden", lambda t: F.contains(said, F.lower(t))))
    nothing = F.array().cast("array<string>")
    return (
        # numbers are extracted once per answer, and per passage that some expected value is sought in; these only look them up
        df.withColumn("_cited", F.col(extracted) if extracted else extract_numbers(answer))
        .withColumns(
            {
                "missing_numbers": missing_numbers,
                "missing_texts": missing_texts,
                "forbidden_found": forbidden,
                "unexpected_numbers": F.when(
                    F.col("kind") == ROBUSTNESS, F.transform(cited, lambda c: c["text"])
                ).otherwise(nothing),
                "expects_numbers": F.size("numbers") > 0,
            }
        )
        .drop("_cited")
    )


def right_tool(called: Column, accepted: Column) -> Column:
    """One of the accepted queries was used, or none is required."""
    return (F.size(accepted) == 0) | F.arrays_overlap(called, accepted)


def passed() -> Column:
    """An answer passes without error, with the right query, and with every list of problems empty."""
    problems = ("missing_numbers", "missing_texts", "hallucinated", "forbidden_found", "unexpected_numbers")
    clean = F.col("error").isNull() & F.col("right_tool")
    for name in problems:
        clean = clean & (F.coalesce(F.size(name), F.lit(0)) <= 0)
    return clean


def score(df: DataFrame, extracted: str | None = None) -> DataFrame:
    """Right query, comparison with the expected values, and `passed`."""
    checked = rescore(df.withColumn("right_tool", right_tool(F.col("tools_called"), F.col("accepted"))), extracted)
    return checked.withColumn("passed", passed())


def _rate(condition: Column, among: Column | None = None) -> Column:
    """% of rows that meet a condition, counting only the rows of `among`."""
    hit = condition.cast("double")
    return F.avg(F.when(among, hit) if among is not None else hit) * 100


def scoreboard(results: DataFrame) -> DataFrame:
    """One row per model; answers with an API error count only in `errors`."""
    answered = F.col("error").isNull()
    latency = F.median(F.when(answered, F.col("latency_s")))
    return results.groupBy("model").agg(
        F.count_if(answered).alias("answered"),
        F.count_if(answered & F.col("passed")).alias("passed"),
        _rate(F.col("passed"), answered).alias("pass_pct"),
        _rate(F.size("missing_numbers") == 0, answered & F.col("expects_numbers")).alias("numbers_pct"),
        _rate(F.size("hallucinated") == 0, answered).alias("supported_pct"),
        _rate(F.col("right_tool"), answered).alias("right_tool_pct"),
        latency.alias("median_latency_s"),
        F.avg(F.when(answered, F.col("tokens_in") + F.col("tokens_out"))).alias("mean_tokens"),
        F.count_if(~answered).alias("errors"),
    )


def scoreboard_by_kind(results: DataFrame) -> DataFrame:
    answered = results.where(F.col("error").isNull())
    return answered.groupBy("kind", "model").agg(
        F.count(F.lit(1)).alias("answered"), _rate(F.col("passed")).alias("pass_pct")
    )


def report_scoreboard(reports: DataFrame) -> DataFrame:
    """Valid reports, verified and checked numbers and latency per model; API errors are kept apart."""
    counted = F.col("valid") | F.contains(F.coalesce("error", F.lit("")), F.lit(FORMAT_ERROR))
    checked, verified = (F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)) for c in ("checked", "verified"))
    return reports.groupBy("model").agg(
        F.count_if(counted & F.col("valid")).alias("valid"),
        F.count_if(counted).alias("reports"),
        checked.alias("checked"),
        verified.alias("verified"),
        (verified / F.nullif(checked, F.lit(0)) * 100).alias("verified_pct"),
        F.avg(F.when(counted, F.col("latency_s"))).alias("mean_latency_s"),
        F.count_if(~counted).alias("errors"),
    )


def failures(results: DataFrame) -> DataFrame:
    """Answers that did not pass, each with its problems in words.

    The rows are counted before they are filtered: a filter on `passed` would otherwise be carried down to the scan, with
    all that scoring does written out in it once per use and run in as few tasks as the scan has.
    """

    def problems(column: str, prefix: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.concat(F.lit(prefix), x))

    called = F.when(F.size("tools_called") > 0, F.array_join("tools_called", ", ")).otherwise("nenhuma")
    wrong = F.when(
        ~F.col("right_tool"), F.array(F.concat(F.lit("consulta errada ("), called, F.lit(")")))
    ).otherwise(F.array().cast("array<string>"))
    words = F.concat(
        problems("missing_numbers", "faltou "),
        problems("missing_texts", "faltou "),
        problems("hallucinated", "número sem fonte: "),
        problems("forbidden_found", "texto proibido: "),
        problems("unexpected_numbers", "número numa pergunta sem resposta nos dados: "),
        wrong,
    )
    lists = ("missing_numbers", "missing_texts", "hallucinated", "forbidden_found", "unexpected_numbers")
    scored = results.select("model", "id", "question", "error", "passed", "right_tool", "tools_called", *lists)
    bad = scored.observe(Observation(), F.count(F.lit(1)).alias("answers")).where(F.col("error").isNull() & ~F.col("passed"))
    return bad.select("model", "id", "question", F.array_join(words, "; ").alias("problems"))


def open_cases(cases: DataFrame, saved: DataFrame, redo: bool = False) -> DataFrame:
    """Cases still to run: not answered yet, answered with an error, or all of them with `redo`."""
    if redo:
        return cases
    return cases.join(saved.where(F.col("error").isNull()).select("id"), "id", "left_anti")


def kept_results(saved: DataFrame, cases: DataFrame, redo: bool = False) -> DataFrame:
    """Stored rows that stay: of other cases, and (unless `redo`) of these cases without error."""
    asked = cases.select("id").distinct()
    others = saved.join(asked, "id", "left_anti")
    if redo:
        return others
    return others.unionByName(saved.join(asked, "id", "left_semi").where(F.col("error").isNull()))
