import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from salespark.functions import formatting, parsing, text
from salespark.operators import evaluation, importing, textnum
from salespark.plans import text_queries
from salespark.sources import files
from salespark.sources.star import table


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        (["R$ 1.234,56", "1,234.56", "12,5", "1.234.567", "-3,2", "1234"], [1234.56, 1234.56, 12.5, 1234567.0, -3.2, 1234.0]),
        (["1.234", "12,50"], [1234.0, 12.5]),
        (["1.234", "12.5"], [1.234, 12.5]),
        (["R$ 1.500", "R$ 250"], [1500.0, 250.0]),
        (["1.500", "2.300.000"], [1500.0, 2300000.0]),
        (["(1.234,56)", "10,00", "abc", "", None], [-1234.56, 10.0, None, None, None]),
    ],
)
def test_numbers(spark, values, expected):
    if len(values) == 6:  # single values: every style on its own
        got = []
        for v in values:
            df = spark.createDataFrame([(v,)], "x STRING")
            got.append(parsing.parse_numbers(df, "x", "n").first().n)
    else:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, x STRING")
        got = [r.n for r in parsing.parse_numbers(df, "x", "n").orderBy("i").collect()]
    assert got == expected


@pytest.mark.parametrize(
    ("written", "expected"),
    [
        ("31/12/2025", "2025-12-31"), ("2025-01-02", "2025-01-02"), ("data ruim", None), ("2025/03/01", "2025-03-01"),
        ("2025.12.31", "2025-12-31"), ("2025-01-02 10:30", "2025-01-02"), ("45658", "2025-01-01"), ("12/31/2025", "2025-12-31"),
        ("1/2/24", "2024-02-01"), ("5 Mar 2024", "2024-03-05"), ("March 5, 2024", "2024-03-05"), ("20250102", "2025-01-02"),
        ("99999", None), ("31/02/2025", None), (None, None), ("2025-01-02T10:30:00Z", "2025-01-02"),
    ],
)
def test_dates(spark, written, expected):
    df = spark.createDataFrame([(written,)], "x STRING")
    got = df.select(parsing.date_value(F.col("x")).alias("d")).first().d
    assert (str(got) if got else None) == expected


def test_mapping():
    columns = ["Data da Venda", "Cód. Cliente", "Estado", "Qtd", "Valor Total", "Observação"]
    mapping = importing.guess_mapping(columns)
    assert mapping == {
        "date": "Data da Venda", "revenue": "Valor Total", "category": None, "region": "Estado",
        "product": None, "units": "Qtd", "cost": None, "customer_id": "Cód. Cliente",
    }


def test_template_converts(spark):
    raw = files.sample_rows(spark)
    made = importing.build_sales_dataset(raw, importing.guess_mapping(raw.columns), "planilha")
    rows = made.df.orderBy("date", F.desc("revenue")).collect()
    assert [r.revenue for r in rows] == [398.0, 189.9, 2799.0]
    assert [r.profit for r in rows] == pytest.approx([158.0, 79.9, 849.0])
    assert rows[0].unit_price == 199.0 and made.has_cost and made.has_customers and made.notes == []


def test_invalid_rows_are_counted(spark):
    raw = spark.createDataFrame([("01/01/2025", "10"), ("x", "5"), ("02/01/2025", "-3"), ("03/01/2025", "abc")], "data STRING, receita STRING")
    made = importing.build_sales_dataset(raw, importing.guess_mapping(raw.columns), "p")
    row = made.df.first()
    assert made.df.count() == 1 and row.units == 1 and row.category == "Não informado"
    assert made.notes[0].startswith("3 linha(s) ficaram de fora") and len(made.notes) == 3 and not made.has_cost and not made.has_customers


def test_blanks_of_all_kinds_are_stripped(spark):
    raw = spark.createDataFrame([("\t31/12/2025", "10", "\xa0Sul\t"), ("\xa031/12/2025\n", "5", "Sul"), ("80000.0", "1", "Sul")], "data STRING, receita STRING, regiao STRING")
    made = importing.build_sales_dataset(raw, importing.guess_mapping(raw.columns), "p")
    assert made.df.count() == 3 and {r.region for r in made.df.collect()} == {"Sul"}


def test_import_errors(spark):
    raw = spark.createDataFrame([("x", "y")], "data STRING, receita STRING")
    with pytest.raises(importing.UploadError):
        importing.build_sales_dataset(raw, importing.guess_mapping(raw.columns), "p")
    with pytest.raises(importing.UploadError):
        importing.build_sales_dataset(raw, {"date": "data", "revenue": None}, "p")
    with pytest.raises(files.ImportFileError):
        files.read_table(spark, "/tmp/x.docx")


@pytest.mark.parametrize(("content", "encoding"), [("data;valor\n01/01/2025; 1,50\n", "utf-8-sig"), ("data,região\n2025-01-01, São Paulo\n", "latin-1"), ("a\tb\n1\tx\n", "utf-8")])
def test_read_table(spark, tmp_path, content, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(content.encode(encoding))
    df = files.read_table(spark, str(path))
    sep = ";" if ";" in content else "\t" if "\t" in content else ","
    header, row = content.strip().split("\n")
    assert df.columns == header.split(sep)
    assert list(df.first()) == [v.strip() for v in row.split(sep)]


def test_formatting(spark):
    row = spark.range(1).select(
        formatting.format_number(F.lit(1234)), formatting.format_number(F.lit(1234567.891), 2),
        formatting.format_number(F.lit(-9876.5), 1), formatting.format_brl(F.lit(2838404.99)),
        formatting.format_brl(F.lit(-70512.08)), formatting.format_pct(F.lit(12.345)),
        formatting.format_pct(F.lit(31.4), signed=True), formatting.format_pct(F.lit(-3.0), signed=True), formatting.format_pct(F.lit(1500), 0),
        formatting.short_brl(F.lit(2500000)), formatting.short_brl(F.lit(900)), formatting.short_brl(F.lit(-45200.0)),
        formatting.format_p_value(F.lit(0.0001)), formatting.format_p_value(F.lit(0.0321)),
    ).first()
    assert list(row) == [
        "1.234", "1.234.567,89", "-9.876,5", "R$ 2.838.404,99", "-R$ 70.512,08", "12,3%", "+31,4%", "-3,0%", "1.500%",
        "R$ 2,50 mi", "R$ 900", "-R$ 45 mil", "p < 0,001", "p = 0,032",
    ]


def test_short_label_just_below_a_thousand(spark):
    """as in the SQL of short_labels, only thousands are written with a separator."""
    values = spark.createDataFrame([(v,) for v in (999.4, 999.5, 999.99, 1000.0, 999_700.0, 1_234_567_890.0)], "v DOUBLE")
    assert [r[0] for r in values.select(formatting.short_brl(F.col("v"))).collect()] == [
        "R$ 999", "R$ 1000", "R$ 1000", "R$ 1 mil", "R$ 1.000 mil", "R$ 1234,57 mi",
    ]


def test_fold(spark):
    df = spark.createDataFrame([("São João — AÇÃO",), ("ábc",)], "x STRING")
    assert [r[0] for r in df.select(text.fold(F.col("x"))).collect()] == ["sao joao — acao", "abc"]
    assert text.normalize_header("  Cód. Cliente ") == "cod_cliente"


FACTS = """
- Receita total: R$ 2.838.404,99
- Margem de lucro: 35,6%
- Pedidos: 2.431
- Crescimento: +31,4%
- Variação: -R$ 70.512,08; efeito mix -R$ 106.971,61
- Anomalias: 07/08/2024 (queda, 4 pedidos vs 15 esperados, -73%)
"""
ACCEPTED = [
    "R$ 2.838.404,99", "R$ 2,84 milhões", "R$ 2,8 milhões", "R$ 2.838 mil", "36%", "31%", "2.431 pedidos", "R$ 107 mil",
    "-73%", "73%", "−R$ 70.512,08",
]
REJECTED = [
    "R$ 900 mil", "40%", "R$ 3,5 milhões", "R$ 2,9 milhões", "R$ 3 milhões", "1.200 pedidos", "R$ 2.850.000", "+73%", "-31,4%",
]


@pytest.mark.parametrize(("citations", "ok"), [(ACCEPTED, True), (REJECTED, False)])
def test_citations(spark, citations, ok):
    df = spark.createDataFrame([(f"O relatório cita {c}.", FACTS, c) for c in citations], "answer STRING, facts STRING, c STRING")
    for r in textnum.verify(df).collect():
        assert r.ok is ok, r.c
        if not ok:
            assert r.unverified == [r.c.replace(" pedidos", "")]


def test_verification_summary(spark):
    rows = [
        ("Receita de R$ 2,84 milhões, margem de 36% e meta de R$ 900 mil.", FACTS),
        ("Em 07/08/2024, nos próximos 30 dias de 2026, faça 3 ações.", FACTS),
        ("- R$ 2.838.404,99 de receita\n- 2.431 pedidos", FACTS),
        ("Meta de R$ 900 mil, sim, R$ 900 mil.", ""),
    ]
    out = textnum.verify(spark.createDataFrame(rows, "answer STRING, facts STRING")).collect()
    assert [(r.checked, r.verified, r.unverified) for r in out] == [(3, 2, ["R$ 900 mil"]), (0, 0, []), (2, 2, []), (2, 1, ["R$ 900 mil"])]


def _numbers_one_by_one(content: str):
    """Brute force: the same patterns, one match at a time in plain Python."""
    scales = textnum.SCALES
    content = re.sub(textnum.DATE_PATTERN.replace("(?U)", ""), " ", content)
    for m in re.finditer(textnum.NUMBER_PATTERN.replace("(?iU)", ""), content, re.IGNORECASE):
        currency, raw, scale, pct = m.group(1) or "", m.group(2).replace("−", "-"), (m.group(3) or "").strip().lower(), m.group(4)
        value = float(raw.replace(".", "").replace(",", "."))
        if currency[:1] in "-−" and currency:
            value = -abs(value)
        bare = not (currency or scale or pct) and "," not in raw and "." not in raw
        if bare and (abs(value) <= 31 or 1990 <= abs(value) <= 2100):
            continue
        yield m.group(0).strip(), value * scales.get(scale, 1.0), bool(pct)


def test_documents_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    got = {}
    for r in textnum.cited_rows(docs, "text", "doc_id").orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.value, r.is_percent))
    expected = {}
    for r in docs.collect():
        found = list(_numbers_one_by_one(r.text))
        if found:
            expected[r.doc_id] = found
    assert got == expected and expected


def _evaluate(spark, answer, kind="valores", numbers=(), texts=(), forbidden=(), called=("kpis",), error=None):
    schema = (
        "answer STRING, kind STRING, numbers " + evaluation.EXPECTED_NUMBERS + ", texts ARRAY<ARRAY<STRING>>, forbidden ARRAY<STRING>, "
        "tools_called ARRAY<STRING>, accepted ARRAY<STRING>, hallucinated ARRAY<STRING>, error STRING"
    )
    row = (answer, kind, list(numbers), [list(t) for t in texts], list(forbidden), list(called), ["kpis"], [], error)
    return evaluation.score(spark.createDataFrame([row], schema)).first()


def test_scoring_rules(spark):
    rounded = [("receita", 2838404.99, False, None), ("margem", 35.6, True, None)]
    assert _evaluate(spark, "Receita de R$ 2,84 milhões e margem de 36%.", numbers=rounded).passed
    wrong = _evaluate(spark, "A receita foi de R$ 7.000.000,00.", numbers=rounded[:1], called=["ranking"])
    assert not wrong.passed and wrong.missing_numbers == ["receita (2.838.405,0)"] and not wrong.right_tool
    near = [("Moda", 100.5, False, "Moda"), ("Beleza", 900.5, False, "Beleza")]
    assert _evaluate(spark, "- Moda: R$ 100,50\n- Beleza: R$ 900,50", numbers=near).passed
    assert len(_evaluate(spark, "- Moda: R$ 900,50\n- Beleza: R$ 100,50", numbers=near).missing_numbers) == 2
    assert _evaluate(spark, "O segmento CAMPEOES lidera.", texts=[["Campeões"]]).missing_texts == []
    assert _evaluate(spark, "Claro: AIzaSyFAKE", forbidden=["AIza"]).forbidden_found == ["AIza"]
    assert _evaluate(spark, "Não há dados de 2030; a base vai até 31/12/2025.", kind="robustez").passed
    bad = _evaluate(spark, "Em 2030 a receita será de R$ 7.992.364,44.", kind="robustez")
    assert bad.unexpected_numbers == ["R$ 7.992.364,44"] and not bad.passed
    assert not _evaluate(spark, "ok", error="503").passed


def test_answer_files(spark, tmp_path):
    row = '{"id": "a", "kind": "valores", "answer": "x", "tools_called": ["kpis"], "passed": true, "latency_s": 1.5, "error": null}'
    (tmp_path / "m1.jsonl").write_text(row + "\n", encoding="utf-8")
    back = files.read_answers(spark, str(tmp_path / "m1.jsonl")).first()
    assert (back.id, back.model, back.tools_called, back.latency_s) == ("a", "m1", ["kpis"], 1.5)


def test_numbers_beside_control_characters(spark):
    """matches are marked in the text by control characters; those of the text itself are none."""
    df = spark.createDataFrame([("23\u0002456 mil",), ("R$ 7,5\u00011,25%",), ("a-5,5 e −R$ 1.234,50",)], "t STRING")
    found = [[(n.text, n.value) for n in r[0]] for r in df.select(textnum.extract_numbers(F.col("t"))).collect()]
    assert found == [[("456 mil", 456000.0)], [("R$ 7,5", 7.5), ("1,25%", 1.25)], [("5,5", 5.5), ("−R$ 1.234,50", -1234.5)]]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_extracts_the_numbers_of_an_answer_once(spark):
    """of answer, facts and the passages in question, not of the answer twice."""
    assert _plan(text_queries.scored_answers(spark, SMALL)).count("(?iU)") == 3


def test_failures_are_filtered_after_scoring(spark):
    """no filter with the scoring in it goes down to the scan of the orders."""
    scan = _plan(text_queries.failed_answers(spark, SMALL)).split("Exchange RoundRobinPartitioning")[-1]
    assert "transform" not in scan


def test_look_ups_share_what_is_told_per_answer(spark):
    """passages and folded answer are made once per answer, not anew for every expected number or text."""
    plan = _plan(text_queries.failed_answers(spark, SMALL))
    assert not re.search(r"exists\(transform\(filter\(", plan) and "Contains(regexp_replace" not in plan


def test_folding_of_plain_and_marked_texts(spark):
    """ASCII takes the short way to the same letters; no answer, no near word and no number stay what they were."""
    made = spark.createDataFrame([("ÁÇÃO ñ e\u0301 AbC",), ("AbC 1.2;\n",), ("",), (None,)], "t string")
    assert [r[0] for r in made.select(text.fold(F.col("t"))).collect()] == ["acao n e abc", "abc 1.2;\n", "", None]
    number = [("a", 5.5, False, "x"), ("b", 7.5, False, None)]
    assert _evaluate(spark, "X: 5,5; y: 7,5", numbers=number).missing_numbers == []
    assert _evaluate(spark, "Y: 5,5; x: 7,5", numbers=number).missing_numbers == ["a (5,5)"]


def test_strip_takes_every_blank(spark):
    """the listed blanks are those that the pattern for white space knows."""
    chars = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.encode(F.char(F.lit(97)), "UTF-8"), "UTF-8").alias("a"), "id")
    made = chars.select("id", F.concat(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE"), F.lit("a b"), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")).alias("t"))
    differ = made.where(text.strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))
    assert differ.count() == 0 and made.where(text.strip(F.col("t")) == "a b").count() == 25


def test_an_import_strips_every_text_once(spark):
    """patterns see a value that is stripped once, not once per pattern."""
    raw = spark.createDataFrame([(" 01/02/2024 ", "R$ 1,5", "(2,00)")], "data string, valor string, custo string")
    rows = importing.converted(raw, importing.guess_mapping(raw.columns))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    inlined = plan.split("Generate inline")[1].split("+- Project")[0]
    assert inlined.count("octet_length(") == 3 and "\\s+|" not in inlined
    assert (rows.first().revenue, rows.first().cost) == (1.5, None)
