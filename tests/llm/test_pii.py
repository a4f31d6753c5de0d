"""Surrogates: nothing of the originals stays, types and formats do, entities stay apart and together."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from salespark.llm import catalog, pii  # noqa: E402

MIDDLE = "/root/testdata/sf0.01"


def luhn(number):
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


PLAIN = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+\d \(\d{3}\) \d{3}-\d{4}|(?<!\w)\d{16}(?!\d)|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\d)")


def test_documents_lose_their_personal_data_only(spark):
    before = dict(brute.documents(spark, MIDDLE))
    pairs = {}
    for r in catalog.op6_pii(spark, MIDDLE).collect():
        text, old = r["text"], before.pop(r["doc_id"])
        real = [m for m in PLAIN.findall(old) if not m.isdigit() or luhn(m)]
        made = [m for m in PLAIN.findall(text) if m not in [x for x in PLAIN.findall(old) if x.isdigit() and not luhn(x)]]
        assert len(real) == len(made) == r["n_email"] + r["n_phone"] + r["n_card"] + r["n_ip"]
        for a, b in zip(real, made, strict=True):
            assert pairs.setdefault(a.lower(), b.lower()) == b.lower() and a != b
            if a.isdigit():
                assert b.isdigit() and luhn(b) and a[0] == b[0] and len(a) == len(b)
            elif "@" not in a and "." not in a:
                assert re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) and a[:2] == b[:2]
        assert PLAIN.sub("", text) == PLAIN.sub("", old)
        assert not any(a in text for a in real)
    assert not before and len(pairs) > 50 and len(set(pairs.values())) == len(pairs)


def replaced(spark, texts, key="k"):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as kind", "2 as uid", "3 as `row`", "4 as pieces", "5 as known", "6 as salt")
    return [r["text"] for r in pii.pseudonymize(table, key).orderBy("doc_id").collect()]


def test_formats_gender_script_and_coreference(spark):
    texts = [
        "Mr. John Smith met Mrs. Mary Smith; MR. SMITH too. Mrs Mary left.", "Mr. John Smith, card 4111-1111 1111 1111 and 4111111111111111.", "Господин Иван Петров", "SSN 123-45-6789, 123-45-678, 1.2.3.4.5, 300.1.1.1, 10.0.0.1",
        "JOE.O'x+7@Mail.Example.ORG or joe.o@mail.example.org", "call (212) 555-0199 or 212-555-0199, +44 20 7946 0958", "4111111111111112 is no card", None, "",
    ]
    first, second, third, numbers, mail, phones, none, null, empty = replaced(spark, texts)
    m = re.fullmatch(r"Mr\. (\w+n) (\w+sen) met Mrs\. (\w+na) (\w+sen); MR\. (\w+SEN) too\. Mrs (\w+sen) left\.", first)
    assert m and m[2] == m[4] and m[5] == m[2].upper() and "Smith" not in first
    n = re.fullmatch(r"Mr\. (\w+) (\w+), card (\d{4}-\d{4} \d{4} \d{4}) and (\d{16})\.", second)
    assert n and (n[1], n[2]) == (m[1], m[2]) and re.sub(r"\D", "", n[3]) == n[4] and luhn(n[4]) and n[4] != "4" + "1" * 15
    assert re.fullmatch(r"Господин [А-Я][а-я]+ [А-Я][а-я]+", third) and "Петров" not in third
    assert re.fullmatch(r"SSN 9\d\d-\d\d-\d{4}, 123-45-678, 1\.2\.3\.4\.5, 300\.1\.1\.1, 10\.\d+\.\d+\.\d+", numbers)
    assert re.fullmatch(r"[a-zA-Z.'+0-9]+@\w+\.example\.(org|ORG) or [a-z]{3}\.[a-z]@\w+\.example\.org", mail)
    assert re.fullmatch(r"call \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}, \+4\d \d\d \d{4} \d{4}", phones)
    a, b = re.findall(r"\(?(\d{3})\)?[ -](\d{3})-(\d{4})", phones)
    assert a == b
    assert (none, null, empty) == ("4111111111111112 is no card", None, "")
    assert replaced(spark, texts) == [first, second, third, numbers, mail, phones, none, null, empty]
    assert replaced(spark, texts[:1], "other") != [first]


def test_clashes_are_resolved(spark):
    names = [f"a{i}" for i in range(700)]
    entities = spark.createDataFrame([("surname_latin", n) for n in names] + [("given_m_latin", n) for n in names[:50]] + [("ip", f"10.0.0.{i}") for i in range(30)], "kind string, canonical string")
    rows = pii.surrogates(entities, "k").collect()
    made = [(r["kind"], r["surrogate"].lower()) for r in rows]
    assert len(set(made)) == len(rows) == 780
    assert not {(r["kind"], r["canonical"]) for r in rows} & set(made)


def test_awkward_rows(spark):
    found = pii.pseudonymize(brute.awkward(spark), "k")
    assert set(found.columns) == {*brute.awkward(spark).columns, "entities"}
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {r[0]: r[1] for r in brute.AWKWARD}
    assert pii.pseudonymize(brute.awkward(spark).limit(0), "k").count() == 0
    twice = spark.createDataFrame([(1, "a@b.com"), (1, "a@b.com"), (None, "x " * 20_000 + "a@b.com")], "doc_id long, text string")
    texts = [r["text"] for r in pii.pseudonymize(twice, "k").collect()]
    assert len(texts) == 3 and len({t.split()[-1] for t in texts}) == 1 and "a@b.com" not in texts


@pytest.mark.parametrize("number", ["4111111111111111", "5500005555555559", "378282246310005"])
def test_luhn_expression(spark, number):
    from pyspark.sql import functions as F

    row = spark.range(1).select((pii._luhn_sum(F.lit(number), 0) % 10).alias("whole"), ((10 - pii._luhn_sum(F.lit(number[:-1]), 1) % 10) % 10).alias("digit")).first()
    assert row["whole"] == 0 and row["digit"] == int(number[-1])


PHONES = ["+49 30 12 34 56 78", "+44 20 79 46 09 58", "+7 (49) 12 34 56", "+47 22 12 34 56", "+33 1 23 45 67 89", "+33.1.23.45.67.89", "+44 (0)20 7946 0958", "+55 11 9 1234 5678", "+1 212 555 0199"]


def test_phones_in_small_groups_and_paired_cards_are_replaced_everywhere(spark):
    texts = [f"call {p} now" for p in PHONES] + [f"call {p} now, a@b.com" for p in PHONES] + ["41 11 11 11 11 11 11 11", "between +1.5 2.25 3.75 and +12 34"]
    found = replaced(spark, texts)
    n = len(PHONES)
    for phone, alone, hinted in zip(PHONES, found[:n], found[n : 2 * n], strict=True):
        assert re.sub(r"\d", "9", alone) == re.sub(r"\d", "9", f"call {phone} now") and phone not in alone
        assert hinted.startswith(alone)
    assert found[-2] != texts[-2] and luhn(found[-2]) and found[-1] == texts[-1]


def test_every_match_implies_the_hint(spark):
    import random

    pick = random.Random(3)
    parts = ["+", "(", ")", " ", "-", ".", "@", "a", "Mr", "A", *"0123456789", "12", "123", "1234", ") ", "+4"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(8, 40))) for _ in range(40_000)]
    texts += ["".join(pick.choice(["+", "(", ")", " ", "-", ".", "1", "23", "456"]) for _ in range(pick.randrange(5, 16))) for _ in range(40_000)]
    table = spark.createDataFrame([(t,) for t in [*texts, *PHONES]], "text string")
    hits = table.where(table["text"].rlike(pii.ANY))
    assert hits.count() > 1000 and hits.where(~hits["text"].rlike(pii.HINT)).count() == 0


def test_names_without_their_title_and_gender_of_all_mentions(spark):
    texts = [
        "Mr. John Smith met Anna. Smith said so, and SMITH'S brother John too; smithy, Johnson and will stay.",
        "Dr. Anna Weber called. Anna answered.", "Frau Anna Weber and Weber-Haus", "Dr. Kim Lee", "Herr Kim Lee, Frau Kim Lee",
    ]
    first, second, third, fourth, fifth = replaced(spark, texts)
    m = re.fullmatch(r"Mr\. (\w+n) (\w+sen) met Anna\. (\w+) said so, and (\w+)'S brother (\w+) too; smithy, Johnson and will stay\.", first)
    assert m and m[3] == m[2] and m[4] == m[2].upper() and m[5] == m[1]
    a, b = re.fullmatch(r"Dr\. (\w+na) (\w+sen) called\. (\w+) answered\.", second), re.match(r"Frau (\w+na) (\w+sen) and", third)
    assert a and b and a[1] == b[1] == a[3] and a[2] == b[2] and "Weber" not in second
    kims = re.findall(r"(?:Dr\.|Herr|Frau) (\w+)", fourth + fifth)
    assert len(kims) == 3 and len(set(kims)) == 1


def test_many_names_settle(spark):
    names = spark.range(20_000).selectExpr("'surname_latin' as kind", "concat('n', id) as canonical")
    rows = pii.surrogates(names, "k").collect()
    assert len(rows) == len({r["surrogate"].lower() for r in rows}) == 20_000
