"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Detection and replacement are column expressions; only rows with a hint of personal data are taken apart. Each
distinct entity gets one surrogate, a function of the key, the entity and a salt, so every mention of it reads alike
everywhere (coreference). Surrogates must differ from each other and from all entities found: entities that clash
get the next salt, round by round, until none does. Mentions meet the surrogates in a join on the entity and
return to their row by its number in a written table.

Types: e-mail addresses (reserved domains), phone numbers (country code kept), payment cards (with a valid check digit
before and after, first digit kept), IPv4 addresses (private range), social security numbers (unassigned range), and
names after a title (by gender of the title and by script; the last of several words is the surname). A name with a
title anywhere in a document is also replaced where it stands there without one. A given name has the gender that its titles tell in the
whole table, none if they disagree. Numbers that fail their check are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from salespark.llm.common import partitions
from salespark.session import stage

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_GROUP = r"(?:\(\d{1,4}\)|\d{2,4}|(?<!\.)\d(?=[ -])|\d(?=(?:\.\d{2}){4}(?!\d)))"  # one digit alone only before blanks or hyphens, or as in +33.1.23.45.67.89
INTERNATIONAL = rf"(?<![\p{{L}}\p{{N}}+])\+(?=\d(?:[ .()-]{{0,3}}\d){{6}})\d{{1,3}}[ .-]?{_GROUP}(?:[ .-]?\d{{2,4}}|[ -]\d(?=[ -])){{1,4}}[ .-]?\d{{2,4}}(?!\d)"
PHONE = rf"{INTERNATIONAL}|(?<![\p{{L}}\p{{N}}])\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)|(?<![\p{{L}}\p{{N}}-])\d{{3}}-\d{{3}}-\d{{4}}(?![\d-])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
CARD = r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?!\d)"
MALE, FEMALE, EITHER = (f"{t}|{t.upper()}" for t in ("Mr|Sir|Herr|Monsieur|Señor|Sr|Господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа", "Dr|Prof"))
TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE}|{EITHER})(?:\. ?| )"
NAME = rf"{TITLE}\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}}"
ANY = "|".join((EMAIL, PHONE, SSN, IP, CARD, NAME))
#: Each alternative of ANY contains one of these: e-mail @; phones +d, (ddd) or ddd-d; SSN ddd-d; IP d.d; cards 13 digits; names a title.
HINT = rf"@|\+\d|\(\d{{3}}\)|\d{{3}}-\d|\d\.\d|\d(?:[ -]?\d){{12}}|{TITLE}\p{{Lu}}"
KINDS = ("email", "phone", "card", "ip", "ssn", "name")
MOST_IDLE = 100  # rounds in a row without a free surrogate

_PIECE = "array<struct<kind:string,surface:string,canonical:string>>"
_LATIN, _SYLLABLES = "abcdefghijklmnopqrstuvwxyz", ("ba", "de", "fi", "go", "ka", "le", "mi", "no", "ra", "se", "ti", "vo", "la", "ne", "ro", "ve")
_CYRILLIC = "абцдефгхийклмнопярстуввхыз"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Digit sum from the right; every second digit is doubled, from the last one on if `doubled` is 1."""
    n = F.char_length(digits)
    digit = lambda i: digits.substr(n - i + 1, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == doubled, digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + term(i))


def _piece(kind: Column, surface: Column, canonical: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), surface.alias("surface"), canonical.cast("string").alias("canonical"))


def _expanded(hit: Column) -> Column:
    """The pieces of one match: literal ones have no kind."""
    one = lambda kind, canonical: F.array(_piece(F.lit(kind), hit, canonical))
    title = F.regexp_extract(hit, f"^{TITLE}", 0)
    words = F.regexp_extract_all(hit.substr(F.char_length(title) + 1, F.char_length(hit)), F.lit("[^ ]+| +"), F.lit(0))
    gender = F.when(title.rlike(f"^(?:{MALE})[. ]"), "m").when(title.rlike(f"^(?:{FEMALE})[. ]"), "f").otherwise("u")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    word = lambda w, i: F.when(w.rlike("^ "), _piece(F.lit(None), w, F.lit(None))).otherwise(
        _piece(F.concat(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender)), F.lit("_"), script(w)), w, F.lower(w))
    )
    name = F.concat(F.array(_piece(F.lit(None), title, F.lit(None))), F.transform(words, word))
    return (
        F.when(hit.rlike("@"), one("email", F.lower(hit)))
        .when(hit.rlike(f"^(?:{PHONE})$"), one("phone", F.regexp_replace(hit, r"[^\d+]", "")))
        .when(hit.rlike(f"^(?:{SSN})$"), one("ssn", _digits(hit)))
        .when(hit.rlike(f"^(?:{IP})$"), one("ip", hit))
        .when(hit.rlike(r"^\d"), F.when(_luhn_sum(_digits(hit), 0) % 10 == 0, one("card", _digits(hit))).otherwise(F.array(_piece(F.lit(None), hit, F.lit(None)))))
        .otherwise(name)
        .cast(_PIECE)
    )


def _pieces(text: Column) -> Column:
    gaps, hits = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    literal = lambda g: F.array(_piece(F.lit(None), g, F.lit(None)))
    return F.flatten(F.zip_with(gaps, hits, lambda g, h: F.when(h.isNull(), literal(g)).otherwise(F.concat(literal(g), _expanded(h))))).cast(_PIECE)


def _made(key: str) -> Column:
    """The surrogate of (kind, canonical, salt)."""
    hashed = lambda *parts: F.sha2(F.concat_ws("\u0001", F.lit(key), *parts), 512)
    salt = F.col("salt").cast("string")
    number = lambda h, i: F.conv(h.substr((i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int")
    h = hashed("kind", "canonical", salt)
    pick = lambda alphabet, n: F.lit(alphabet).substr(n % len(alphabet) + 1, F.lit(1))

    def alike(text: Column, h: Column) -> Column:
        """Letters by letters of the script, digits by digits, the rest as it is."""
        return F.array_join(
            F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike(r"\d"), pick("0123456789", number(h, i))).when(c.rlike(r"\p{IsCyrillic}"), pick(_CYRILLIC, number(h, i))).when(c.rlike(r"\p{L}"), pick(_LATIN, number(h, i))).otherwise(c)), ""
        )

    local, domain = F.substring_index("canonical", "@", 1), F.substring_index("canonical", "@", -1)
    label, top = F.substring_index(domain, ".", 1), F.substring_index(domain, ".", -1)
    email = F.concat(alike(local, h), F.lit("@"), alike(label, hashed(F.lit("domain"), domain)), F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise("com"))
    whole = F.col("canonical")
    random = alike(whole, h)
    start = F.when(whole.startswith("+"), 2).otherwise(1)
    phone = F.concat(F.when(whole.startswith("+"), whole.substr(1, 2)).otherwise(""), pick("23456789", number(h, F.lit(60))), random.substr(start + F.when(whole.startswith("+"), 2).otherwise(1), F.char_length(whole)))
    body = F.concat(whole.substr(1, 1), random.substr(F.lit(2), F.char_length(whole) - 2))
    card = F.concat(body, ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string"))
    ip = F.concat_ws(".", F.lit("10"), *[number(h, F.lit(i)).cast("string") for i in range(3)])
    ssn = F.concat(F.lit("9"), random.substr(2, 8))
    syllable = lambda i: F.element_at(F.array(*map(F.lit, _SYLLABLES)), number(h, i) % len(_SYLLABLES) + 1)
    stem = F.array_join(F.transform(F.sequence(F.lit(1), 2 + F.col("salt")), lambda i: syllable(i)), "")
    ending = F.when(F.col("kind").startswith("given_m"), "n").when(F.col("kind").startswith("given_f"), "na").when(F.col("kind").startswith("surname"), "sen").otherwise("")
    name = F.initcap(F.concat(stem, ending))
    name = F.when(F.col("kind").endswith("cyrillic"), F.initcap(F.translate(F.lower(name), _LATIN, _CYRILLIC))).otherwise(name)
    kind = F.col("kind")
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "ssn", ssn).otherwise(name)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical); surrogates differ from each other and from all entities.

    Only entities that clash go on to the next round, against the surrogates settled by then.
    """
    spark, n = entities.sparkSession, partitions(entities)
    taken = stage(entities.select("kind", F.col("canonical").alias("form")), "pii-entities")
    # few bytes, but costly expressions: dealt out by hand, or they would all be one task
    current = entities.select("kind", "canonical", F.lit(0).alias("salt"))
    done, idle = spark.createDataFrame([], "kind string, canonical string, surrogate string"), 0
    while True:
        made = stage(current.repartition(n, "kind", "canonical").withColumn("surrogate", _made(key)).withColumn("form", F.lower("surrogate")), "pii-made")
        first = F.row_number().over(W.partitionBy("kind", "form").orderBy("salt", "canonical"))
        used = taken.unionByName(done.select("kind", F.lower("surrogate").alias("form"))).withColumn("used", F.lit(True)).distinct()
        met = made.withColumn("n", first).join(used, ["kind", "form"], "left").select("kind", "canonical", "salt", "surrogate", ((F.col("n") > 1) | F.col("used").isNotNull()).alias("clash"))
        settled = stage(met, "pii-surrogates")
        found = settled.agg(F.count_if("clash"), F.count_if(~F.col("clash"))).first()
        done = done.unionByName(settled.where("not clash").select("kind", "canonical", "surrogate"))
        if not found[0]:
            return done
        idle = 0 if found[1] else idle + 1
        if idle == MOST_IDLE:
            raise ValueError(f"{found[0]} entities find no free surrogate; their types have too few forms.")
        current = settled.where("clash").select("kind", "canonical", (F.col("salt") + 1).alias("salt"))


def _with_gender(entities: DataFrame) -> DataFrame:
    """(kind, canonical, resolved): kinds of given names with the gender that all mentions of the name agree on."""
    script = F.regexp_extract("kind", "^given_._(.*)$", 1)
    given = entities.where("kind LIKE 'given%'").groupBy(script.alias("script"), "canonical")
    told = given.agg(F.bool_or(F.col("kind").startswith("given_m")).alias("m"), F.bool_or(F.col("kind").startswith("given_f")).alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("u")
    told = told.select("script", "canonical", F.concat(F.lit("given_"), gender, F.lit("_"), "script").alias("resolved"))
    return entities.withColumn("script", script).join(told, ["script", "canonical"], "left").select("kind", "canonical", F.coalesce("resolved", "kind").alias("resolved"))


def _untitled(pieces: Column) -> Column:
    """The pieces, with the names among them also found in the texts between."""
    named = F.filter(pieces, lambda p: F.coalesce(p["kind"].rlike("^(given|surname)"), F.lit(False)))
    names = F.array_sort(F.array_distinct(F.transform(named, lambda p: F.struct(p["kind"].alias("kind"), p["canonical"].alias("canonical")))))  # given names first
    either = F.array_join(F.array_distinct(F.transform(names, lambda n: n["canonical"])), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?=\p{Lu})(?iu:"), either, F.lit(r")(?![\p{L}\p{N}])"))
    literal = lambda g: _piece(F.lit(None), g, F.lit(None))
    kind_of = lambda h: F.filter(names, lambda n: n["canonical"] == F.lower(h))[0]["kind"]

    def apart(text: Column) -> Column:
        gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
        return F.flatten(F.zip_with(gaps, hits, lambda g, h: F.when(h.isNull(), F.array(literal(g))).otherwise(F.array(literal(g), _piece(kind_of(h), h, F.lower(h))))))

    spread = F.flatten(F.transform(pieces, lambda p: F.when(p["kind"].isNull() & (p["surface"] != ""), apart(p["surface"])).otherwise(F.array(p)))).cast(_PIECE)
    return F.when(F.size(named) > 0, spread).otherwise(pieces)


def _rendered(piece: Column, known: Column) -> Column:
    made = F.element_at(known, F.concat(piece["kind"], F.lit(":"), piece["canonical"]))
    chars = F.split(piece["surface"], "")
    sizes = F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.char_length(_digits(F.array_join(F.slice(chars, 1, i), ""))))
    digits = _digits(made)
    spaced = F.array_join(F.zip_with(chars, sizes, lambda c, n: F.when(c.rlike(r"\d"), digits.substr(n, F.lit(1))).otherwise(c)), "")
    upper = (piece["surface"] == F.upper(piece["surface"])) & (piece["surface"] != F.lower(piece["surface"])) & (F.char_length(piece["surface"]) > 1)
    return (
        F.when(piece["kind"].isNull(), piece["surface"])
        .when(piece["kind"].isin("phone", "card", "ssn"), spaced)
        .when(upper, F.upper(made))
        .otherwise(made)
    )


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """All columns of docs with text replaced, and `entities`: map of type to number of mentions.

    Null and empty texts stay as they are and have no entities. Repeated rows are replaced one by one, and alike.
    A column of docs named entities is replaced. Reruns with one key agree.
    """
    columns = [c for c in docs.columns if c != "entities"]
    others = [c for c in columns if c != "text"]
    text = F.col("text")
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    plain = docs.where(~hinted).select(*[F.col(f"`{c}`") for c in columns], nothing.alias("entities"))
    # the row stays in one column while others are added, so that its names can't clash with them
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_"))
    marked = docs.where(hinted).select(row.alias("row"), _pieces(text).alias("pieces"), F.monotonically_increasing_id().alias("uid"))
    marked = stage(marked.withColumn("pieces", _untitled(F.col("pieces"))), "pii-pieces")
    real = F.filter("pieces", lambda p: p["kind"].isNotNull())
    mentions = marked.select("uid", F.explode(F.array_distinct(F.transform(real, lambda p: F.struct(p["kind"].alias("kind"), p["canonical"].alias("canonical"))))).alias("e")).select("uid", "e.kind", "e.canonical")
    entities = stage(_with_gender(mentions.select("kind", "canonical").distinct()), "pii-genders")
    made = surrogates(entities.select(F.col("resolved").alias("kind"), "canonical").distinct(), key)
    table = entities.join(made.withColumnRenamed("kind", "resolved"), ["resolved", "canonical"]).select("kind", "canonical", "surrogate")
    known = (
        mentions.join(table, ["kind", "canonical"])
        .groupBy("uid")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "canonical"), "surrogate"))).alias("known"))
    )
    family = F.transform(real, lambda p: F.when(p["kind"].rlike("^(given|surname)"), "name").otherwise(p["kind"]))
    counts = F.map_filter(reduce(lambda a, b: F.map_concat(a, b), [F.create_map(F.lit(k), F.size(_equal(family, k))) for k in KINDS]), lambda _, n: n > 0)
    changed = (
        marked.join(known, "uid", "left")
        .select("row", F.array_join(F.transform("pieces", lambda p: _rendered(p, F.col("known"))), "").alias("new_text"), counts.alias("counts"))
        .select("row.*", F.col("new_text").alias("text"), F.col("counts").alias("entities"))
    )
    return plain.unionByName(changed.select(*[F.col(f"`{c}`") for c in columns], "entities"))


def _equal(values: Column, wanted: str) -> Column:
    return F.filter(values, lambda x: x == wanted)
