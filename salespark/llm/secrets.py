"""Secret scans: fixed patterns, and sliding-window entropy per character class over candidate strings.

Everything happens inside the row with built-in functions: no shuffle, no Python. Positions of matches come from
the texts between them, so whole texts are read once by each pattern that a cheap test finds in them.

A candidate is a run of at least `WINDOW` characters of one class. A window of that width slides over it; the
counts of its characters are kept up to date by one arrival and one departure, and so is the sum of c*log2(c),
from which the entropy follows. Counts are five bits each, packed into a few integers, so a step costs the same
wherever it is and a run takes time in proportion to its length. Overlapping windows that look like secrets form one
span. The allow list works on parts: a public form inside a candidate (example words, alphabets, UUIDs) breaks it there and
the rest is still scanned.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespark.llm.common import running_starts

#: Contract patterns. The parts of `hex` and `access` that fail on length can be left to the pattern itself: a
#: run that is too short contains no longer match. An assignment that fails still uses up its characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)password|passwd|secret|token|api_?key"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
SHORTEST_VALUE = 8

WINDOW = 20
UPPERS, LOWERS, DIGITS, SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/=_-"
#: name, alphabet as characters, as pattern, least entropy in bits of a window of 20.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", "[0-9a-fA-F]", 3.0),
    ("entropy_base64", UPPERS + LOWERS + DIGITS + SIGNS, "[A-Za-z0-9+/=_-]", 3.8),
)
#: Forms that no window may touch, and their lengths.
ALLOWED = (
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", 36),
    (r"(?i)0123456789abcdef", 16),
    (r"(?i)abcdefghijklmnop", 16),
    (r"(?i)placeholder", 11),
    (r"(?i)example", 7),
    (r"(?i)changeme", 8),
    (r"(?i)sample", 6),
    (r"(?i)x{8}", 8),
    (r"0{12}", 12),
)
#: Words, numbers and paths have high entropies too. A window needs letters, and a digit or this many letters of
#: either case; one with signs (paths, names with dashes) needs a digit and this many of either case.
EITHER_CASE, EITHER_CASE_WITH_SIGNS = 5, 3
KINDS = ("assign", "access", "hex", *[name for name, *_ in CLASSES])


def _located(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, rank, end, kind, hit>> of the leftmost non-overlapping matches."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(F.char_length(g).cast("long").alias("gap"), h.alias("hit")))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())
    before = running_starts(F.transform(pairs, lambda p: p["gap"] + F.char_length(p["hit"])))
    return F.zip_with(
        pairs, before,
        lambda p, b: F.struct(
            (b + p["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
            (b + p["gap"] + F.char_length(p["hit"])).alias("end"), F.lit(kind).alias("kind"), p["hit"].alias("hit"),
        ),
    )


_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(_SPAN)


def _base(text: Column, pattern: str, kind: str, hint: str) -> Column:
    found = _located(text, pattern, kind)
    if kind == "assign":
        found = F.filter(found, lambda s: F.char_length(F.regexp_extract(s["hit"], pattern, 2)) >= SHORTEST_VALUE)
    return F.when(text.rlike(hint), _plain(found)).otherwise(F.array().cast(_SPAN))


def _entropy_spans(text: Column, name: str, alphabet: str, pattern: str, least: float) -> Column:
    runs = _located(text, f"{pattern}{{{WINDOW},}}", name)
    spans = F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                _slide(r["hit"], alphabet, least),
                lambda s: F.struct((r["start"] + s["start"]).alias("start"), r["rank"].alias("rank"), (r["start"] + s["end"]).alias("end"), r["kind"].alias("kind")),
            ),
        )
    )
    return F.when(text.rlike(f"{pattern}{{{WINDOW}}}"), spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _masked(run: Column) -> Column:
    """The run with blanks in place of allowed forms."""
    return reduce(lambda text, form: F.regexp_replace(text, form[0], " " * form[1]), ALLOWED, run)


_BITS, _PER_WORD = 5, 12  # counts up to 20, twelve to a 64-bit integer


def _slide(run: Column, alphabet: str, least: float) -> Column:
    places = [alphabet.find(chr(i)) for i in range(128)]
    by_ascii = F.array(*[F.lit(place if place >= 0 else None).cast("int") for place in places])
    words = -(-len(alphabet) // _PER_WORD)  # the integer after these counts upper and lower case, digits and signs
    table = lambda of, kind="int": F.array(*[F.lit(of(i)).cast(kind) for i in range(len(alphabet))])
    word_of, shift_of = table(lambda i: i // _PER_WORD), table(lambda i: _BITS * (i % _PER_WORD))
    unit_of = table(lambda i: 1 << _BITS * (i % _PER_WORD), "long")
    kind_of = table(lambda i: 1 << _BITS * next(k for k, of in enumerate((UPPERS, LOWERS, DIGITS, SIGNS)) if alphabet[i] in of), "long")
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    limit = WINDOW * (math.log2(WINDOW) - least) + 1e-9  # entropy >= least, as a bound on the sum of c*log2(c)
    none, span = F.lit(-1).cast("long"), "array<struct<start:bigint,end:bigint>>"
    zeros = F.array_repeat(F.lit(0).cast("long"), words + 1)

    def part(word: Column, shift) -> Column:
        shifted = F.call_function("shiftright", word, shift if isinstance(shift, Column) else F.lit(shift))
        return shifted.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

    def count(counts: Column, symbol: Column) -> Column:
        return part(F.get(counts, F.get(word_of, symbol)), F.get(shift_of, symbol))

    def change(symbol: Column, word: Column) -> Column:
        """What one more of the symbol adds to the integer of that number."""
        return F.when(F.get(word_of, symbol) == word, F.get(unit_of, symbol)).when(word == words, F.get(kind_of, symbol)).otherwise(F.lit(0).cast("long"))

    def slid(s: Column, p: Column) -> Column:
        """counts, sum and the number of characters since the last blank, after the next character."""
        come, gone = p["come"], F.when(s["clean"] >= WINDOW, p["gone"])
        moved = F.transform(s["counts"], lambda c, i: c + change(come, i) - F.when(gone.isNotNull(), change(gone, i)).otherwise(F.lit(0).cast("long")))
        more = F.get(terms, count(s["counts"], come) + 1) - F.get(terms, count(s["counts"], come))
        less = F.get(terms, count(s["counts"], gone) - 1) - F.get(terms, count(s["counts"], gone))
        delta = F.when(come.eqNullSafe(gone), F.lit(0.0)).otherwise(more + F.coalesce(less, F.lit(0.0)))
        broken = come.isNull()
        return F.struct(
            F.when(broken, zeros).otherwise(moved).alias("counts"), F.when(broken, F.lit(0.0)).otherwise(s["sum"] + delta).alias("sum"),
            F.when(broken, F.lit(0).cast("long")).otherwise(s["clean"] + 1).alias("clean"), (s["at"] + 1).alias("at"),
            s["from"].alias("from"), s["upto"].alias("upto"), s["found"].alias("found"),
        )

    def told(t: Column) -> Column:
        kinds = F.get(t["counts"], F.lit(words))
        upper, lower, digits, signs = (part(kinds, _BITS * k) for k in range(4))
        cased = lambda n: (upper >= n) & (lower >= n)
        telling = F.when(signs > 0, (digits > 0) & cased(EITHER_CASE_WITH_SIGNS)).otherwise((digits > 0) | cased(EITHER_CASE))
        hit = (t["clean"] >= WINDOW) & (t["sum"] <= limit) & (upper + lower > 0) & telling
        return F.struct(t["counts"].alias("counts"), t["sum"].alias("sum"), t["clean"].alias("clean"), t["at"].alias("at"), t["from"].alias("from"), t["upto"].alias("upto"), t["found"].alias("found"), hit.alias("hit"))

    def spanned(t: Column) -> Column:
        """An open span grows or is put away before the next one opens."""
        start, apart = t["at"] - WINDOW, t["upto"] < t["at"] - WINDOW
        closed = F.concat(t["found"], F.array(F.struct(t["from"].alias("start"), t["upto"].alias("end"))).cast(span))
        fresh = t["hit"] & ((t["from"] < 0) | apart)
        return F.struct(
            t["counts"].alias("counts"), t["sum"].alias("sum"), t["clean"].alias("clean"), t["at"].alias("at"),
            F.when(fresh, start).otherwise(t["from"]).alias("from"), F.when(t["hit"], t["at"]).otherwise(t["upto"]).alias("upto"),
            F.when(fresh & (t["from"] >= 0), closed).otherwise(t["found"]).alias("found"),
        )

    # a transform over an array of one names a value, so that it is computed once
    named = lambda value, use: F.transform(F.array(value), use)[0]
    step = lambda s, p: named(named(slid(s, p), told), spanned)
    start = F.struct(
        zeros.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("clean"), F.lit(0).cast("long").alias("at"),
        none.alias("from"), none.alias("upto"), F.array().cast(span).alias("found"),
    )
    finish = lambda s: F.when(s["from"] < 0, s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(s["from"].alias("start"), s["upto"].alias("end"))).cast(span)))
    codes = F.transform(F.split(_masked(run), ""), lambda c: F.get(by_ascii, F.ascii(c)))
    later = lambda c: F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), c), F.lit(1), F.size(c))
    pairs = lambda c: F.zip_with(c, later(c), lambda a, b: F.struct(a.alias("come"), b.alias("gone")))
    return named(codes, lambda c: F.aggregate(pairs(c), start, step, finish))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans, found.

    `spans` lists kind:start:end (code points, end exclusive) of all spans, base and entropy ones; `found` has them
    as structs. Null and empty texts have no spans; repeated rows are answered one by one; columns other than
    doc_id and text are ignored. Spans of different kinds may overlap.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs.select(
        "doc_id",
        _base(text, ASSIGN, "assign", ASSIGN_HINT).alias("assign"),
        _base(text, ACCESS, "access", ACCESS).alias("access"),
        _base(text, HEX, "hex", HEX).alias("hex"),
        F.concat(*[_entropy_spans(text, *of) for of in CLASSES]).alias("entropy"),
    )
    base = F.concat("assign", "access", "hex")
    return based.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex", "entropy")],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, "entropy")).alias("spans"),
        F.array_sort(F.concat(base, "entropy")).alias("found"),
    )
