"""Accent and case folding for names and answers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Latin letters that decompose to an ASCII letter plus marks, with that letter (aligned strings)."""
    pairs = [(chr(code), unicodedata.normalize("NFKD", chr(code))) for code in range(0xC0, 0x250)]
    kept = [(marked, parts[0]) for marked, parts in pairs if len(parts) > 1 and parts[0].isascii()]
    return "".join(m for m, _ in kept), "".join(p for _, p in kept)


_MARKED, _PLAIN = _plain_letters()


ASCII_BLANKS = "\t\n\x0b\x0c\r "
#: What Unicode calls white space.
BLANKS = ASCII_BLANKS + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without blanks of any kind (no-break spaces, tabs, line ends) at either end; the long list only where it can matter."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.btrim(text, F.lit(ASCII_BLANKS))).otherwise(F.btrim(text, F.lit(BLANKS)))


def fold(text: Column) -> Column:
    """Lower case without accents (composed letters and stray combining marks); ASCII holds none."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.regexp_replace(F.lower(F.translate(text, _MARKED, _PLAIN)), r"\p{M}", ""))


def normalize_name(text: Column) -> Column:
    """`Cód. Cliente` → `cod_cliente`."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"[^\x00-\x7f]", ""), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_header(name: str) -> str:
    """Same rule as `normalize_name`, for column headers."""
    plain = unicodedata.normalize("NFKD", str(name)).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")
