"""Text expressions that stay inside the JVM, and the two Unicode functions that need Arrow batches.

Every function takes and gives Columns; null gives null.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = r"\s\x1c-\x1f\x85\p{Z}"
ENDS = f"^[{BLANK}]+|[{BLANK}]+$"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
UNIT_SEPARATOR = "\x1f"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else t.casefold())


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(c, ENDS, "")


def nfc(c: Column) -> Column:
    """Canonical composition. Texts below U+0300 are composed already and don't leave the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x{2FF}]"), c)), c)


def casefold(c: Column) -> Column:
    """Full case folding; plain ASCII doesn't leave the JVM."""
    return F.coalesce(_casefold(F.when(c.rlike(r"[^\x00-\x7f]"), c)), F.lower(c))


def unify_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def plain_blanks(c: Column) -> Column:
    """No-break spaces become spaces; soft hyphens go."""
    return F.translate(c, " ­", " ")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def stripped_lines(c: Column) -> Column:
    """Lines with runs of horizontal white space collapsed and their ends stripped."""
    return F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, "[\\t\\x0b\\x0c ]+", " ")))


def horizontal_runs(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[\\t\\x0b\\x0c ]+"))


def join_lines(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def compact_lines(lines: Column) -> Column:
    """Runs of empty lines become one; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def match_key(c: Column) -> Column:
    """Lower case, marks as blanks, blanks collapsed: for comparing recognised with native text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}_\s]", " "), r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """Of two match keys: 0 if one is empty, 1 if equal or one contains the other, else the Jaccard index of words."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when((a == b) | F.contains(a, b) | F.contains(b, a), F.lit(1.0)).otherwise(jaccard)


def graphemes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("\\X"), F.lit(0))


def graph_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("\\X"))


#: Letters that only Kazakh uses among the languages told apart by script.
KAZAKH = "ӘәҒғҚқҢңӨөҰұҮүҺһІі"


def script_languages(c: Column) -> Column:
    """kk for Kazakh letters, else ru for Cyrillic; en for Latin; und if there are none."""
    kk, cyr, lat = c.rlike(f"[{KAZAKH}]"), c.rlike(f"[А-Яа-яЁё{KAZAKH}]"), c.rlike("[A-Za-z]")
    found = F.array_compact(F.array(F.when(kk, "kk").when(cyr, "ru"), F.when(lat, "en")))
    return F.when(F.size(found) == 0, F.array(F.lit("und"))).otherwise(found)

