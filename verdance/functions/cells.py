"""Cells of text tables and answers of models, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean true and false.
TRUE_WORDS = ["true", "yes", "met", "meets", "satisfied", "1"]
FALSE_WORDS = ["false", "no", "not met", "not_met", "unmet", "does not meet", "0"]
#: First characters of a formula.
_RISKY = "^[=+\\-@\\t\\r]"


def neutralised(cell: Column) -> Column:
    """A cell that a spreadsheet can't take for a formula: one that starts with = + - @, tab or CR gets a quote before it."""
    return F.when(F.rlike(cell, F.lit(_RISKY)), F.concat(F.lit("'"), cell)).otherwise(cell)


def restored(cell: Column) -> Column:
    """What neutralised() was given."""
    return F.when(F.rlike(cell, F.lit("^'[=+\\-@\\t\\r]")), F.substring(cell, 2, F.length(cell))).otherwise(cell)


def without_mark(cell: Column) -> Column:
    """A cell without a leading byte order mark."""
    return F.regexp_replace(cell, "^\\uFEFF", "")


def answer_object(raw: Column) -> Column:
    """The JSON object of an answer, from its first { to its last }; NULL if there is none. Code fences go."""
    found = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x as a double between low and high; 0.5 if it is no number."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), 0.5).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), v)))


def as_boolean(word: Column) -> Column:
    """True or false of a word or number, NULL if it says neither."""
    w = F.lower(F.trim(word))
    n = w.try_cast("double")
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False).when(n.isNotNull(), n != 0)


def parsed_answer(raw: Column) -> Column:
    """struct(label, confidence, rationale) of an answer; label is NULL if it can't be told."""
    o = answer_object(raw)
    field = lambda name: F.get_json_object(o, f"$.{name}")
    return F.struct(as_boolean(field("label")).alias("label"), clamped(F.coalesce(field("confidence"), F.lit("0.5"))).alias("confidence"), field("rationale").alias("rationale"))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(p, F.lit("")) for p in parts)), 256)
