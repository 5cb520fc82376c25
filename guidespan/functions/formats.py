"""Values as text, and text as values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fixed(value: Column, decimals: int = 2) -> Column:
    """A real number with so many decimals (never minus zero), NaN and infinities by name, null as the empty text."""
    text = F.format_string(f"%.{decimals}f", F.round(value, decimals) + 0.0)
    text = F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise(F.regexp_replace(text, r"^-(0(?:\.0*)?)$", "$1"))
    return F.coalesce(text, F.lit(""))


def shown(rows: DataFrame, decimals: int = 2) -> DataFrame:
    """All columns as text: real numbers with fixed decimals, whole numbers and labels as they are, truth values capitalised, null empty."""

    def one(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return fixed(c, decimals)
        if isinstance(field.dataType, T.BooleanType):
            return F.coalesce(F.initcap(c.cast("string")), F.lit(""))
        return F.coalesce(c.cast("string"), F.lit(""))

    return rows.select(*(one(f).alias(f.name) for f in rows.schema.fields))


def decimal_text(text: Column, decimals: int = 2) -> Column:
    """A text that reads as a decimal number with fixed decimals; whole numbers (ids with leading zeros) and other texts as they are."""
    real = F.trim(text).rlike(r"^[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+[eE][+-]?[0-9]+|[0-9]+\.[0-9]*[eE][+-]?[0-9]+)$")
    return F.when(real, fixed(F.trim(text).try_cast("double"), decimals)).otherwise(text)


def truth(text: Column) -> Column:
    """True, false or null of a text in one of the usual spellings."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("1", "true", "yes", "y", "on"), True).when(low.isin("0", "false", "no", "n", "off"), False)


def number(text: Column, kind: str = "double") -> Column:
    """A finite number of a text, null if it is none."""
    value = F.trim(text).try_cast(kind)
    return F.when(~(F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf"))), value)


def slug(text: Column, blank: str = "unnamed") -> Column:
    """Letters, digits, dots, dashes and underscores; runs of anything else become one underscore, none at the ends."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.trim(text), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(blank))


def is_fallback(model: Column) -> Column:
    """Whether a model's name says that it stood in for another one."""
    low = F.lower(F.coalesce(model, F.lit("")))
    return low.contains("fallback") | low.contains("heuristic") | low.endswith("_bias") | (low == "nuc_features")


def is_reference_only(model: Column) -> Column:
    return F.lower(F.coalesce(model, F.lit(""))).endswith("_reference_only")


def places_json(places: Column, text_ids: bool = False) -> Column:
    """A JSON list of [sequence, strand, place] from an array of (seq_id, strand, start)."""
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x.cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
    one = lambda p: F.concat(F.lit("["), quoted(p["seq_id"]) if text_ids else p["seq_id"].cast("string"), F.lit(", "), quoted(p["strand"]), F.lit(", "), p["start"].cast("string"), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(places, one), ", "), F.lit("]"))


def places_of(text: Column) -> Column:
    """The array of (seq_id, strand, start) of such a list; entries of fewer than three values, and text that is no list, give none."""
    lists = F.coalesce(F.from_json(text, "array<array<string>>"), F.array().cast("array<array<string>>"))
    whole = F.filter(lists, lambda p: F.size(p) >= 3)
    return F.transform(whole, lambda p: F.struct(p[0].alias("seq_id"), p[1].alias("strand"), p[2].try_cast("long").alias("start")))
