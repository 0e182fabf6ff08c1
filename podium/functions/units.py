"""Unit spellings, conversion, and the unit words that only scale a value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fixed
from .text import _col, bind, clean, fixed_map


def _unit_map() -> Column:
    known = {}
    for canonical, dimension, factor, spellings in fixed.table(fixed.UNITS):
        entry = {"canonical": canonical, "dimension": dimension, "factor": float(factor), "known": True}
        known.update({spelling.strip(): entry for spelling in spellings.split(";")})
    return fixed_map(known, "struct<canonical:string,dimension:string,factor:double,known:boolean>")


def normalize_unit(c: Column | str) -> Column:
    """``struct(canonical, dimension, factor, known)``; blank means count, an unknown unit keeps its spelling."""
    def look_up(spelling: Column) -> Column:
        unknown = F.struct(spelling.alias("canonical"), F.lit("unknown").alias("dimension"), F.lit(1.0).alias("factor"),
                           F.lit(False).alias("known"))
        key = F.when(spelling == "", F.lit("count")).otherwise(spelling)
        return F.when(spelling.isNotNull(), F.coalesce(F.try_element_at(_unit_map(), key), unknown))

    return bind(F.regexp_replace(F.lower(clean(c)), r"\s*\.+$", ""), look_up)


def convert_unit(value: Column | str, source: Column | str, target: Column | str) -> Column:
    """Value in the target unit, or null where no conversion is defined.

    Both units must be known and share the canonical unit: a dimension alone is not enough, since dollars and
    euros (or barrels and litres) have no fixed ratio.
    """
    return convert_known(_col(value), normalize_unit(source), normalize_unit(target))


def convert_known(value: Column, a: Column, b: Column) -> Column:
    """As ``convert_unit`` for units that are already looked up."""
    defined = a["known"] & b["known"] & (a["dimension"] == b["dimension"]) & (a["canonical"] == b["canonical"])
    return F.when(defined, value * a["factor"] / b["factor"])


def unit_word(c: Column | str) -> Column:
    """``struct(base, multiplier)`` used to compare values given in words of scale; null counts as 'count'."""
    words = {}
    for base, multiplier, spellings in fixed.table(fixed.UNIT_WORDS):
        words.update({w.strip(): {"base": base, "multiplier": float(multiplier)} for w in spellings.split(";")})

    def look_up(text: Column) -> Column:
        as_is = F.struct(F.when(text == "", F.lit("count")).otherwise(text).alias("base"), F.lit(1.0).alias("multiplier"))
        return F.coalesce(F.try_element_at(fixed_map(words, "struct<base:string,multiplier:double>"), F.lower(text)), as_is)

    return bind(clean(F.coalesce(_col(c), F.lit("count"))), look_up)
