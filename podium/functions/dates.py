"""Date spellings as text: a date here is an ISO-like string, a frequency and a sortable number.

``DateType`` is not used on purpose: years below 0001, quarters and impossible days must survive.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fixed
from .text import _col, bind, clean, fixed_map, matched


_MONTH_STARTS = "".join(m[:3] for m in fixed.MONTHS)
_NAME = "(" + "|".join(m[:3] for m in fixed.MONTHS) + ")[a-z]{0,6}"
_YEAR, _MONTH, _TIME = r"(-?\d{1,5})", "(0?[1-9]|1[0-2])", "(?:[T ].*)?"

# One pattern for all spellings, in order of preference: full date, quarter, month in digits or by name, year. The
# time of day after a T or a space is ignored.
_SPELLING = (
    rf"(?s)^(?:{_YEAR}[-/.](\d{{1,2}})[-/.](\d{{1,2}}).*"
    rf"|{_YEAR}[-/ ]?[qQ]([1-4])|[qQ]([1-4])[-/ ]?{_YEAR}"
    rf"|{_YEAR}[-/.]{_MONTH}{_TIME}|{_MONTH}[-/.]{_YEAR}{_TIME}"
    rf"|(?i:{_NAME}[ ,\-]+{_YEAR}|{_YEAR}[ ,\-]+{_NAME})"
    rf"|{_YEAR}{_TIME})$")
# Groups outside the matching alternative are empty, so each field below is the one group that took part:
# year | month of a full date | day | quarter | month or month name.
_FIELDS = "$1$4$7$8$11$13$14$16|$2|$3|$5$6|$9$10$12$15"


def parse_date(c: Column | str) -> Column:
    """``struct(iso, frequency, sort_key)`` of a date spelling, or null.

    Full dates win over quarters, quarters over months, months over years. Full dates match as a prefix and
    their month and day are not range-checked (see ``is_calendar_date``). One regular expression runs per row.
    """
    fields = F.regexp_replace(F.translate(clean(c), "|", "!"), _SPELLING, _FIELDS)
    return F.when(_col(c).isNotNull(), bind(F.split(fields, r"\|"), _from_fields))


def _from_fields(fields: Column) -> Column:
    # Casts are guarded by what the pattern matched: a failing try_cast costs far more than the whole parse.
    def text(i: int) -> Column:
        return F.get(fields, F.lit(i))

    def whole(i: int) -> Column:
        return text(i).cast("int")

    year, quarter, month = whole(0), whole(3), text(4)
    named = F.floor((F.instr(F.lit(_MONTH_STARTS), F.lower(F.substring(month, 1, 3))) + 2) / 3).cast("int")
    month = F.when(month < "A", month.cast("int")).otherwise(named)

    def parsed(iso: Column, frequency: str, m: Column, d: Column) -> Column:
        key = (year.cast("bigint") * 10000 + m * 100 + d).cast("bigint")
        return F.struct(iso.alias("iso"), F.lit(frequency).alias("frequency"), key.alias("sort_key"))

    one = F.lit(1)
    return (F.when(F.size(fields) == 1, F.lit(None))
            .when(text(2) != "", parsed(F.format_string("%04d-%02d-%02d", year, whole(1), whole(2)), "daily", whole(1), whole(2)))
            .when(text(3) != "", parsed(F.format_string("%04d-Q%d", year, quarter), "quarterly", quarter * 3 - 2, one))
            .when(text(4) != "", parsed(F.format_string("%04d-%02d", year, month), "monthly", month, one))
            .otherwise(parsed(F.format_string("%04d-01-01", year), "annual", one, one)))


def frequency_of_hint(c: Column | str) -> Column:
    """Frequency named by a hint word, or null."""
    return F.try_element_at(fixed_map(fixed.FREQUENCY_HINTS), F.lower(clean(c)))


def is_calendar_date(c: Column | str) -> Column:
    """Whether a parsed daily spelling is a real calendar day; other frequencies are always real."""
    parsed = parse_date(c)
    day = F.try_to_timestamp(parsed["iso"], F.lit("yyyy-MM-dd"))
    return F.when(parsed["frequency"] == "daily", day.isNotNull()).otherwise(parsed.isNotNull())


def looks_like_date(c: Column | str) -> Column:
    return clean(c).rlike("^(" + "|".join(f"(?:{shape})" for shape in fixed.DATE_SHAPES) + ")$")


def infer_frequency(c: Column | str) -> Column:
    text = _col(c)
    return (F.when(text.rlike(r"^-?\d{1,5}-\d{2}-\d{2}"), F.lit("daily"))
            .when(text.rlike(r"^-?\d{1,5}-\d{2}$"), F.lit("monthly"))
            .when(text.rlike(r"(?i)^-?\d{1,5}-Q[1-4]$"), F.lit("quarterly"))
            .when(text.rlike(r"^-?\d{1,5}$"), F.lit("annual"))
            .otherwise(F.lit("unknown")))


def leading_year(c: Column | str) -> Column:
    """Signed year a date spelling starts with, or null."""
    return matched(clean(c), r"^(-?\d{1,5})", 1).cast("int")


def year_label(year: Column) -> Column:
    return F.when(year >= 0, year.cast("string")).otherwise(F.concat((-year).cast("string"), F.lit(" BC")))


def display_label(iso: Column | str, frequency: Column | str) -> Column:
    """2020, Q2 2020, 05/2020, 500 BC; anything else is shown as it is."""
    text, kind = _col(iso), _col(frequency)
    year = year_label(matched(text, r"^\s*(-?\d+)", 1).cast("bigint"))
    quarter, month = matched(text, r"Q(.+)$", 1), matched(text, r"^[^-/.]*[-/.](\d{2})(?:[-/.].*)?$", 1)
    return F.coalesce(
        F.when(kind == "annual", year)
        .when(kind == "quarterly", F.concat(F.lit("Q"), quarter, F.lit(" "), F.coalesce(year, F.lit(""))))
        .when(kind == "monthly", F.concat(month, F.lit("/"), F.coalesce(year, F.lit("")))),
        text)
