"""Names, keys, numbers in text, and rules that tag a line of text. All are built-in Column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed


#: Inside a character class: white space of any script, no-break spaces and the byte order mark included.
BLANK = r"\t-\r\x85\p{Z}\uFEFF"
#: The same as plain characters.
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` evaluated once per row.

    A Column used in several branches of a CASE is copied into each of them. For a chain of regular expressions
    that means running the chain again and again, and code too large for the JVM to compile. A lambda variable
    over a one-element array keeps one copy.
    """
    return F.get(F.transform(F.array(c), body), F.lit(0))


def fixed_map(entries: dict, value_type: str = "string") -> Column:
    """A constant map. As JSON text it is one small node while a plan is built; the optimizer turns it into a literal."""
    return F.from_json(F.lit(json.dumps(entries)), f"map<string,{value_type}>")


def clean(c: Column | str) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(_col(c), F.lit(BLANKS))


def squeeze(c: Column | str) -> Column:
    """Trimmed text with inner white space collapsed to one space."""
    return F.regexp_replace(clean(c), f"[{BLANK}]+", " ")


def matched(c: Column, pattern: str, group: int = 0) -> Column:
    """The matched group, or null (not an empty string) where the pattern is not found."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def norm_key(c: Column | str) -> Column:
    """Comparison key: lower-case letters and digits of any script, nothing else."""
    return F.lower(F.regexp_replace(_col(c), r"[^\p{IsAlphabetic}\p{N}]", ""))


def slugify(c: Column | str) -> Column:
    """Letters and digits of any script, lower-cased, with single dashes between words."""
    return F.lower(F.regexp_replace(F.regexp_replace(_col(c), r"[^\p{IsAlphabetic}\p{N}]+", "-"), r"^-|-$", ""))


def ascii_slug(c: Column | str) -> Column:
    """As ``slugify``, but only a-z and 0-9 survive."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def prefixed_slug(prefix: str, c: Column | str) -> Column:
    """``prefix_slug`` identifier."""
    return F.concat(F.lit(prefix + "_"), ascii_slug(c))


def strip_corporate_suffix(c: Column | str) -> Column:
    """Drop trailing company-form words; a name made only of them stays as it is."""
    forms = rf"(?:\s*\b(?:{fixed.CORPORATE_SUFFIXES})\.?)+$"
    return F.regexp_replace(squeeze(c), rf"(?i)^(?!{forms})(.*?){forms}", "$1")


def alias_name(c: Column | str) -> Column:
    """Display name after the alias table (62 fixed entries, folded into the plan as one literal map)."""
    return bind(squeeze(c), lambda name: F.coalesce(F.try_element_at(fixed_map(dict(fixed.table(fixed.ENTITY_ALIASES, " = "))), F.lower(name)), name))


def canonical_key(c: Column | str) -> Column:
    """Identity of an entity across sources: suffix stripped, aliased, ASCII slug."""
    return ascii_slug(alias_name(strip_corporate_suffix(c)))


def flag_emoji(c: Column | str) -> Column:
    """Two regional-indicator letters for a two-letter code, else null."""
    code = F.upper(_col(c))
    letters = [chr(0x41 + i) for i in range(26)]
    flags = fixed_map({a: chr(0x1F1E6 + i) for i, a in enumerate(letters)})
    emoji = F.concat(F.try_element_at(flags, F.substring(code, 1, 1)), F.try_element_at(flags, F.substring(code, 2, 1)))
    return F.when(code.rlike("^[A-Z]{2}$"), emoji)


def has_real_flag(c: Column | str) -> Column:
    code = F.upper(_col(c))
    return (F.length(code) == 2) & ~code.isin(*fixed.AGGREGATE_CODES)


# --- numbers ---------------------------------------------------------------------------------------------

def scaled_number(c: Column | str) -> Column:
    """``struct(value, unit_hint)`` of a number cell with scale words, currency and percent signs.

    The longest numeric prefix counts, as in ``12.5k``; a cell with no leading number has a null value.
    """
    cell = clean(c)
    marked = F.regexp_replace(F.translate(cell, "~" + fixed.CURRENCY_SIGNS + ",", "!"), f"[{BLANK}]+|%$", "")
    for power, words in fixed.NUMBER_SCALES:
        marked = F.regexp_replace(marked, f"(?i)({words})$", f"~{power}")
    marked = F.when(~cell.rlike("(?i)^n/?a$"), F.concat(marked, F.when(cell.endswith("%"), F.lit("%")).otherwise(F.lit(""))))

    def read(m: Column) -> Column:
        # Guarded, because a failing try_cast is very slow; the pattern admits numbers only.
        digits = F.regexp_extract(m, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
        number = bind(digits, lambda d: F.when(d != "", d.cast("double")))
        scale = F.lit(1.0)
        for power, _ in fixed.NUMBER_SCALES:
            scale = F.when(m.rlike(f"~{power}%?$"), F.lit(float(f"1e{power}"))).otherwise(scale)
        value = F.when(F.abs(number) < F.lit(float("inf")), number * scale)
        return F.struct(value.alias("value"), F.when(m.endswith("%") & number.isNotNull(), F.lit("percent")).alias("unit_hint"))

    return bind(marked, read)


def _fixed_digits(c: Column, digits: int) -> Column:
    """Decimal text of the exact binary value; an exact tie rounds away from zero.

    ``format_number`` works on the exact value but sends ties to the even digit. A double is an exact tie at d
    digits only when 2^(d+1) times it is an odd integer, and that product is exact.
    """
    steps = c * F.lit(float(2 ** (digits + 1)))
    tie = (steps == F.floor(steps)) & (F.abs(steps % 2) == 1)
    nudged = F.when(tie, c + F.signum(c) * F.lit(10.0 ** -(digits + 2))).otherwise(c)
    return F.replace(F.format_number(nudged, digits), F.lit(","), F.lit(""))


def compact_number(c: Column | str) -> Column:
    """1.21 B, 411.9 M, 259.7 K style."""
    v = _col(c).cast("double")
    size = F.abs(v)
    return (F.when(size >= 1e12, F.concat(_fixed_digits(v / 1e12, 2), F.lit(" T")))
            .when(size >= 1e9, F.concat(_fixed_digits(v / 1e9, 2), F.lit(" B")))
            .when(size >= 1e6, F.concat(_fixed_digits(v / 1e6, 1), F.lit(" M")))
            .when(size >= 1e3, F.concat(_fixed_digits(v / 1e3, 1), F.lit(" K")))
            .when(v == F.floor(v), F.floor(v).cast("string"))
            .otherwise(_fixed_digits(v, 2)))


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def format_value(c: Column | str, unit: Column | str) -> Column:
    v, u = _col(c).cast("double"), _col(unit)
    return (F.when(~_finite(v), F.lit("-"))
            .when(u == "percent", F.concat(_fixed_digits(v, 2), F.lit("%")))
            .otherwise(compact_number(v)))


def format_spec_value(c: Column | str, unit: Column | str) -> Column:
    """Short form used inside sentences: one decimal with M or K, else rounded, then the unit."""
    v, u = _col(c).cast("double"), F.coalesce(_col(unit), F.lit(""))
    size = F.abs(v)
    short = (F.when(size >= 1e6, F.concat(_fixed_digits(v / 1e6, 1), F.lit("M")))
             .when(size >= 1e3, F.concat(_fixed_digits(v / 1e3, 1), F.lit("K")))
             .otherwise(F.floor(v + 0.5).cast("string")))
    return (F.when(~_finite(v), F.lit("-"))
            .when(u == "percent", F.concat(_fixed_digits(v, 2), F.lit("%")))
            .when(u == "", short).otherwise(F.concat(short, F.lit(" "), u)))


# --- lists of names in a cell ------------------------------------------------------------------------------

def cell_names(c: Column | str) -> Column:
    """Distinct names inside a JSON list of objects; else the cell itself when it is a plain name."""
    # The name pattern never backtracks, so a long text cannot exhaust the stack of the regex engine.
    pattern = r'"name"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'

    def names(cell: Column) -> Column:
        found = F.transform(F.regexp_extract_all(cell, F.lit(pattern), F.lit(1)), lambda n: clean(F.replace(n, F.lit('\\"'), F.lit('"'))))
        kept = F.array_distinct(F.filter(found, lambda n: F.length(n) > 1))
        single = F.when(F.length(cell) > 1, F.array(cell)).otherwise(F.array().cast("array<string>"))
        return bind(kept, lambda k: F.when(F.size(k) >= 1, k).otherwise(single))

    return bind(clean(c), names)


# --- text taggers ------------------------------------------------------------------------------------------

def rank_direction(c: Column | str) -> Column:
    """'asc' when the text asks for the small end; words for the small end are looked for first."""
    return F.when(F.lower(_col(c)).rlike(rf"\b({fixed.SMALLEST_FIRST_WORDS})\b"), F.lit("asc")).otherwise(F.lit("desc"))


def topics(c: Column | str) -> Column:
    """Distinct topics of a text, in rule order."""
    text = _col(c)
    tags = [F.when(text.rlike("(?i)" + rule), F.lit(topic)) for topic, rule in fixed.TOPIC_WORDS]
    return F.array_distinct(F.array_compact(F.array(*tags)))


def year_range(c: Column | str) -> Column:
    """``struct(year_from, year_to)`` of "1990 to 2020", "500 BC - 100 AD"; swapped when reversed."""
    text = _col(c)
    rule = "(?i)" + fixed.YEAR_RANGE

    def year(number: int, era: int) -> Column:
        n = matched(text, rule, number).cast("int")
        return F.when(F.lower(F.regexp_extract(text, rule, era)).isin("bc", "bce"), -n).otherwise(n)

    first, second = year(1, 2), year(3, 4)
    low, high = F.least(first, second), F.greatest(first, second)
    usable = (low >= -20000) & (high <= 2100)
    return F.when(usable, F.struct(low.alias("year_from"), high.alias("year_to")))


def top_n_wanted(c: Column | str, default: int = 10) -> Column:
    n = matched(_col(c), r"(?i)top\s*(\d{1,3})", 1).cast("int")
    return F.when(n.isNull(), F.lit(default)).otherwise(F.least(F.lit(30), F.greatest(F.lit(3), n)))


def month_day_hint(c: Column | str) -> Column:
    """Month and day ("0615") named in a text as 20240615 or "June 15"; "0101" when there is none."""
    text = _col(c)
    stamp = matched(text, r"\b(?:19|20)\d{2}(\d{4})\b", 1)
    stamp = F.when(stamp.rlike(r"^(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"), stamp)
    rule = rf"(?i)\b({'|'.join(fixed.MONTHS)})\s+(\d{{1,2}})\b"
    number = fixed_map({m: f"{i + 1:02d}" for i, m in enumerate(fixed.MONTHS)})
    named = F.concat(F.try_element_at(number, F.lower(matched(text, rule, 1))), F.lpad(matched(text, rule, 2), 2, "0"))
    return F.coalesce(stamp, named, F.lit("0101"))


def _first_unit(rules, text: Column) -> Column:
    unit = F.lit("count")
    for name, words in reversed(rules):
        unit = F.when(text.rlike(words), F.lit(name)).otherwise(unit)
    return unit


def table_unit(headers: Column | str, topic: Column | str, given: Column | None = None) -> Column:
    """Unit of a table: the given one, else the first rule that its headers or topic meet, else count."""
    text = F.lower(F.concat_ws(" ", _col(headers), _col(topic)))
    guessed = _first_unit(fixed.TABLE_UNIT_WORDS, text)
    return guessed if given is None else F.coalesce(F.nullif(given, F.lit("")), guessed)


def fetched_table_unit(headers: Column | str, topic: Column | str) -> Column:
    """Unit of a directly fetched table; headers and topic have their own word lists."""
    heads, about = F.lower(_col(headers)), F.lower(_col(topic))
    unit = F.lit("count")
    for name, head_words, topic_words in reversed(fixed.FETCHED_UNIT_WORDS):
        hit = heads.rlike(head_words) if topic_words is None else heads.rlike(head_words) | about.rlike(topic_words)
        unit = F.when(hit, F.lit(name)).otherwise(unit)
    return unit


def indicator_unit(name: Column | str) -> Column:
    return _first_unit(fixed.INDICATOR_UNIT_WORDS, F.lower(_col(name)))


# --- hashing -------------------------------------------------------------------------------------------------

def content_hash(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def record_hash(*cols: Column | str) -> Column:
    """Hash of a record from its columns in the given order; null and empty differ, and so do shifted cells."""
    cells = [F.coalesce(F.concat(F.length(_col(c).cast("string")).cast("string"), F.lit(":"), _col(c).cast("string")),
                        F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws("|", *cells).cast("binary"), 256)


def dataset_hash(df: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, hash): a hash of a table that its order and partitioning do not change; repeated rows count.

    Sixty bits at a time of the row hashes are added up, so tasks combine their rows before the shuffle.
    """
    row = record_hash(*columns)
    parts = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(4)]
    sums = df.select(row.alias("_h")).agg(F.count("*").alias("rows"), *parts)
    return sums.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(f"s{i}", F.lit("0")) for i in range(4)]), 256).alias("hash"))
