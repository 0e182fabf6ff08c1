"""Observation tables derived from the given tables, in Spark and, for the oracles, in SQL.

Money is summed in whole cents so that the order of addition cannot change a value. ``ord`` is always a data key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cents(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("bigint")


def dollars(total: Column) -> Column:
    return total.cast("double") / F.lit(100.0)


def pick(k: Column, *options) -> Column:
    """The option at ``k mod n``."""
    values = [o if isinstance(o, Column) else F.lit(o) for o in options]
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(k % len(values) == i, v).otherwise(out)
    return out


def sql_pick(k: str, *options: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"(CASE {k} % {len(options)} {cases} END)"


# --- orders as raw observations: many rows per (customer, month) ------------------------------------------------

def obs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as_obs(load(spark, sf_dir, "orders"))


def orders_as_obs(o: DataFrame) -> DataFrame:
    return o.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("entity"),
        F.date_format("o_orderdate", "yyyy-MM").alias("date"), F.col("o_totalprice").alias("value"),
        F.when(F.col("o_orderstatus") == "F", F.lit("VERIFIED")).when(F.col("o_orderstatus") == "P", F.lit("ESTIMATED"))
        .otherwise(F.lit("SUPPORTED")).alias("status"), F.lit("USD").alias("unit"))


OBS_ORDERS = """obs AS (SELECT o_orderkey AS ord, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS entity,
  'customer-' || lpad(o_custkey::VARCHAR, 9, '0') AS entity_id, strftime(o_orderdate, '%Y-%m') AS date,
  strftime(o_orderdate, '%m/%Y') AS label,
  (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + 1)::BIGINT AS sort_key, o_totalprice AS value,
  CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'P' THEN 'ESTIMATED' ELSE 'SUPPORTED' END AS status, 'USD' AS unit
  FROM orders)"""


# --- revenue per nation and month: dense --------------------------------------------------------------------------

def obs_nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("c"))
    per_order = line.groupBy("l_orderkey").agg(F.sum("c").alias("c"))  # shares its shuffle with the join below
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("date"))
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sales = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    totals = sales.groupBy("c_nationkey", "date").agg(F.sum("c").alias("c"))
    rows = totals.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    ord_ = F.col("n_nationkey").cast("bigint") * 1000000 + F.replace("date", F.lit("-")).cast("bigint")
    return rows.select(ord_.alias("ord"), F.col("n_name").alias("entity"), "date", dollars(F.col("c")).alias("value"))


OBS_NATION_MONTH = """obs AS (SELECT n_nationkey::BIGINT * 1000000 + (year(o_orderdate) * 100 + month(o_orderdate)) AS ord,
  n_name AS entity, lower(replace(n_name, '_', '-')) AS entity_id, strftime(o_orderdate, '%Y-%m') AS date,
  strftime(o_orderdate, '%m/%Y') AS label, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + 1)::BIGINT AS sort_key,
  sum(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5)::BIGINT)::DOUBLE / 100.0::DOUBLE AS value, 'SUPPORTED' AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


# --- activity per user and day: with gaps ---------------------------------------------------------------------------

def obs_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    days = e.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(
        F.min("event_id").alias("ord"), F.sum(cents(F.col("value"))).alias("c"))
    return days.select("ord", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("entity"), "date", dollars(F.col("c")).alias("value"))


OBS_USER_DAY = """obs AS (SELECT min(event_id) AS ord, 'user ' || user_id AS entity, 'user-' || user_id AS entity_id,
  strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%d') AS label,
  (year(ts) * 10000 + month(ts) * 100 + day(ts))::BIGINT AS sort_key,
  sum(floor(value * 100 + 0.5)::BIGINT)::DOUBLE / 100.0::DOUBLE AS value, 'SUPPORTED' AS status
  FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d'), sort_key)"""


# --- three publishers on the same cells ---------------------------------------------------------------------------------

def obs_publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly order totals per nation as told by A (dollars), B (millions, off by 0..9 %), and A once more on another page."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), cents(F.col("o_totalprice")).alias("c"))
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    totals = (orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "y").agg(F.sum("c").alias("c"))
              .join(nations, F.col("c_nationkey") == F.col("n_nationkey")))
    k = F.col("n_nationkey") + F.col("y")
    total = F.col("c").cast("double") / F.lit(100.0)
    gone = F.lit(None).cast("double")

    def told(source, url, value, unit, confidence, name):
        return F.struct(F.lit(source).alias("source"), F.lit(url).alias("source_url"), value.alias("value"),
                        F.lit(unit).alias("unit"), F.lit(confidence).alias("confidence"), name.alias("entity"))

    voices = F.array(
        told("Ledger A", "https://www.a.test/1", F.when(k % 13 != 0, total).otherwise(gone), "count", 0.8, F.col("n_name")),
        told("Ledger B", "https://b.test/x", F.when(k % 5 != 4, total * (F.lit(1.0) + (k % 4) * F.lit(0.03)) / F.lit(1000000.0)).otherwise(gone),
             "million", 0.7, F.concat(F.col("n_name"), F.lit(" Inc."))),
        told("ledger a", "https://a.test/2", F.when(k % 3 == 0, total * F.lit(1.2)).otherwise(gone), "count", 0.6, F.upper("n_name")))
    rows = totals.select("n_nationkey", "y", F.posexplode(voices).alias("p", "v"))
    ord_ = (F.col("n_nationkey").cast("bigint") * 10000 + F.col("y")) * 10 + F.col("p")
    kept = (F.col("p") != 2) | F.col("v.value").isNotNull()
    status = F.when(F.col("v.value").isNull(), F.lit("UNKNOWN")).otherwise(F.lit("SUPPORTED"))
    return rows.filter(kept).select(ord_.alias("ord"), "v.entity", F.lower(F.col("v.entity")).alias("entity_id"),
                                    F.col("y").cast("string").alias("date"), "v.value", "v.unit", status.alias("status"),
                                    "v.confidence", "v.source", "v.source_url")


OBS_PUBLISHERS = """totals AS (SELECT n_nationkey, n_name, year(o_orderdate) AS y, n_nationkey + year(o_orderdate) AS k,
   sum(floor(o_totalprice * 100 + 0.5)::BIGINT)::DOUBLE / 100.0::DOUBLE AS total
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
 obs AS (
  SELECT (n_nationkey::BIGINT * 10000 + y) * 10 AS ord, n_name AS entity, y::VARCHAR AS date, 'Ledger A' AS source,
    'https://www.a.test/1' AS source_url, CASE WHEN k % 13 <> 0 THEN total END AS value, 'count' AS unit, 0.8::DOUBLE AS confidence,
    'count' AS base_unit, 1::DOUBLE AS mult, 'ledger a||a.test' AS pub, lower(replace(n_name, '_', '-')) AS canonical FROM totals
  UNION ALL
  SELECT (n_nationkey::BIGINT * 10000 + y) * 10 + 1, n_name || ' Inc.', y::VARCHAR, 'Ledger B', 'https://b.test/x',
    CASE WHEN k % 5 <> 4 THEN total * (1::DOUBLE + (k % 4) * 0.03::DOUBLE) / 1000000::DOUBLE END, 'million', 0.7::DOUBLE, 'count',
    1000000::DOUBLE, 'ledger b||b.test', lower(replace(n_name, '_', '-')) FROM totals
  UNION ALL
  SELECT (n_nationkey::BIGINT * 10000 + y) * 10 + 2, upper(n_name), y::VARCHAR, 'ledger a', 'https://a.test/2', total * 1.2::DOUBLE,
    'count', 0.6::DOUBLE, 'count', 1::DOUBLE, 'ledger a||a.test', lower(replace(n_name, '_', '-')) FROM totals WHERE k % 3 = 0),
 obs_s AS (SELECT *, CASE WHEN value IS NULL THEN 'UNKNOWN' ELSE 'SUPPORTED' END AS status FROM obs)"""


# --- untidy rows: spellings of names, dates, numbers, units, addresses -------------------------------------------------

def obs_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    year, quarter = F.date_format(d, "yyyy"), F.quarter(d).cast("string")
    name = pick(k, "USA", "United States of America", "Deutschland", "Nokia Corp.", "\u00a0Côte \u00a0d'Ivoire\ufeff", "World",
                F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" Co., Ltd.")))
    date = pick(k, F.concat(F.lit("\u00a0"), year), F.date_format(d, "yyyy-MM"), F.concat(F.lit("Q"), quarter, F.lit(" "), year), F.date_format(d, "MM/yyyy"),
                F.date_format(d, "MMM yyyy"), F.date_format(d, "yyyy MMM"), F.date_format(d, "yyyy-MM-dd"),
                F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00")), "n.d.", F.concat(year, F.lit("-Q"), quarter))
    whole, tenth = (k % 9973).cast("string"), (k % 10).cast("string")
    number = F.concat(whole, F.lit("."), tenth)
    cell = pick(k, F.concat(number, F.lit("M")), F.concat(F.lit("$"), number, F.lit("bn")), F.concat(number, F.lit("%")), "n/a",
                F.concat(F.lit("1\u00a0"), F.lpad(tenth, 3, "2")), F.concat(number, F.lit(" million")), F.concat(F.lit("-"), number), "", "unknown",
                F.concat(F.lit("€"), whole, F.lit(",000")), F.concat(number, F.lit("k")))
    value = F.when(k % 17 != 3, F.when(k % 13 == 5, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
    unit = pick(k, "million", "USD", "%", "count", "kg", "furlongs", "people", " Tonnes. ", "", F.lit(None).cast("string"), "mi")
    source = pick(k, "Ledger A", " ledger a", "Ledger B", F.lit(None).cast("string"), "Ledger C")
    url = pick(k, F.concat(F.lit("https://www.a.test/p?utm_source=x&id="), (k % 50).cast("string"), F.lit("#top")),
               F.concat(F.lit("http://B.test/q/"), (k % 40).cast("string"), F.lit("/")), F.lit(None).cast("string"), "ftp://c.test/z", "upload:file-1",
               F.concat(F.lit("https://data.gov/"), (k % 30).cast("string"), F.lit("?ref=y&b=2")), "not a url")
    status = pick(k, "VERIFIED", "SUPPORTED", "ESTIMATED", "UNKNOWN", "CONFLICTING", "REJECTED", "forecast", F.lit(None).cast("string"))
    blank = F.lit(" ")
    return o.select(k.alias("ord"), F.when(k % 97 == 0, blank).otherwise(name).alias("entity"),
                    F.when(k % 89 == 0, blank).otherwise(date).alias("date"), value.alias("value"), cell.alias("cell"),
                    unit.alias("unit"), source.alias("source"), url.alias("source_url"), status.alias("status"))


_Y, _Q = "strftime(o_orderdate, '%Y')", "quarter(o_orderdate)"
_NUM = "((o_orderkey % 9973) || '.' || (o_orderkey % 10))"
OBS_DIRTY = f"""obs AS (SELECT o_orderkey AS ord,
  CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE {sql_pick('o_orderkey', "'USA'", "'United States of America'", "'Deutschland'", "'Nokia Corp.'",
  "chr(160) || 'Côte ' || chr(160) || 'd''Ivoire' || chr(65279)", "'World'", "'Customer ' || o_custkey || ' Co., Ltd.'")} END AS entity,
  CASE WHEN o_orderkey % 89 = 0 THEN ' ' ELSE {sql_pick('o_orderkey', f"chr(160) || {_Y}", "strftime(o_orderdate, '%Y-%m')", f"'Q' || {_Q} || ' ' || {_Y}",
  "strftime(o_orderdate, '%m/%Y')", "strftime(o_orderdate, '%b %Y')", "strftime(o_orderdate, '%Y %b')", "strftime(o_orderdate, '%Y-%m-%d')",
  "strftime(o_orderdate, '%Y-%m-%d') || 'T10:00'", "'n.d.'", f"{_Y} || '-Q' || {_Q}")} END AS date,
  CASE WHEN o_orderkey % 17 <> 3 THEN CASE WHEN o_orderkey % 13 = 5 THEN -o_totalprice ELSE o_totalprice END END AS value,
  {sql_pick('o_orderkey', f"{_NUM} || 'M'", f"'$' || {_NUM} || 'bn'", f"{_NUM} || '%'", "'n/a'", "'1' || chr(160) || '22' || (o_orderkey % 10)", f"{_NUM} || ' million'",
  f"'-' || {_NUM}", "''", "'unknown'", "'€' || (o_orderkey % 9973) || ',000'", f"{_NUM} || 'k'")} AS cell,
  {sql_pick('o_orderkey', "'million'", "'USD'", "'%'", "'count'", "'kg'", "'furlongs'", "'people'", "' Tonnes. '", "''", "NULL", "'mi'")} AS unit,
  {sql_pick('o_orderkey', "'Ledger A'", "' ledger a'", "'Ledger B'", "NULL", "'Ledger C'")} AS source,
  {sql_pick('o_orderkey', "'https://www.a.test/p?utm_source=x&id=' || (o_orderkey % 50) || '#top'", "'http://B.test/q/' || (o_orderkey % 40) || '/'",
  "NULL", "'ftp://c.test/z'", "'upload:file-1'", "'https://data.gov/' || (o_orderkey % 30) || '?ref=y&b=2'", "'not a url'")} AS source_url,
  {sql_pick('o_orderkey', "'VERIFIED'", "'SUPPORTED'", "'ESTIMATED'", "'UNKNOWN'", "'CONFLICTING'", "'REJECTED'", "'forecast'", "NULL")} AS status
  FROM orders)"""


# --- wide and transposed tables -----------------------------------------------------------------------------------------

YEARS = [str(y) for y in range(1995, 2002)]


def wide_nation_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation | 1995 | ... | 2001 as text cells; every seventh cell is a dash."""
    obs = obs_publishers(spark, sf_dir).filter("source = 'Ledger A'")
    key = F.floor(F.col("ord") / 10)
    cell = F.when(key % 7 == 0, F.lit("-")).otherwise(F.floor("value").cast("bigint").cast("string"))
    return obs.select("entity", "date", cell.alias("cell")).groupBy(F.col("entity").alias("country")).pivot("date", YEARS).agg(F.first("cell"))


WIDE_CELLS = OBS_PUBLISHERS + """, cells AS (SELECT entity, date, CASE WHEN (ord // 10) % 7 = 0 THEN NULL ELSE floor(value) END AS value
  FROM obs WHERE source = 'Ledger A')"""
