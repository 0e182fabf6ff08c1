"""Scalar functions and text rules over the tables' own text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import entities
from .catalogue import query
from .views import OBS_DIRTY, load, obs_dirty

#: White space of any script in the oracle's regular expressions.
WS = r"\t-\r\x85\p{Z}\x{FEFF}"
TRIM = rf"regexp_replace({{0}}, '^[{WS.replace('{', '{{').replace('}', '}}')}]+|[{WS.replace('{', '{{').replace('}', '}}')}]+$', '', 'g')"


def trim(c: str) -> str:
    return TRIM.format(c)


PARSED = f"""d AS (SELECT *, {trim('date')} AS s FROM obs), h AS (SELECT *, regexp_extract(s, '^([^T ]*)', 1) AS h FROM d),
 p AS (SELECT *, CASE
  WHEN regexp_matches(h, '^-?\\d{{1,5}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}') THEN 'daily'
  WHEN regexp_matches(s, '^-?\\d{{1,5}}[-/ ]?[qQ][1-4]$') OR regexp_matches(s, '^[qQ][1-4][-/ ]?-?\\d{{1,5}}$') THEN 'quarterly'
  WHEN regexp_matches(h, '^-?\\d{{1,5}}[-/.](0?[1-9]|1[0-2])$') OR regexp_matches(h, '^(0?[1-9]|1[0-2])[-/.]-?\\d{{1,5}}$')
    OR regexp_matches(s, '(?i)^[a-z]{{3,9}}[ ,-]+\\d{{1,5}}$') OR regexp_matches(s, '(?i)^\\d{{1,5}}[ ,-]+[a-z]{{3,9}}$') THEN 'monthly'
  WHEN regexp_matches(h, '^-?\\d{{1,5}}$') THEN 'annual' END AS frequency,
  regexp_extract(s, '(\\d{{4}})', 1) AS y4, regexp_extract(s, '[qQ]([1-4])', 1) AS q, lower(regexp_extract(s, '([A-Za-z]{{3}})', 1)) AS mon FROM h),
 m AS (SELECT *, y4::INT AS y, CASE frequency WHEN 'quarterly' THEN q::INT * 3 - 2 WHEN 'annual' THEN 1
   WHEN 'daily' THEN substr(h, 6, 2)::INT ELSE coalesce(try_cast(regexp_extract(h, '^\\d{{4}}-(\\d{{2}})$', 1) AS INT),
   try_cast(regexp_extract(h, '^(\\d{{2}})/', 1) AS INT), (instr('janfebmaraprmayjunjulaugsepoctnovdec', mon) + 2) // 3) END AS m,
   CASE WHEN frequency = 'daily' THEN substr(h, 9, 2)::INT ELSE 1 END AS dd FROM p WHERE frequency IS NOT NULL),
 dated AS (SELECT *, y::BIGINT * 10000 + m * 100 + dd AS sort_key, CASE frequency WHEN 'daily' THEN printf('%04d-%02d-%02d', y, m, dd)
   WHEN 'quarterly' THEN y4 || '-Q' || q WHEN 'monthly' THEN printf('%04d-%02d', y, m) ELSE y4 || '-01-01' END AS iso FROM m)"""


@query("parse_date", f"WITH {OBS_DIRTY}, {PARSED} SELECT ord, iso, frequency, sort_key FROM dated")
def parse_date(spark, sf):
    rows = obs_dirty(spark, sf).select("ord", fn.parse_date("date").alias("p"))
    return rows.filter("p is not null").select("ord", "p.iso", "p.frequency", "p.sort_key")


@query("display_label", f"""WITH {OBS_DIRTY}, {PARSED} SELECT ord, CASE frequency WHEN 'annual' THEN y::VARCHAR WHEN 'quarterly' THEN 'Q' || q || ' ' || y
 WHEN 'monthly' THEN printf('%02d/%d', m, y) ELSE iso END AS label FROM dated""")
def display_label(spark, sf):
    rows = obs_dirty(spark, sf).select("ord", fn.parse_date("date").alias("p")).filter("p is not null")
    return rows.select("ord", fn.display_label("p.iso", "p.frequency").alias("label"))


@query("infer_frequency", f"""WITH {OBS_DIRTY} SELECT date, CASE WHEN regexp_matches(date, '^-?\\d{{1,5}}-\\d{{2}}-\\d{{2}}') THEN 'daily'
 WHEN regexp_matches(date, '^-?\\d{{1,5}}-\\d{{2}}$') THEN 'monthly' WHEN regexp_matches(date, '(?i)^-?\\d{{1,5}}-Q[1-4]$') THEN 'quarterly'
 WHEN regexp_matches(date, '^-?\\d{{1,5}}$') THEN 'annual' ELSE 'unknown' END AS frequency, count(*) AS n FROM obs GROUP BY ALL""")
def infer_frequency(spark, sf):
    return obs_dirty(spark, sf).groupBy("date", fn.infer_frequency("date").alias("frequency")).agg(F.count("*").alias("n"))


LOOKS = r"""(regexp_matches(s, '^-?\d{1,5}(-\d{2}(-\d{2})?)?$') OR regexp_matches(s, '^-?\d{1,5}-Q[1-4]$') OR regexp_matches(s, '(?i)^Q[1-4]\s*-?\d{1,5}$')
 OR regexp_matches(s, '^-?\d{1,5}/\d{1,2}(/\d{1,2})?$') OR regexp_matches(s, '^\d{1,2}/-?\d{1,5}$')
 OR regexp_matches(s, '(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+-?\d{1,5}$')
 OR regexp_matches(s, '(?i)^-?\d{1,5}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*$'))"""


@query("looks_like_date", f"WITH {OBS_DIRTY}, d AS (SELECT date, {trim('date')} AS s FROM obs) SELECT DISTINCT date, {LOOKS} AS looks FROM d")
def looks_like_date(spark, sf):
    return obs_dirty(spark, sf).select("date").distinct().withColumn("looks", fn.looks_like_date("date"))


SCALED = r"""c AS (SELECT *, regexp_replace(cell, '[\t-\r\x85\p{Z}\x{FEFF},$€£¥₹]|%$', '', 'g') AS b FROM obs),
 e AS (SELECT *, try_cast(regexp_extract(b, '^[+-]?(\d+\.?\d*|\.\d+)') AS DOUBLE) AS num, CASE WHEN regexp_matches(b, '(?i)(trillion|tn|t)$') THEN 1e12
  WHEN regexp_matches(b, '(?i)(billion|bn|bln|b)$') THEN 1e9 WHEN regexp_matches(b, '(?i)(million|mn|mln|m)$') THEN 1e6
  WHEN regexp_matches(b, '(?i)(thousand|k)$') THEN 1e3 ELSE 1 END::DOUBLE AS f FROM c)"""


@query("scaled_number", f"""WITH {OBS_DIRTY}, {SCALED} SELECT ord, cell, num * f AS value,
 CASE WHEN num IS NOT NULL AND cell LIKE '%\\%' ESCAPE '\\' THEN 'percent' END AS unit_hint FROM e""")
def scaled_number(spark, sf):
    p = fn.scaled_number("cell")
    return obs_dirty(spark, sf).select("ord", "cell", p["value"].alias("value"), p["unit_hint"].alias("unit_hint"))


UNIT_SQL = """CASE u WHEN 'million' THEN {million} WHEN 'usd' THEN {usd} WHEN '%' THEN {pct} WHEN 'count' THEN {count} WHEN 'people' THEN {count}
 WHEN '' THEN {count} WHEN 'kg' THEN {kg} WHEN 'tonnes' THEN {tonne} WHEN 'mi' THEN {mile} ELSE {other} END"""
UNITS = rf"""u AS (SELECT *, regexp_replace(lower({trim('unit')}), '\s*\.+$', '') AS u FROM obs),
 n AS (SELECT *, {UNIT_SQL.format(million="'count'", usd="'USD'", pct="'percent'", count="'count'", kg="'kg'", tonne="'kg'", mile="'km'", other='u')} AS canonical,
  {UNIT_SQL.format(million="'count'", usd="'currency'", pct="'ratio'", count="'count'", kg="'mass'", tonne="'mass'", mile="'distance'",
                   other="CASE WHEN u IS NOT NULL THEN 'unknown' END")} AS dimension,
  {UNIT_SQL.format(million='1e6', usd='1', pct='1', count='1', kg='1', tonne='1e3', mile='1.609344', other='CASE WHEN u IS NOT NULL THEN 1 END')}::DOUBLE AS factor,
  CASE WHEN u IS NOT NULL THEN u <> 'furlongs' END AS known FROM u)"""


@query("normalize_unit", f"WITH {OBS_DIRTY}, {UNITS} SELECT unit, canonical, dimension, factor, known, count(*) AS n FROM n GROUP BY ALL")
def normalize_unit(spark, sf):
    u = obs_dirty(spark, sf).groupBy("unit").agg(F.count("*").alias("n")).withColumn("u", fn.normalize_unit("unit"))
    return u.select("unit", "u.canonical", "u.dimension", "u.factor", "u.known", "n")


@query("convert_unit", f"""WITH {OBS_DIRTY}, {UNITS} SELECT ord, CASE WHEN canonical = 'kg' THEN value * factor / 1000::DOUBLE END AS tonnes,
 CASE WHEN canonical = 'count' THEN value * factor / 1000000::DOUBLE END AS millions, NULL::DOUBLE AS euros FROM n""")
def convert_unit(spark, sf):
    to = lambda u: fn.convert_unit("value", "unit", F.lit(u))
    return obs_dirty(spark, sf).select("ord", to("tonnes").alias("tonnes"), to("million").alias("millions"), to("EUR").alias("euros"))


@query("unit_word", f"""WITH {OBS_DIRTY}, t AS (SELECT unit, {trim("coalesce(unit, 'count')")} AS t FROM obs) SELECT DISTINCT unit,
 CASE WHEN lower(t) IN ('million', '') THEN 'count' WHEN t = '%' THEN 'percent' WHEN lower(t) IN ('usd', 'count', 'people') THEN lower(t) ELSE t END AS base,
 CASE WHEN t = 'million' THEN 1e6 ELSE 1 END::DOUBLE AS multiplier FROM t""")
def unit_word(spark, sf):
    w = fn.unit_word("unit")
    return obs_dirty(spark, sf).select("unit").distinct().select("unit", w["base"].alias("base"), w["multiplier"].alias("multiplier"))


@query("slugify", r"""WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
 SELECT doc_id, lower(regexp_replace(regexp_replace(line, '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM w""")
def slugify(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", fn.slugify("line").alias("slug"))


@query("norm_key", r"""SELECT doc_id, sha256(lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) AS key FROM documents""")
def norm_key(spark, sf):
    return load(spark, sf, "documents").select("doc_id", fn.content_hash(fn.norm_key("text")).alias("key"))


SUFFIX = r"(\s*\b(inc|ltd|llc|corp|corporation|co|company|gmbh|s\.?a\.?|s\.?r\.?l\.?|pty|plc|bv|nv|ab|asa|oyj|k\.?k\.?)\.?)+$"
STRIPPED = f"""s AS (SELECT *, regexp_replace({trim('entity')}, '[{WS}]+', ' ', 'g') AS name FROM obs),
 t AS (SELECT *, CASE WHEN regexp_replace(name, '(?i){SUFFIX}', '') = '' THEN name ELSE regexp_replace(name, '(?i){SUFFIX}', '') END AS stripped FROM s)"""


@query("strip_suffix", f"WITH {OBS_DIRTY}, {STRIPPED} SELECT entity, stripped, count(*) AS n FROM t GROUP BY ALL")
def strip_suffix(spark, sf):
    return obs_dirty(spark, sf).groupBy("entity", fn.strip_corporate_suffix("entity").alias("stripped")).agg(F.count("*").alias("n"))


CANONICAL = STRIPPED + """, a AS (SELECT *, CASE lower(stripped) WHEN 'usa' THEN 'United States' WHEN 'united states of america' THEN 'United States'
 WHEN 'côte d''ivoire' THEN 'Cote d''Ivoire' ELSE stripped END AS alias FROM t),
 k AS (SELECT *, regexp_replace(regexp_replace(lower(alias), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS canonical FROM a)"""


@query("canonical_key", f"WITH {OBS_DIRTY}, {CANONICAL} SELECT canonical, count(*) AS n, count(DISTINCT entity) AS spellings FROM k GROUP BY ALL")
def canonical_key(spark, sf):
    return obs_dirty(spark, sf).groupBy(fn.canonical_key("entity").alias("canonical")).agg(
        F.count("*").alias("n"), F.count_distinct("entity").alias("spellings"))


@query("alias_join", f"WITH {OBS_DIRTY}, {CANONICAL} SELECT ord, alias FROM k")
def alias_join(spark, sf):
    return obs_dirty(spark, sf).select("ord", fn.alias_name(fn.strip_corporate_suffix("entity")).alias("alias"))


HOST = "coalesce(regexp_replace(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', ''), '')"


@query("publisher_key", f"""WITH {OBS_DIRTY} SELECT lower({trim("coalesce(source, '')")}) || '||' || {HOST} AS publisher, count(*) AS n FROM obs GROUP BY ALL""")
def publisher_key(spark, sf):
    return obs_dirty(spark, sf).groupBy(fn.publisher_key("source", "source_url").alias("publisher")).agg(F.count("*").alias("n"))


URL_KEY = r"""CASE WHEN regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN lower(regexp_replace(regexp_replace(
 split_part(regexp_replace({0}, '#.*$', ''), '?', 1), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+)$', '\1/') ||
 CASE WHEN len(list_filter(string_split(regexp_extract(regexp_replace({0}, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|mc_|(fbclid|gclid|ref)(=|$))'))) > 0
 THEN '?' || array_to_string(list_transform(list_filter(string_split(regexp_extract(regexp_replace({0}, '#.*$', ''), '\?(.*)$', 1), '&'),
  lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|mc_|(fbclid|gclid|ref)(=|$))')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') ELSE '' END, '/$', ''))
 ELSE lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')) END"""


@query("normalise_url", f"""SELECT page_id AS id, {URL_KEY.format('url')} AS url_key FROM pages UNION ALL
 SELECT -1 - ord, {URL_KEY.format('source_url')} FROM (WITH {OBS_DIRTY} SELECT * FROM obs WHERE source_url IS NOT NULL)""")
def normalise_url(spark, sf):
    pages = load(spark, sf, "pages").select(F.col("page_id").alias("id"), fn.normalise_url("url").alias("url_key"))
    dirty = obs_dirty(spark, sf).filter("source_url is not null")
    return pages.unionByName(dirty.select((-1 - F.col("ord")).alias("id"), fn.normalise_url("source_url").alias("url_key")))


@query("host_authority", f"""WITH {OBS_DIRTY} SELECT host, CASE WHEN host = '' THEN 0.3 WHEN host = 'data.gov' THEN 0.8 ELSE 0.3 END::DOUBLE AS authority, count(*) AS n
 FROM (SELECT {HOST} AS host FROM obs) GROUP BY ALL""")
def host_authority(spark, sf):
    return obs_dirty(spark, sf).groupBy(fn.host_of("source_url").alias("host")).agg(F.count("*").alias("n")).withColumn(
        "authority", fn.host_authority("host"))


def fixed(v: str, d: int, after: str = "") -> str:
    """Decimal text in SQL; C formatting sends exact ties to even, so those are nudged up."""
    steps = f"(({v}) * {2 ** (d + 1)}::DOUBLE)"
    return f"printf('%.{d}f{after}', ({v}) + CASE WHEN {steps} = floor({steps}) AND {steps}::HUGEINT % 2 = 1 THEN {10.0 ** -(d + 2)}::DOUBLE ELSE 0 END)"


@query("compact_number", f"""SELECT o_orderkey AS ord, CASE WHEN v >= 1e9 THEN {fixed('v / 1e9::DOUBLE', 2, ' B')} WHEN v >= 1e6 THEN {fixed('v / 1e6::DOUBLE', 1, ' M')}
 WHEN v >= 1e3 THEN {fixed('v / 1e3::DOUBLE', 1, ' K')} WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE {fixed('v', 2)} END AS text, {fixed('v', 2, '%%')} AS pct
 FROM (SELECT o_orderkey, (o_orderkey * 7919 % 1000000007)::DOUBLE / (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 0.25 END)::DOUBLE AS v FROM orders)""")
def compact_number(spark, sf):
    k = F.col("o_orderkey")
    v = (k * 7919 % 1000000007).cast("double") / F.when(k % 3 == 0, F.lit(1.0)).when(k % 3 == 1, F.lit(1024.0)).otherwise(F.lit(0.25))
    return load(spark, sf, "orders").select(k.alias("ord"), fn.format_value(v, F.lit("count")).alias("text"), fn.format_value(v, F.lit("percent")).alias("pct"))


@query("content_hash", """SELECT doc_id, sha256(text) AS text_hash, sha256(length(doc_id::VARCHAR) || ':' || doc_id || '|' || length(lang) || ':' || lang || '|'
 || coalesce(length(source) || ':' || source, '-')) AS record_hash FROM documents""")
def content_hash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", fn.content_hash("text").alias("text_hash"), fn.record_hash("doc_id", "lang", "source").alias("record_hash"))



@query("rank_direction", r"""SELECT page_id, CASE WHEN regexp_matches(lower(html), '\b(poorest|smallest|lowest|least|cheapest|slowest|shortest|bottom|worst|least-populous|smallest-population)\b')
 THEN 'asc' ELSE 'desc' END AS direction FROM pages""")
def rank_direction(spark, sf):
    return load(spark, sf, "pages").select("page_id", fn.rank_direction("html").alias("direction"))


# Prompts made of the orders' own keys, so that every rule of the taggers is met.
PROMPT = r"""p AS (SELECT o_orderkey AS id, (CASE o_orderkey % 6 WHEN 0 THEN 'Poorest countries by GDP' WHEN 1 THEN 'Largest browser share in India'
 WHEN 2 THEN 'Olympic medals and hospital health' WHEN 3 THEN 'Steel and coal emission' WHEN 4 THEN 'unemployment of students' ELSE 'market cap of the company' END)
 || ' top ' || (o_orderkey % 50) || ' from ' || (o_orderkey % 3000) || (CASE WHEN o_orderkey % 4 = 0 THEN ' BC' ELSE '' END) || ' to ' || (o_orderkey % 2300)
 || ' see https://x' || (o_orderkey % 7) || '.test/a, or https://x.test/b. ' || (CASE WHEN o_orderkey % 5 = 0 THEN 'on 20240615' WHEN o_orderkey % 5 = 1 THEN 'each June 5' ELSE '' END)
 AS text FROM orders)"""


def prompts(spark, sf):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    about = (F.when(k % 6 == 0, F.lit("Poorest countries by GDP")).when(k % 6 == 1, F.lit("Largest browser share in India"))
             .when(k % 6 == 2, F.lit("Olympic medals and hospital health")).when(k % 6 == 3, F.lit("Steel and coal emission"))
             .when(k % 6 == 4, F.lit("unemployment of students")).otherwise(F.lit("market cap of the company")))
    day = F.when(k % 5 == 0, F.lit("on 20240615")).when(k % 5 == 1, F.lit("each June 5")).otherwise(F.lit(""))
    text = F.concat(about, F.lit(" top "), s(k % 50), F.lit(" from "), s(k % 3000), F.when(k % 4 == 0, F.lit(" BC")).otherwise(F.lit("")), F.lit(" to "),
                    s(k % 2300), F.lit(" see https://x"), s(k % 7), F.lit(".test/a, or https://x.test/b. "), day)
    return load(spark, sf, "orders").select(k.alias("id"), text.alias("text"))


@query("text_tags", f"""WITH {PROMPT}, r AS (SELECT *, CASE WHEN id % 4 = 0 THEN -(id % 3000) ELSE id % 3000 END AS a, id % 2300 AS b FROM p)
 SELECT id, CASE WHEN id % 6 = 0 THEN 'asc' ELSE 'desc' END AS direction, CASE id % 6 WHEN 0 THEN 'economy' WHEN 1 THEN 'technology,india' WHEN 2 THEN 'health,sports'
 WHEN 3 THEN 'energy,environment,industry' WHEN 4 THEN 'labour' ELSE 'finance' END AS topics, least(30, greatest(3, id % 50)) AS top_n,
 CASE WHEN greatest(a, b) <= 2100 THEN least(a, b) END AS year_from, CASE WHEN greatest(a, b) <= 2100 THEN greatest(a, b) END AS year_to,
 CASE id % 5 WHEN 0 THEN '0615' WHEN 1 THEN '0605' ELSE '0101' END AS mmdd, 'https://x' || (id % 7) || '.test/a https://x.test/b' AS urls FROM r""")
def text_tags(spark, sf):
    years = fn.year_range("text")
    return prompts(spark, sf).select(
        "id", fn.rank_direction("text").alias("direction"), F.array_join(fn.topics("text"), ",").alias("topics"),
        fn.top_n_wanted("text").cast("bigint").alias("top_n"), years["year_from"].cast("bigint").alias("year_from"),
        years["year_to"].cast("bigint").alias("year_to"), fn.month_day_hint("text").alias("mmdd"), F.array_join(fn.extract_urls("text"), " ").alias("urls"))


@query("unit_sniff", f"""WITH {PROMPT}, t AS (SELECT id, lower('Country Name 1960 ' || text) AS t FROM p) SELECT id, CASE WHEN regexp_matches(t, '%|percent|share|rate|ratio') THEN 'percent'
 WHEN regexp_matches(t, '\\b(usd|dollar|revenue|gross|box office|budget|income|price|cost|spend|gdp)\\b') THEN 'USD' WHEN regexp_matches(t, '\\b(population|people)\\b') THEN 'people' ELSE 'count' END AS unit,
 CASE WHEN regexp_matches(t, 'percent|\\(%|%\\s*of') THEN 'percent' WHEN regexp_matches(t, 'us\\$|\\$|dollar|gdp|gni') THEN 'USD' ELSE 'count' END AS indicator_unit FROM t""")
def unit_sniff(spark, sf):
    return prompts(spark, sf).select("id", fn.table_unit(F.lit("Country Name 1960"), "text").alias("unit"), fn.indicator_unit("text").alias("indicator_unit"))


@query("extract_urls", r"""SELECT page_id, u AS url FROM (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(url || '. ' || html, 'https?://[^\s)"'']+'),
 lambda x: regexp_replace(x, '[.,;]+$', '')))) AS u FROM pages)""")
def extract_urls(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.explode(fn.extract_urls(F.concat_ws(". ", "url", "html"))).alias("url"))


# --- resolution ----------------------------------------------------------------------------------------------

RESOLVED = """CASE WHEN {0} IN ('usa', 'unitedstatesofamerica') THEN 'United States' WHEN {0} = 'deutschland' THEN 'Germany' WHEN {0} = 'world' THEN 'World' END"""
KEYED = r"""k AS (SELECT *, lower(regexp_replace(entity, '[^\p{L}\p{N}]', '', 'g')) AS key FROM obs), """ + \
    f"r AS (SELECT *, {RESOLVED.format('key')} AS known FROM k)"


@query("resolve_entity", f"""WITH {OBS_DIRTY}, {KEYED} SELECT entity, CASE WHEN known IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS resolution,
 CASE WHEN key = '' THEN '' ELSE lower(regexp_replace(regexp_replace(coalesce(known, entity), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g')) END AS resolved_id,
 CASE known WHEN 'United States' THEN 'us' WHEN 'Germany' THEN 'de' END AS flag_code, count(*) AS n FROM r GROUP BY ALL""")
def resolve_entity(spark, sf):
    found = entities.resolve_entities(obs_dirty(spark, sf))
    return found.groupBy("entity", "resolution", "resolved_id", "flag_code").agg(F.count("*").alias("n"))


@query("country_only", f"WITH {OBS_DIRTY}, {KEYED} SELECT ord, known AS entity FROM r WHERE known IN ('United States', 'Germany')")
def country_only(spark, sf):
    return entities.countries_only(obs_dirty(spark, sf)).select("ord", "entity")


@query("canonical_names", f"""WITH {OBS_DIRTY}, {KEYED} SELECT ord, coalesce(known, CASE WHEN key = 'côtedivoire' THEN 'Cote d''Ivoire' ELSE
 regexp_replace({trim('entity')}, '[{WS}]+', ' ', 'g') END) AS entity FROM r""")
def canonical_names(spark, sf):
    return entities.canonical_names(obs_dirty(spark, sf)).select("ord", "entity")


@query("entity_filter", f"""WITH {OBS_DIRTY} SELECT ord, entity FROM obs WHERE lower(entity) IN ('usa', 'nokia corp.')""")
def entity_filter(spark, sf):
    obs = obs_dirty(spark, sf).withColumn("entity_id", fn.ascii_slug("entity"))
    return entities.keep_entities(obs, ["Usa", "NOKIA CORP."]).select("ord", "entity")
