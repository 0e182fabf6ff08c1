"""Quality checks, verification, cleaning and revision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ascii_slug, slugify
from ..operators import clean as cleaning
from ..operators import insight, quality, ranking, tape, verify
from ..operators.ranking import with_period
from .catalogue import query
from .dataset import SourceTable, build_dataset
from .queries_text import CANONICAL, KEYED, PARSED, UNITS, trim
from .views import OBS_DIRTY, OBS_ORDERS, OBS_PUBLISHERS, OBS_USER_DAY, load, obs_dirty, obs_orders, obs_publishers, obs_user_day

MAX_DATE = "2000-06-30"
SLUG = r"lower(regexp_replace(regexp_replace(entity, '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g'))"
BLANK = lambda c: f"coalesce({trim(c)}, '') = ''"


def _rows(spark, sf):
    return obs_dirty(spark, sf)


def _sql(check: str, detail: str, body: str, n: str = "1", ctes: str = OBS_DIRTY) -> str:
    return f"""WITH {ctes} SELECT '{check}' AS "check", ({detail})::VARCHAR AS detail, ({n})::BIGINT AS n FROM {body}"""


CHECK_SQL = {
    "schema": _sql("schema", "ord || ' ' || problem", f"""(SELECT ord, 'empty entity' AS problem FROM obs WHERE {BLANK('entity')}
      UNION ALL SELECT ord, 'empty date' FROM obs WHERE {BLANK('date')})"""),
    "type": _sql("type", "ord", "obs WHERE value IS NOT NULL AND NOT isfinite(value)"),
    "date": _sql("date", "ord || ' ' || date", "obs WHERE ord NOT IN (SELECT ord FROM dated)", ctes=f"{OBS_DIRTY}, {PARSED}"),
    "unit": _sql("unit", "concat_ws(' ', ord, unit)", "n WHERE coalesce(NOT known, true)", ctes=f"{OBS_DIRTY}, {UNITS}"),
    "entity": _sql("entity", "'x'", "obs WHERE false"),
    "duplicate": _sql("duplicate", "s || ' / ' || date", f"(SELECT {SLUG} AS s, date, count(*) AS c FROM obs GROUP BY ALL HAVING count(*) > 1)", "c - 1"),
    "range": _sql("range", "ord", "n WHERE coalesce(dimension, 'count') = 'count' AND value < 0", ctes=f"{OBS_DIRTY}, {UNITS}"),
    "source": _sql("source", "concat_ws(' ', ord, source_url)", """obs WHERE (source IS NULL AND source_url IS NULL)
      OR NOT coalesce(starts_with(source_url, 'http') OR starts_with(source_url, 'file:') OR starts_with(source_url, 'upload:'), true)"""),
    "temporal": _sql("temporal", "ord || ' ' || date", "dated WHERE sort_key > 20000630 AND coalesce(lower(status) NOT IN ('forecast', 'estimated'), true)",
                     ctes=f"{OBS_DIRTY}, {PARSED}"),
    "citation": _sql("citation", "v", "(SELECT count(*) AS v, count(coalesce(source, source_url)) AS c FROM obs WHERE value IS NOT NULL) WHERE v > 0 AND c = 0"),
}


@query("q_schema", CHECK_SQL["schema"])
def q_schema(spark, sf):
    return quality.check_schema(_rows(spark, sf))


@query("q_type", _sql("type", "ord", "obs WHERE ord % 50 < 2", ctes=OBS_ORDERS))
def q_type(spark, sf):
    k = F.col("ord") % 50
    bad = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return quality.check_type(obs_orders(spark, sf).withColumn("value", bad))


@query("q_date", CHECK_SQL["date"])
def q_date(spark, sf):
    return quality.check_date(_rows(spark, sf))


@query("q_date_normalised", _sql("date", "ord || ' ' || date", r"obs WHERE NOT regexp_matches(date, '^-?\d{1,5}(-\d{2}(-\d{2})?|(-Q[1-4]))?$')"))
def q_date_normalised(spark, sf):
    return quality.check_date_normalised(_rows(spark, sf))


@query("q_unit", CHECK_SQL["unit"])
def q_unit(spark, sf):
    return quality.check_unit(_rows(spark, sf))


@query("q_unit_present", _sql("unit", "ord", f"obs WHERE {BLANK('unit')}"))
def q_unit_present(spark, sf):
    return quality.check_unit_present(_rows(spark, sf))


@query("q_entity", """SELECT 'entity' AS "check", count(*)::VARCHAR AS detail, 1::BIGINT AS n FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1)
 HAVING count(*) > 0""")
def q_entity(spark, sf):
    """Part names as entities, against a dictionary in which one name may stand for several brands."""
    part = load(spark, sf, "part")
    names = part.select("p_name", "p_brand").distinct()
    dictionary = names.select(F.concat_ws(" ", "p_brand", "p_name").alias("name"), F.lit("").alias("iso2"), F.lit("").alias("iso3"), F.lit("").alias("region"),
                              F.array("p_name").alias("aliases"))
    return quality.check_entity(part.select(F.col("p_name").alias("entity")), dictionary)


@query("q_duplicate", CHECK_SQL["duplicate"])
def q_duplicate(spark, sf):
    return quality.check_duplicate(_rows(spark, sf))


BASE_UNIT = f"""CASE WHEN lower({trim("coalesce(unit, 'count')")}) IN ('million', '') THEN 'count' WHEN unit = '%' THEN 'percent' WHEN unit = 'USD' THEN 'usd'
 ELSE {trim("coalesce(unit, 'count')")} END"""


@query("q_duplicate_cells", _sql("duplicate", "canonical || '|' || date || '|' || base", f"""(SELECT canonical, date, {BASE_UNIT} AS base, count(*) AS c,
 count(*) FILTER (status = 'CONFLICTING') AS d FROM k GROUP BY ALL) WHERE c > 1 AND d < c""", ctes=f"{OBS_DIRTY}, {CANONICAL}"))
def q_duplicate_cells(spark, sf):
    return quality.check_duplicate_cells(_rows(spark, sf))


@query("q_range", CHECK_SQL["range"])
def q_range(spark, sf):
    return quality.check_range(_rows(spark, sf)).withColumn("detail", F.substring_index("detail", " ", 1))


@query("q_range_count", _sql("range", "ord", "obs WHERE unit = 'count' AND value < 0"))
def q_range_count(spark, sf):
    return quality.check_range_count(_rows(spark, sf))


@query("q_source", CHECK_SQL["source"])
def q_source(spark, sf):
    return quality.check_source(_rows(spark, sf))


@query("q_source_url", _sql("source", "ord", "obs WHERE source_url IS NULL"))
def q_source_url(spark, sf):
    return quality.check_source_url(_rows(spark, sf))


@query("q_temporal", CHECK_SQL["temporal"])
def q_temporal(spark, sf):
    return quality.check_temporal(_rows(spark, sf), MAX_DATE)


@query("q_temporal_text", _sql("temporal", "ord || ' ' || date", f"obs WHERE substr(date, 1, 10) > '{MAX_DATE}'"))
def q_temporal_text(spark, sf):
    return quality.check_temporal_text(_rows(spark, sf), MAX_DATE)


@query("q_rejected", _sql("ranking", "'rejected values are present'", "obs WHERE value IS NOT NULL AND status = 'REJECTED' LIMIT 1"))
def q_rejected(spark, sf):
    return quality.check_rejected(_rows(spark, sf))


RANKY = """obs AS (SELECT o_orderkey AS ord, 'c' || o_custkey AS entity, (o_custkey % 200)::VARCHAR AS date, CASE WHEN o_custkey % 200 % 3 = 0
 THEN row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) ELSE o_totalprice END::DOUBLE AS value FROM orders)"""


def _ranky(spark, sf):
    """Orders by a key, a third of them with their place in the key as the value."""
    from pyspark.sql import Window
    o, key = load(spark, sf, "orders"), F.col("o_custkey") % 200
    place = F.row_number().over(Window.partitionBy(key).orderBy("o_orderkey")).cast("double")
    return o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"), key.cast("string").alias("date"),
                    F.when(key % 3 == 0, place).otherwise(F.col("o_totalprice")).alias("value"))


@query("rank_as_value", f"""WITH {RANKY} SELECT date, count(*) AS n FROM obs GROUP BY date HAVING count(*) >= 5 AND min(value) = 1 AND max(value) = count(*)
 AND count(DISTINCT value) = count(*) AND bool_and(value = floor(value))""")
def rank_as_value(spark, sf):
    return quality.rank_columns_as_values(_ranky(spark, sf))


@query("q_rank_as_value", _sql("rank-as-value", "date || ' 1..' || c", """(SELECT date, count(*) AS c FROM obs GROUP BY date HAVING count(*) >= 5 AND min(value) = 1
 AND max(value) = count(*) AND count(DISTINCT value) = count(*) AND bool_and(value = floor(value)))""", ctes=RANKY))
def q_rank_as_value(spark, sf):
    return quality.check_rank_as_value(_ranky(spark, sf))


@query("q_citation", _sql("citation", "count(*)", "obs WHERE value IS NOT NULL HAVING count(*) > 0"))
def q_citation(spark, sf):
    none = F.lit(None).cast("string")
    return quality.check_citation(_rows(spark, sf).withColumns({"source": none, "source_url": none}))


@query("q_citation_each", _sql("citation", "ord", "obs WHERE value IS NOT NULL AND source IS NULL"))
def q_citation_each(spark, sf):
    return quality.check_citation_each(_rows(spark, sf))


@query("q_unit_mismatch", _sql("unit-mismatch", "canonical || '|' || date", f"""(SELECT canonical, date FROM k WHERE value IS NOT NULL GROUP BY ALL
 HAVING count(DISTINCT {BASE_UNIT}) > 1)""", ctes=f"{OBS_DIRTY}, {CANONICAL}"))
def q_unit_mismatch(spark, sf):
    return quality.check_unit_mismatch(_rows(spark, sf))


@query("unit_mismatch", f"WITH {OBS_DIRTY}, {CANONICAL} SELECT canonical, date, count(DISTINCT {BASE_UNIT}) AS units FROM k WHERE value IS NOT NULL GROUP BY ALL HAVING units > 1")
def unit_mismatch(spark, sf):
    return verify.unit_mismatches(_rows(spark, sf))


JUMPS = """j AS (SELECT *, lag(date) OVER w AS from_date, lag(value) OVER w AS from_value FROM obs WHERE value IS NOT NULL AND value <> 0
 WINDOW w AS (PARTITION BY entity_id ORDER BY sort_key, ord))"""
SPIKY = OBS_USER_DAY.replace("obs AS (SELECT", "obs0 AS (SELECT") + """, obs AS (SELECT * REPLACE (CASE WHEN ord % 7 = 0 THEN value * 1000 WHEN ord % 11 = 0 THEN NULL
 ELSE value END AS value) FROM obs0)"""


def _spiky(spark, sf):
    k = F.col("ord")
    value = F.when(k % 7 == 0, F.col("value") * 1000).when(k % 11 == 0, F.lit(None)).otherwise(F.col("value"))
    return with_period(obs_user_day(spark, sf)).withColumn("value", value).withColumn("unit", F.lit("count"))


@query("outlier_jumps", f"""WITH {SPIKY}, {JUMPS} SELECT entity_id, ord, from_date, from_value, date AS to_date, value AS to_value, abs(value) / abs(from_value) AS ratio
 FROM j WHERE abs(value) / abs(from_value) >= 100 OR abs(value) / abs(from_value) <= 1 / 100::DOUBLE""")
def outlier_jumps(spark, sf):
    return verify.outlier_jumps(_spiky(spark, sf))


@query("q_outlier", _sql("outlier", "entity_id || ' ' || from_date || ' ' || date", """j WHERE abs(value) / abs(from_value) >= 100
 OR abs(value) / abs(from_value) <= 1 / 100::DOUBLE""", ctes=f"{SPIKY}, {JUMPS}"))
def q_outlier(spark, sf):
    return quality.check_outlier(_spiky(spark, sf))


@query("q_money", """SELECT 'money' AS "check", p_name || ' price / ' || p_type AS detail, 1::BIGINT AS n FROM (SELECT p_partkey, p_name,
 CASE p_partkey % 3 WHEN 0 THEN 'Count' WHEN 1 THEN 'USD' ELSE ' index ' END AS p_type FROM part) WHERE p_partkey % 3 <> 1""")
def q_money(spark, sf):
    k = F.col("p_partkey") % 3
    meta = load(spark, sf, "part").select(F.concat("p_name", F.lit(" price")).alias("metric"),
                                          F.when(k == 0, F.lit("Count")).when(k == 1, F.lit("USD")).otherwise(F.lit(" index ")).alias("unit"))
    return quality.check_money(meta)


@query("q_multi_value", """WITH n AS (SELECT DISTINCT text AS name FROM documents) SELECT 'multi-value' AS "check", count(*) FILTER (contains(name, ','))
 || ' of ' || count(*) AS detail, 1::BIGINT AS n FROM (SELECT DISTINCT regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS name FROM n) WHERE name <> '' HAVING count(*) FILTER (contains(name, ',')) * 2 >= count(*)""")
def q_multi_value(spark, sf):
    return quality.check_multi_value(load(spark, sf, "documents").select(F.col("text").alias("entity")))


@query("q_null_status", _sql("null-status", "ord", "obs WHERE value IS NULL AND coalesce(status <> 'UNKNOWN', true)"))
def q_null_status(spark, sf):
    return quality.check_null_status(_rows(spark, sf))


REPORT = " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in CHECK_SQL.values())


@query("quality_report", f"""SELECT "check", sum(n)::BIGINT AS violations, sum(n) = 0 AS passed FROM ({REPORT} UNION ALL
 SELECT unnest(['schema', 'type', 'date', 'unit', 'entity', 'duplicate', 'range', 'source', 'temporal', 'ranking', 'rank-as-value', 'citation']), NULL, 0) GROUP BY "check" """)
def quality_report(spark, sf):
    obs = _rows(spark, sf)
    drawn = ranking.top_per_period(cleaning.tape_input(obs)[0], 10)
    return quality.quality_report(quality.core_counts(obs, MAX_DATE, ranked=drawn), quality.CORE_CHECKS)


PLATFORM = {
    "date": r"obs WHERE NOT regexp_matches(date, '^-?\d{1,5}(-\d{2}(-\d{2})?|(-Q[1-4]))?$')",
    "unit": f"obs WHERE {BLANK('unit')}", "range": "obs WHERE unit = 'count' AND value < 0", "source": "obs WHERE source_url IS NULL",
    "temporal": f"obs WHERE substr(date, 1, 10) > '{MAX_DATE}'", "citation": "obs WHERE value IS NOT NULL AND source IS NULL",
    "duplicate": f"(SELECT 1 FROM k GROUP BY canonical, date, {BASE_UNIT} HAVING count(*) > 1 AND count(*) FILTER (status = 'CONFLICTING') < count(*))",
    "unit-mismatch": f"(SELECT 1 FROM k WHERE value IS NOT NULL GROUP BY canonical, date HAVING count(DISTINCT {BASE_UNIT}) > 1)",
    "outlier": f"""(SELECT value, lag(value) OVER (PARTITION BY canonical, {BASE_UNIT} ORDER BY sort_key NULLS FIRST, k.ord) AS was FROM k LEFT JOIN (SELECT ord, sort_key FROM dated) d
      ON d.ord = k.ord WHERE value IS NOT NULL AND value <> 0) WHERE abs(value) / abs(was) >= 100 OR abs(value) / abs(was) <= 1 / 100::DOUBLE""",
    "ranking": "(SELECT 1 FROM obs WHERE value IS NOT NULL AND status = 'REJECTED' LIMIT 1)",
}
PLATFORM_SQL = " UNION ALL ".join(f"SELECT '{name}' AS \"check\", count(*) AS violations FROM {body}" for name, body in PLATFORM.items())


@query("quality_report_platform", f"""WITH {OBS_DIRTY}, {PARSED}, {CANONICAL},
 r AS ({PLATFORM_SQL} UNION ALL SELECT unnest(['schema', 'type', 'rank-as-value']), 0) SELECT "check", violations, violations = 0 AS passed FROM r""")
def quality_report_platform(spark, sf):
    return quality.quality_report(quality.platform_violations(_rows(spark, sf), MAX_DATE), quality.PLATFORM_CHECKS)


@query("report_totals", f"""WITH v AS ({REPORT}) SELECT (SELECT count(*) FROM (WITH {OBS_DIRTY} SELECT * FROM obs)) AS observations,
 (SELECT count(DISTINCT {SLUG}) FROM (WITH {OBS_DIRTY} SELECT * FROM obs)) AS entities, sum(n)::BIGINT AS violations, sum(n) = 0 AS passed FROM v""")
def report_totals(spark, sf):
    obs = _rows(spark, sf)
    ranked = ranking.rank_observations(cleaning.tape_input(obs)[0]).cells.filter("n_valued > 0")
    return quality.report_totals(quality.quality_report(quality.core_violations(obs, MAX_DATE, ranked=ranked), quality.CORE_CHECKS), obs)


@query("gate", _sql("gate", "text", """(SELECT 'null not UNKNOWN: ' || ord AS text FROM obs WHERE value IS NULL AND coalesce(status <> 'UNKNOWN', true)
 UNION ALL SELECT 'blank name: ' || ord FROM obs WHERE trim(entity) = '' UNION ALL SELECT 'failed check: citation')"""))
def gate(spark, sf):
    obs = _rows(spark, sf)
    frames = tape.build_tape(ranking.rank_observations(cleaning.tape_input(obs)[0], 10), 2).frames()
    none = F.lit(None).cast("string")
    report = quality.quality_report(quality.check_citation(obs.withColumns({"source": none, "source_url": none})), ("citation",))
    return quality.gate(obs, frames, report)


# --- verification ------------------------------------------------------------------------------------------------

VERIFIED = OBS_PUBLISHERS + """, prim AS (SELECT pub FROM obs_s GROUP BY pub ORDER BY count(DISTINCT canonical || '|' || date) DESC, avg(coalesce(confidence, 0)) DESC, min(ord) LIMIT 1),
 cells AS (SELECT canonical, date, base_unit, count(*) AS n, count(DISTINCT pub) AS publishers, arg_min(mult, ord) AS s, min(value * mult) / arg_min(mult, ord) AS low,
  max(value * mult) / arg_min(mult, ord) AS high, min(ord) AS first_ord, min(ord) FILTER (pub = (SELECT pub FROM prim)) AS prim_ord FROM obs_s WHERE value IS NOT NULL GROUP BY ALL),
 sp AS (SELECT *, (high - low) / greatest(abs(high), abs(low), 1e-9::DOUBLE) AS spread FROM cells),
 oc AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN spread <= 0.05::DOUBLE AND publishers >= 2 THEN 'verified' WHEN publishers < 2 THEN 'repeated' ELSE 'conflict' END AS outcome FROM sp)"""
TRUST = "CASE WHEN outcome = 'verified' THEN least(0.98::DOUBLE, 0.75::DOUBLE + 0.05::DOUBLE * publishers) ELSE confidence END"


def _verified(rows):
    return rows.select("ord", "entity_id", "date", "value", "status", F.round("confidence", 6).alias("confidence"))


@query("verify_multi", f"""WITH {VERIFIED} SELECT ord, canonical AS entity_id, o.date, value, CASE outcome WHEN 'verified' THEN 'VERIFIED' WHEN 'conflict' THEN 'CONFLICTING' ELSE status END AS status,
 round({TRUST}, 6) AS confidence FROM obs_s o JOIN oc USING (canonical, date, base_unit) WHERE value IS NOT NULL AND (outcome = 'conflict' OR ord = first_ord)
 UNION ALL SELECT ord, canonical, date, value, status, round(confidence, 6) FROM obs_s WHERE value IS NULL""")
def verify_multi(spark, sf):
    return _verified(verify.verify_across_sources(obs_publishers(spark, sf)).observations)


@query("verify_single_source", f"""WITH {VERIFIED} SELECT ord, canonical AS entity_id, o.date, value, CASE outcome WHEN 'verified' THEN 'VERIFIED' ELSE status END AS status,
 round({TRUST}, 6) AS confidence FROM obs_s o JOIN oc USING (canonical, date, base_unit) WHERE value IS NOT NULL AND ord = prim_ord
 UNION ALL SELECT ord, canonical, date, value, status, round(confidence, 6) FROM obs_s WHERE value IS NULL AND pub = (SELECT pub FROM prim)""")
def verify_single_source(spark, sf):
    return _verified(verify.verify_across_sources(obs_publishers(spark, sf), single_source=True).observations)


@query("conflicts", f"""WITH {VERIFIED} SELECT canonical, date, base_unit, n, publishers, round(low, 2) AS low, round(high, 2) AS high, round(spread, 6) AS spread, first_ord FROM oc WHERE outcome = 'conflict'""")
def conflicts(spark, sf):
    found = verify.verify_across_sources(obs_publishers(spark, sf)).conflicts
    return found.withColumns({"low": F.round("low", 2), "high": F.round("high", 2), "spread": F.round("spread", 6)})


@query("conflict_candidates", f"""WITH {VERIFIED} SELECT canonical, o.date, base_unit, ord, value, source_url, status FROM obs_s o JOIN oc USING (canonical, date, base_unit)
 WHERE outcome = 'conflict' AND value IS NOT NULL""")
def conflict_candidates(spark, sf):
    return verify.verify_across_sources(obs_publishers(spark, sf)).candidates


@query("conflict_records", f"""WITH {VERIFIED} SELECT 'conflict_' || sha1('sales|' || canonical || '|' || date || '|' || base_unit) AS conflict_id, 'sales' AS metric, canonical AS entity_id, date,
 base_unit AS unit, n::BIGINT AS candidates, publishers, false AS resolved FROM oc WHERE outcome = 'conflict'""")
def conflict_records(spark, sf):
    found = verify.conflict_records(verify.verify_across_sources(obs_publishers(spark, sf)), "sales")
    return found.withColumn("publishers", F.regexp_extract("reason", r"^(\d+) publishers", 1).cast("bigint")).drop("reason")


@query("verify_notes", f"""WITH {VERIFIED}, kept AS (SELECT canonical, o.date, value, ord FROM obs_s o JOIN oc USING (canonical, date, base_unit) WHERE value IS NOT NULL AND ord = prim_ord),
 j AS (SELECT *, lag(value) OVER w AS before, lag(date) OVER w AS since FROM kept WHERE value <> 0 WINDOW w AS (PARTITION BY canonical ORDER BY date, ord))
 SELECT 'dispute' AS kind, canonical AS entity_id, date, n || ' values of ' || publishers || ' publishers' AS detail FROM oc WHERE outcome = 'conflict' AND prim_ord IS NOT NULL
 UNION ALL SELECT 'not from primary', canonical, date, n || ' values left out' FROM oc WHERE prim_ord IS NULL
 UNION ALL SELECT 'outlier', canonical, date, 'since ' || since FROM j WHERE abs(value) / abs(before) >= 1.1::DOUBLE OR abs(value) / abs(before) <= 1 / 1.1::DOUBLE
 UNION ALL SELECT 'unit mismatch', canonical, date, count(DISTINCT base_unit) || ' units' FROM obs_s WHERE value IS NOT NULL GROUP BY canonical, date HAVING count(DISTINCT base_unit) > 1""")
def verify_notes(spark, sf):
    obs = obs_publishers(spark, sf)
    return verify.verification_notes(obs, verify.verify_across_sources(obs, single_source=True), outlier_ratio=1.1)


@query("dropped_cells", f"WITH {VERIFIED} SELECT canonical, date, base_unit, n, first_ord FROM oc WHERE prim_ord IS NULL")
def dropped_cells(spark, sf):
    return verify.verify_across_sources(obs_publishers(spark, sf), single_source=True).dropped


@query("verification_summary", f"""WITH {VERIFIED}, out_ AS (SELECT value, CASE outcome WHEN 'verified' THEN 'VERIFIED' ELSE status END AS status FROM obs_s o
 JOIN oc USING (canonical, date, base_unit) WHERE value IS NOT NULL AND ord = prim_ord UNION ALL SELECT value, status FROM obs_s WHERE value IS NULL AND pub = (SELECT pub FROM prim))
 SELECT count(*) AS observations, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status = 'SUPPORTED') AS supported,
 count(*) FILTER (status = 'UNKNOWN') AS "unknown", 0 AS conflicting, 0 AS rejected, count(value) AS valued, count(*) FILTER (status = 'SUPPORTED' AND value IS NOT NULL) AS single_publisher,
 (SELECT count(*) FROM oc WHERE outcome = 'conflict' AND prim_ord IS NOT NULL) AS conflicts FROM out_""")
def verification_summary(spark, sf):
    return verify.verification_summary(verify.verify_across_sources(obs_publishers(spark, sf), single_source=True))


@query("primary_source", f"""WITH {OBS_PUBLISHERS}, g AS (SELECT pub AS publisher, count(DISTINCT canonical || '|' || date) AS cells, count(*) AS observations,
 round(avg(confidence), 6) AS mean_confidence, min(ord) AS first_ord, bool_or(unit = 'million') AS unit_match FROM obs_s GROUP BY pub)
 SELECT *, row_number() OVER (ORDER BY unit_match DESC, cells DESC, mean_confidence DESC, first_ord) AS place FROM g""")
def primary_source(spark, sf):
    from pyspark.sql import Window
    ranked = verify.primary_sources(obs_publishers(spark, sf), "Million").withColumn("mean_confidence", F.round("mean_confidence", 6))
    place = F.row_number().over(Window.orderBy(*verify.preference())).cast("bigint")
    return ranked.select("publisher", "cells", "observations", "mean_confidence", "first_ord", "unit_match", place.alias("place"))


# --- cleaning, statistics, revision ---------------------------------------------------------------------------------

REASON = f"""CASE WHEN {BLANK('entity')} OR {BLANK('date')} THEN 'missing entity or date' WHEN value < 0 AND regexp_matches(unit, '(?i)count') THEN 'negative count' END"""


@query("sanitize", f"WITH {OBS_DIRTY} SELECT ord, {REASON} AS reason FROM obs")
def sanitize(spark, sf):
    kept, dropped = cleaning.sanitize(_rows(spark, sf))
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(dropped).select("ord", "reason")


ASCII = "regexp_replace(regexp_replace(lower(entity), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query("build_observation", f"""WITH {OBS_DIRTY} SELECT 'obs_' || CASE WHEN ord < 100000 THEN lpad(ord::VARCHAR, 5, '0') ELSE ord::VARCHAR END AS observation_id,
 {ASCII} AS entity_id, value, CASE WHEN value IS NULL THEN 'UNKNOWN' ELSE coalesce(status, 'SUPPORTED') END AS status, coalesce(unit, 'count') AS unit,
 CASE WHEN regexp_matches(date, '^-?\\d{{1,5}}-\\d{{2}}-\\d{{2}}') THEN 'daily' WHEN regexp_matches(date, '^-?\\d{{1,5}}-\\d{{2}}$') THEN 'monthly'
 WHEN regexp_matches(date, '^-?\\d{{1,5}}-Q[1-4]$') THEN 'quarterly' WHEN regexp_matches(date, '^-?\\d{{1,5}}$') THEN 'annual' ELSE 'unknown' END AS frequency FROM obs""")
def build_observation(spark, sf):
    return cleaning.build_observations(_rows(spark, sf)).select("observation_id", "entity_id", "value", "status", "unit", "frequency")


@query("normalize_job", f"""WITH {OBS_DIRTY}, {PARSED}, {UNITS}, {KEYED} SELECT d.ord, coalesce(r.known, d.entity) AS entity, d.iso AS date, d.frequency, d.sort_key,
 CASE WHEN n.canonical = 'kg' THEN d.value * n.factor / 1000::DOUBLE ELSE d.value END AS value, CASE WHEN d.value IS NULL THEN 'UNKNOWN' ELSE coalesce(d.status, 'SUPPORTED') END AS status,
 CASE WHEN d.unit IS NULL THEN 'count' ELSE n.canonical END AS unit, CASE WHEN n.canonical = 'kg' AND d.value IS NOT NULL THEN n.factor END AS conversion_factor
 FROM dated d JOIN n ON n.ord = d.ord JOIN r ON r.ord = d.ord""")
def normalize_job(spark, sf):
    rows, _ = cleaning.normalize(_rows(spark, sf), dataset_unit="count", target_unit="tonnes")
    return rows.select("ord", "entity", "date", "frequency", "sort_key", "value", "status", "unit", "conversion_factor")


@query("normalize_dropped", f"WITH {OBS_DIRTY}, {PARSED} SELECT ord, date, 'unparsable-date' AS reason FROM obs WHERE ord NOT IN (SELECT ord FROM dated)")
def normalize_dropped(spark, sf):
    return cleaning.normalize(_rows(spark, sf))[1]


@query("drop_counters", f"""WITH {OBS_DIRTY}, {PARSED}, v AS (SELECT sort_key, {SLUG} AS e, count(*) AS c FROM dated WHERE value IS NOT NULL GROUP BY ALL)
 SELECT (SELECT count(*) FROM obs WHERE ord NOT IN (SELECT ord FROM dated)) AS dropped_unparsable_date, (SELECT count(*) FROM dated WHERE value IS NULL) AS dropped_missing_value,
 (SELECT count(*) FROM v WHERE c > 1) AS duplicate_cells""")
def drop_counters(spark, sf):
    from ..operators.ranking import drop_counters as counters, entity_cells
    return counters(entity_cells(_rows(spark, sf)))


@query("revision_topn", f"""WITH {OBS_DIRTY} SELECT ord, date, value, status FROM obs WHERE status IN ('VERIFIED', 'SUPPORTED', 'ESTIMATED') AND entity <> 'World'
 QUALIFY row_number() OVER (PARTITION BY date ORDER BY value DESC NULLS LAST, ord) <= 3""")
def revision_topn(spark, sf):
    obs = _rows(spark, sf).withColumn("entity_id", ascii_slug("entity"))
    return cleaning.revise(obs, ["VERIFIED", "SUPPORTED", "ESTIMATED"], ["world"], top_n=3).select("ord", "date", "value", "status")


@query("revision_annual", f"WITH {OBS_DIRTY} SELECT ord, date FROM obs WHERE regexp_matches(date, '^-?\\d{{1,5}}$')")
def revision_annual(spark, sf):
    return cleaning.revise(cleaning.build_observations(_rows(spark, sf)), annual_only=True).select("ord", "date")


@query("tape_input", f"WITH {OBS_DIRTY} SELECT count(*) AS excluded FROM obs WHERE status IN ('CONFLICTING', 'REJECTED')")
def tape_input(spark, sf):
    return cleaning.tape_input(_rows(spark, sf))[1]


@query("browse", f"WITH {OBS_DIRTY} SELECT ord, entity, date, value FROM obs WHERE value IS NOT NULL AND contains(lower(entity), 'customer') ORDER BY date DESC, ord LIMIT 300")
def browse(spark, sf):
    return cleaning.browse(_rows(spark, sf), 300, "Customer").select("ord", "entity", "date", "value")


@query("dataset_stats", f"""WITH {OBS_DIRTY} SELECT count(*) AS observations, count(DISTINCT {ASCII}) AS entities, count(*) FILTER (status = 'VERIFIED') AS verified,
 count(*) FILTER (status = 'SUPPORTED') AS supported, count(*) FILTER (status = 'ESTIMATED') AS estimated, count(*) FILTER (status = 'UNKNOWN') AS "unknown",
 count(*) FILTER (status = 'CONFLICTING') AS conflicting, count(*) FILTER (status = 'REJECTED') AS rejected FROM obs""")
def dataset_stats(spark, sf):
    return insight.dataset_stats(_rows(spark, sf).withColumn("entity_id", ascii_slug("entity")))


@query("majority_unit", f"""WITH {OBS_DIRTY} SELECT u AS unit FROM (SELECT ord, coalesce(nullif({trim('unit')}, ''), 'count') AS u FROM obs WHERE value IS NOT NULL) GROUP BY u
 ORDER BY count(*) DESC, u = 'count', min(ord) LIMIT 1""")
def majority_unit(spark, sf):
    return insight.majority_unit(_rows(spark, sf))


@query("time_range", f"WITH {OBS_DIRTY} SELECT min(y)::VARCHAR AS start, max(y)::VARCHAR AS \"end\" FROM (SELECT try_cast(regexp_extract({trim('date')}, '^(-?\\d{{1,5}})', 1) AS INT) AS y FROM obs)")
def time_range(spark, sf):
    return insight.observed_range(_rows(spark, sf))



@query("coverage", f"""WITH {OBS_DIRTY}, c AS (SELECT source, try_cast(regexp_extract({trim('date')}, '^(-?\\d{{1,5}})', 1) AS INT) AS y FROM obs WHERE value IS NOT NULL)
 SELECT source, min(y) AS year_from, max(y) AS year_to, max(y) - min(y) AS span FROM c WHERE y IS NOT NULL GROUP BY source""")
def coverage(spark, sf):
    return insight.coverage(_rows(spark, sf))


@query("widest_range", f"""WITH {OBS_PUBLISHERS}, c AS (SELECT source, min(date::INT) AS a, max(date::INT) AS b FROM obs_s WHERE value IS NOT NULL GROUP BY source)
 SELECT source, a AS year_from, b AS year_to, greatest(1990, a) AS use_from, least(1999, b) AS use_to FROM c ORDER BY b - a DESC, source LIMIT 1""")
def widest_range(spark, sf):
    return insight.widest_range(obs_publishers(spark, sf), 1990, 1999)


@query("distinct_leaders", f"""WITH {OBS_ORDERS} SELECT count(DISTINCT entity_id) AS distinct_leaders FROM (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY date ORDER BY value DESC, ord) = 1)""")
def distinct_leaders(spark, sf):
    return insight.distinct_leaders(obs_orders(spark, sf).withColumn("entity_id", slugify("entity")))


@query("distinct_sources", f"WITH {OBS_DIRTY} SELECT source_url, arg_max(source, ord) AS source FROM obs WHERE source IS NOT NULL GROUP BY source_url")
def distinct_sources(spark, sf):
    return insight.distinct_sources(_rows(spark, sf).filter("source is not null"))


@query("publisher_line", f"WITH {OBS_PUBLISHERS} SELECT DISTINCT source FROM obs_s")
def publisher_line(spark, sf):
    return insight.publisher_line(obs_publishers(spark, sf))


# --- raw tables to a dataset ------------------------------------------------------------------------------------------

BUILT = f"""WITH {VERIFIED} SELECT canonical AS entity_id, o.date, value, CASE outcome WHEN 'verified' THEN 'VERIFIED' ELSE status END AS status, source
 FROM obs_s o JOIN oc USING (canonical, date, base_unit) WHERE value IS NOT NULL AND ord = prim_ord
 UNION ALL SELECT canonical, date, value, status, source FROM obs_s WHERE value IS NULL AND pub = (SELECT pub FROM prim)"""


def _built(spark, sf):
    rows = obs_publishers(spark, sf)
    text = rows.select("ord", F.col("entity").alias("country"), F.col("date").alias("year"), F.col("value").cast("string").alias("total"), "source", "source_url")
    tables = [SourceTable(text.filter((F.col("source") == name) & (F.col("source_url") == url)).select("ord", "country", "year", "total"), name, url, unit, trust)
              for name, url, unit, trust in (("Ledger A", "https://www.a.test/1", "count", 0.8), ("Ledger B", "https://b.test/x", "million", 0.7),
                                             ("ledger a", "https://a.test/2", "count", 0.6))]
    return build_dataset(tables, "2026-01-01")


@query("dataset_build", BUILT)
def dataset_build(spark, sf):
    return _built(spark, sf).observations.select("entity_id", "date", "value", "status", "source")


@query("dataset_report", f"""WITH b AS ({BUILT}) SELECT 'duplicate' AS "check", 0::BIGINT AS violations, true AS passed UNION ALL
 SELECT unnest(['schema', 'type', 'date', 'unit', 'entity', 'range', 'source', 'temporal', 'ranking', 'rank-as-value', 'citation']), 0, true""")
def dataset_report(spark, sf):
    return _built(spark, sf).report()
