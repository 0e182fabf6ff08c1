"""Ranking, tape and insight queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import insight, ranking, reranking, tape
from ..operators.quality import check_ranking
from ..session import shared_folder
from .catalogue import query
from .views import OBS_NATION_MONTH, OBS_ORDERS, OBS_USER_DAY, obs_nation_month, obs_orders, obs_user_day

N, STEPS = 10, 10

# --- SQL pieces -----------------------------------------------------------------------------------------------------


def cells_sql(extreme: str = "max", order: str = "DESC") -> str:
    return f"""cells AS (SELECT sort_key, entity_id, {extreme}(value) AS value, count(*) AS n, min(entity) AS entity,
  CASE WHEN count(*) > 1 THEN 'DUPLICATE' ELSE max(status) END AS status, min(label) AS label
  FROM obs WHERE value IS NOT NULL GROUP BY sort_key, entity_id),
 ranks AS (SELECT *, row_number() OVER (PARTITION BY sort_key ORDER BY value {order}, entity_id) AS rank FROM cells),
 deltas AS (SELECT *, lag(rank) OVER (PARTITION BY entity_id ORDER BY sort_key) - rank AS rank_delta FROM ranks),
 periods AS (SELECT sort_key, label, row_number() OVER (ORDER BY sort_key) - 1 AS period_index
  FROM (SELECT sort_key, min(label) AS label FROM cells GROUP BY sort_key))"""


def ranked_sql(obs: str, where: str = "TRUE", extreme: str = "max", order: str = "DESC") -> str:
    return f"""WITH {obs}, {cells_sql(extreme, order)}
 SELECT entity_id, sort_key, period_index, value, rank, rank_delta, coalesce(abs(rank_delta) >= 2, false) AS is_mover, status
 FROM deltas JOIN periods USING (sort_key) WHERE {where}"""


def tape_sql(obs: str, top_n: int = N, steps: int = STEPS, cap: int | None = None, strict: bool = False, asc: bool = False,
             source: str = "topn") -> str:
    """The whole tape without pruning, from the entity x period grid."""
    extreme, order = ("min", "ASC") if asc else ("max", "DESC")
    keep = "TRUE" if source == "all" else f"rank <= {top_n}"
    carry = f"AND (idx - last_seen) <= {cap}" if cap is not None else ""
    ends = "a IS NOT NULL AND b IS NOT NULL" if strict else "a IS NOT NULL OR b IS NOT NULL"
    return f"""WITH {obs}, {cells_sql(extreme, order)},
 seen AS (SELECT entity_id, period_index AS idx, value FROM ranks JOIN periods USING (sort_key) WHERE {keep}),
 size_ AS (SELECT count(*) AS n FROM periods),
 grid AS (SELECT entity_id, period_index AS idx FROM (SELECT DISTINCT entity_id FROM seen), periods),
 filled0 AS (SELECT g.entity_id, g.idx, s.value IS NULL AS held,
   last_value(s.value IGNORE NULLS) OVER (PARTITION BY g.entity_id ORDER BY g.idx) AS value,
   max(CASE WHEN s.value IS NOT NULL THEN g.idx END) OVER (PARTITION BY g.entity_id) AS last_seen
   FROM grid g LEFT JOIN seen s ON g.entity_id = s.entity_id AND g.idx = s.idx),
 filled AS (SELECT entity_id, idx, value, held FROM filled0 WHERE value IS NOT NULL {carry}),
 boundary AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY value {order}, entity_id) AS rank FROM filled),
 ends AS (SELECT coalesce(x.entity_id, y.entity_id) AS entity_id, coalesce(x.idx, y.idx - 1) AS tr, x.value AS a, y.value AS b,
   coalesce(x.held, true) OR coalesce(y.held, true) AS held
   FROM filled x FULL JOIN filled y ON x.entity_id = y.entity_id AND y.idx = x.idx + 1),
 drawn0 AS (SELECT entity_id, tr, k, held, coalesce(a, b) + (coalesce(b, a) - coalesce(a, b)) * (k / {steps}::DOUBLE) AS value
   FROM ends, (SELECT unnest(generate_series(0, {steps - 1})) AS k), size_ WHERE tr >= 0 AND tr < n - 1 AND ({ends})),
 drawn AS (SELECT tr * {steps} + k AS frame_index, *, row_number() OVER (PARTITION BY tr, k ORDER BY value {order}, entity_id) AS rank
   FROM drawn0),
 moving AS (SELECT d.*, greatest(max(d.value) OVER (PARTITION BY frame_index), 2.220446049250313e-16::DOUBLE) AS max_value,
   b.rank AS previous_rank FROM (SELECT * FROM drawn WHERE rank <= {top_n}) d
   LEFT JOIN (SELECT * FROM boundary WHERE rank <= {top_n}) b ON b.entity_id = d.entity_id AND b.idx = d.tr),
 bars AS (SELECT * FROM moving UNION ALL SELECT m.* REPLACE (m.frame_index + h AS frame_index)
   FROM moving m, size_, (SELECT unnest(generate_series(1, {steps})) AS h) WHERE m.frame_index = (n - 1) * {steps} - 1)"""


BARS = """ SELECT frame_index, entity_id, value, rank, previous_rank, value / max_value AS width, held,
 previous_rank - rank AS rank_delta, coalesce(abs(previous_rank - rank) >= 2, false) AS is_mover FROM bars"""


def _bars(t: tape.Tape, **options):
    return t.bars(**options).select("frame_index", "entity_id", "value", "rank", "previous_rank", "width", "held", "rank_delta", "is_mover")


def _ranked(r: ranking.Ranking):
    return r.rows().select("entity_id", "sort_key", "period_index", "value", "rank", "rank_delta", "is_mover", "status")


def _nation_tape(spark, sf, direction="desc", **options):
    return tape.build_tape(ranking.rank_observations(obs_nation_month(spark, sf), N, direction=direction), STEPS, **options)


def _user_tape(spark, sf, **options):
    return tape.build_tape(ranking.rank_observations(obs_user_day(spark, sf), N), STEPS, **options)


# --- ranking --------------------------------------------------------------------------------------------------------


@query("rank_delta_mover", ranked_sql(OBS_NATION_MONTH, f"rank <= {N}"))
def rank_delta_mover(spark, sf):
    return _ranked(ranking.rank_observations(obs_nation_month(spark, sf), N))


@query("rank_desc", ranked_sql(OBS_ORDERS))
def rank_desc(spark, sf):
    return _ranked(ranking.rank_observations(obs_orders(spark, sf)))


@query("rank_asc", ranked_sql(OBS_ORDERS, "rank <= 5", "min", "ASC"))
def rank_asc(spark, sf):
    return _ranked(ranking.rank_observations(obs_orders(spark, sf), 5, direction="asc"))


@query("topn_per_period", f"""WITH {OBS_ORDERS}, {cells_sql()}
 SELECT sort_key, entity_id, value, status, rank FROM ranks WHERE rank <= 3""")
def topn_per_period(spark, sf):
    return ranking.top_per_period(obs_orders(spark, sf), 3)


@query("cell_dedupe", f"WITH {OBS_ORDERS}, {cells_sql()} SELECT sort_key, entity_id, value, n AS n_valued, status FROM cells")
def cell_dedupe(spark, sf):
    return ranking.entity_cells(obs_orders(spark, sf)).select("sort_key", "entity_id", "value", "n_valued", "status")


@query("period_meta", f"""WITH {OBS_ORDERS}, {cells_sql()} SELECT period_index, sort_key, label, 'monthly' AS frequency,
 (sort_key // 10000) || '-' || lpad((sort_key // 100 % 100)::VARCHAR, 2, '0') AS iso FROM periods""")
def period_meta(spark, sf):
    return ranking.period_table(ranking.entity_cells(obs_orders(spark, sf)))


@query("entity_order", f"""WITH {OBS_NATION_MONTH}, {cells_sql()} SELECT entity_id, round(sum(value), 2) AS total,
 row_number() OVER (ORDER BY sum(value) DESC, entity_id) AS place FROM ranks WHERE rank <= {N} GROUP BY entity_id""")
def entity_order(spark, sf):
    order = ranking.rank_observations(obs_nation_month(spark, sf), N).entity_order()
    from pyspark.sql import Window
    place = F.row_number().over(Window.orderBy(F.col("total").desc(), "entity_id")).cast("bigint")
    return order.select("entity_id", F.round("total", 2).alias("total"), place.alias("place"))


# --- tape -----------------------------------------------------------------------------------------------------------


@query("tape_bars_carry", tape_sql(OBS_NATION_MONTH) + BARS)
def tape_bars_carry(spark, sf):
    return _bars(_nation_tape(spark, sf))


@query("tape_bars_gaps", tape_sql(OBS_USER_DAY) + BARS)
def tape_bars_gaps(spark, sf):
    return _bars(_user_tape(spark, sf))


@query("tape_bars_strict", tape_sql(OBS_USER_DAY, strict=True) + BARS)
def tape_bars_strict(spark, sf):
    return _bars(_user_tape(spark, sf, policy="strict"))


@query("tape_bars_asc", tape_sql(OBS_NATION_MONTH, asc=True) + BARS)
def tape_bars_asc(spark, sf):
    return _bars(_nation_tape(spark, sf, direction="asc"))


@query("tape_fill_all", tape_sql(OBS_USER_DAY, source="all") + BARS)
def tape_fill_all(spark, sf):
    return _bars(_user_tape(spark, sf, fill_from="all"))


@query("fill_forward", tape_sql(OBS_USER_DAY) + " SELECT entity_id, idx AS period_index, value, held FROM filled")
def fill_forward(spark, sf):
    return _user_tape(spark, sf).filled


@query("carry_cap", tape_sql(OBS_USER_DAY, cap=3) + " SELECT entity_id, idx AS period_index, value, held FROM filled")
def carry_cap(spark, sf):
    return _user_tape(spark, sf, max_carry=3).filled


@query("boundary_ranks", tape_sql(OBS_USER_DAY) + f" SELECT entity_id, idx AS period_index, value, rank FROM boundary WHERE rank <= {N}")
def boundary_ranks(spark, sf):
    return _user_tape(spark, sf).boundary_ranks().select("entity_id", "period_index", "value", "rank")


@query("tape_final_hold", tape_sql(OBS_NATION_MONTH) + f""" SELECT frame_index, entity_id, value, rank FROM bars, size_
 WHERE frame_index >= (n - 1) * {STEPS}""")
def tape_final_hold(spark, sf):
    t = _nation_tape(spark, sf)
    return t.bars().filter(F.col("frame_index") > t.last_moving_frame).select("frame_index", "entity_id", "value", "rank")


@query("tape_frames_meta", tape_sql(OBS_NATION_MONTH) + f""", steps_ AS (SELECT unnest(generate_series(0, {STEPS - 1})) AS k),
 f AS (SELECT p.period_index * {STEPS} + k AS frame_index, CASE WHEN k / {STEPS}::DOUBLE < 0.5 THEN p.label ELSE q.label END AS label,
   p.label AS from_label, q.label AS to_label, k / {STEPS}::DOUBLE AS t, k = 0 AS is_period_boundary
   FROM periods p JOIN periods q ON q.period_index = p.period_index + 1, steps_
   UNION ALL SELECT (n - 1) * {STEPS} + k, label, label, label, 1.0::DOUBLE, false FROM periods, size_, steps_ WHERE period_index = n - 1)
 SELECT f.*, max_value FROM f LEFT JOIN (SELECT DISTINCT frame_index, max_value FROM bars) USING (frame_index)""")
def tape_frames_meta(spark, sf):
    return _nation_tape(spark, sf).frames()


@query("tape_notes", tape_sql(OBS_USER_DAY) + """ SELECT (SELECT count(*) FROM moving WHERE held) AS held_bar_frames,
 0 AS dropped_unparsable_date, 0 AS dropped_missing_value, (SELECT count(*) FROM cells WHERE n > 1) AS duplicate_cells""")
def tape_notes(spark, sf):
    return _user_tape(spark, sf).notes()


@query("tape_entity_meta", f"""WITH {OBS_NATION_MONTH}, {cells_sql()}, o AS (SELECT entity_id, min(entity) AS entity,
 row_number() OVER (ORDER BY sum(value) DESC, entity_id) - 1 AS place FROM ranks WHERE rank <= {N} GROUP BY entity_id)
 SELECT entity_id, entity, place, list_extract(['#2563eb', '#dc2626', '#f59e0b', '#059669', '#7c3aed', '#0891b2', '#db2777', '#65a30d',
 '#ea580c', '#4338ca', '#0d9488', '#b91c1c', '#4d7c0f', '#9333ea', '#0369a1', '#c2410c', '#1e40af', '#be123c', '#a16207', '#15803d',
 '#6d28d9', '#0e7490', '#9d174d', '#3f6212'], place % 24 + 1) AS color FROM o""")
def tape_entity_meta(spark, sf):
    return _nation_tape(spark, sf).entity_meta().select("entity_id", "entity", "place", "color")


@query("tape_max", tape_sql(OBS_NATION_MONTH) + " SELECT max(value) AS max_value FROM bars")
def tape_max(spark, sf):
    return insight.tape_max(_nation_tape(spark, sf).bars())


@query("tape_diff", tape_sql(OBS_USER_DAY, cap=2) + f""", other AS (SELECT entity_id, idx FROM filled0 WHERE value IS NOT NULL)
 SELECT count(*) AS rows_only_in_longer FROM other o WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.entity_id = o.entity_id AND f.idx = o.idx)""")
def tape_diff(spark, sf):
    longer, shorter = _user_tape(spark, sf).filled, _user_tape(spark, sf, max_carry=2).filled
    return tape.tape_difference(longer, shorter).filter("side = 'left'").agg(F.count("*").alias("rows_only_in_longer"))


@query("tape_pruning", tape_sql(OBS_USER_DAY) + " SELECT 0 AS differing_bars FROM size_")
def tape_pruning(spark, sf):
    t = _user_tape(spark, sf)
    return tape.tape_difference(_bars(t), _bars(t, prune=False)).agg(F.count("*").alias("differing_bars"))


@query("carry_cap_years", f"""WITH {OBS_NATION_MONTH}, y AS (SELECT DISTINCT substr(date, 1, 4)::INT AS y FROM obs),
 s AS (SELECT count(*) AS n, max(y) - min(y) AS span FROM y) SELECT greatest(1, floor(10::DOUBLE / greatest(1::DOUBLE,
 (CASE WHEN n > 1 THEN span ELSE 1 END)::DOUBLE / greatest(1, n - 1)) + 0.5))::BIGINT AS max_carry FROM s""")
def carry_cap_years(spark, sf):
    return tape.carry_cap_in_periods(obs_nation_month(spark, sf))


# --- insight -----------------------------------------------------------------------------------------------------------

EVENTS = """, b AS (SELECT tr AS idx, entity_id, rank, value FROM moving WHERE k = 0),
 h AS (SELECT *, lag(idx) OVER w AS before, lag(rank) OVER w AS was FROM b WINDOW w AS (PARTITION BY entity_id ORDER BY idx)),
 l AS (SELECT *, lag(entity_id) OVER (ORDER BY idx) AS led FROM b WHERE rank = 1),
 events_ AS (SELECT idx AS period_index, 'newcomer' AS kind, entity_id, rank, value, NULL::BIGINT AS from_rank FROM h WHERE before IS NULL
  UNION ALL SELECT idx, 'jump', entity_id, rank, value, was FROM h WHERE before = idx - 1 AND was - rank >= 3
  UNION ALL SELECT idx, 'overtake', entity_id, rank, value, NULL FROM l WHERE led <> entity_id)"""


@query("tape_events", tape_sql(OBS_NATION_MONTH) + EVENTS + " SELECT * FROM events_")
def tape_events(spark, sf):
    return insight.tape_events(insight.boundary_bars(_nation_tape(spark, sf)))


FACTS = EVENTS + """, scored AS (SELECT *, CASE kind WHEN 'overtake' THEN 110 - rank WHEN 'newcomer' THEN 60 - rank ELSE 30 + from_rank - rank END AS interest,
 (SELECT max(b_) FROM (SELECT unnest(generate_series(0, 7)) AS b_), size_ WHERE (b_ * n) // 8 <= period_index) AS bucket FROM events_),
 facts AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY interest DESC, period_index,
  CASE WHEN kind = 'overtake' THEN 1 ELSE 0 END, rank) = 1)"""


@query("fact_picker", tape_sql(OBS_NATION_MONTH) + FACTS + """, names AS (SELECT DISTINCT entity_id, entity FROM obs),
 told AS (SELECT facts.*, entity, label, CASE WHEN value >= 1e6 THEN printf('%.1fM USD', value / 1e6) WHEN value >= 1e3
  THEN printf('%.1fK USD', value / 1e3) ELSE floor(value + 0.5)::BIGINT || ' USD' END AS amount
  FROM facts JOIN names USING (entity_id) JOIN periods p ON p.period_index = facts.period_index)
 SELECT bucket, period_index, kind, entity_id, rank, from_rank, CASE kind
  WHEN 'newcomer' THEN label || ': first appearance of ' || entity || ', in place ' || rank || ' (' || amount || ').'
  WHEN 'jump' THEN label || ': ' || entity || ' moves up from place ' || from_rank || ' to place ' || rank || '.'
  ELSE label || ': ' || entity || ' is the new number one (' || amount || ').' END AS text FROM told""")
def fact_picker(spark, sf):
    t = _nation_tape(spark, sf)
    facts = insight.pick_facts(insight.tape_events(insight.boundary_bars(t)), t.n_periods, 8)
    names = t.ranking.rows().select("entity_id", "entity").distinct()
    told = insight.fact_sentences(facts, names, t.ranking.periods(), "USD")
    return told.select("bucket", "period_index", "kind", "entity_id", "rank", "from_rank", "text")


SPOTS = ["01/1996", "06/1998", "01/2000", "08/2001"]


@query("decade_spotlights", tape_sql(OBS_NATION_MONTH) + f""", marks AS (SELECT label, CASE WHEN label = '{SPOTS[-1]}' THEN n * {STEPS} - 1
   ELSE least(period_index * {STEPS}, n * {STEPS} - 1) END AS f, least(greatest(0, period_index - 10) * {STEPS}, n * {STEPS} - 1) AS g
   FROM periods, size_ WHERE label IN ('{"', '".join(SPOTS)}')),
 m AS (SELECT label, x.entity_id, x.rank, x.value, coalesce(y.rank, {N + 5}) - x.rank AS gain FROM marks JOIN bars x ON x.frame_index = f
   LEFT JOIN bars y ON y.frame_index = g AND y.entity_id = x.entity_id)
 SELECT label, max(entity_id) FILTER (rank = 1) AS leader_id, max(value) FILTER (rank = 1) AS leader_value,
   max(entity_id) FILTER (rank = 2) AS second_id, max(entity_id) FILTER (rank = 3) AS third_id,
   max_by(entity_id, gain * 1000 - rank) FILTER (gain > 0) AS climber_id, max(gain) FILTER (gain > 0) AS climber_gain FROM m GROUP BY label""")
def decade_spotlights(spark, sf):
    return insight.spotlights(_nation_tape(spark, sf), SPOTS)


@query("group_totals", tape_sql(OBS_NATION_MONTH) + """, g AS (SELECT lower(replace(n_name, '_', '-')) AS entity_id, CASE WHEN n_nationkey % 6 <> 5
   THEN r_name END AS grp FROM nation JOIN region ON n_regionkey = r_regionkey),
 s AS (SELECT frame_index, coalesce(grp, 'Other') AS "group", sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM bars LEFT JOIN g USING (entity_id) GROUP BY ALL)
 SELECT frame_index, "group", cents, row_number() OVER (PARTITION BY frame_index ORDER BY cents DESC, "group") AS place FROM s
 QUALIFY place <= 5""")
def group_totals(spark, sf):
    from .views import load
    region = load(spark, sf, "region")
    groups = load(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("entity_id"),
        F.when(F.col("n_nationkey") % 6 != 5, F.col("r_name")).alias("group"))
    bars = _nation_tape(spark, sf).bars().withColumn("value", F.round(F.col("value") * 100).cast("bigint"))
    return insight.group_totals(bars, groups).select("frame_index", "group", F.col("value").alias("cents"), "place")


@query("leaders", tape_sql(OBS_NATION_MONTH) + " SELECT tr AS period_index, entity_id, value FROM moving WHERE k = 0 AND rank = 1")
def leaders(spark, sf):
    return insight.leaders(insight.boundary_bars(_nation_tape(spark, sf)))


@query("last_frame_movers", tape_sql(OBS_USER_DAY) + f""" SELECT entity_id, rank, previous_rank - rank AS rank_delta FROM bars, size_
 WHERE frame_index = n * {STEPS} - 1 AND abs(previous_rank - rank) >= 1""")
def last_frame_movers(spark, sf):
    ranked = ranking.rank_observations(obs_user_day(spark, sf), N, mover_threshold=1)
    return insight.last_frame_movers(tape.build_tape(ranked, STEPS))


@query("q_ranking", f"""WITH {OBS_ORDERS}, {cells_sql()}, holed AS (SELECT * FROM ranks WHERE NOT (rank = 2 AND sort_key // 100 % 2 = 0))
 SELECT 'ranking' AS "check", sort_key::VARCHAR AS detail, 1 AS n FROM holed GROUP BY sort_key HAVING count(*) <> max(rank)""")
def q_ranking(spark, sf):
    """Ranks of all cells, with second places missing in every other month."""
    ranked = ranking.rank_observations(obs_orders(spark, sf)).cells
    return check_ranking(ranked.filter(~((F.col("rank") == 2) & (F.floor(F.col("sort_key") / 100) % 2 == 0))))


@query("scorecard", f"""WITH {OBS_USER_DAY}, f AS (SELECT count(*) AS o, count(DISTINCT date) AS d, count(DISTINCT entity_id) AS e,
 (SELECT count(DISTINCT entity_id) FROM (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY date ORDER BY value DESC, ord) = 1)) AS l FROM obs),
 s AS (SELECT o AS observations, d AS distinct_dates, e AS entities, l AS distinct_leaders, least(1.0::DOUBLE, o / 400::DOUBLE) AS data_completeness,
 least(1.0::DOUBLE, d / 40::DOUBLE) AS historical_depth, 0.7::DOUBLE AS source_quality, least(1.0::DOUBLE, e / 15::DOUBLE) AS entity_count,
 least(1.0::DOUBLE, e / 10::DOUBLE) AS visual_potential, least(1.0::DOUBLE, l / 5::DOUBLE) AS change_frequency,
 least(1.0::DOUBLE, e / 8::DOUBLE) AS audience_clarity, least(1.0::DOUBLE, d / 25::DOUBLE) AS update_potential FROM f)
 SELECT *, (data_completeness + historical_depth + source_quality + entity_count + visual_potential + change_frequency + audience_clarity
 + update_potential) / 8::DOUBLE AS mean_score FROM s""")
def scorecard(spark, sf):
    from ..functions import slugify
    return insight.scorecard(obs_user_day(spark, sf).withColumn("entity_id", slugify("entity")), 0.7)


SPARSE = """e AS (SELECT o_orderkey AS ord, 'c' || o_custkey AS entity_id, year(o_orderdate) AS y, CASE WHEN year(o_orderdate) >= 1997 OR o_custkey < 3 THEN o_totalprice END AS value,
 CASE WHEN o_orderkey % 5 = 0 THEN 'REJECTED' ELSE 'SUPPORTED' END AS status FROM orders),
 p AS (SELECT y, count(DISTINCT entity_id) AS n FROM e WHERE status <> 'REJECTED' AND value IS NOT NULL GROUP BY y),
 w AS (SELECT greatest(2, least(10, (SELECT count(DISTINCT entity_id) FROM e WHERE status <> 'REJECTED' AND value IS NOT NULL))) AS wanted),
 s AS (SELECT min(CASE WHEN n >= wanted THEN y END) AS full_, min(y) AS head FROM p, w)"""


def _sparse(spark, sf):
    """Orders whose values before 1997 are known for two customers only."""
    from .views import load
    told = (F.year("o_orderdate") >= 1997) | (F.col("o_custkey") < 3)
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity_id"),
        F.year("o_orderdate").cast("string").alias("date"), F.when(told, F.col("o_totalprice")).alias("value"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("REJECTED")).otherwise(F.lit("SUPPORTED")).alias("status"))


@query("trim_sparse_head", f"""WITH {SPARSE} SELECT ord, entity_id, y::VARCHAR AS date, value, status FROM e, s WHERE full_ IS NULL OR full_ = head OR y >= full_""")
def trim_sparse_head(spark, sf):
    return tape.trim_sparse_head(_sparse(spark, sf), 10)


@query("sparse_head", f"""WITH {SPARSE} SELECT CASE WHEN full_ > head THEN full_ END AS kept_from, head AS first_year,
 CASE WHEN full_ > head THEN (SELECT count(*) FROM p WHERE y < full_) ELSE 0 END AS dropped_periods FROM s""")
def sparse_head(spark, sf):
    return tape.sparse_head(_sparse(spark, sf), 10)


@query("interpolate_irregular", f"""WITH pts AS (SELECT user_id, epoch_us(ts) // 3600000000 AS x, value FROM events
   QUALIFY row_number() OVER (PARTITION BY user_id, x ORDER BY event_id) = 1),
 seg AS (SELECT *, lead(x) OVER w AS x2, lead(value) OVER w AS v2 FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY x)),
 mom AS (SELECT user_id, 473352 + 12 * unnest(generate_series(0, 59)) AS x FROM (SELECT DISTINCT user_id FROM events))
 SELECT 'user ' || m.user_id AS entity_id, m.x, CASE WHEN s.x IS NULL THEN 0 WHEN s.x2 IS NULL OR m.x = s.x THEN s.value
   ELSE s.value + (s.v2 - s.value) * ((m.x - s.x)::DOUBLE / (s.x2 - s.x)::DOUBLE) END AS value
 FROM mom m ASOF LEFT JOIN seg s ON m.user_id = s.user_id AND m.x >= s.x""")
def interpolate_irregular(spark, sf):
    from .views import load
    e = load(spark, sf, "events").select("event_id", "user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("x"), "value")
    points = e.groupBy("user_id", "x").agg(F.min_by("value", "event_id").alias("value"))
    named = F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("entity_id")
    moments = e.select("user_id").distinct().select(named, F.explode(F.sequence(F.lit(473352).cast("bigint"), F.lit(473352 + 59 * 12).cast("bigint"), F.lit(12).cast("bigint"))).alias("x"))
    return tape.interpolate_at(points.select(named, "x", "value"), moments)


@query("logistic_spread", """WITH p AS (SELECT p_name || p_partkey AS entity_id, 1990 + p_size % 20 AS launch, 1990 + p_size % 20 + p_partkey % 13 AS finish,
 p_retailprice AS total FROM part), y AS (SELECT *, unnest(generate_series(launch, 2012)) AS year FROM p),
 u AS (SELECT *, (year - launch)::DOUBLE / greatest(1, finish - launch) AS u FROM y),
 g AS (SELECT *, (1 / (1 + exp(-10::DOUBLE * (u - 0.35::DOUBLE))) - 1 / (1 + exp(-10::DOUBLE * (0 - 0.35::DOUBLE))))
   / (1 / (1 + exp(-10::DOUBLE * (1 - 0.35::DOUBLE))) - 1 / (1 + exp(-10::DOUBLE * (0 - 0.35::DOUBLE)))) AS g FROM u)
 SELECT entity_id, year, CASE WHEN year >= finish THEN total ELSE round(total * g, 2) END AS value FROM g
 WHERE CASE WHEN year >= finish THEN total ELSE round(total * g, 2) END > 0""")
def logistic_spread(spark, sf):
    from .views import load
    launch = F.lit(1990) + F.col("p_size") % 20
    totals = load(spark, sf, "part").select(
        F.concat("p_name", F.col("p_partkey").cast("string")).alias("entity_id"), launch.cast("int").alias("launch"),
        (launch + F.col("p_partkey") % 13).cast("int").alias("finish"), F.col("p_retailprice").alias("total"))
    return tape.logistic_spread(totals, 2012)


# --- a written ranking after a revision -----------------------------------------------------------------------------

_REVISED = f"""{OBS_ORDERS}, c AS (SELECT sort_key, entity_id, max(value) AS value FROM obs GROUP BY ALL),
 m AS (SELECT *, (sort_key // 100) % 100 = 3 AS march, right(entity_id, 1) AS digit FROM c),
 r AS (SELECT sort_key, entity_id, CASE WHEN march AND digit IN ('1', '2') THEN value * 2 ELSE value END AS value FROM m WHERE NOT (march AND digit = '0')
  UNION ALL SELECT DISTINCT sort_key, 'newcomer', 500000::DOUBLE FROM m WHERE march),
 k AS (SELECT *, row_number() OVER (PARTITION BY sort_key ORDER BY value DESC, entity_id) AS rank FROM r),
 now AS (SELECT *, lag(rank) OVER (PARTITION BY entity_id ORDER BY sort_key) - rank AS rank_delta FROM k)"""


def _revised(spark, sf):
    """Full ranks of customers per month, written, then revised in every March: values doubled, cells removed, a newcomer added."""
    path = f"{shared_folder(spark)}/ranks-{uuid.uuid4().hex}"
    cells = ranking.entity_cells(obs_orders(spark, sf)).select("sort_key", "entity_id", "value")
    reranking.write_ranking(cells, path)
    march = reranking.read_ranking(spark, path).filter(F.floor(F.col("sort_key") / 100) % 100 == 3)
    digit = F.substring("entity_id", -1, 1)
    changed = march.select("sort_key", "entity_id", F.when(digit == "0", None).when(digit.isin("1", "2"), F.col("value") * 2).otherwise(F.col("value")).alias("value"))
    added = march.select("sort_key").distinct().select("sort_key", F.lit("newcomer").alias("entity_id"), F.lit(500000.0).alias("value"))
    return reranking.revise_ranking(spark, path, changed.unionByName(added).withColumn("ord", F.lit(0)))


@query("rerank_revision", f"WITH {_REVISED} SELECT sort_key, entity_id, value, rank, rank_delta FROM now")
def rerank_revision(spark, sf):
    return _revised(spark, sf).select("sort_key", "entity_id", "value", "rank", "rank_delta")


@query("rerank_versions", f"""WITH {_REVISED}, was AS (SELECT *, lag(rank) OVER (PARTITION BY entity_id ORDER BY sort_key) - rank AS rank_delta
  FROM (SELECT *, row_number() OVER (PARTITION BY sort_key ORDER BY value DESC, entity_id) AS rank FROM c)),
 diff AS (SELECT DISTINCT coalesce(now.sort_key, was.sort_key) AS sort_key FROM now FULL JOIN was ON now.sort_key = was.sort_key AND now.entity_id = was.entity_id
  WHERE now.value IS DISTINCT FROM was.value OR now.rank IS DISTINCT FROM was.rank OR now.rank_delta IS DISTINCT FROM was.rank_delta)
 SELECT sort_key, CASE WHEN sort_key IN (SELECT sort_key FROM diff) THEN 2 ELSE 1 END::BIGINT AS version, count(*) AS n FROM now GROUP BY ALL""")
def rerank_versions(spark, sf):
    """Only periods in which something differs are written by the revision."""
    return _revised(spark, sf).groupBy("sort_key", "version").agg(F.count("*").alias("n"))
