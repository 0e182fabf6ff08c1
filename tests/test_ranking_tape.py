import random

import pytest
from pyspark.sql import functions as F

from podium.operators import insight, ranking, tape
from podium.operators.ordering import first_rows, first_rows_spread, ranked_stage, with_previous


def test_desc_drops_missing(obs):
    r = ranking.rank_observations(obs([("China", "1990", 100.0), ("China", "1991", 110.0), ("India", "1990", 80.0), ("India", "1991", None)]))
    rows = {(x.entity, x.period_label): x.rank for x in r.rows().collect()}
    assert rows == {("China", "1990"): 1, ("India", "1990"): 2, ("China", "1991"): 1}
    assert r.counters().collect()[0].asDict() == {"dropped_unparsable_date": 0, "dropped_missing_value": 1, "duplicate_cells": 0}


def test_asc(obs):
    r = ranking.rank_observations(obs([("Switzerland", "1990", 36945.0), ("Burundi", "1990", 180.0), ("Malawi", "1990", 210.0)]), top_n=2, direction="ascending")
    assert [x.entity for x in r.rows().orderBy("rank").collect()] == ["Burundi", "Malawi"]
    assert r.entity_order().collect()[0].entity_id == "burundi"


def test_movers_and_duplicates(obs):
    rows = [("A", "2000", 1.0), ("A", "2001", 5.0), ("B", "2000", 2.0), ("B", "2001", 4.0), ("B", "2001-01", 3.0), ("B", "soon", 9.0)]
    r = ranking.rank_observations(obs(rows), mover_threshold=1)
    a = r.rows().filter("entity = 'A' and period_label = '2001'").collect()[0]
    assert (a.rank, a.rank_delta, a.is_mover) == (1, 1, True)
    b = r.rows().filter("entity = 'B' and period_label = '2001'").collect()[0]
    assert (b.value, b.status) == (4.0, "DUPLICATE")
    assert r.counters().collect()[0].asDict() == {"dropped_unparsable_date": 1, "dropped_missing_value": 0, "duplicate_cells": 1}


def test_delta_uses_full_ranks(obs):
    rows = [("A", "2000", 3.0), ("B", "2000", 2.0), ("C", "2000", 1.0), ("C", "2001", 9.0)]
    c = ranking.rank_observations(obs(rows), top_n=1).rows().filter("entity = 'C'").collect()[0]
    assert (c.rank, c.rank_delta) == (1, 2)


def test_names_are_first_seen_even_if_dropped(obs):
    rows = [("côte", "junk", 1.0), ("Côte", "2000", 2.0)]
    assert ranking.rank_observations(obs(rows), top_n=1).rows().collect()[0].entity == "côte"


def test_hot_period_is_ranked_across_tasks(spark):
    """A period with most of the rows spans tasks and still has ranks 1..n."""
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id") % 5).alias("p"), (F.col("id") % 97).cast("double").alias("v"), F.col("id").alias("e"))
    ranked = ranked_stage(df, ["p"], [F.col("v").desc(), F.col("e")])
    stats = ranked.groupBy("p").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("d")).collect()
    assert all(s.a == 1 and s.b == s.n == s.d for s in stats)
    want = {r["e"]: i + 1 for i, r in enumerate(sorted(df.filter("p = 1").collect(), key=lambda r: (-r["v"], r["e"])))}
    assert {r["e"]: r["rank"] for r in ranked.filter("p = 1").collect()} == want


def test_with_previous_across_tasks(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("x"), F.when(F.col("id") % 700 == 3, F.col("id")).alias("v"))
    out = with_previous(df, ["k"], [F.col("x")], F.col("v"), "last").orderBy("x").collect()
    last = None
    for r in out:
        assert r["last"] == last
        last = r["v"] if r["v"] is not None else last


def test_first_rows_large(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 30011).alias("v"))
    assert [r.v for r in first_rows(df, [F.col("v").desc()], 3).collect()] == sorted([r.v for r in df.collect()])[:-4:-1]
    got = sorted(r.v for r in first_rows_spread(df, [F.col("v").desc()], 10_500).collect())
    assert got == sorted((r.v for r in df.collect()), reverse=True)[:10_500][::-1]


def test_tape_of_two_entities(obs):
    rows = [(e, y, v) for e, vs in (("India", (10.0, 12.0, 14.0)), ("China", (5.0, 9.0, 20.0))) for y, v in zip(("2000", "2001", "2002"), vs)]
    t = tape.build_tape(ranking.rank_observations(obs(rows), top_n=10, mover_threshold=1), frames_per_transition=10)
    bars, frames = t.bars().collect(), t.frames().orderBy("frame_index").collect()
    assert [f.frame_index for f in frames] == list(range(30)) and frames[5].label == "2001" and frames[4].label == "2000"
    assert [f.is_period_boundary for f in frames].count(True) == 2
    first = [b for b in bars if b.frame_index == 0 and b.rank == 1][0]
    assert (first.entity_id, first.width) == ("india", 1.0)
    last = [b for b in bars if b.frame_index == 29 and b.rank == 1][0]
    assert last.entity_id == "china" and last.is_mover
    meta = {m.entity_id: m for m in t.entity_meta().collect()}
    assert meta["india"].flag_code == "in" and meta["india"].place == 0


def test_single_period_tape(obs):
    t = tape.build_tape(ranking.rank_observations(obs([("A", "2000", 4.0), ("B", "2000", 2.0)]), top_n=1), 3)
    assert {(b.frame_index, b.entity_id, b.value, b.held) for b in t.bars().collect()} == {(i, "a", 4.0, False) for i in range(6)}
    assert [f.t for f in t.frames().orderBy("frame_index").collect()][-1] == 1.0


def test_exact_final_hold(obs):
    rows = [("A", "2000", 4.0), ("A", "2001", 8.0), ("B", "2000", 5.0), ("B", "2001", 6.0)]
    t = tape.build_tape(ranking.rank_observations(obs(rows), top_n=2, mover_threshold=1), 2)
    got = {(b.frame_index, b.entity_id, b.value, b.rank, b.rank_delta, b.width) for b in t.bars(exact_final=True).filter("frame_index >= 2").collect()}
    assert got == {(i, *x) for i in (2, 3) for x in (("a", 8.0, 1, 1, 1.0), ("b", 6.0, 2, -1, 0.75))}


def test_carry_cap(obs):
    rows = [("A", str(y), 1.0) for y in range(2000, 2008)] + [("B", "2000", 5.0), ("B", "2002", 6.0)]
    t = tape.build_tape(ranking.rank_observations(obs(rows), top_n=5), 2, max_carry=2)
    b = {r.period_index: r.held for r in t.filled.filter("entity_id = 'b'").collect()}
    assert b == {0: False, 1: True, 2: False, 3: True, 4: True}


@pytest.mark.parametrize("direction, policy", [("desc", "carryForward"), ("asc", "carryForward"), ("desc", "strict"), ("asc", "strict")])
def test_pruned_tape_is_the_whole_tape(obs, direction, policy):
    rng = random.Random(direction + policy)
    rows = [(f"e{e}", str(2000 + y), float(rng.choice([rng.randint(-5, 40), 7]))) for e in range(25) for y in range(8) if rng.random() < 0.6]
    t = tape.build_tape(ranking.rank_observations(obs(rows), top_n=4, direction=direction), 6, policy=policy, fill_from="all")
    assert tape.tape_difference(t.bars(), t.bars(prune=False)).count() == 0


def test_events_and_facts(obs):
    rows = [("A", str(2000 + i), v) for i, v in enumerate((9.0, 9.0, 1.0, 1.0))] + [("B", str(2000 + i), v) for i, v in enumerate((8.0, 8.0, 8.0, 8.0))] + \
           [("C", str(2000 + i), v) for i, v in enumerate((7.0, 7.0, 7.0, 7.0))] + [("D", str(2000 + i), v) for i, v in enumerate((1.0, 1.0, 20.0, 20.0))]
    t = tape.build_tape(ranking.rank_observations(obs(rows), top_n=4), 2)
    events = insight.tape_events(insight.boundary_bars(t))
    kinds = {(e.period_index, e.kind, e.entity_id, e.from_rank) for e in events.collect()}
    assert kinds == {(0, "newcomer", x, None) for x in "abcd"} | {(2, "jump", "d", 4), (2, "overtake", "d", None)}
    with_last = insight.tape_events(insight.boundary_bars(t, include_last=True)).count()
    assert with_last == len(kinds)
    facts = insight.fact_sentences(insight.pick_facts(events, t.n_periods, 2), t.ranking.rows().select("entity_id", "entity").distinct(), t.ranking.periods(), "USD")
    assert [f.text for f in facts.orderBy("bucket").collect()] == ["2000: first appearance of A, in place 1 (9 USD).", "2002: D is the new number one (20 USD)."]


def test_trim_sparse_head(obs):
    schema = "ord bigint, entity_id string, date string, value double, status string"
    rows = [("us", "1963-01-01", 1.6, "SUPPORTED"), ("us", "1964-01-01", 1.5, "SUPPORTED")] + [(c, "1981-01-01", 80.0, "SUPPORTED") for c in "abcdefghij"]
    assert {r.date for r in tape.trim_sparse_head(obs(rows, schema), 10).collect()} == {"1981-01-01"}
    full = [(c, "2000-01-01", 1.0, "SUPPORTED") for c in "abc"]
    assert tape.trim_sparse_head(obs(full, schema), 10).count() == 3


def test_interpolation(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 100.0), ("a", 20.0, 50.0)], "entity_id string, x double, value double")
    moments = spark.createDataFrame([("a", x) for x in (-1.0, 0.0, 5.0, 10.0, 15.0, 99.0)], "entity_id string, x double")
    got = [r.value for r in tape.interpolate_at(points, moments).orderBy("x").collect()]
    assert got == [0.0, 0.0, 50.0, 100.0, 75.0, 50.0]


def test_logistic(spark):
    df = spark.createDataFrame([("a", 2000, 2010, 100.0)], "entity_id string, launch int, finish int, total double")
    got = [r.value for r in tape.logistic_spread(df, 2012).orderBy("year").collect()]
    assert got[-3:] == [100.0, 100.0, 100.0] and got == sorted(got) and len(got) == 12


def test_years_of_carry(obs):
    assert tape.carry_cap_in_periods(obs([("a", str(y), 1.0) for y in (1900, 1950, 2000)])).collect()[0].max_carry == 1
    assert tape.carry_cap_in_periods(obs([("a", str(y), 1.0) for y in (2000, 2001, 2002)])).collect()[0].max_carry == 10


@pytest.mark.parametrize("direction,policy,cap", [("desc", "carryForward", None), ("asc", "carryForward", 4), ("desc", "strict", 3)])
def test_fill_from_all_is_pruned_before_it_is_expanded(spark, direction, policy, cap):
    """The same bars as a fill of entities times periods gives, from far fewer rows."""
    rng = random.Random(5)
    rows = [(n, f"E{e}", str(1900 + y), float(rng.randrange(40 if e % 3 else 8))) for n, (e, y) in enumerate((e, y) for e in range(60) for y in range(90) if rng.random() < 0.06)]
    obs = spark.createDataFrame([(i, e, d, v) for i, e, d, v in rows], "ord bigint, entity string, date string, value double")
    ranked = ranking.rank_observations(obs, top_n=3, direction=direction)
    tapes = tape.build_tape(ranked, 5, policy, cap, fill_from="all")
    seen = ranked.plain.filter("n_valued > 0").join(ranked.periods().select("sort_key", "period_index"), "sort_key")
    whole = tape.forward_fill(seen.select("entity_id", "period_index", "value"), tapes.n_periods, cap)
    every = tape.Tape(ranked, whole, tapes.n_periods, 5, policy)
    assert tapes.filled.exceptAll(whole).count() == 0
    if cap is None:
        assert tapes.filled.count() < 0.4 * whole.count()
    assert tape.tape_difference(tapes.bars(), every.bars()).count() == 0 and every.bars().count() > 500
    assert tapes.boundary_ranks().exceptAll(every.boundary_ranks()).count() == every.boundary_ranks().exceptAll(tapes.boundary_ranks()).count() == 0
