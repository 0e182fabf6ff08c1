import json

from pyspark.sql import functions as F

from podium.operators import clean, insight, ranking, sourcing, tape
from podium.plans.dataset import SourceTable, build_dataset
from podium.session import shared_folder, write_stage
from podium.sources import write_nested_json


def test_nested_and_flat_forms(spark, tmp_path):
    rows = spark.createDataFrame([(1, "India", "2000", None), (2, "China", "2001", 2.0)], "ord bigint, entity string, date string, value double")
    obs = clean.build_observations(rows.withColumns({"source": F.lit("A"), "source_url": F.lit("https://a.test")}))
    write_nested_json(obs, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    india = next(x for x in lines if x["entity"]["name"] == "India")
    assert india["value"] is None and india["status"] == "UNKNOWN" and india["source"] == {"url": "https://a.test", "publisher": "A"}
    back = clean.to_core(spark.read.json(str(tmp_path / "out")))
    assert {(r.entity, r.value, r.source) for r in back.collect()} == {("India", None, "A"), ("China", 2.0, "A")}


def test_explicit_entity_metadata(spark, obs):
    t = tape.build_tape(ranking.rank_observations(obs([("India", "2000", 2.0), ("Nokia", "2000", 1.0)]), top_n=5), 2)
    given = spark.createDataFrame([("nokia", "Nokia Oyj", "#000000", "logo.svg", None, "Phones")], "entity_id string, name string, color string, logo string, image string, `group` string")
    meta = {m.entity_id: m for m in t.entity_meta(given).collect()}
    assert (meta["nokia"].entity, meta["nokia"].color, meta["nokia"].logo, meta["nokia"].group) == ("Nokia Oyj", "#000000", "logo.svg", "Phones")
    assert (meta["india"].entity, meta["india"].flag, meta["india"].group, meta["india"].color) == ("India", "\U0001F1EE\U0001F1F3", "Asia", "#2563eb")


def test_spotlights(obs):
    rows = [(e, str(y), float(v)) for y in range(1995, 2003) for e, v in (("A", 50), ("B", 40), ("C", 10 if y < 1999 else 60), ("D", 5))]
    t = tape.build_tape(ranking.rank_observations(obs(rows), top_n=4), 3)
    spots = {s.label: s for s in insight.spotlights(t, ["1995", "2000", "2002"], back=3).collect()}
    assert (spots["2000"].leader_id, spots["2000"].second_id, spots["2000"].climber_id, spots["2000"].climber_gain) == ("c", "a", "c", 2)
    assert spots["1995"].climber_id is None and spots["2002"].leader_id == "c"


def test_scalar_facts(obs):
    schema = "ord bigint, entity_id string, date string, value double, source string"
    df = obs([("a", "2000", 1.0, "s"), ("b", "2000", 2.0, "s"), ("a", "2001", 5.0, "t"), ("b", "2001", None, "t"), ("a", "-44", 1.0, "t")], schema)
    assert insight.distinct_leaders(df).collect()[0][0] == 2
    assert tuple(insight.observed_range(df).collect()[0]) == ("44 BC", "2001")
    wide = insight.widest_range(df, 1990, None).collect()[0]
    assert (wide.source, wide.use_from, wide.use_to) == ("t", 1990, 2001)


def test_decisions_and_tiers(spark):
    candidates = spark.createDataFrame([("a",), ("b",), ("c",)], "candidate_id string")
    decisions = spark.createDataFrame([("a", True, 1), ("b", False, 2)], "candidate_id string, accept boolean, pick int")
    got = {r.candidate_id: (r.accept, r.primary) for r in sourcing.apply_decisions(candidates, decisions).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (None, False)}


def test_tables_to_dataset(spark):
    wide = spark.createDataFrame([("USA", "100", "110"), ("Peru", "7", "-")], "country string, `2000` string, `2001` string")
    long = spark.createDataFrame([(0, "United States of America", "2000", "101"), (1, "Peru", "2000", "70"), (2, "Nowhere", "2000", "1")],
                                 "ord int, country string, year string, value string")
    data = build_dataset([SourceTable(wide, "A", "https://a.test/x"), SourceTable(long, "B", "https://b.test/y")], "2026-01-01", countries_only=True)
    rows = {(r.entity, r.date): (r.value, r.status, r.source) for r in data.observations.collect()}
    assert rows == {("United States", "2000"): (100.0, "VERIFIED", "A"), ("United States", "2001"): (110.0, "SUPPORTED", "A"), ("Peru", "2000"): (7.0, "SUPPORTED", "A")}
    assert data.verification.conflicts.count() == 1 and data.unit().collect()[0].unit == "count"
    assert data.report().filter("not passed").count() == 0
    assert data.tape(top_n=2, frames_per_transition=2).frames().count() == 4


def test_stage_reads_what_it_wrote(spark):
    df = spark.range(5).withColumn("x", F.rand())
    staged = write_stage(df, "random")
    assert staged.exceptAll(staged).count() == 0 and shared_folder(spark) in staged.inputFiles()[0]


def test_a_page_with_very_many_claims(spark):
    """The text meets rows of quotes, not claims; a page may be there twice, have no claims, or be missing."""
    pages = [(p, f"Page  {p} says " + " and ".join(f"item {i} is {i * 7}" for i in range(60))) for p in range(4)] + [(0, "something else")]
    claims = [(n, n % 3 and 0 or n % 6, f"e{n % 50}", "2020", float(n % 80 * 7), f"ITEM {n % 80}  is {n % 80 * 7}") for n in range(300)] + [(400, None, "x", "1", 7.0, "item 1 is 7"), (401, 1, "x", "1", 7.0, None)]
    pages = spark.createDataFrame(pages, "page_id bigint, text string")
    table = spark.createDataFrame(claims, "ord bigint, page_id bigint, entity string, date string, value double, quote string")
    text = {(r.page_id): [] for r in pages.collect()}
    for r in pages.collect():
        text[r.page_id].append(" ".join(r.text.lower().split()))
    for at_once in (4096, 3):
        got = {r.ord: r.dropped for r in sourcing.ground_claims(table, pages, at_once).collect()}
        assert len(got) == len(claims)
        for n, p, _, _, _, q in claims:
            q = " ".join((q or "").lower().split())
            absent = len(q) >= 8 and not any(q in t for t in text.get(p, []))
            assert (got[n] == "quote not in page") == absent and (got[n] == "short quote") == (len(q) < 8)
    joined = sourcing.quotes_in_pages(table, pages, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in joined and joined.count("collect_list") == 1


def test_links_of_one_run_and_host(spark):
    """Links that are beginnings of addresses, also inside an address, also with a part of a host."""
    links = [(1, f"https://h.test/{n}") for n in range(0, 2000, 3)] + [(1, "https://h.te"), (1, "https://in.test/x"), (1, "http://no.test"), (2, "https://h.test/1"), (1, "ftp://h.test/1"), (1, "HTTPS://h.test/5"), (None, "https://h.test/1")]
    pages = [(1, "a", " ".join(f"(HTTPS://h.test/{n})" for n in range(0, 1000, 2)) + " http://q.test?u=https://in.test/xyz"), (1, "http://no.test", "-"), (2, "b", None)]
    got = sourcing.grounded_links(spark.createDataFrame(links, "run_id bigint, url string"), spark.createDataFrame(pages, "run_id bigint, url string, text string"))
    low = {r: " ".join(t.lower() for q, _, t in pages if q == r and t) for r in (1, 2)}
    want = {(r, u) for r, u in links if r and u.startswith("http") and (u.lower() in low[r] or (r, u) == (1, "http://no.test"))}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 150
