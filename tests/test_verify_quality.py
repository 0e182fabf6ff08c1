import pytest
from pyspark.sql import functions as F

from podium.operators import clean, entities, insight, quality, verify

SCHEMA = ("ord bigint, entity string, entity_id string, date string, value double, unit string, status string, confidence double, source string, "
          "source_url string")


@pytest.fixture
def told(spark):
    def make(*rows):
        data = []
        for i, r in enumerate(rows):
            entity, date, value, pub, unit = (*r, *("https://a.test", "count")[len(r) - 3:]) if len(r) < 5 else r
            url = pub if pub.startswith("http") else f"https://{pub}"
            name = url.split("/")[2][0].upper()
            data.append((i, entity, entity.lower(), date, value, unit, "UNKNOWN" if value is None else "SUPPORTED", 0.5, name, url))
        return spark.createDataFrame(data, SCHEMA)
    return make


def outcome(result):
    return sorted((r.entity_id, r.date, r.value, r.status) for r in result.observations.collect())


def test_agreement_is_verified(told):
    r = verify.verify_across_sources(told(("India", "2000", 100.0, "a.test"), ("India", "2000", 101.0, "b.test")))
    assert outcome(r) == [("india", "2000", 100.0, "VERIFIED")] and r.conflicts.count() == 0
    assert abs(r.observations.collect()[0].confidence - 0.85) < 1e-9


def test_disagreement_conflicts(told):
    r = verify.verify_across_sources(told(("India", "2000", 100.0, "a.test"), ("India", "2000", 140.0, "b.test")))
    assert [o[3] for o in outcome(r)] == ["CONFLICTING"] * 2
    assert r.conflicts.count() == 1 and r.candidates.count() == 2


def test_one_publisher_is_not_corroboration(told):
    r = verify.verify_across_sources(told(("India", "2000", 100.0, "https://a.test/1"), ("India", "2000", 100.0, "https://a.test/2")))
    assert outcome(r) == [("india", "2000", 100.0, "SUPPORTED")]


def test_scale_words_and_spellings(told):
    r = verify.verify_across_sources(told(("USA", "2000", 1.2, "a.test", "million"), ("United States of America", "2000", 1200000.0, "b.test", "count")))
    assert outcome(r) == [("united-states", "2000", 1.2, "VERIFIED")]


def test_unit_mismatch(told):
    obs = told(("India", "2000", 100.0, "a.test", "count"), ("India", "2000", 10.0, "b.test", "percent"))
    assert verify.verify_across_sources(obs).conflicts.count() == 0
    assert verify.unit_mismatches(obs).count() == 1


def test_negative_and_zero(told):
    r = verify.verify_across_sources(told(("India", "2000", -100.0, "a.test"), ("India", "2000", -105.2, "b.test"), ("China", "2000", 0.0, "a.test"), ("China", "2000", 0.0, "b.test")))
    assert [o[3] for o in outcome(r)] == ["VERIFIED"] * 2


def test_single_source(told):
    obs = told(("India", "2000", 100.0, "a.test"), ("India", "2001", 110.0, "a.test"), ("India", "2001", 999.0, "b.test"), ("China", "2001", 210.0, "b.test"), ("Peru", "2001", None, "b.test"))
    r = verify.verify_across_sources(obs.filter("ord < 3 or ord = 4"), single_source=True)
    assert outcome(r) == [("india", "2000", 100.0, "SUPPORTED"), ("india", "2001", 110.0, "SUPPORTED")]
    assert r.conflicts.count() == 1 and r.primary.collect()[0].source == "A"
    r = verify.verify_across_sources(told(("India", "2000", 100.0, "a.test"), ("China", "2000", 200.0, "a.test"), ("China", "2001", 210.0, "b.test")), single_source=True)
    assert r.dropped.count() == 1 and r.observations.count() == 2
    r = verify.verify_across_sources(told(("India", "2000", 100.0, "a.test"), ("India", "2001", 110.0, "a.test"), ("India", "2000", 101.0, "b.test")), single_source=True)
    assert outcome(r)[0] == ("india", "2000", 100.0, "VERIFIED")


def test_summary(told):
    r = verify.verify_across_sources(told(("India", "2000", 100.0, "a.test"), ("India", "2000", 101.0, "b.test"), ("China", "2000", 200.0, "a.test")))
    s = verify.verification_summary(r).collect()[0]
    assert (s.observations, s.verified, s.valued, s.single_publisher, s.conflicts) == (2, 1, 2, 1, 0)


def test_jump(told):
    obs = told(("India", "2000", 100.0, "a.test"), ("India", "2001", 50000.0, "a.test"), ("India", "2002", 0.0, "a.test"), ("India", "2003", 50001.0, "a.test"))
    jumps = verify.outlier_jumps(obs.withColumn("sort_key", F.col("date").cast("bigint"))).collect()
    assert [(j.from_date, j.to_date, j.ratio) for j in jumps] == [("2000", "2001", 500.0)]


def test_majority_unit(told):
    def unit(*us):
        return insight.majority_unit(told(*[("India", str(2000 + i), 1.0, "a.test", u) for i, u in enumerate(us)])).collect()[0].unit
    assert unit("USD", "USD", "count") == "USD" and unit("percent", "count") == "percent" and unit("count", "percent") == "percent"
    assert insight.majority_unit(told(("India", "2000", None, "a.test", "USD"))).collect()[0].unit == "count"


def counts(report):
    return {r.check: r.violations for r in report.collect()}


def test_clean_and_broken_reports(told):
    good = told(("India", "2000-01-01", 1.0, "a.test"), ("India", "2001-01-01", 2.0, "a.test"))
    report = quality.quality_report(quality.core_violations(good, "2026-09-21"))
    assert sum(counts(report).values()) == 0 and set(counts(report)) == set(quality.UNRANKED_CHECKS)  # only what ran
    ranked = good.sparkSession.createDataFrame([(1, 1), (1, 3), (2, 1)], "sort_key bigint, rank bigint")
    broken = quality.quality_report(quality.core_violations(good, "2026-09-21", ranked=ranked), quality.CORE_CHECKS)
    assert counts(broken)["ranking"] == 1 and sum(counts(broken).values()) == 1
    assert sum(counts(quality.quality_report(quality.platform_violations(good, "2026-09-21"), quality.PLATFORM_CHECKS)).values()) == 0
    none = F.lit(None).cast("string")
    bare = good.withColumns({"source": none, "source_url": none})
    assert counts(quality.quality_report(quality.core_violations(bare, "2026-09-21")))["source"] == 2
    late = told(("India", "2099", 1.0, "a.test"))
    assert counts(quality.quality_report(quality.core_violations(late, "2026-09-21")))["temporal"] == 1
    assert quality.check_temporal(late.withColumn("status", F.lit("Forecast")), "2026-09-21").count() == 0
    empty = quality.quality_report(quality.core_violations(good.limit(0), "2026-09-21"))
    assert counts(empty)["schema"] == 1
    totals = quality.report_totals(report, good).collect()[0]
    assert (totals.observations, totals.entities, totals.violations, totals.passed) == (2, 1, 0, True)


def test_conflicting_cell_is_no_duplicate(told):
    r = verify.verify_across_sources(told(("India", "2000", 100.0, "a.test"), ("India", "2000", 140.0, "b.test")))
    assert quality.check_duplicate_cells(r.observations).count() == 0
    assert quality.check_duplicate(r.observations).collect()[0].n == 1


def test_rank_as_value(told):
    assert quality.rank_columns_as_values(told(*[(c, "2022", float(i + 1), "a.test", "USD") for i, c in enumerate("ABCDEF")])).collect()[0].n == 6
    assert quality.rank_columns_as_values(told(*[(c, "2022", v, "a.test", "USD") for c, v in zip("ABCDEF", (1.0, 2.5, 3.0, 10.0, 25.0, 100.0))])).count() == 0
    assert quality.rank_columns_as_values(told(*[(c, "2022", v, "a.test", "USD") for c, v in zip("ABCDEF", (1.0, 2.0, 3.0, 4.0, 6.0, 6.0))])).count() == 0


def test_null_status_and_gate(told):
    obs = told(("India", "2000", None, "a.test"), ("", "2001", 1.0, "a.test"))
    assert quality.check_null_status(obs).count() == 0
    broken = obs.withColumn("status", F.lit("VERIFIED"))
    found = quality.gate(broken, obs.limit(0), quality.quality_report(quality.check_type(obs)))
    assert {r.detail for r in found.collect()} == {"no frames", "null not UNKNOWN: 0", "blank name: 1"}


def test_entities(spark):
    df = spark.createDataFrame([(n,) for n in ("USA", "uk", "Deutschland", "DR Congo", "Nokia", "World", "??")], "entity string")
    got = {r.entity: (r.resolution, r.iso2, r.resolved_id, r.flag_code) for r in entities.resolve_entities(df).collect()}
    assert got == {"USA": ("resolved", "US", "united-states", "us"), "uk": ("resolved", "GB", "united-kingdom", "gb"), "Deutschland": ("resolved", "DE", "germany", "de"),
                   "DR Congo": ("resolved", "CD", "democratic-republic-of-the-congo", "cd"), "Nokia": ("unresolved", None, "nokia", None), "World": ("resolved", "XX", "world", None),
                   "??": ("unresolved", None, "", None)}
    assert sorted(r.entity for r in entities.countries_only(df).collect()) == ["Democratic Republic of the Congo", "Germany", "United Kingdom", "United States"]
    keys = entities.dictionary_keys(entities.country_dictionary(spark))
    assert keys.filter("hits > 1").count() == 0 and entities.country_dictionary(spark).count() == 128


def test_ambiguous_names(spark):
    dictionary = spark.createDataFrame([("Georgia", "GE", "GEO", "Asia", []), ("US State Georgia", "U1", "US1", "America", ["georgia"])],
                                       "name string, iso2 string, iso3 string, region string, aliases array<string>")
    df = spark.createDataFrame([("georgia",)], "entity string")
    row = entities.resolve_entities(df, "entity", dictionary).collect()[0]
    assert (row.resolution, row.candidates) == ("ambiguous", ["Georgia", "US State Georgia"])
    assert quality.check_entity(df, dictionary).count() == 1


def test_build_observations(spark):
    df = spark.createDataFrame([(1, "A b", "2020", None), (123456, "B", "2020-05", float("nan")), (3, "C", "x", 1.0)], "ord bigint, entity string, date string, value double")
    got = {r.entity: (r.observation_id, r.status, r.frequency, r.value, r.entity_id) for r in clean.build_observations(df).collect()}
    assert got == {"A b": ("obs_00001", "UNKNOWN", "annual", None, "a-b"), "B": ("obs_123456", "UNKNOWN", "monthly", None, "b"), "C": ("obs_00003", "SUPPORTED", "unknown", 1.0, "c")}


def test_sanitize(told):
    obs = told(("India", "2000", -1.0, "a.test", "counts"), ("India", "2001", float("inf"), "a.test"), (" ", "2001", 1.0, "a.test"), ("India", "2002", -1.0, "a.test", "USD"))
    kept, dropped = clean.sanitize(obs)
    assert [r.ord for r in kept.collect()] == [3]
    assert {r.ord: r.reason for r in dropped.collect()} == {0: "negative count", 1: "non-finite value", 2: "missing entity or date"}


def test_normalize(told):
    rows, dropped = clean.normalize(told(("USA", "05/2020", 2.0, "a.test", "kt"), ("Nokia", "junk", 1.0, "a.test"), ("UK", "2020", None, "a.test", "furlong")), target_unit="t")
    got = {r.entity: (r.date, r.value, r.unit, r.conversion_factor, r.status) for r in rows.collect()}
    assert got == {"United States": ("2020-05", 2000.0, "kg", 1e6, "SUPPORTED"), "United Kingdom": ("2020-01-01", None, "furlong", None, "UNKNOWN")}
    assert dropped.collect()[0].reason == "unparsable-date"
