import json

from pyspark.sql import functions as F

from podium.operators import ordering, quality
from podium.sources import readers, variants


def written(tmp_path, name, *texts):
    folder = tmp_path / name
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"{i}.json").write_text(text, encoding="utf-8")
    return str(folder)


MIXED = ('{"rows": null, "items": [{"a": 1, "b": "x"}, 5, {"a": [1, {"z": null}]}]}', '[{"a": "1.50", "it\'s": true}, null]', '{"a": {"k": 1.50}, "b": null}',
         '{"data": {"a": 1}, "b": "no list"}', "{bad", "17", "  \n ", '{"rows": [], "a": 3}')


def test_documents_of_any_shape(spark, tmp_path):
    docs = variants.read_variants(spark, written(tmp_path, "mixed", *MIXED))
    records = variants.variant_records(docs)
    got = sorted(map(tuple, variants.variant_table(records, ["a", "b", "it's"]).collect()))
    assert got == sorted([("1", "x", ""), ('[1,{"z":null}]', "", ""), ("1.50", "", "true"), ('{"k":1.5}', "", ""), ("", "no list", "")])
    kinds = {r["kind"]: (r["documents"], r["records"]) for r in variants.document_kinds(docs).collect()}
    assert kinds == {"items": (1, 2), "list": (1, 1), "object": (2, 2), "unreadable": (1, 0), "scalar": (1, 0), "rows": (1, 0)}
    keys = {r["key"]: r["rows"] for r in variants.variant_columns(records).collect()}
    assert keys == {"a": 4, "b": 3, "it's": 1, "data": 1}
    assert sorted(map(tuple, records.select("source_file", "place").collect())) == [("0.json", 0), ("0.json", 2), ("1.json", 0), ("2.json", 0), ("3.json", 0)]


def test_same_rows_as_the_reader_with_a_schema(spark, tmp_path):
    texts = [json.dumps({name: [{"a": f"{name}{i}", "b": i} for i in range(3)]}) for name in ("rows", "records", "observations", "results")]
    path = written(tmp_path, "envelopes", *texts, json.dumps([{"a": "l", "b": None}]))
    there = sorted(map(tuple, readers.read_json_table(spark, path, ["a", "b"]).collect()))
    here = sorted(map(tuple, variants.variant_table(variants.variant_records(variants.read_variants(spark, path)), ["a", "b"]).collect()))
    assert here == there and len(here) == 13


def test_one_scan_without_inference(spark, tmp_path):
    path = written(tmp_path, "lines", "\n".join(json.dumps({"a": i}) for i in range(50)))
    table = variants.variant_table(variants.variant_records(variants.read_variants(spark, path, lines=True)), ["a", "missing"])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "json" not in plan.split("FileScan")[1].split()[0] and table.count() == 50


def test_no_documents(spark, tmp_path):
    docs = variants.read_variants(spark, written(tmp_path, "none", " "))
    assert variants.variant_records(docs).count() == 0 and variants.document_kinds(docs).count() == 0


def test_observations_in_envelopes(spark, tmp_path):
    texts = ('{"observations": [{"entity": {"id": "e1"}, "date": "2020", "value": "12", "source": {"title": "T", "url": "u"}}, {"entity": "E", "value": 1.5, "sourceUrl": "w"}]}',
             '[{"entity": null, "value": null, "source": "S"}, {"entity": {"name": "N", "id": "x"}, "value": 1e3, "source": {}}]')
    docs = variants.read_variants(spark, written(tmp_path, "obs", *texts))
    got = variants.variant_observations(variants.variant_records(docs)).orderBy("ord").select("entity", "date", "value", "source", "source_url").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("e1", "2020", None, "T", "u"), ("E", None, 1.5, None, "w"), ("", None, None, "S", None),
                                                       ("N", None, 1000.0, None, None)], key=str)


def ranked(df, value, k, descending):
    return [tuple(r) for r in ordering.first_rows_sketched(df, value, [F.col("i")], k, descending).orderBy("rank").collect()]


def test_first_rows_by_a_sketched_bound(spark):
    numbers = [float(i * 7919 % 1000) for i in range(20_000)]  # every value twenty times
    df = spark.createDataFrame(list(enumerate(numbers)), "i int, v double").repartition(7)
    for descending in (True, False):
        want = sorted(enumerate(numbers), key=lambda r: ((-1 if descending else 1) * r[1], r[0]))[:1234]
        assert ranked(df, "v", 1234, descending) == [(i, v, n + 1) for n, (i, v) in enumerate(want)]
        assert 1234 <= ordering.rows_beyond(df, "v", 1234, descending).count() <= 1234 + 0.02 * len(numbers)


def test_first_rows_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    values = [None, nan, 1.0, -inf, None, inf, 2.0, nan, 2.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert [r[0] for r in ranked(df, "v", 9, True)] == [1, 7, 5, 6, 8, 2, 3, 0, 4]
    assert [r[0] for r in ranked(df, "v", 50, False)] == [3, 2, 6, 8, 5, 1, 7, 0, 4]
    assert [r[0] for r in ranked(df, "v", 3, True)] == [1, 7, 5] and [r[0] for r in ranked(df, "v", 2, False)] == [3, 2]
    assert ranked(df.limit(0), "v", 5, True) == [] and [r[0] for r in ranked(df.filter("v is null"), "v", 1, True)] == [0]
    many = spark.createDataFrame([(i, nan if i % 3 else 1.0 * i) for i in range(3000)], "i int, v double")
    assert [r[0] for r in ranked(many, "v", 2500, True)][:2001] == [i for i in range(3000) if i % 3] + [2997]
    assert [r[0] for r in ranked(many, "v", 1200, False)] == list(range(0, 3000, 3)) + [i for i in range(3000) if i % 3][:200]
    longs = spark.createDataFrame([(i, (1 << 60) + i) for i in range(500)], "i int, v bigint")  # one double holds many of them
    assert [r[0] for r in ranked(longs, "v", 5, True)] == [499, 498, 497, 496, 495]


def test_counts_of_one_scan_equal_the_listed_violations(spark, obs):
    nan = float("nan")
    cases = [
        [],
        [("A", "2020", 1.0, "USD", None, "S", None)],
        [(None, None, None, None, None, None, None), (" ", "", nan, "furlong", "Forecast", None, "ftp://x"), ("A Inc", "2099", -1.0, "count", "forecast", "S", "http://x"),
         ("A Inc", "2099", -1.0, "count", None, "S", "bad"), ("a inc", "2099", 0.0, "", "estimated", None, None), ("A-Inc", "2099", -0.0, None, "x", "S", None),
         ("Congo", "n/a", float("inf"), "people", None, "S", None)],
        [("E%d" % i, "2001", float(i), "count", None, None, None) for i in range(1, 8)] + [("F%d" % i, "2002", float(i % 5 + 1), "count", None, None, None) for i in range(6)],
    ]
    for rows in cases:
        df = obs(rows, "ord bigint, entity string, date string, value double, unit string, status string, source string, source_url string")
        for unit in (None, "USD"):
            reports = [{r["check"]: (r["violations"], r["passed"]) for r in quality.quality_report(found).collect()}
                       for found in (quality.core_violations(df, "2026-12-31", unit), quality.core_counts(df, "2026-12-31", unit))]
            assert reports[0] == reports[1] and len(reports[0]) == 11


def test_neighbours_across_tasks(spark):
    """One series with a third of the rows, long stretches without a value, null keys; many small tasks."""
    rows = [(("hot", "b", None, f"s{i % 40}")[min(i % 7, 3)], i, float(i) if i % 11 == 0 or i % 7 == 2 and i > 900 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "k string, x int, v double")
    want = {}
    for key in {r[0] for r in rows}:
        series = [r for r in rows if r[0] == key]
        for n, (_, x, _v) in enumerate(series):
            want[(key, x)] = (next((v for _, _, v in reversed(series[:n]) if v is not None), None), next((v for _, _, v in series[n + 1:] if v is not None), None))
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or the tasks of small rows become one
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = {(r.k, r.x): (r.b, r.a) for r in ordering.with_neighbours(df, ["k"], [F.col("x")], F.col("v"), "b", "a").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want
