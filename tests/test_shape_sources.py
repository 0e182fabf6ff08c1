import io
import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from podium.operators import shape, sourcing
from podium.sources import pages, payloads, readers, snapshots, writers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture
def folder(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)
    return write


PHONES = "brand, year ,share,unit,source\n Nokia ,2007,38.6,percent,s\nSamsung,2007,14.4,percent,s\nApple,2007,0.3,percent,s\n\nNokia,2008,38.6,percent\nSamsung,2008,16.3,percent,s\nApple,2008,1.1,percent,s\n"


def test_csv_is_trimmed_and_ragged(spark, folder):
    df = readers.read_table(spark, folder("p.csv", PHONES))
    assert df.columns == ["brand", "year", "share", "unit", "source", "source_file"]
    got = df.collect()
    assert len(got) == 6 and got[0].brand == "Nokia" and got[3].source is None and got[0].source_file == "p.csv"


def test_multiline_quotes(spark, folder):
    path = folder("m.csv", 'title,release_date,revenue,cast\n"A ""big"" one",2001-05-01,10,"[{""name"": ""X Y""}, {""name"": ""Z W""}]"\n"B\nsecond line",2002,20,"[{""name"": ""X Y""}]"\n')
    df = readers.read_delimited(spark, path, multi_line=True)
    assert {r.title for r in df.collect()} == {'A "big" one', "B\nsecond line"}
    sums = shape.sum_by_name_year(df, "cast", "release_date", "revenue")
    assert rows(sums) == [("X Y", "2001", 10.0), ("X Y", "2002", 20.0), ("Z W", "2001", 10.0)]


def test_tsv_json_jsonl_and_unknown(spark, folder):
    assert readers.read_table(spark, folder("t.tsv", "a\tb\n1\t2\n")).select("a", "b").collect()[0] == ("1", "2")
    doc = {"meta": {"n": 1}, "results": [{"brand": "N", "value": 1.50, "x": None}, {"brand": "S", "more": {"k": [1, 2]}}]}
    got = readers.read_table(spark, folder("d.json", json.dumps(doc)))
    assert {(r.brand, r.value, r.more) for r in got.collect()} == {("N", "1.5", ""), ("S", "", '{"k": [1, 2]}')}
    array = readers.read_table(spark, folder("a.json", '[{"a": 1, "b": true}, {"a": "x"}]'))
    assert rows(array.select("a", "b")) == [("1", "true"), ("x", "")]
    assert readers.read_table(spark, folder("o.json", '{"a": 5}')).collect()[0].a == "5"
    lines = readers.read_table(spark, folder("l.jsonl", '{"a": 1}\n\n{"a": 2, "b": [3]}\n'))
    assert rows(lines.select("a", "b")) == [("1", ""), ("2", "[3]")]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, folder("bad.jsonl", '{"a": 1}\nnot json\n')).collect()
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_table(spark, "x.docx")


def test_column_lookup(spark):
    df = spark.createDataFrame([("a",)], "`Country Name` string")
    assert shape.find_column(df, "country_name") == "Country Name" and shape.find_column(df, "x") is None


def archive(name, text):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("readme.md", "no table")
        z.writestr(name, text)
    return buffer.getvalue()


def test_zipped_tables(spark, folder, tmp_path):
    text = 'name,year,net_worth_b\n"Ann, B",2001,10\nBob,2002,20\n'
    folder("z/one.zip", archive("data/list.csv", text))
    folder("z/two.zip", archive("list.TSV", "name\tyear\tnet_worth_b\nCy\t2003\t30\n"))
    df = readers.read_zipped(spark, str(tmp_path / "z"))
    assert rows(df.select("name", "year", "net_worth_b")) == [("Ann, B", "2001", "10"), ("Bob", "2002", "20"), ("Cy", "2003", "30")]
    with pytest.raises(Exception, match="without a delimited file"):
        readers.read_zipped_cells(spark, folder("n.zip", archive("x.bin", "y"))).collect()
    with pytest.raises(Exception, match="not a zip"):
        readers.read_zipped_cells(spark, folder("fake.zip", "plain")).collect()


def test_observation_reader(spark, folder):
    path = folder("obs.jsonl", "\n".join([
        '{"entity": "India", "date": "2000", "value": 1.5, "source": "S", "sourceUrl": "https://s.test"}',
        '{"entity": {"id": "cn", "name": "China"}, "date": "2001", "value": null, "source": {"title": "T", "url": "https://t.test"}}',
        '{"entity": {"id": "only-id"}, "date": "2002"}']))
    got = rows(readers.read_observations(spark, path).select("entity", "date", "value", "source", "source_url"))
    assert got == [("China", "2001", None, "T", "https://t.test"), ("India", "2000", 1.5, "S", "https://s.test"), ("only-id", "2002", None, None, None)]


def test_detection(spark):
    def found(columns, *cells):
        return shape.detect_columns(spark.createDataFrame(list(cells), ", ".join(f"`{c}` string" for c in columns)))
    assert found(["Country", "Year", "code", "note", "GDP total"], ("India", "2000", "1", "x", "5"), ("China", "2001", "2", "3", "6")) == shape.Columns("Country", "Year", "GDP total", False)
    assert found(["who", "date", "a", "b"], ("Ann", "2000", "", "7"), ("Bob", "2001", "x", "8")) == shape.Columns("who", "date", "b", True)
    assert found(["year", "value"], ("2000", "text")) == shape.Columns("value", "year", None, True)


def test_drafts_of_three_shapes(spark):
    wide = spark.createDataFrame([("Apple Inc.", "1,000", "–"), ("", "1", "1"), ("Foo", "-5", "2.5k")], "country string, `2000` string, `2001` string")
    assert rows(shape.drafts_from_table(wide)) == [("Apple", "2000", 1000.0, "count"), ("Foo", "2001", 2500.0, "count")]
    across = spark.createDataFrame([("2007", "38%", "14", "x"), ("soon", "1", "1", "y"), ("2008", "0", "", "z")], "Date string, Nokia string, Samsung string, note string")
    got = shape.melt_transposed(across, "Date", "share")
    assert rows(got) == [("Nokia", "2007", 38.0, "percent"), ("Samsung", "2007", 14.0, "share")]
    long = spark.createDataFrame([("India", "2000", "1.2M"), ("", "2000", "1"), ("China", "later", "1"), ("China", "Q1 2001", "n/a")], "country string, year string, population string")
    assert rows(shape.drafts_from_table(long)) == [("China", "Q1 2001", None, "count"), ("India", "2000", 1200000.0, "count")]
    marked = shape.long_drafts(long, "country", "year", "population")
    assert tuple(shape.skip_counts(marked).collect()[0]) == (2, 1, 1)
    with pytest.raises(ValueError):
        shape.drafts_from_table(spark.createDataFrame([("a", "b")], "x string, y string"))


def test_year_span(spark):
    assert tuple(shape.year_span(spark.createDataFrame([("a", "b")], "`1990` string, `2005` string")).collect()[0]) == (1990, 2005)
    assert tuple(shape.year_span(spark.createDataFrame([("x", "-44"), ("y", "1999"), ("z", "n")], "n string, Year string")).collect()[0]) == (-44, 1999)
    assert tuple(shape.year_span(spark.createDataFrame([("1850", "9"), ("y", "1999")], "n string, m string")).collect()[0]) == (9, 1999)


CHART = '<html><head><title>Apple (AAPL) - Market capitalization</title></head><script>c = [{"d":859766400,"m":23075},{"d":1606780800,"m":20864611},{"d":1607472000,"m":20704794},{"d":1790949128,"m":48408895}]</script></html>'


def test_embedded_series(spark):
    points = pages.embedded_series(spark.createDataFrame([(CHART,), ("<p>no data</p>",)], "html string"))
    assert points.count() == 4 and {r.entity for r in points.collect()} == {"Apple"}
    assert rows(shape.year_end_values(points)) == [("Apple", 1997, 2307500000.0), ("Apple", 2020, 2070479400000.0), ("Apple", 2026, 4840889500000.0)]


TABLES = """<TABLE class="w"><tr><th>Country</th><th>In 1990 [1]</th><th>2000</th></tr><tr><td><a>India</a></td><td>1,0&nbsp;0</td><td></td></tr><tr><td></td><td>9</td><td>9</td></tr></table>
<table><tr><td>menu</td></tr><tr><td>1990</td></tr></table><table><tr><th>Land</th><th>1990</th><th>2000</th></tr><tr><td>India</td><td>7</td><td>8 &amp; [ 2 ]</td></tr></table>"""


def test_html_tables(spark):
    cells = pages.html_tables(spark.createDataFrame([(1, TABLES), (2, "<p>none</p>")], "page_id int, html string"))
    assert rows(cells.select("entity_header", "entity", "year", "value"), "year") == [("Country", "India", "1990", "1,0 0"), ("Country", "India", "2000", "8 &")]
    assert pages.as_wide(cells, ["1990", "2000"]).select("entity", "1990", "2000").collect()[0] == ("India", "1,0 0", "8 &")


def test_html_links(spark):
    html = '<a class="x" href="https://www.a.test/1"> <b>One</b>\n link</a><a href="/rel">r</a><A HREF=\'http://b.test\'></A><a href="https://www.a.test/1">again</a><a href="https://c.test">c</a>'
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert rows(pages.html_links(df, limit=2), "place") == [(1, 1, "https://www.a.test/1", "One link"), (1, 2, "http://b.test", "b.test")]
    assert pages.html_links(df, absolute_only=False).count() == 4


def test_snapshots(spark):
    data = [("2000-06-15", r, f"d{r}") for r in range(1, 6)] + [("2000-06-16", r, f"e{r}") for r in range(1, 13)] + [("2001-06-14", r, f"f{r}") for r in range(1, 13)]
    lists = spark.createDataFrame(data, "day string, rank bigint, entity string").withColumn("day", F.to_date("day"))
    got = snapshots.snapshot_series(lists, 1999, 2002, "0615", top_n=10).collect()
    assert {(r.year, r.entity[0]) for r in got} == {(2000, "e"), (2001, "f")} and len(got) == 20
    assert {r.score for r in got} == set(range(91, 101))
    assert snapshots.snapshot_series(lists, 2001, 2001, "0615", top_n=5).count() == 0


def test_payloads(spark, folder, tmp_path):
    page = '[{"page":1},[{"indicator":{"id":"X"},"country":{"id":"IN","value":"India"},"date":"2000","value":5.5},{"country":{"id":"WLD","value":"World"},"date":"2000","value":9},{"country":{"id":"FR","value":"France"},"date":"2000","value":null}]]'
    assert rows(payloads.read_indicator_pages(spark, folder("wb/p.json", page))) == [("IN", "India", "X", "2000", 5.5)]
    meta = spark.createDataFrame([('{"dimensions":[{"display":{"unit":" t "},"unit":"x"}],"unit":"y"}',), ('{"columns":[{"unit":"x"}]}',), ('{"unit":"y"}',), ("{}",)], "m string")
    assert [r[0] for r in meta.select(payloads.sidecar_unit("m")).collect()] == ["t", "x", "y", None]
    csv = folder("charts/gdp.csv", "Entity,Year,GDP\nIndia,2000,5\n")
    folder("meta/gdp.metadata.json", '{"unit":"USD"}')
    assert payloads.read_charts(spark, csv, str(tmp_path / "meta")).select("Entity", "GDP", "unit").collect()[0] == ("India", "5", "USD")
    ckan = '{"result":{"results":[{"name":"set","title":"Set","resources":[{"name":"r","url":"https://www.d.test/x","format":"csv"},{"url":"ftp://x"}]}]}}'
    found = payloads.catalogue_resources(spark.createDataFrame([(ckan,)], "value string"))
    assert rows(found.select("place", "name", "format")) == [(0, "r", "CSV"), (1, "resource", "")]
    best = payloads.resource_candidates(found, "Open").collect()
    assert [(c.candidate_id, c.publisher, c.access, c.machine_readable) for c in best] == [("ckan_set-r", "d.test", "download", True)]
    community = '[{"ref":"ann/set-1","title":"T","lastUpdated":"2026-01-02T00:00:00Z"},{"ref":"b/c","description":"' + "d" * 400 + '"}]'
    got = payloads.community_candidates(spark.createDataFrame([(community,)], "value string"), "2026-06-01").collect()
    assert [(c.owner, c.title, c.recency, len(c.description or "")) for c in got] == [("ann", "T", 0.7, 0), ("b", "b/c", 0.4, 400)]
    service = '{"features":[{"name":"a"}],"rows":[{"row":{"a":1,"b":"x"}},{"row":{"a":null}}]}'
    assert rows(payloads.row_service_table(spark.createDataFrame([(service,)], "value string"), ["a", "b"])) == [("", ""), ("1", "x")]


def test_registry(spark):
    candidates = sourcing.registry_candidates(sourcing.source_registry(spark))
    first = candidates.filter("name = 'Our World in Data'").collect()[0]
    assert (first.candidate_id, first.directness, first.coverage, first.machine_readable) == ("registry_our-world-in-data", 0.75, 0.9, True)
    scored = sourcing.score_candidates(candidates, "name").collect()
    assert scored[0].name == "Data Commons" or scored[0].quality_score >= scored[-1].quality_score
    listed = sourcing.sources_for_topics(sourcing.tiered_sources(spark), ["economy", "trade"]).collect()
    assert listed[0].name == "World Bank Open Data" and {r.tier for r in listed} == {1, 2} and len(listed) == 37


def test_source_score(spark):
    cols = "authority double, directness double, coverage double, machine_readable boolean, methodology double, recency double, consistency double"
    df = spark.createDataFrame([(0.95, 0.95, 0.85, True, 0.8, 0.9, 0.9), (0.3, 0.25, 0.3, False, 0.2, 0.4, 0.3)], cols)
    api, web = [r[0] for r in df.select(sourcing.quality_score()).collect()]
    assert 0 <= web < api <= 1


def test_name_matching(spark):
    names = ["Population, total", "Population density of countries", "Health care", "Country population growth rate"]
    df = spark.createDataFrame(list(enumerate(names)), "ord int, name string")
    best = sourcing.match_names(df, "world population by countries").orderBy(*sourcing.match_order()).collect()
    assert [(b.name, b.matched) for b in best] == [("Country population growth rate", 2), ("Population density of countries", 2), ("Population, total", 1)]
    assert sourcing.match_names(df, "car").count() == 0 and sourcing.match_names(df, "the of").count() == 0


def test_hosts_and_urls(spark):
    urls = ["https://a.test/1", "https://A.test/1/", "https://a.test/2", "https://www.a.test/3", "https://a.test/4", "https://b.test/x.csv", "nonsense"]
    df = spark.createDataFrame(list(enumerate(urls)), "ord int, url string")
    assert [r.ord for r in sourcing.cap_per_host(df).orderBy("ord").collect()] == [0, 2, 3, 5, 6]
    assert [r.ord for r in sourcing.web_candidates(df).filter("machine_readable").collect()] == [5]


def test_writers(spark, tmp_path):
    obs = spark.createDataFrame([("2001", "b", "B", 2.0), ("2000", "c", "C", None), ("2000", "a", "A", 1.5)], "date string, entity_id string, entity string, value double")
    writers.write_dataset_csv(obs, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*")))
    body = [line for line in text.splitlines() if not line.startswith("date,")]
    assert body == ["2000,a,A,1.5", "2000,c,C,", "2001,b,B,2.0"]
    paths = writers.write_artefacts(str(tmp_path / "out"), {"notes": "json"}, dataset=obs, notes=obs.limit(1))
    assert spark.read.parquet(paths["dataset"]).count() == 3 and spark.read.json(paths["notes"]).count() == 1
    log = str(tmp_path / "log")
    writers.append_log(spark.createDataFrame([("a", 1)], "agent string, n bigint"), log)
    (tmp_path / "log" / "part-x.json").write_text('{"agent": "b", "n": 2}\n{broken\n')
    assert rows(writers.read_log(spark, log, "agent string, n bigint")) == [("a", 1), ("b", 2)]


def test_files_of_unlike_headers(spark, folder):
    path = folder("several/a.csv", "country,year,value\nX,2020,1\n").rsplit("/", 1)[0]
    folder("several/b.csv", "year,country,value\n2021,Z,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_delimited(spark, path).collect()


def test_surplus_cells_are_reported(spark, folder):
    path = folder("ragged.csv", "a,b\n1,2\n3,4,5\n6\n")
    got = sorted(map(tuple, readers.read_delimited(spark, path, ragged="line").select("a", "b", "line").collect()), key=str)
    assert got == [("1", "2", None), ("3", "4", "3,4,5"), ("6", None, "6")]


def test_mixed_json_envelopes(spark, folder):
    path = folder("mixed/a.json", '{"data": [{"a": 1, "b": "x"}, {"a": 2}], "total": 2}').rsplit("/", 1)[0]
    folder("mixed/b.json", '{"rows": [{"a": 3, "c": null}]}')
    folder("mixed/c.json", '[{"a": 4}, {"b": "y"}]')
    for columns in (None, ["a", "b", "c"]):
        got = sorted(map(tuple, readers.read_json_table(spark, path, columns).select("a", "b", "c").collect()))
        assert got == [("", "y", ""), ("1", "x", ""), ("2", "", ""), ("3", "", ""), ("4", "", "")]


def test_json_documents_are_read_as_one_line_each(spark, folder, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader
    asked, read = [], DataFrameReader.json

    def json_(self, path, *args, **options):
        asked.append(options.get("multiLine"))
        return read(self, path, *args, **options)

    monkeypatch.setattr(DataFrameReader, "json", json_)
    path = folder("many/k=1/a.json", '{"data": [{"a": 1.50,\n "b": {"x": [1e2]}}]}').rsplit("/", 2)[0]
    folder("many/k=2/b.json", '{"data": [{"c": "\u00e9"}]}')
    folder("many/k=2/broken.json", '{"data": [{"z": 1')
    folder("many/k=1/c.json", '{"data": [{"c": "\u00fc"}]}'.encode("utf-16"))
    found = readers.read_json_table(spark, path)
    assert found.columns == ["a", "b", "c"]
    assert rows(found) == [("", "", "\u00e9"), ("", "", "\u00fc"), ("1.50", '{"x": [1e2]}', "")]
    assert asked == [None, None]
    plain = folder("plain/k=7/a.json", '{"b": 1}').rsplit("/", 2)[0]
    assert [r.asDict() for r in readers.read_json_table(spark, plain).collect()] == [{"b": "1", "k": "7"}]


def test_envelope_query_writes_few_documents(spark, tmp_path, monkeypatch):
    from podium.plans import queries_source
    seen, read = [], readers.read_json_table
    monkeypatch.setattr(readers, "read_json_table", lambda s, path: seen.append(path) or read(s, path))
    spark.range(30_000).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name").write.parquet(str(tmp_path / "part.parquet"))
    assert queries_source.read_json_envelope(spark, str(tmp_path)).distinct().count() == 30_000
    assert len(list(Path(seen[0].removeprefix("file:")).rglob("*.json"))) == 10


def test_archives_of_unlike_headers(spark, tmp_path):
    import zipfile
    for name, text in (("a", "k,v\n1,2\n"), ("b", "v,w,k\n5,6,4\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("t.csv", text)
    assert sorted(map(tuple, readers.read_zipped(spark, str(tmp_path)).select("k", "v", "w").collect()), key=str) == [("1", "2", None), ("4", "5", "6")]


def test_one_number_column_is_no_transposed_table(spark):
    df = spark.createDataFrame([("2000", "5"), ("2001", "6")], "year string, India string")
    with pytest.raises(ValueError, match="two number columns"):
        shape.melt_transposed(df, "year")


def test_cells_end_with_their_own_tag(spark):
    html = "<table><tr><th>N</th><th>2000</th></tr><tr><td>A<th>x</th></td><td>5</td></tr></table>"
    got = pages.html_tables(spark.createDataFrame([(1, html)], "page_id bigint, html string")).select("entity", "year", "value").collect()
    assert [tuple(r) for r in got] == [("A x", "2000", "5")]


def test_keys_of_sources_do_not_meet(spark):
    from podium.plans.dataset import SourceTable, source_observations
    one = spark.createDataFrame([("India", "2000", "5", (1 << 60) + 7)], "entity string, year string, value string, ord bigint")
    rows_ = source_observations([SourceTable(one, f"P{i}", f"https://p{i}.test") for i in (0, 1)])
    assert sorted(int(r.ord) for r in rows_.select("ord").collect()) == [(1 << 60) + 7, (1 << 64) + (1 << 60) + 7]
