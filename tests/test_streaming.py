from pyspark.sql import functions as F

from podium.operators import ranking, shape
from podium.streaming import (append_stream, batch_log, compact, current_leaderboard, late_rows, read_current, read_latest, stream_cells, stream_daily_best,
                              stream_daily_cells, stream_daily_sums, stream_name_year_sums, write_current_tables, write_deltas)


def test_stream_sums_equal_batch_sums(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "title string, release_date string, revenue string, cast string"
    head = "title,release_date,revenue,cast\n"
    (src / "1.csv").write_text(head + 'A,2001-01-02,10,"[{""name"": ""Ann Lee""}, {""name"": ""Bob Ray""}]"\nB,,5,"[{""name"": ""Ann Lee""}]"\n')
    (src / "2.csv").write_text(head + 'C,2001,1.5k,"[{""name"": ""Ann Lee""}]"\nD,2002,0,"[{""name"": ""Ann Lee""}]"\n')
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        sums = stream_name_year_sums(spark, str(src), schema, "cast", "release_date", "revenue")
        write_current_tables(sums, out, mark).awaitTermination()
        return {tuple(r) for r in read_current(spark, out).select("entity", "date", "value").collect()}

    assert run() == {("Ann Lee", "2001", 1510.0), ("Bob Ray", "2001", 10.0)}
    (src / "3.csv").write_text(head + 'E,2001,7,"[{""name"": ""Bob Ray""}]"\n')
    later = run()
    batch = shape.sum_by_name_year(spark.read.csv(str(src), header=True, escape='"'), "cast", "release_date", "revenue", keep=None)
    assert later == {tuple(r) for r in batch.collect()} == {("Ann Lee", "2001", 1510.0), ("Bob Ray", "2001", 17.0)}


def test_one_file_of_a_stream_is_parsed_by_all_cores(spark, tmp_path, capsys):
    src, schema = str(tmp_path / "in"), "who string, day string, amount string"
    spark.createDataFrame([("Ann", "2001-01-02", "2"), ("Ann", "2001-03-04", "3"), (None, "2001", "1"), ("Bob", None, "1")], schema).coalesce(1).write.parquet(src)
    sums = stream_name_year_sums(spark, src, schema, "who", "day", "amount", "parquet")
    write_current_tables(sums, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert [tuple(r) for r in read_current(spark, str(tmp_path / "out")).collect()] == [("Ann", "2001", 5.0)]
    sums.explain()
    plan = capsys.readouterr().out
    assert plan.rindex("regexp") < plan.index("RoundRobinPartitioning")  # what stands higher in the plan comes later


def test_live_leaderboard(spark, tmp_path):
    src = str(tmp_path / "obs")
    obs = spark.createDataFrame([(0, "A", "2000", 1.0), (1, "B", "2000", 2.0), (2, "A", "2000", 3.0), (3, "C", "2001", 1.0)], "ord long, entity string, date string, value double")
    obs.write.parquet(src)
    stream = spark.readStream.schema(obs.schema).parquet(src)
    write_current_tables(stream_cells(stream), str(tmp_path / "o"), str(tmp_path / "c"), lambda c: current_leaderboard(c, 1)).awaitTermination()
    live = {(r.sort_key, r.entity_id, r.value) for r in read_current(spark, str(tmp_path / "o")).collect()}
    assert live == {(r.sort_key, r.entity_id, r.value) for r in ranking.top_per_period(obs, 1).collect()} == {(20000101, "a", 3.0), (20010101, "c", 1.0)}


def test_daily_cells_close(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [("A", "2024-01-01 01:00:00", 1.0), ("A", "2024-01-01 02:00:00", 4.0), ("B", "2024-01-09 00:00:00", 2.0)]
    events = spark.createDataFrame(rows, "entity string, t string, value double").select("entity", F.to_timestamp("t").alias("event_time"), "value")
    events.coalesce(1).write.parquet(src)
    cells = stream_daily_cells(spark.readStream.schema(events.schema).parquet(src), "2 days")
    append_stream(cells, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.sort_key, r.entity_id, r.value) for r in got] == [(20240101, "a", 4.0)]


KEYS = ["day", "kind"]


def _deliver(spark, rows, folder):
    spark.createDataFrame(rows, "t string, kind string, value bigint").select(F.to_timestamp("t").alias("event_time"), "kind", "value").repartition(2).write.mode("append").parquet(folder)


def test_daily_sums_in_update_mode(spark, tmp_path):
    """Three deliveries with late rows: as the batch twin without them; pieces hold changed keys only, state is what is open."""
    folder, path, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    parts = [[(f"2024-01-0{d} 0{h}:00:00", k, d * 10 + h) for d in days for h in (1, 2) for k in "ab"] for days in ((1, 2), (3, 4, 5), (6,))]
    parts[2] += [("2024-01-01 05:00:00", "a", 1000), ("2024-01-05 05:00:00", "b", 7), ("2024-01-02 01:00:00", "c", 9)]  # the first and last of these: too late
    parts[0] += [(None, "a", 1), ("2024-01-01 00:00:00", "a", None)]
    logs = []
    for n, rows in enumerate(parts):
        _deliver(spark, rows, folder)
        stream = spark.readStream.schema("event_time timestamp, kind string, value bigint").option("maxFilesPerTrigger", 1000).parquet(folder)
        query = write_deltas(stream_daily_sums(stream, ["kind"], "1 day"), path, mark)
        query.awaitTermination()
        logs += batch_log(query)
        if n == 1:
            before = {tuple(r) for r in read_latest(spark, path, KEYS).collect()}
            assert compact(spark, path, KEYS) is not None and compact(spark, path, KEYS) is None
            assert {tuple(r) for r in read_latest(spark, path, KEYS).collect()} == before
    want = {}
    for t, k, v in (r for rows in parts for r in rows):
        if t and v is not None and v not in (1000, 9):
            day = want.setdefault((t[:10], k), [0, 0])
            day[0], day[1] = day[0] + v, day[1] + 1
    assert {(str(r.day), r.kind): [r.value, r.n] for r in read_latest(spark, path, KEYS).collect()} == want
    assert tuple(late_rows(spark, path, logs).collect()[0]) == (27, 25, 2)
    assert max(entry["open"] for entry in logs) <= 10 and logs[-1]["open"] <= 4
    assert [entry["changed"] for entry in logs if entry["rows"]] == [4, 6, 3]


def test_compaction_keeps_the_pieces_of_the_last_one(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(6):
        spark.createDataFrame([("a", n, 1), (f"k{n}", n, 1)], "k string, value int, n int").write.parquet(f"{path}/delta/batch={n:08d}")
        if n in (1, 3, 4):
            assert compact(spark, path, ["k"]) == n
    spark.createDataFrame([("a", 99, 1)], "k string, value int, n int").write.parquet(f"{path}/delta/batch=00000009")
    (tmp_path / "t/delta/batch=00000009/_SUCCESS").unlink()  # a batch that was never finished
    assert {r.k: r.value for r in read_latest(spark, path, ["k"]).collect()} == {"a": 5, **{f"k{n}": n for n in range(6)}}
    assert sorted(p.name for p in (tmp_path / "t/delta").iterdir()) == ["batch=00000004", "batch=00000005", "batch=00000009"]
    assert sorted(p.name for p in (tmp_path / "t/base").iterdir()) == ["upto=00000003", "upto=00000004"]


def test_live_best_of_open_days(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = [("A", "2024-01-01 01:00:00", 1.0), ("A", "2024-01-01 02:00:00", 4.0), ("B", "2024-01-01 00:00:00", 2.0), ("B", "2024-01-09 00:00:00", 2.0)]
    events = spark.createDataFrame(rows, "entity string, t string, value double").select("entity", F.to_timestamp("t").alias("event_time"), "value")
    events.write.parquet(src)
    write_deltas(stream_daily_best(spark.readStream.schema(events.schema).parquet(src), "2 days"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    board = current_leaderboard(read_latest(spark, str(tmp_path / "o"), ["sort_key", "entity_id"]).drop("n"), 1)
    assert {tuple(r) for r in board.collect()} == {(20240101, "a", 4.0, 1), (20240109, "b", 2.0, 1)}
