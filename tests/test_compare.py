import random
from pathlib import Path

import pytest

from podium.operators import sourcing
from podium.operators.matching import match_name_table
from podium.sources import changed_ranges, ranged_difference, read_ranged, write_ranged


@pytest.mark.parametrize("least", [0.5, 0.75, 1.0])
def test_name_table_equals_one_metric_at_a_time(spark, least):
    rng = random.Random(5)
    words = ["city", "cities", "glass", "gas", "gases", "car", "cars", "population", "income", "tax", "the", "of", "ab", "Count", "counts"]
    texts = [" ".join(rng.choices(words, weights=[9] + [1] * 14, k=rng.randint(0, 7))) for _ in range(300)]
    names = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:250], None, "city car", "City, car!"])], "name_id bigint, name string")
    asked = [*texts[250:], None, "", "the of", "city city income"]
    metrics = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, metric string")
    found = match_name_table(metrics, names, least)
    got = {(r.query_id, r.name_id): (r.matched, r.score) for r in found.expanded().collect()}
    want = {}
    for q in sorted({0, 7, 13, 20, 28, 34, 41, 49, *range(50, len(asked))}):
        for r in sourcing.match_names(names, asked[q] or "", least=least).collect():
            want[q, r.name_id] = (r.matched, r.score)
        assert {k: v for k, v in got.items() if k[0] == q} == {k: v for k, v in want.items() if k[0] == q}
    assert want and found.pairs.count() < len(got)


def test_name_table_without_rows(spark):
    none = spark.createDataFrame([], "query_id bigint, metric string")
    names = spark.createDataFrame([(1, "a name")], "name_id bigint, name string")
    assert match_name_table(none, names).expanded().count() == 0
    asked = spark.createDataFrame([(1, "some name")], "query_id bigint, metric string")
    assert match_name_table(asked, names.filter("name_id = 2")).pairs.count() == 0


def test_pairs_are_counted_on_numbers(spark, monkeypatch):
    from podium.operators import matching
    pairs, write = [], matching.Stages.write

    def noted(self, df, name):
        if name == "scored":
            pairs.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(matching.Stages, "write", noted)
    names = spark.createDataFrame([(1, "City, cities!"), (2, "cities"), (3, "city taxes"), (4, "glass")], "name_id bigint, name string")
    metrics = spark.createDataFrame([(7, "cities city city tax"), (8, "cities cities"), (9, "gas")], "query_id bigint, metric string")
    found = match_name_table(metrics, names).pairs
    assert sorted(map(tuple, found.collect())) == [(7, 1, 3, 0.75), (7, 3, 3, 0.75), (8, 1, 2, 1.0), (8, 2, 2, 1.0), (8, 3, 2, 1.0)]
    assert len(pairs) == 1 and "array_intersect" in pairs[0] and "lambda" not in pairs[0]


SCHEMA = "frame bigint, entity string, value double, tags array<string>"


def _frames(n=100):
    return [(f, e, float(f * 10 + i), [e] if i else None) for f in range(n) for i, e in enumerate("abc")]


def test_one_changed_row_reads_one_range(spark, tmp_path):
    path, rows = str(tmp_path / "tape"), _frames()
    write_ranged(spark.createDataFrame(rows, SCHEMA), path, "frame", 10, ["value"])
    assert ranged_difference(spark, path, spark.createDataFrame(rows[::-1], SCHEMA)).count() == 0
    other = [r if r[:2] != (42, "b") else (42, "b", -1.0, r[3]) for r in rows]
    # Files of all other ranges are spoilt: whoever opens one fails.
    for file in Path(path, "rows").glob("_range=*/*.parquet"):
        if file.parent.name != "_range=4":
            file.write_bytes(b"no parquet")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    again = spark.createDataFrame(other, SCHEMA)
    assert [tuple(r) for r in changed_ranges(spark, path, again).collect()] == [(4, 30, 30)]
    got = {(r.side, r.frame, r.entity, r.value) for r in ranged_difference(spark, path, again).collect()}
    assert got == {("written", 42, "b", 421.0), ("again", 42, "b", -1.0)}
    assert [r.frame for r in read_ranged(spark, path, 41, 43).orderBy("frame").collect()] == [41] * 3 + [42] * 3 + [43] * 3


def test_ranges_of_odd_rows(spark, tmp_path):
    rows = [(None, "a", 1.0, None), (None, "a", 1.0, None), (-1, None, None, []), (-16, "x", float("nan"), [None]), (0, "", -0.0, ["q"])]
    path = str(tmp_path / "odd")
    write_ranged(spark.createDataFrame(rows, SCHEMA), path, "frame", 16)
    assert ranged_difference(spark, path, spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert sorted(map(str, read_ranged(spark, path, -16, -1).collect())) == sorted(map(str, spark.createDataFrame(rows[2:4], SCHEMA).collect()))
    fewer = ranged_difference(spark, path, spark.createDataFrame(rows[1:], SCHEMA)).collect()
    assert [(r.side, r.frame, r.entity) for r in fewer] == [("written", None, "a")]
    swapped = [(f, None, v, t) if e == "" else (f, "", v, t) if e is None else (f, e, v, t) for f, e, v, t in rows]
    assert ranged_difference(spark, path, spark.createDataFrame(swapped, SCHEMA)).count() == 4


def test_ranges_of_an_empty_table(spark, tmp_path):
    path, none = str(tmp_path / "none"), spark.createDataFrame([], SCHEMA)
    write_ranged(none, path, "frame", 16)
    assert read_ranged(spark, path).count() == 0 and read_ranged(spark, path, 1, 2).columns == none.columns
    assert ranged_difference(spark, path, none).count() == 0
    assert ranged_difference(spark, path, spark.createDataFrame(_frames(2), SCHEMA)).count() == 6
