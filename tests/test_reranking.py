"""Incremental re-ranking against a full one."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from podium.operators.reranking import read_ranking, revise_ranking, write_ranking

EDITS = "ord bigint, sort_key bigint, entity_id string, value double"


def full(cells, direction="desc"):
    """{(period, entity): (value, rank, change)} by sorting everything."""
    out, last = {}, {}
    for period in sorted({p for p, _ in cells}):
        order = sorted(((v if direction == "asc" else -v), e) for (p, e), v in cells.items() if p == period)
        for rank, (v, e) in enumerate(order, 1):
            out[period, e] = (v if direction == "asc" else -v, rank, last[e] - rank if e in last else None)
            last[e] = rank
    return out


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).glob("sort_key=*/*.parquet")}


@pytest.mark.parametrize("direction", ["desc", "asc"])
def test_random_revisions(spark, tmp_path, direction):
    rng, path = random.Random(3), str(tmp_path / "ranks")
    cells = {(20000101 + p, f"e{e}"): float(rng.randrange(12)) for p in range(14) for e in range(9) if rng.random() < 0.5}
    table = write_ranking(spark.createDataFrame([(p, e, v) for (p, e), v in cells.items()], "sort_key bigint, entity_id string, value double"), path, direction)
    for revision in range(2, 5):
        edits = [(n, 20000101 + rng.randrange(15), f"e{rng.randrange(11)}", rng.choice([None, float(rng.randrange(12))])) for n in range(6)]
        if revision == 3:  # a period loses all its cells
            edits += [(100 + n, p, e, None) for n, (p, e) in enumerate(cells) if p == 20000105]
        before, old = files(path), full(cells, direction)
        for _, p, e, v in edits:
            cells.pop((p, e), None)
            if v is not None:
                cells[p, e] = v
        table = revise_ranking(spark, path, spark.createDataFrame(edits, EDITS), direction)
        want = full(cells, direction)
        assert {(r.sort_key, r.entity_id): (r.value, r["rank"], r.rank_delta) for r in table.collect()} == want
        same = {p for p, _ in want if {k: v for k, v in want.items() if k[0] == p} == {k: v for k, v in old.items() if k[0] == p}}
        after = files(path)
        assert same and all(after.get(f) == t for f, t in before.items() if int(f.parent.name[9:]) in same)
        assert {r.version for r in table.filter(~F.col("sort_key").isin([*same])).collect()} <= {revision}


def test_edits_that_change_nothing(spark, tmp_path):
    path = str(tmp_path / "ranks")
    cells = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", None)], "sort_key bigint, entity_id string, value double")
    write_ranking(cells, path)
    before = files(path)
    edits = spark.createDataFrame([(0, 1, "a", 5.0), (1, 1, "a", 2.0), (2, 9, "x", None), (3, None, "x", 1.0), (4, 1, None, 1.0)], EDITS)
    revise_ranking(spark, path, edits)
    revise_ranking(spark, path, edits.limit(0))
    assert files(path) == before
    assert sorted(tuple(r) for r in read_ranking(spark, path).select("sort_key", "entity_id", "rank").collect()) == [(1, "a", 1), (1, "b", 2)]
