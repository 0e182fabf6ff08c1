import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
import check  # noqa: E402

SAMPLE = ("rank_delta_mover", "rank_asc", "tape_bars_gaps", "tape_fill_all", "verify_multi", "verify_single_source", "quality_report", "parse_date", "scaled_number",
          "html_tables", "ground_quotes", "host_cap", "token_match", "stream_leaderboard", "verify_notes", "name_table", "many_links", "dataset_hash", "sparse_head",
          "domain_ranks", "candidate_ids")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, db, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = check.rows_of(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == want and want
