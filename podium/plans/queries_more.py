"""Queries of readers, sinks, streams and helpers on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import clean, shape
from ..sources import pages, payloads, snapshots, writers
from ..streaming import append_stream, batch_log, compact, late_rows, read_current, read_latest, stream_daily_sums, stream_name_year_sums, write_current_tables, write_deltas
from .catalogue import query
from .queries_source import fresh
from .views import OBS_DIRTY, OBS_ORDERS, load, obs_dirty, obs_orders


@query("community_list", """SELECT 'kaggle_' || lower(replace(replace(s_name, '#', '-'), ' ', '-')) || '-set-' || s_suppkey AS candidate_id, s_name AS owner, s_name || '/set ' || s_suppkey AS ref,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Title ' || s_suppkey ELSE s_name || '/set ' || s_suppkey END AS title, repeat('d', 290 + (s_suppkey % 30)::INT) AS description,
 CASE WHEN s_suppkey % 4 = 0 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS recency FROM supplier""")
def community_list(spark, sf):
    """Descriptions of more than 300 characters stay whole."""
    k = F.col("s_suppkey")
    record = F.struct(F.concat("s_name", F.lit("/set "), k.cast("string")).alias("ref"), F.when(k % 2 == 0, F.concat(F.lit("Title "), k.cast("string"))).alias("title"),
                      F.repeat(F.lit("d"), (290 + k % 30).cast("int")).alias("description"), F.when(k % 4 == 0, F.lit("2026-01-02T00:00:00Z")).when(k % 4 == 1, F.lit("2001-01-01")).alias("lastUpdated"))
    lists = load(spark, sf, "supplier").select(F.to_json(F.array(record)).alias("value"))
    return payloads.community_candidates(lists, "2026-06-01").select("candidate_id", "owner", "ref", "title", "description", "recency")


@query("row_service", "SELECT p_partkey::VARCHAR AS \"p_partkey\", p_name AS \"p name\", '' AS nothing FROM part")
def row_service(spark, sf):
    row = F.to_json(F.struct("p_partkey", F.col("p_name").alias("p name")))
    answers = load(spark, sf, "part").select(F.to_json(F.struct(F.array(F.struct(row.alias("row"))).alias("rows"))).alias("value"))
    # The service nests each row as an object, not as its text.
    answers = answers.select(F.regexp_replace(F.replace("value", F.lit('\\"'), F.lit('"')), r'"row":"(\{.*?\})"', r'"row":$1').alias("value"))
    return payloads.row_service_table(answers, ["p_partkey", "p name", "nothing"])


@query("sidecar_unit", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'unit ' || p_partkey % 7 WHEN 1 THEN 'top ' || p_partkey % 5 END AS unit FROM part")
def sidecar_unit(spark, sf):
    k = F.col("p_partkey")
    inner = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit(" unit "), (k % 7).cast("string"), F.lit(" ")).alias("unit")).alias("display"))).alias("dimensions")))
    outer = F.to_json(F.struct(F.concat(F.lit("top "), (k % 5).cast("string")).alias("unit")))
    text = F.when(k % 3 == 0, inner).when(k % 3 == 1, outer).otherwise(F.lit("{}"))
    return load(spark, sf, "part").select("p_partkey", payloads.sidecar_unit(text).alias("unit"))


@query("write_artefacts", "SELECT 'orders' AS artefact, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM orders UNION ALL SELECT 'customer', count(*), count(DISTINCT c_custkey) FROM customer")
def write_artefacts(spark, sf):
    out = writers.write_artefacts(fresh(spark, "artefacts"), {"customer": "json"}, orders=load(spark, sf, "orders"), customer=load(spark, sf, "customer"))
    one = spark.read.parquet(out["orders"]).select(F.lit("orders").alias("artefact"), F.col("o_custkey").alias("k"))
    two = spark.read.json(out["customer"]).select(F.lit("customer").alias("artefact"), F.col("c_custkey").alias("k"))
    return one.unionByName(two).groupBy("artefact").agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys"))


@query("nested_records", f"WITH {OBS_ORDERS} SELECT entity, date, value, unit, status FROM obs")
def nested_records(spark, sf):
    """To nested records, to JSON lines, and back to flat rows."""
    path = fresh(spark, "nested")
    writers.write_nested_json(clean.build_observations(obs_orders(spark, sf)), path)
    schema = "entity struct<id: string, name: string>, date string, value double, unit string, frequency string, geography string, status string, source struct<url: string, publisher: string>, confidence double"
    return clean.to_core(spark.read.schema(schema).json(path)).select("entity", "date", "value", "unit", "status")


@query("find_column", "SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders")
def find_column(spark, sf):
    o = load(spark, sf, "orders")
    return o.agg(F.round(F.sum(shape.find_column(o, "O Total-Price")), 2).alias("total"), F.count(shape.find_column(o, "o orderkey")).alias("n"))


@query("flag_emoji", """SELECT lang, chr(127462 + ascii(upper(lang)) - 65) || chr(127462 + ascii(upper(substr(lang, 2, 1))) - 65) AS flag, count(*) AS n FROM documents GROUP BY lang""")
def flag_emoji(spark, sf):
    return load(spark, sf, "documents").groupBy("lang", fn.flag_emoji("lang").alias("flag")).agg(F.count("*").alias("n"))


@query("candidate_ids", "SELECT s_suppkey, 'ckan_' || repeat('long-', 12) || 'supplier-' || lpad(s_suppkey::VARCHAR, 9, '0') AS id FROM supplier")
def candidate_ids(spark, sf):
    """Ids that differ behind their sixtieth character stay apart."""
    name = F.concat(F.repeat(F.lit("Long "), 12), F.lit("Supplier#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    return load(spark, sf, "supplier").select("s_suppkey", fn.prefixed_slug("ckan", name).alias("id"))


@query("many_links", "SELECT page_id, i + 1 AS place, 'https://l.test/' || page_id || '/' || i AS url, 'no ' || i AS title FROM pages, range(90) t(i)")
def many_links(spark, sf):
    """A page of ninety links, each twice."""
    link = F.transform(F.sequence(F.lit(0), F.lit(89)), lambda i: F.concat(F.lit('<a class="x" href="https://l.test/'), F.col("page_id").cast("string"), F.lit("/"), i.cast("string"),
                                                                           F.lit('">no <b>'), i.cast("string"), F.lit("</b></a> ")))
    html = F.concat(F.array_join(link, ""), F.array_join(link, ""))
    return pages.html_links(load(spark, sf, "pages").select("page_id", html.alias("html")))


@query("many_names", "SELECT 'Name ' || i AS entity, year(o_orderdate)::VARCHAR AS date, count(*)::DOUBLE AS value FROM orders, range(80) t(i) WHERE o_orderkey % 3 = 0 OR i < 2 GROUP BY ALL")
def many_names(spark, sf):
    """Cells of eighty names, in every third row; two names in the others."""
    last = F.when(F.col("o_orderkey") % 3 == 0, F.lit(79)).otherwise(F.lit(1))
    names = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.concat(F.lit("Name "), i.cast("string")).alias("name")))
    rows = load(spark, sf, "orders").select(F.to_json(names).alias("cast"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("1").alias("one"))
    return shape.sum_by_name_year(rows, "cast", "day", "one")


@query("distinct_entities", f"WITH {OBS_DIRTY} SELECT source AS entity_id, arg_min(entity, ord) AS entity FROM obs GROUP BY source")
def distinct_entities(spark, sf):
    return clean.distinct_entities(obs_dirty(spark, sf).withColumn("entity_id", F.col("source")))


@query("stream_append", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def stream_append(spark, sf):
    """An append log fed by several files in several batches; a second run adds nothing."""
    folder, log, state = fresh(spark, "appended"), fresh(spark, "append-log"), fresh(spark, "append-state")
    events = load(spark, sf, "events").select("event_id", "event_type")
    events.repartition(4, "event_id").write.json(folder)
    for _ in range(2):
        rows = spark.readStream.schema("event_id bigint, event_type string").option("maxFilesPerTrigger", 1).json(folder)
        append_stream(rows, log, state).awaitTermination()
    return spark.read.schema("event_id bigint, event_type string").json(log).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("stream_sums_batches", "SELECT o_orderpriority AS entity, year(o_orderdate)::VARCHAR AS date, sum(floor(o_totalprice))::DOUBLE AS value FROM orders GROUP BY ALL")
def stream_sums_batches(spark, sf):
    """Sums over four files in four batches agree with the sums of the whole table."""
    folder, out = fresh(spark, "sum-files"), fresh(spark, "sum-batches")
    orders = load(spark, sf, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.floor("o_totalprice").cast("string").alias("price"), "o_orderkey")
    orders.repartition(4, "o_orderkey").drop("o_orderkey").write.parquet(folder)
    sums = stream_name_year_sums(spark, folder, "o_orderpriority string, day string, price string", "o_orderpriority", "day", "price", "parquet", files_per_trigger=1)
    write_current_tables(sums, out, fresh(spark, "sum-state")).awaitTermination()
    return read_current(spark, out)


@query("name_table", """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Player ' || i ELSE 'Solo ' || o_orderkey % 7 END AS entity, year(o_orderdate)::VARCHAR AS date, sum(floor(o_totalprice))::DOUBLE AS value, 'USD' AS unit
 FROM orders, range(3) t(i) WHERE o_orderkey % 3 = 0 OR i = 0 GROUP BY ALL""")
def name_table(spark, sf):
    """The list column is found among titles and dates with odd headers; every third row lists three players."""
    k = F.col("o_orderkey")
    three = F.to_json(F.array(*[F.struct(F.lit(f"Player {i}").alias("name")) for i in range(3)]))
    table = load(spark, sf, "orders").select(
        F.concat(F.lit("Title "), k.cast("string")).alias("title"), F.when(k % 3 == 0, three).otherwise(F.concat(F.lit("Solo "), (k % 7).cast("string"))).alias("starring"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"), F.floor("o_totalprice").cast("string").alias("revenue"))
    return shape.name_table_drafts(table, "USD")


@query("domain_ranks", """SELECT s_suppkey AS rank, 's' || s_suppkey || '.test' AS entity FROM supplier WHERE s_suppkey % 5 NOT IN (1, 2) AND s_suppkey >= 1
 UNION ALL SELECT s_suppkey, 's' || s_suppkey || '.test' FROM supplier WHERE s_suppkey % 5 = 1""")
def domain_ranks(spark, sf):
    """Lists with a rank that is no number, a name without a dot, capitals and blanks."""
    k = F.col("s_suppkey")
    host = F.concat(F.lit("s"), k.cast("string"), F.lit(".test"))
    rows = load(spark, sf, "supplier").select(
        F.concat(F.lit("\u00a0"), k.cast("string"), F.lit(" ")).alias("r"), F.when(k % 5 == 1, F.concat(F.lit(" "), F.upper(host))).when(k % 5 == 2, F.lit("no domain")).otherwise(host).alias("d"))
    heads = load(spark, sf, "supplier").select(F.lit("rank").alias("r"), F.lit("a.test").alias("d"))
    return snapshots.domain_ranks(rows.unionByName(heads), "r", "d")


@query("dataset_hash", """WITH r AS (SELECT sha256(coalesce(length(o_orderkey::VARCHAR) || ':' || o_orderkey::VARCHAR, '-') || '|' || coalesce(length(o_orderpriority::VARCHAR) || ':' || o_orderpriority::VARCHAR, '-') || '|' || coalesce(length(nullif(o_orderstatus, 'O')::VARCHAR) || ':' || nullif(o_orderstatus, 'O')::VARCHAR, '-')) AS h FROM orders), s AS (SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS s0, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS s1, sum(('0x' || substr(h, 31, 15))::BIGINT)::VARCHAR AS s2, sum(('0x' || substr(h, 46, 15))::BIGINT)::VARCHAR AS s3 FROM r)
 SELECT rows, sha256(concat_ws('|', rows::VARCHAR, s0, s1, s2, s3)) AS hash FROM s""")
def dataset_hash(spark, sf):
    orders = load(spark, sf, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("O")))
    return fn.dataset_hash(orders.repartition(5), "o_orderkey", "o_orderpriority", "status")


@query("fetched_unit", """SELECT doc_id, CASE WHEN regexp_matches(lower(text), '%|percent|share|rate|ratio') THEN 'percent' END IS NOT NULL AS percent FROM documents""")
def fetched_unit(spark, sf):
    unit = fn.fetched_table_unit("text", F.lit(""))
    return load(spark, sf, "documents").select("doc_id", (unit == "percent").alias("percent"))


# --- streams in update mode ----------------------------------------------------------------------------------------

#: Events come in four deliveries in order of time; one row in fifty comes with the last one, whatever its time. A day of which the
#: end lies two days before the latest event of the deliveries before is closed.
_DELIVERED = """e AS (SELECT event_id, event_type, ts, CAST(floor(value * 100) AS BIGINT) AS cents, date_trunc('day', ts) AS day,
  CASE WHEN event_id % 50 = 7 THEN 3 ELSE date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) * 4
   // (date_diff('day', (SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events)) + 1) END AS delivery
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
 tops AS (SELECT delivery, max(ts) AS top FROM e GROUP BY delivery),
 marks AS (SELECT a.delivery, max(b.top) - INTERVAL 2 DAY AS mark FROM tops a LEFT JOIN tops b ON b.delivery < a.delivery GROUP BY a.delivery),
 kept AS (SELECT e.* FROM e JOIN marks ON e.delivery = marks.delivery WHERE mark IS NULL OR day + INTERVAL 1 DAY > mark)"""


def _delivered_stream(spark, sf):
    """Four deliveries, each consumed by a run of its own, with a compaction in between: (path of the table, logs of the runs)."""
    folder, path, state = fresh(spark, "deliveries"), fresh(spark, "daily-sums"), fresh(spark, "daily-state")
    events = load(spark, sf, "events").select("event_id", "event_type", F.col("ts").alias("event_time"), F.floor(F.col("value") * 100).cast("bigint").alias("value"))
    span = events.agg(F.to_date(F.min("event_time")).alias("first"), F.to_date(F.max("event_time")).alias("last")).first()
    days = max((span["last"] - span["first"]).days + 1, 1) if span["first"] else 1
    part = F.when(F.col("event_id") % 50 == 7, 3).otherwise(F.floor(F.datediff("event_time", F.lit(span["first"])) * 4 / days))
    logs = []
    for n in range(4):
        events.filter(part == n).drop("event_id").write.mode("append").parquet(folder)
        rows = spark.readStream.schema("event_type string, event_time timestamp, value bigint").option("maxFilesPerTrigger", 1_000_000).parquet(folder)
        run = write_deltas(stream_daily_sums(rows, ["event_type"], "2 days"), path, state)
        run.awaitTermination()
        logs += batch_log(run)
        if n == 1:
            compact(spark, path, ["day", "event_type"])
    return path, logs


@query("stream_daily_update", f"WITH {_DELIVERED} SELECT day::DATE AS day, event_type, sum(cents)::BIGINT AS value, count(*) AS n FROM kept GROUP BY ALL")
def stream_daily_update(spark, sf):
    """Daily sums written as changed keys per batch, merged on read; rows of closed days are dropped."""
    return read_latest(spark, _delivered_stream(spark, sf)[0], ["day", "event_type"])


@query("stream_late_rows", f"WITH {_DELIVERED} SELECT (SELECT count(*) FROM e) AS rows_read, (SELECT count(*) FROM kept) AS rows_held, (SELECT count(*) FROM e) - (SELECT count(*) FROM kept) AS rows_late")
def stream_late_rows(spark, sf):
    path, logs = _delivered_stream(spark, sf)
    return late_rows(spark, path, logs)
