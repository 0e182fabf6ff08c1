"""Sources, table shapes, pages, candidates and streams, on data derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import shape, sourcing
from ..session import shared_folder
from ..sources import pages, payloads, readers, snapshots, writers
from ..streaming import current_leaderboard, read_current, stream_cells, stream_name_year_sums, write_current_tables
from .catalogue import query
from .queries_text import HOST, URL_KEY, prompts, PROMPT
from .views import OBS_DIRTY, OBS_ORDERS, OBS_PUBLISHERS, WIDE_CELLS, YEARS, load, obs_dirty, obs_orders, orders_as_obs, wide_nation_year
from .queries_text import LOOKS, SCALED, STRIPPED, trim


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- table shapes ---------------------------------------------------------------------------------------------------


@query("melt_wide", f"WITH {WIDE_CELLS} SELECT entity, date, value::DOUBLE AS value, 'USD' AS unit FROM cells WHERE value > 0")
def melt_wide(spark, sf):
    return shape.melt_wide(wide_nation_year(spark, sf), "country", "USD")


@query("melt_transposed", f"WITH {WIDE_CELLS} SELECT entity, date, value::DOUBLE AS value, 'USD' AS unit FROM cells WHERE value > 0")
def melt_transposed(spark, sf):
    nations = [f"NATION_{i}" for i in range(25)]
    long = wide_nation_year(spark, sf).unpivot("country", YEARS, "year", "cell")
    table = long.groupBy("year").pivot("country", nations).agg(F.first("cell"))
    return shape.melt_transposed(table, "year", "USD", nations)


@query("detected_melt", f"WITH {WIDE_CELLS} SELECT entity, date, value::DOUBLE AS value, 'count' AS unit FROM cells WHERE value > 0")
def detected_melt(spark, sf):
    return shape.drafts_from_table(wide_nation_year(spark, sf))


DRAFT = f"""{OBS_DIRTY}, {SCALED}, {STRIPPED}, j AS (SELECT t.ord, stripped, {trim('t.date')} AS s, num * f AS value,
 CASE WHEN num IS NOT NULL AND right(t.cell, 1) = '%' THEN 'percent' ELSE 'count' END AS unit FROM t JOIN e ON e.ord = t.ord),
 k AS (SELECT *, CASE WHEN stripped = '' OR s = '' THEN 'blank' WHEN NOT {LOOKS} THEN 'bad date' END AS skipped FROM j)"""


@query("drafts_long", f"WITH {DRAFT} SELECT ord, stripped AS entity, s AS date, value, unit, skipped FROM k")
def drafts_long(spark, sf):
    return shape.long_drafts(obs_dirty(spark, sf), "entity", "date", "cell")


@query("skip_counts", f"WITH {DRAFT} SELECT count(*) FILTER (skipped IS NULL) AS kept, count(*) FILTER (skipped = 'blank') AS skipped_blank, count(*) FILTER (skipped = 'bad date') AS skipped_bad_date FROM k")
def skip_counts(spark, sf):
    return shape.skip_counts(shape.long_drafts(obs_dirty(spark, sf), "entity", "date", "cell"))


@query("detect_columns", "SELECT 'c_name' AS entity, NULL AS date, 'c_acctbal' AS value, true AS guessed FROM customer LIMIT 1")
def detect_columns(spark, sf):
    """Detected on the customers, whose key is set aside as an id."""
    found = shape.detect_columns(load(spark, sf, "customer").select("c_name", "c_acctbal", "c_mktsegment"))
    row = [(found.entity, found.date, found.value, found.value_guessed)]
    return spark.createDataFrame(row, "entity string, date string, value string, guessed boolean")


CAST = """c AS (SELECT o_orderkey AS ord, '[{"name": "Name ' || (o_custkey % 50) || '", "id": 1}, {"name":"Name ' || (o_custkey % 7) || ' Inc."}, {"name": "N"}]' AS people,
 'in ' || year(o_orderdate) AS at_, o_totalprice AS v, o_custkey FROM orders),
 x AS (SELECT 'Name ' || (o_custkey % 50) AS entity, at_, v FROM c UNION ALL SELECT 'Name ' || (o_custkey % 7), at_, v FROM c)"""


def _cast(spark, sf):
    o = load(spark, sf, "orders")
    one, two = (o["o_custkey"] % 50).cast("string"), (o["o_custkey"] % 7).cast("string")
    people = F.concat(F.lit('[{"name": "Name '), one, F.lit('", "id": 1}, {"name":"Name '), two, F.lit(' Inc."}, {"name": "N"}]'))
    return o.select(people.alias("cast"), F.concat(F.lit("in "), F.year("o_orderdate").cast("string")).alias("release_date"),
                    F.col("o_totalprice").cast("string").alias("revenue"))


@query("explode_names_sum", f"WITH {CAST} SELECT entity, right(at_, 4) AS date, round(sum(v), 2) AS value FROM x GROUP BY ALL")
def explode_names_sum(spark, sf):
    sums = shape.sum_by_name_year(_cast(spark, sf), "cast", "release_date", "revenue", keep=None)
    return sums.withColumn("value", F.round("value", 2))


@query("top_name_years", f"WITH {CAST} SELECT entity, right(at_, 4) AS date, round(sum(v), 2) AS value FROM x GROUP BY ALL ORDER BY sum(v) DESC, entity, date LIMIT 25")
def top_name_years(spark, sf):
    sums = shape.sum_by_name_year(_cast(spark, sf), "cast", "release_date", "revenue", keep=25)
    return sums.withColumn("value", F.round("value", 2))


@query("top_rows_large", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12000")
def top_rows_large(spark, sf):
    """A top-k too large for one task's merge."""
    from ..operators.ordering import first_rows_spread
    return first_rows_spread(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 12_000).drop("rank")


@query("year_end_value", """SELECT 'user ' || (user_id % 40) AS entity, year(ts + to_days((event_id % 900)::INT)) AS year,
 floor(arg_max(value, epoch_us(ts) // 1000000 * 1000 + (event_id % 900) * 86400000 + 0) * 100000 + 0.5)::DOUBLE AS value FROM (SELECT * FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id % 40, epoch_us(ts) // 1000000 + (event_id % 900) * 86400 ORDER BY event_id) = 1) GROUP BY ALL""")
def year_end_value(spark, sf):
    e = load(spark, sf, "events")
    ts = F.unix_seconds(F.col("ts").cast("timestamp")) + (F.col("event_id") % 900) * 86400
    name = F.concat(F.lit("user "), (F.col("user_id") % 40).cast("string"))
    points = e.select(name.alias("entity"), ts.alias("ts"), "event_id", "value").groupBy("entity", "ts").agg(F.min_by("value", "event_id").alias("m"))
    return shape.year_end_values(points, 100000.0)


@query("year_span", f"WITH {OBS_PUBLISHERS} SELECT min(date::INT) AS year_min, max(date::INT) AS year_max FROM obs")
def year_span(spark, sf):
    return shape.year_span(load(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("year"), "o_totalprice"))


# --- readers and writers on written copies -----------------------------------------------------------------------------


@query("read_csv_multiline", r"""SELECT doc_id::VARCHAR AS doc_id, regexp_replace(text, '^ +| +$', '', 'g') AS text, lang FROM documents""")
def read_csv_multiline(spark, sf):
    path = fresh(spark, "csv")
    load(spark, sf, "documents").select("doc_id", "text", "lang").write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    return readers.read_delimited(spark, path, multi_line=True).select("doc_id", "text", "lang")


@query("read_tsv", "SELECT o_orderkey::VARCHAR AS k, o_orderpriority AS p FROM orders")
def read_tsv(spark, sf):
    path = fresh(spark, "tsv")
    load(spark, sf, "orders").select(F.col("o_orderkey").alias(" k "), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("p")).write.csv(path, header=True, sep="\t")
    return readers.read_table(spark, path, "tsv").select("k", "p")


@query("read_jsonl", "SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment, '{\"nation\":' || c_nationkey || '}' AS place, '' AS nothing FROM customer")
def read_jsonl(spark, sf):
    path = fresh(spark, "jsonl")
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.struct(F.col("c_nationkey").alias("nation")).alias("place"), F.lit(None).cast("string").alias("nothing"))
    c.write.json(path, ignoreNullFields=False)
    return readers.read_jsonl(spark, path)


@query("read_json_envelope", "SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part")
def read_json_envelope(spark, sf):
    path = fresh(spark, "json")
    p = load(spark, sf, "part")
    # A document holds 10 000 keys, so that their number stays far below that of rows: opening a file costs more than reading it.
    bags = p.groupBy((F.col("p_partkey") % 10).alias("bag"), F.floor(F.col("p_partkey") / 100_000).alias("block")).agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("results"))
    bags.write.partitionBy("bag", "block").json(path)  # one document per file
    return readers.read_json_table(spark, path).select("p_partkey", "p_name")


def observation_lines(spark, sf):
    """Path of records whose entity and source are objects in every other row and plain text in the rest."""
    path = fresh(spark, "observations")
    obs = obs_dirty(spark, sf)
    as_object = F.col("ord") % 2 == 0
    entity = F.when(as_object, F.to_json(F.struct(F.lit("x").alias("id"), F.col("entity").alias("name")))).otherwise(F.to_json(F.struct(F.col("entity").alias("t"))))
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("t"))), r"^\{(?:\"t\":)?(.*)\}$", 1), F.lit(""))
    quoted = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(text(c))
    plain = F.concat(F.lit('{"entity":'), F.when(as_object, entity).otherwise(text("entity")), F.lit(',"date":'), text("date"), F.lit(',"value":'),
                     F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit(',"source":'),
                     F.when(as_object & F.col("source").isNotNull(), F.concat(F.lit('{"publisher":'), text("source"), F.lit("}"))).otherwise(quoted("source")),
                     F.lit(',"sourceUrl":'), quoted("source_url"), F.lit("}"))
    obs.select(plain.alias("value")).write.text(path)
    return path


@query("read_observations", f"""WITH {OBS_DIRTY} SELECT CASE WHEN entity = ' ' THEN ' ' ELSE entity END AS entity, date, value, source, source_url, count(*) AS n FROM obs GROUP BY ALL""")
def read_observations(spark, sf):
    return readers.read_observations(spark, observation_lines(spark, sf)).groupBy("entity", "date", "value", "source", "source_url").agg(F.count("*").alias("n"))


@query("read_indicator_pages", "SELECT 'N' || c_nationkey AS country_code, c_name AS entity, 'I.D' AS indicator, (1990 + c_custkey % 30)::VARCHAR AS date, c_acctbal AS value FROM customer WHERE c_custkey % 5 <> 0 AND c_nationkey <> 3")
def read_indicator_pages(spark, sf):
    path = fresh(spark, "indicator")
    c = load(spark, sf, "customer")
    code = F.when(F.col("c_nationkey") == 3, F.lit("WLD")).otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    row = F.struct(F.struct(code.alias("id"), F.col("c_name").alias("value")).alias("country"), F.struct(F.lit("I.D").alias("id")).alias("indicator"),
                   (1990 + F.col("c_custkey") % 30).cast("string").alias("date"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("value"))
    sheets = c.groupBy(F.floor(F.col("c_custkey") / 200).alias("page")).agg(F.collect_list(row).alias("rows"))
    text = F.concat(F.lit('[{"page":1},'), F.to_json("rows", {"ignoreNullFields": "false"}), F.lit("]"))
    sheets.select(text.alias("value")).repartition(8).write.option("lineSep", "\n").text(path)
    lines = spark.read.text(path)
    one_per_file = fresh(spark, "indicator-page")
    lines.withColumn("p", F.xxhash64("value")).write.partitionBy("p").text(one_per_file)
    return payloads.read_indicator_pages(spark, one_per_file + "/*")


@query("write_dataset_csv", f"WITH {OBS_ORDERS} SELECT date, entity_id, entity AS entity_name, value::VARCHAR AS value FROM obs")
def write_dataset_csv(spark, sf):
    from ..functions import slugify
    path = fresh(spark, "dataset")
    writers.write_dataset_csv(obs_orders(spark, sf).withColumn("entity_id", slugify("entity")), path)
    back = readers.read_delimited(spark, path).select("date", "entity_id", "entity_name", "value")
    return back.withColumn("value", F.col("value").cast("double").cast("string"))


@query("append_log", "SELECT event_type AS agent, count(*) * 2 AS n FROM events GROUP BY event_type")
def append_log(spark, sf):
    path = fresh(spark, "log")
    e = load(spark, sf, "events").select(F.col("event_type").alias("agent"), F.col("event_id").alias("id"))
    writers.append_log(e, path)
    writers.append_log(e, path)
    return writers.read_log(spark, path, "agent string, id bigint").groupBy("agent").agg(F.count("*").alias("n"))


@query("upload_kind", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'csv' WHEN 1 THEN 'csv' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'json' WHEN 4 THEN 'pdf' WHEN 5 THEN 'image' WHEN 6 THEN 'txt' ELSE 'unknown' END AS kind FROM part")
def upload_kind(spark, sf):
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("csv", "TSV", "ods", "jsonl", "PDF", "jpeg", "txt", "exe")]), (k % 8 + 1).cast("int"))
    return load(spark, sf, "part").select("p_partkey", readers.upload_kind(F.concat("p_name", F.lit("."), ext)).alias("kind"))


# --- pages ------------------------------------------------------------------------------------------------------------

LINK = r"""(?is)<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>"""


@query("html_links", f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS us, regexp_extract_all(html, '{LINK}', 2) AS ts FROM pages),
 l AS (SELECT page_id, unnest(us) AS url, unnest(ts) AS inner_, unnest(generate_series(1, len(us))) AS at_ FROM a),
 o AS (SELECT page_id, url, min(at_) AS at_, arg_min(inner_, at_) AS inner_ FROM l GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY at_) AS place, trim(regexp_replace(regexp_replace(inner_, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM o)
 SELECT page_id, place, url, title FROM p WHERE place <= 60""")
def html_links(spark, sf):
    return pages.html_links(load(spark, sf, "pages"), absolute_only=False)


@query("ranked_slugs", r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([a-z0-9-]+)"', 1)) AS slug, unnest(generate_series(1, len(regexp_extract_all(html, 'href="/([a-z0-9-]+)"', 1)))) AS at_ FROM pages),
 o AS (SELECT page_id, slug, min(at_) AS at_ FROM l GROUP BY ALL) SELECT page_id, slug, row_number() OVER (PARTITION BY page_id ORDER BY at_) AS rank FROM o QUALIFY rank <= 3""")
def ranked_slugs(spark, sf):
    return pages.ranked_slugs(load(spark, sf, "pages"), 3, r'href="/([a-z0-9-]+)"')


@query("html_tables", f"WITH {WIDE_CELLS} SELECT n_nationkey AS page_id, entity, date AS year, value::BIGINT::VARCHAR || ' & more' AS value FROM cells JOIN nation ON n_name = entity WHERE value IS NOT NULL AND n_nationkey % 4 <> 3")
def html_tables(spark, sf):
    """Pages with two tables each: the nation's years, and one that repeats them with other numbers."""
    wide = wide_nation_year(spark, sf).join(load(spark, sf, "nation"), F.col("country") == F.col("n_name"))
    cell = lambda i, y, suffix: F.coalesce(F.concat(F.nullif(F.col(y), F.lit("-")), F.lit(f"[{i + 1}]&nbsp;&amp; <b>{suffix}</b>")), F.lit(""))
    cells = lambda suffix: F.concat(*[F.concat(F.lit("<td>"), cell(i, y, suffix), F.lit("</td>")) for i, y in enumerate(YEARS)])
    head = "<tr><th>Country</th>" + "".join(f"<th>In {y}</th>" for y in YEARS) + "</tr>"
    row = lambda suffix: F.concat(F.lit(f"<TABLE class=x>{head}<tr><td><a href='/x'>"), "country", F.lit("</a></td>"), cells(suffix), F.lit("</tr></TABLE>"))
    html = F.concat(F.lit("<html><table><tr><td>menu</td></tr></table>"), row("more"), F.lit("<p>text</p>"), row("less"), F.lit("</html>"))
    html = F.when(F.col("n_nationkey") % 4 == 3, F.lit("<p>no table</p>")).otherwise(html)
    return pages.html_tables(wide.select(F.col("n_nationkey").alias("page_id"), html.alias("html"))).select("page_id", "entity", "year", "value")


@query("embedded_series", """SELECT CASE WHEN user_id % 3 = 0 THEN 'company' ELSE 'User ' || user_id END AS entity, epoch_us(ts) // 1000000 AS ts, round(value, 2) AS m FROM events WHERE round(value, 2) > 0""")
def embedded_series(spark, sf):
    """One page per user and day, with the day's events as the points of its chart."""
    e = load(spark, sf, "events")
    point = F.concat(F.lit('{"d":'), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit(',"m":'), F.format_string("%.2f", "value"), F.lit("}"))
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.collect_list(point), ",").alias("points"))
    who = F.col("user_id").cast("string")
    title = F.when(F.col("user_id") % 3 == 0, F.lit("<title>Home</title>")).otherwise(F.concat(F.lit("<title> User "), who, F.lit(" (U"), who, F.lit(") - Market capitalization</title>")))
    return pages.embedded_series(days.select(F.concat(title, F.lit("<script>var c = ["), "points", F.lit("]</script>")).alias("html")))


# --- dated lists ----------------------------------------------------------------------------------------------------------


@query("snapshot_series", """WITH l AS (SELECT o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey) AS rank, 'c' || o_custkey AS entity FROM orders),
 w AS (SELECT y, p, make_date(y::INT, 6, 15) + list_extract([0, 1, -1, 2, -2, 7, -7], p::INT)::INT AS day FROM (SELECT unnest(generate_series(1994, 2002)) AS y), (SELECT unnest(generate_series(1, 7)) AS p)),
 s AS (SELECT day FROM l GROUP BY day HAVING count(*) >= 5), c AS (SELECT y, arg_min(w.day, p) AS day FROM w JOIN s ON s.day = w.day GROUP BY y)
 SELECT entity, y AS year, 101 - rank AS score FROM l JOIN c USING (day) WHERE rank <= 5""")
def snapshot_series(spark, sf):
    from pyspark.sql import Window
    o = load(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    place = F.row_number().over(Window.partitionBy("day").orderBy("o_orderkey")).cast("bigint")
    lists = o.select("day", place.alias("rank"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"))
    return snapshots.snapshot_series(lists, 1994, 2002, "0615", top_n=5)


# --- candidates -----------------------------------------------------------------------------------------------------------


def _scored(spark, sf):
    p, k = load(spark, sf, "part"), F.col("p_partkey")
    part = lambda m: (k % m).cast("double") / F.lit(float(m))
    return p.select(k.alias("ord"), part(10).alias("authority"), part(7).alias("directness"), part(9).alias("coverage"), (k % 2 == 0).alias("machine_readable"),
                    part(3).alias("methodology"), part(4).alias("recency"), part(11).alias("consistency"))


@query("source_score", """SELECT p_partkey AS ord, round(((k % 10) / 10::DOUBLE * 0.25 + (k % 7) / 7::DOUBLE * 0.2 + (k % 9) / 9::DOUBLE * 0.15 + (CASE WHEN k % 2 = 0 THEN 1 ELSE 0.35 END) * 0.1
 + (k % 3) / 3::DOUBLE * 0.15 + (k % 4) / 4::DOUBLE * 0.05 + (k % 11) / 11::DOUBLE * 0.1), 6) AS quality_score FROM (SELECT p_partkey, p_partkey AS k FROM part)""")
def source_score(spark, sf):
    return sourcing.score_candidates(_scored(spark, sf)).select("ord", F.round("quality_score", 6).alias("quality_score"))


def _results(spark, sf):
    return obs_dirty(spark, sf).filter("source_url is not null").select("ord", F.col("source_url").alias("url"))


RESULTS = f"{OBS_DIRTY}, r AS (SELECT ord, source_url AS url, {URL_KEY.format('source_url')} AS url_key, {HOST} AS host FROM obs WHERE source_url IS NOT NULL)"


@query("url_dedupe", f"WITH {RESULTS} SELECT url_key, min(ord) AS ord, arg_min(url, ord) AS url FROM r GROUP BY url_key")
def url_dedupe(spark, sf):
    return sourcing.distinct_urls(_results(spark, sf))


@query("unseen_urls", f"WITH {RESULTS} SELECT ord, url FROM r WHERE url_key NOT IN (SELECT url_key FROM r WHERE ord < 40)")
def unseen_urls(spark, sf):
    results = _results(spark, sf)
    return sourcing.unseen_urls(results, results.filter("ord < 40").select("url")).select("ord", "url")


@query("host_cap", f"""WITH {RESULTS}, d AS (SELECT url_key, min(ord) AS ord, arg_min(url, ord) AS url, CASE WHEN arg_min(host, ord) = '' THEN 'web' ELSE arg_min(host, ord) END AS host FROM r GROUP BY url_key)
 SELECT host, url, ord, row_number() OVER (PARTITION BY host ORDER BY ord) AS host_place FROM d QUALIFY host_place <= 3""")
def host_cap(spark, sf):
    return sourcing.cap_per_host(_results(spark, sf)).select("host", "url", "ord", "host_place")


@query("web_candidates", f"WITH {RESULTS} SELECT ord, host, regexp_matches(url, '(?i)\\.(csv|json|xlsx?|tsv)(\\?|$)') OR regexp_matches(url, '(?i)/api/') AS machine_readable, CASE WHEN host = 'data.gov' THEN 0.8 ELSE 0.3 END::DOUBLE AS authority FROM r")
def web_candidates(spark, sf):
    return sourcing.web_candidates(_results(spark, sf)).select("ord", "host", "machine_readable", "authority")


@query("top_per_source", "SELECT source, tier, ord, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS place FROM (SELECT source, length(source) AS tier, doc_id AS ord FROM documents)) WHERE place <= 5")
def top_per_source(spark, sf):
    hits = load(spark, sf, "documents").select("source", F.length("source").alias("tier"), F.col("doc_id").alias("ord"))
    return sourcing.top_per_source(hits, 5)


@query("apply_decisions", "SELECT d.doc_id AS candidate_id, quality = 1 AS accept, coalesce(quality = 1 AND toxic = 1, false) AS \"primary\" FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def apply_decisions(spark, sf):
    candidates = load(spark, sf, "documents").select(F.col("doc_id").alias("candidate_id"))
    decisions = load(spark, sf, "labels").select(F.col("doc_id").alias("candidate_id"), (F.col("quality") == 1).alias("accept"), F.col("toxic").alias("pick"))
    return sourcing.apply_decisions(candidates, decisions).select("candidate_id", "accept", "primary")


@query("token_match", """WITH c AS (SELECT p_partkey AS ord, p_name || ' ' || p_type AS name FROM part), s AS (SELECT *, string_split_regex(lower(name), '[^a-z0-9]+') AS w FROM c),
 m AS (SELECT ord, name, (list_contains(w, 'red') OR list_contains(w, 'reds'))::INT + (list_contains(w, 'widget') OR list_contains(w, 'widgets'))::INT + (list_contains(w, 'economy') OR list_contains(w, 'economies'))::INT AS matched FROM s)
 SELECT ord, name, matched, matched / 3::DOUBLE AS score FROM m WHERE matched / 3::DOUBLE >= 0.5""")
def token_match(spark, sf):
    names = load(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return sourcing.match_names(names, "the largest RED widgets of economies")


GROUND = """docs AS (SELECT doc_id AS page_id, text || ' was ' || (100000 + doc_id) || ' in all' AS text FROM documents),
 cl AS (SELECT doc_id * 4 + p AS ord, doc_id AS page_id, CASE WHEN p IN (0, 3) THEN 'Total' ELSE 'E' || p END AS entity, '2020' AS date,
  CASE p WHEN 1 THEN NULL WHEN 2 THEN 7 ELSE 100000 + doc_id END::DOUBLE AS value, CASE p WHEN 0 THEN 'WAS  ' || (100000 + doc_id) WHEN 1 THEN substr(text, 1 + doc_id % 9, doc_id % 40) WHEN 2 THEN 'never said by this page'
  ELSE ' was ' || (100000 + doc_id) || ' in' END AS quote FROM documents, (SELECT unnest(generate_series(0, 3)) AS p)),
 q AS (SELECT c.*, lower(regexp_replace(c.quote, '\\s+', ' ', 'g')) AS qn, lower(regexp_replace(d.text, '\\s+', ' ', 'g')) AS hay FROM cl c JOIN docs d USING (page_id)),
 v AS (SELECT *, CASE WHEN length(qn) < 8 THEN 'short quote' WHEN NOT contains(hay, qn) THEN 'quote not in page' WHEN value IS NOT NULL AND NOT contains(qn, value::BIGINT::VARCHAR) THEN 'number not in quote' END AS d FROM q)"""


@query("ground_quotes", f"""WITH {GROUND} SELECT ord, page_id, CASE WHEN d IS NULL AND ord > min(CASE WHEN d IS NULL THEN ord END) OVER (PARTITION BY page_id, lower(entity), date) THEN 'repeated cell' ELSE d END AS dropped FROM v""")
def ground_quotes(spark, sf):
    d = load(spark, sf, "documents")
    number = F.col("doc_id") + 100000
    text = F.concat("text", F.lit(" was "), number.cast("string"), F.lit(" in all"))
    sides = d.select("doc_id", "text", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("p"))
    quote = (F.when(F.col("p") == 0, F.concat(F.lit("WAS  "), number.cast("string")))
             .when(F.col("p") == 1, F.substring(F.col("text"), (1 + F.col("doc_id") % 9).cast("int"), (F.col("doc_id") % 40).cast("int")))
             .when(F.col("p") == 2, F.lit("never said by this page")).otherwise(F.concat(F.lit(" was "), number.cast("string"), F.lit(" in"))))
    claims = sides.select((F.col("doc_id") * 4 + F.col("p")).alias("ord"), F.col("doc_id").alias("page_id"),
                          F.when(F.col("p").isin(0, 3), F.lit("Total")).otherwise(F.concat(F.lit("E"), F.col("p").cast("string"))).alias("entity"), F.lit("2020").alias("date"),
                          F.when(F.col("p") == 2, F.lit(7.0)).when(F.col("p") != 1, number.cast("double")).alias("value"), quote.alias("quote"))
    return sourcing.ground_claims(claims, d.select(F.col("doc_id").alias("page_id"), text.alias("text"))).select("ord", "page_id", "dropped")


@query("grounded_links", """WITH p AS (SELECT conv_id AS run_id, turn AS ord, text || ' HTTPS://s' || (conv_id % 5) || '.test/' || turn AS text FROM conversations),
 l AS (SELECT DISTINCT conv_id AS run_id, 'https://s' || (conv_id % 5) || '.test/' || turn AS url FROM conversations)
 SELECT DISTINCT l.run_id, url FROM l JOIN p ON p.run_id = l.run_id AND contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), url)""")
def grounded_links(spark, sf):
    c = load(spark, sf, "conversations")
    address = F.concat(F.lit("https://s"), (F.col("conv_id") % 5).cast("string"), F.lit(".test/"), F.col("turn").cast("string"))
    read = c.select(F.col("conv_id").alias("run_id"), F.lit("none").alias("url"), F.concat("text", F.lit(" "), F.replace(address, F.lit("https"), F.lit("HTTPS"))).alias("text"))
    return sourcing.grounded_links(c.select(F.col("conv_id").alias("run_id"), address.alias("url")), read)


@query("sources_for_topics", f"""WITH {PROMPT}, t AS (SELECT count(*) FILTER (id % 6 = 0) > 0 AS any_ FROM p) SELECT 20 AS tier1, 17 AS tier2, 0 AS tier3 FROM t WHERE any_""")
def sources_for_topics(spark, sf):
    """Sources ordered for the most frequent topic of the prompts, counted per tier."""
    from ..functions import topics
    tags = prompts(spark, sf).select(F.explode(topics("text")).alias("topic")).groupBy("topic").count()
    top = tags.orderBy(F.col("count").desc(), "topic").first()["topic"]
    listed = sourcing.sources_for_topics(sourcing.tiered_sources(spark), [top])
    return listed.agg(*[F.count(F.when(F.col("tier") == i, F.lit(1))).alias(f"tier{i}") for i in (1, 2, 3)])


@query("catalogue_resources", """SELECT n_name AS dataset, 'Supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') AS name, CASE s_suppkey % 3 WHEN 0 THEN 'CSV' WHEN 1 THEN 'PDF' ELSE '' END AS format FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def catalogue_resources(spark, sf):
    """Search payloads, one per nation and block of suppliers, flattened to resources."""
    s = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    res = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("https://r.test/"), k.cast("string")).alias("url"), F.when(k % 3 == 0, F.lit("csv")).when(k % 3 == 1, F.lit("Pdf")).alias("format"))
    packages = s.groupBy("n_name", F.floor(k / 100).alias("block")).agg(F.collect_list(res).alias("resources"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("n_name").alias("name"), "resources")).alias("results")).alias("result")))
    return payloads.catalogue_resources(packages.select(body.alias("value"))).select("dataset", "name", "format")


@query("preferred_resource", """SELECT n_name AS dataset, coalesce(min(s_suppkey) FILTER (s_suppkey % 3 = 0), min(s_suppkey)) AS pick FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def preferred_resource(spark, sf):
    s = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    sets = s.groupBy("n_name").agg(F.array_sort(F.collect_list(F.struct(k.alias("key"), F.when(k % 3 == 0, F.lit("csv")).otherwise(F.lit("pdf")).alias("format")))).alias("r"))
    return sets.select(F.col("n_name").alias("dataset"), payloads.preferred_resource("r")["key"].alias("pick"))


# --- streams ------------------------------------------------------------------------------------------------------------------


@query("stream_name_year_sum", "SELECT o_orderpriority AS entity, year(o_orderdate)::VARCHAR AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def stream_name_year_sum(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    sums = stream_name_year_sums(spark, f"{sf}/orders*.parquet", orders.schema.simpleString()[7:-1].replace(":", " "), "o_orderpriority", "o_orderdate", "o_totalprice", "parquet")
    out = fresh(spark, "sums")
    write_current_tables(sums, out, fresh(spark, "sums-checkpoint")).awaitTermination()
    return read_current(spark, out).withColumn("value", F.round("value", 2))


@query("stream_leaderboard", f"""WITH {OBS_ORDERS}, c AS (SELECT sort_key, entity_id, max(value) AS value FROM obs GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY sort_key ORDER BY value DESC, entity_id) AS rank FROM c QUALIFY rank <= 3""")
def stream_leaderboard(spark, sf):
    schema = load(spark, sf, "orders").schema
    rows = orders_as_obs(spark.readStream.schema(schema).parquet(f"{sf}/orders*.parquet"))
    out = fresh(spark, "live")
    write_current_tables(stream_cells(rows), out, fresh(spark, "live-checkpoint"), lambda cells: current_leaderboard(cells, 3)).awaitTermination()
    return read_current(spark, out)
