"""Queries of JSON whose shape differs from document to document, and of candidates from registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering, shape, sourcing
from ..sources import variants
from .catalogue import query
from .queries_source import fresh, observation_lines
from .queries_text import SCALED
from .views import OBS_DIRTY, load, pick, sql_pick


def _mixed_documents(spark, sf):
    """Orders in blocks of up to eight: a list, two kinds of envelope (one beside an empty field of another name), or one object with the first order.

    ``who`` is text or an object, ``more`` is a nested object that only urgent orders have, and one document in a block is no JSON.
    """
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    who = F.when(k % 2 == 0, F.to_json(F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("name")))).otherwise(
        F.concat(F.lit('"C'), F.col("o_custkey").cast("string"), F.lit('"')))
    more = F.when(F.col("o_orderpriority").startswith("1"), F.lit(', "more": {"tags": [1, "x"], "at": null}')).otherwise(F.lit(""))
    record = F.concat(F.lit('{"key": '), k.cast("string"), F.lit(', "who": '), who, more, F.lit("}"))
    blocks = o.groupBy(F.floor(k / 8).alias("block")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), record.alias("r")))).alias("rs"))
    joined = F.concat_ws(", ", F.transform("rs", lambda r: r["r"]))
    shaped = pick(F.col("block"), F.concat(F.lit("["), joined, F.lit(", 7]")), F.concat(F.lit('{"n": 1, "rows": ['), joined, F.lit("]}")),
                  F.concat(F.lit('{"rows": null, "items": ['), joined, F.lit("]}")), F.col("rs")[0]["r"], F.lit("{not json"))
    path = fresh(spark, "any-json")
    blocks.select(shaped.alias("value")).write.text(path)
    return variants.read_variants(spark, path, lines=True)


_MIXED = """o AS (SELECT *, o_orderkey // 8 AS block, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_orderkey // 8) AS first_ FROM orders),
 r AS (SELECT * FROM o WHERE block % 5 < 3 OR (block % 5 = 3 AND first_))"""


@query("json_any_shape", f"""WITH {_MIXED} SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 2 = 0 THEN '{{"name":"C' || o_custkey || '"}}' ELSE 'C' || o_custkey END AS who,
 CASE WHEN starts_with(o_orderpriority, '1') THEN '{{"at":null,"tags":[1,"x"]}}' ELSE '' END AS more FROM r""")
def json_any_shape(spark, sf):
    return variants.variant_table(variants.variant_records(_mixed_documents(spark, sf)), ["key", "who", "more"])


@query("json_any_columns", f"""WITH {_MIXED} SELECT 'key' AS key, count(*) AS rows, 'BIGINT' AS type FROM r UNION ALL
 SELECT 'who', count(*), CASE WHEN count(DISTINCT o_orderkey % 2) = 2 THEN 'VARIANT' END FROM r UNION ALL
 SELECT 'more', count(*), 'OBJECT<at: VOID, tags: ARRAY<VARIANT>>' FROM r WHERE starts_with(o_orderpriority, '1')""")
def json_any_columns(spark, sf):
    return variants.variant_columns(variants.variant_records(_mixed_documents(spark, sf)))


@query("json_document_kinds", f"""WITH {_MIXED}, b AS (SELECT block, count(*) AS n FROM o GROUP BY block)
 SELECT {sql_pick('block', "'list'", "'rows'", "'items'", "'object'", "'unreadable'")} AS kind, count(*) AS documents,
 sum(CASE block % 5 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE n END)::BIGINT AS records FROM b GROUP BY 1""")
def json_document_kinds(spark, sf):
    return variants.document_kinds(_mixed_documents(spark, sf))


@query("observations_any", f"WITH {OBS_DIRTY} SELECT entity, date, value, source, source_url, count(*) AS n FROM obs GROUP BY ALL")
def observations_any(spark, sf):
    """The tolerant observation records of ``read_observations``, by way of VARIANT."""
    docs = variants.read_variants(spark, observation_lines(spark, sf), lines=True)
    found = variants.variant_observations(variants.variant_records(docs, envelopes=()))
    return found.groupBy("entity", "date", "value", "source", "source_url").agg(F.count("*").alias("n"))


@query("registry_scores", f"""WITH r AS (SELECT s_suppkey AS k, {sql_pick('s_suppkey', "'api'", "'download'", "'web'")} AS access FROM supplier)
 SELECT 'registry_supplier-' || lpad(k::VARCHAR, 9, '0') AS candidate_id, access <> 'web' AS machine_readable,
 floor((0.25 * greatest(0.1, 1 - (k % 12) / 12) + 0.2 * CASE access WHEN 'api' THEN 0.9 WHEN 'download' THEN 0.75 ELSE 0.3 END + 0.15 * CASE WHEN k % 2 = 0 THEN 0.9 ELSE 0.6 END
 + 0.1 * CASE WHEN access = 'web' THEN 0.35 ELSE 1 END + 0.15 * 0.7 + 0.05 * 0.7 + 0.1 * 0.7) * 1e6 + 0.5)::BIGINT AS millionths FROM r""")
def registry_scores(spark, sf):
    """A registry of every supplier, as scored candidates."""
    k = F.col("s_suppkey")
    registry = load(spark, sf, "supplier").select(
        F.concat(F.lit("Supplier  "), F.lpad(k.cast("string"), 9, "0")).alias("name"), F.concat(F.lit("https://s.test/"), k.cast("string")).alias("url"),
        pick(k, "api", "download", "web").alias("access"), (k % 12).cast("int").alias("priority"),
        F.when(k % 2 == 0, F.array(F.lit("global"), F.lit("annual"))).otherwise(F.array(F.lit("country"))).alias("categories"))
    scored = sourcing.score_candidates(sourcing.registry_candidates(registry), tie="candidate_id")
    return scored.select("candidate_id", "machine_readable", F.floor(F.col("quality_score") * 1e6 + 0.5).cast("bigint").alias("millionths"))


@query("topic_sources", """WITH s AS (SELECT p_partkey AS place, 1 + p_partkey % 3 AS tier,
 list_value(CASE p_partkey % 4 WHEN 0 THEN 'economy' WHEN 1 THEN 'health' WHEN 2 THEN 'sports' ELSE 'energy' END, CASE WHEN p_partkey % 5 = 0 THEN 'trade' ELSE 'other' END) AS topics FROM part),
 h AS (SELECT place, tier, len(list_intersect(topics, ['economy', 'trade'])) AS hits FROM s)
 SELECT place, tier, hits, row_number() OVER (ORDER BY tier, hits DESC, place) AS nth FROM h WHERE hits > 0 OR tier <= 2""")
def topic_sources(spark, sf):
    """Sources made of all parts, in the order in which a topic class lists them."""
    k = F.col("p_partkey")
    sources = load(spark, sf, "part").select(k.alias("place"), (1 + k % 3).alias("tier"), F.array(
        pick(k, "economy", "health", "sports", "energy"), F.when(k % 5 == 0, F.lit("trade")).otherwise(F.lit("other"))).alias("topics"))
    listed = sourcing.sources_for_topics(sources, ["economy", "trade"])
    order = [F.col("tier"), F.col("hits").desc(), F.col("place")]
    return ordering.ranked_stage(listed.select("place", "tier", "hits", F.lit(0).alias("one")), ["one"], order, rank="nth").drop("one")


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_SHARES = "obs AS (" + " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS name, trim({c}::VARCHAR) AS cell FROM customer" for i, c in enumerate(_CUSTOMER)) + f"""), {SCALED},
 share AS (SELECT place, name, count(num) / count(*) AS numbers, 1 - count(num) / count(*) AS texts FROM e WHERE cell <> '' GROUP BY ALL)"""


@query("detect_columns_whole", f"""WITH {_SHARES}, v AS (SELECT arg_max(name, numbers - place / 1e9) AS value FROM share WHERE numbers >= 0.5)
 SELECT (SELECT arg_max(name, texts - place / 1e9) FROM share, v WHERE texts >= 0.5 AND name <> v.value) AS entity, NULL::VARCHAR AS date, value, true AS guessed FROM v""")
def detect_columns_whole(spark, sf):
    """The whole customer table, keys included; the shares are computed from its cells on both sides."""
    found = shape.detect_columns(load(spark, sf, "customer").select(*_CUSTOMER))
    return spark.createDataFrame([(found.entity, found.date, found.value, found.value_guessed)], "entity string, date string, value string, guessed boolean")


_TOP = "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice {}, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 9000"


def _top_lines(spark, sf, descending):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return ordering.first_rows_sketched(lines, "l_extendedprice", [F.col("l_orderkey"), F.col("l_linenumber")], 9000, descending)


@query("top_rows_sketched", _TOP.format("DESC"))
def top_rows_sketched(spark, sf):
    return _top_lines(spark, sf, True)


@query("bottom_rows_sketched", _TOP.format("ASC"))
def bottom_rows_sketched(spark, sf):
    return _top_lines(spark, sf, False)
