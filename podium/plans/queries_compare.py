"""Queries that compare tables with tables: names with many metrics, written artefacts with recomputed ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.matching import match_name_table
from ..sources import ranged
from .catalogue import query
from .queries_rank import BARS, _bars, _nation_tape, tape_sql
from .queries_source import fresh
from .views import OBS_NATION_MONTH, load

_STOP = "('the', 'of', 'by', 'in', 'and', 'most', 'popular', 'best', 'selling', 'top', 'largest', 'world', 'global')"
_SINGULAR = """CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN w[:-4] || 'y' WHEN ends_with(w, 'ses') AND length(w) > 4 THEN w[:-3]
 WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN w[:-2] ELSE w END"""
_MATCHES = f"""q AS (SELECT query_id, list_sort(list_filter(string_split_regex(lower(coalesce(metric, '')), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN {_STOP})) AS words FROM metrics),
 qs AS (SELECT min(query_id) AS query_id, words FROM q WHERE len(words) > 0 GROUP BY words),
 c AS (SELECT name_id, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(name, '')), '[^a-z0-9]+'), lambda x: x <> ''))) AS held FROM catalogue),
 cs AS (SELECT min(name_id) AS name_id, held FROM c WHERE len(held) > 0 GROUP BY held),
 qw AS (SELECT query_id, len(words) AS n, unnest(range(len(words))) AS i, unnest(words) AS w FROM qs),
 forms AS (SELECT query_id, n, i, w AS token FROM qw UNION SELECT query_id, n, i, {_SINGULAR} FROM qw),
 hits AS (SELECT query_id, name_id, n, count(DISTINCT i)::INT AS matched FROM forms JOIN (SELECT name_id, unnest(held) AS token FROM cs) USING (token) GROUP BY ALL),
 pairs AS (SELECT query_id, name_id, matched, matched / n::DOUBLE AS score FROM hits WHERE matched / n::DOUBLE >= 0.5)"""


@query("match_name_table", f"""WITH metrics AS (SELECT item_id AS query_id, text AS metric FROM benchmark), catalogue AS (SELECT doc_id AS name_id, text AS name FROM documents), {_MATCHES}
 SELECT query_id, name_id, matched, score FROM pairs""")
def match_texts(spark, sf):
    """Every benchmark text asks all documents for half of its words."""
    metrics = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("metric"))
    return match_name_table(metrics, load(spark, sf, "documents").select(F.col("doc_id").alias("name_id"), F.col("text").alias("name"))).pairs


@query("match_name_members", f"""WITH metrics AS (SELECT p_partkey AS query_id, 'Largest ' || p_name || 's of ' || p_type || ' makers' AS metric FROM part),
 catalogue AS (SELECT p_partkey AS name_id, p_name || ' ' || p_type AS name FROM part), {_MATCHES},
 sizes AS (SELECT cs.name_id, count(*) AS k FROM c JOIN cs USING (held) GROUP BY cs.name_id),
 per AS (SELECT query_id AS same_id, sum(k)::BIGINT AS names, max(score) AS best FROM pairs JOIN sizes USING (name_id) GROUP BY query_id)
 SELECT q.query_id, names, best FROM q JOIN qs USING (words) JOIN per ON per.same_id = qs.query_id""")
def match_members(spark, sf):
    """A metric for every part, most of them equal: names that match each, from pairs between word sets and their members."""
    part = load(spark, sf, "part")
    metrics = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Largest "), "p_name", F.lit("s of "), "p_type", F.lit(" makers")).alias("metric"))
    found = match_name_table(metrics, part.select(F.col("p_partkey").alias("name_id"), F.concat_ws(" ", "p_name", "p_type").alias("name")))
    sizes = found.names.groupBy("same_id").count().withColumnRenamed("same_id", "name_id")
    per_set = found.pairs.join(sizes, "name_id").groupBy("query_id").agg(F.sum("count").alias("names"), F.max("score").alias("best"))
    return found.queries.join(per_set.withColumnRenamed("query_id", "same_id"), "same_id").select("query_id", "names", "best")


_EDITED = f"{tape_sql(OBS_NATION_MONTH)}, shown AS ({BARS})"


def _written_and_again(spark, sf):
    """The path of a written tape, and the tape with the value of every 97th frame's bars one higher."""
    bars, path = _bars(_nation_tape(spark, sf)), fresh(spark, "ranged")
    ranged.write_ranged(bars, path, "frame_index", 16, ["rank"])
    written = ranged.read_ranged(spark, path)
    return path, written.withColumn("value", F.when(F.col("frame_index") % 97 == 5, F.col("value") + 1).otherwise(F.col("value")))


@query("tape_recomputed", _EDITED + """ SELECT 'written' AS side, frame_index, entity_id, value, rank FROM shown WHERE frame_index % 97 = 5
 UNION ALL SELECT 'again', frame_index, entity_id, value + 1, rank FROM shown WHERE frame_index % 97 = 5""")
def tape_recomputed(spark, sf):
    path, again = _written_and_again(spark, sf)
    return ranged.ranged_difference(spark, path, again).select("side", "frame_index", "entity_id", "value", "rank")


@query("tape_changed_ranges", _EDITED + """ SELECT frame_index // 16 AS range, count(*) AS rows_written, count(*) AS rows_again FROM shown
 GROUP BY frame_index // 16 HAVING count(*) FILTER (frame_index % 97 = 5) > 0""")
def tape_changed_ranges(spark, sf):
    path, again = _written_and_again(spark, sf)
    return ranged.changed_ranges(spark, path, again).withColumnRenamed(ranged.RANGE, "range")


@query("tape_stretch", _EDITED + " SELECT frame_index, entity_id, value, rank FROM shown WHERE frame_index BETWEEN 100 AND 140")
def tape_stretch(spark, sf):
    bars, path = _bars(_nation_tape(spark, sf)), fresh(spark, "ranged")
    ranged.write_ranged(bars, path, "frame_index", 16, ["rank"])
    return ranged.read_ranged(spark, path, 100, 140).select("frame_index", "entity_id", "value", "rank")
