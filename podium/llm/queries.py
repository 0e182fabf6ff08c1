"""The operators over their whole tables, with production parameters, and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ann import search
from .bitpack import pack_documents as pack_bits
from .bpe import bpe_round_trip
from .common import BLANKS, Query, table
from .decontamination import contamination
from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .line_dedup import line_duplicates
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import quality
from .runs import periodic_runs
from .token_counts import token_counts
from .toxicity import toxicity

def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op6_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


@_query
def op4_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_bits(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(), end_id=50256)


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("k1", "k2")


@_query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary())


@_query
def op2_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), end_id=0, window=1024)


@_query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("k1", "k2")


@_query
def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates(table(spark, sf_dir, "documents")).drop("k1", "k2")


@_query
def op11_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, span: n + span["length"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op11_wu_manber_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS win
             FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
     lengths AS (SELECT DISTINCT k FROM win),
     places AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
     hit AS (SELECT DISTINCT places.doc_id, places.i, places.k, win.item_id FROM places JOIN win ON places.win = win.win),
     words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


@_query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     g AS (SELECT DISTINCT lang, source FROM d),
     t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
     kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
     sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
     counts AS (SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY ALL),
     totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
     p AS (SELECT g.lang, g.source, kept.term, coalesce(counts.n, 0) AS n,
                  1 + (CAST(1000000000 AS HUGEINT) * (coalesce(counts.n, 0) + 2)) // (coalesce(totals.total, 0) + 2 * sizes.v) AS p,
                  1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 2)) // (sizes.total + 2 * sizes.v) AS q
           FROM g JOIN kept ON g.lang = kept.lang JOIN sizes ON g.lang = sizes.lang
           LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = kept.term
           LEFT JOIN totals ON totals.lang = g.lang AND totals.source = g.source),
     sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
     ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
                FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _planted(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by the CRC-32 h of its id, repeats itself: with g = floor(h / 10), its words from a = g % n
    on are the p = 1 + floor((n - a) / (3 + g % 8)) words from there, again and again."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.col("text"), BLANKS), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, "p"), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_planted(table(spark, sf_dir, "documents")))

    def before(x: Column, y: Column) -> Column:
        """Negative where x is the run to report: greater length / period, by products; then start, then period."""
        more = y["length"] * x["period"] - x["length"] * y["period"]
        return F.when(more != 0, F.signum(more)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")

    found = found.withColumn("best", F.try_element_at(F.array_sort("runs", before), F.lit(1)))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    milli = F.call_function("div", 1000 * F.col("best.length"), F.col("best.period"))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
                        milli.alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
