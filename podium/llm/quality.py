"""Quality by hierarchical empirical Bayes: evidence of the document itself, shifted by what is known of its site.

The document classifier is a logistic regression on measures of the text. A host's and a path's share of good labelled
documents are Beta posteriors: the corpus-wide share is the hosts' prior, a host's posterior is its paths' prior, and the
strength of each prior comes from how much the sites differ beyond chance. A site with few labels stays near its
prior. All statistics are grouped sums over every labelled document that is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Stages
from .common import col, row_key, slices, unused
from .textvec import span_hashes, text_bytes, word_spans, BLANK
from .toxicity import held_out, label_rows

_CLASSES = {"upper": (65, 91), "lower": (97, 123), "digit": (48, 58), "high": (128, 256)}
_TABLES = {name: np.isin(np.arange(256), np.arange(*span)) for name, span in _CLASSES.items()}
_TABLES["mark"] = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_TABLES["odd"] = np.isin(np.arange(256), [ord(c) for c in "#$%&*@^_|~<>{}[]\\/+="])
_TABLES["loud"] = np.isin(np.arange(256), [ord(c) for c in "!?"])
_LINE = np.zeros(256, bool)
_LINE[10] = True
MEASURES = (*_TABLES, "words", "word_length", "long_words", "distinct_words", "repeated_pairs", "repeated_lines", "line_words", "short")


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each text."""
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=n)


def measures(column: pa.Array) -> np.ndarray:
    """One row of ``MEASURES`` per text, shares and logarithms, none beyond a few units."""
    flat, offsets = text_bytes(column)
    n, size = len(column), np.maximum(np.diff(offsets), 1)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    counts = np.bincount(owner.astype(np.int64) * 256 + flat, minlength=n * 256).reshape(n, 256) if len(flat) else np.zeros((n, 256), int)
    out = [np.sqrt(counts[:, t].sum(1) / size) for t in _TABLES.values()]
    starts, ends, text = word_spans(flat, offsets, BLANK)
    h = span_hashes(flat, starts, ends)
    words = np.bincount(text, minlength=n)
    some, length = np.maximum(words, 1), (ends - starts).astype(float)
    out += [np.log1p(words) / 5, np.bincount(text, length, n) / some / 10, np.bincount(text, length > 20, n) / some, _distinct(h, text, n) / some]
    same = text[1:] == text[:-1]
    pairs = (h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])[same]
    of = text[:-1][same]
    out.append(1 - _distinct(pairs, of, n) / np.maximum(np.bincount(of, minlength=n), 1))
    a, b, line_of = word_spans(flat, offsets, _LINE)
    lines = np.maximum(np.bincount(line_of, minlength=n), 1)
    out += [1 - np.where(words > 0, _distinct(span_hashes(flat, a, b), line_of, n), lines) / lines, np.log1p(words / lines) / 5, 1 / some]
    return np.stack(out, 1)


def _with_squares(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, x * x], 1)


def fit_logistic(rows: DataFrame, rounds: int = 12, ridge: float = 0.1) -> np.ndarray:
    """Newton's method on (m array<double>, label); each round is one pass that adds up gradients and curvatures.

    A task sends one row of a few hundred numbers, whatever the number of documents.
    """
    width = 1 + 2 * len(MEASURES)
    weights = np.zeros(width)
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            g, c = np.zeros(width), np.zeros((width, width))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _with_squares(np.asarray(batch["m"].flatten()).reshape(batch.num_rows, -1))
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                g += x.T @ (np.asarray(batch["label"]) - p)
                c += (x * (p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_pydict({"sums": [np.concatenate([g, c.ravel()])]})

        each = rows.mapInArrow(sums, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
        total = np.zeros(width + width * width)
        for row in each.groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many rows as there are sums
            total[row["i"]] = row["v"]
        pull = np.full(width, ridge)
        pull[0] = 1e-3
        step = np.linalg.solve(total[width:].reshape(width, width) + np.diag(pull), total[:width] - pull * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    return weights


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, good: str, n: str, prior: Column, default: float = 20.0) -> DataFrame:
    """Pseudo-labels a prior is worth, by the method of moments on the spread of site shares beyond chance; one row."""
    share = F.col(good) / F.col(n)
    spread = F.sum(F.col(n) * F.pow(share - prior, 2)) / F.sum(n)
    chance = F.sum(prior * (1 - prior)) / F.sum(n)
    within = F.sum(F.col(n) * prior * (1 - prior)) / F.sum(n)
    between = spread - chance
    return groups.filter(F.col(n) > 0).agg(F.coalesce(F.when(between > 0, F.least(F.greatest(within / between - 1, F.lit(2.0)), F.lit(1e4))).otherwise(1e4),
                                                      F.lit(default)).alias("strength"))


def site_posteriors(labelled: DataFrame) -> DataFrame:
    """(host, path, site): the posterior share of good documents of each path, from (host, path, label).

    Everything is pre-aggregated per path, so a host with a third of all rows is a few numbers per task.
    """
    paths = labelled.groupBy("host", "path").agg(F.sum("label").cast("double").alias("good"), F.count("*").cast("double").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("h_good"), F.sum("n").alias("h_n"))
    total = hosts.agg(((F.sum("h_good") + 1) / (F.sum("h_n") + 2)).alias("prior")).first()["prior"] or 0.5
    k = _strength(hosts, "h_good", "h_n", F.lit(total)).first()["strength"]
    hosts = hosts.select(F.col("host").alias("_host"), ((F.col("h_good") + k * total) / (F.col("h_n") + k)).alias("h_post"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    j = _strength(paths, "good", "n", F.col("h_post")).first()["strength"]
    sites = paths.select("host", "path", ((F.col("good") + F.col("h_post") * j) / (F.col("n") + j)).alias("site"))
    return sites.unionByName(hosts.select(F.col("_host").alias("host"), F.lit(None).cast("string").alias("path"), F.col("h_post").alias("site"))
                             .withColumn("path", F.lit("\u0000any"))).withColumn("prior", F.lit(float(total)))


def quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id",
            text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, evidence, site, score, kept of every document, and k1, k2, the key of the row.

    ``host`` and ``path`` name a document's site, by default its source and, within it, its language. ``evidence`` is
    the document classifier's probability, ``site`` the posterior share of good documents at its path, ``score``
    their combination; ``kept`` says score >= ``threshold``.

    Null text is empty and is measured as such. Null hosts or paths are a site of their own. A path without labels has its
    host's posterior, a host without labels the corpus-wide share. Ids that are held out, null or unlabelled are scored
    but not learnt from. Repeated rows get equal scores. Without labels, everything scores 0.5 and is kept. An empty table
    gives no rows.
    """
    stages = Stages(docs.sparkSession, "quality")
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    narrow = docs.select(col(id_col).cast("bigint").alias("doc_id"), *row_key(id_col, text_col), F.coalesce(col(text_col), F.lit("")).alias("text"),
                         F.coalesce(host.cast("string"), F.lit("\u0000none")).alias("host"), F.coalesce(path.cast("string"), F.lit("\u0000none")).alias("path"))

    names, kinds = ("doc_id", "k1", "k2", "host", "path"), "doc_id bigint, k1 bigint, k2 bigint, host string, path string"

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, byte_bound=1 << 20):
            m = measures(batch["text"])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), lists], names=[*names, "m"])

    rows = stages.write(narrow.mapInArrow(measured, f"{kinds}, m array<double>"), "measures")
    labelled = stages.write(rows.join(label_rows(labels, label_col), "doc_id"), "labelled")
    weights = fit_logistic(labelled)
    sites = stages.write(site_posteriors(labelled), "sites")
    stages.drop("labelled")
    prior = sites.agg(F.max("prior")).first()[0]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _with_squares(np.asarray(batch["m"].flatten()).reshape(batch.num_rows, -1))
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(p)], names=[*names, "evidence"])

    scored = rows.mapInArrow(judged, f"{kinds}, evidence double")
    by_host = sites.filter("path = '\u0000any'").select("host", F.col("site").alias("_h"))
    scored = scored.join(sites.select("host", "path", "site"), ["host", "path"], "left").join(by_host, "host", "left")
    prior = F.lit(0.5 if prior is None else float(prior))
    site = F.coalesce("site", "_h", prior)
    total = _logit(F.greatest(F.least("evidence", F.lit(1 - 1e-9)), F.lit(1e-9))) + _logit(site) - _logit(prior)
    score = 1 / (1 + F.exp(-total))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", site.alias("site"), score.alias("score"), (score >= threshold).alias("kept"), "k1", "k2")


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are not kept, other columns as they are.

    Null ids and texts are judged like others; repeated rows go or stay together; an empty table stays empty; texts of any length
    are read whole; columns may have any names.
    """
    key = unused(docs, "key")
    poor = quality(docs, labels, id_col=id_col, text_col=text_col, **options).filter("NOT kept").select(F.struct("k1", "k2").alias(key + "_"))
    rows = docs.withColumn(key, F.struct(*row_key(id_col, text_col)))
    return rows.join(poor.hint("merge"), F.col(key) == F.col(key + "_"), "left_anti").select(*map(col, docs.columns))
