"""Search, toxicity and quality: recall, held-out accuracy, learning by hand."""

import zlib

import numpy as np
import pytest

from podium.llm import queries
from podium.llm.ann import InvertedFiles, orders, search
from podium.llm.quality import MEASURES, drop_poor, fit_logistic, measures, quality, site_posteriors
from podium.llm.textvec import BLANK, span_hashes, text_bytes, word_spans, words
from podium.llm.toxicity import Ftrl, drop_toxic, label_rows, toxicity


def nearest(rows, k=20, every=20):
    """{query id: [(id, score)]} of exact search over (id, vector) rows that take part."""
    live = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    dim = max(len(v) for _, v in live)
    live = [(i, np.pad(v, (0, dim - len(v)))) for i, v in live]
    return {i: sorted(((-float(v @ q), j) for j, v in live if j != i))[:k] for i, q in live if i % every == 0}


def test_search_query_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, got = nearest(rows), {}
    vectors = {i: np.array(v, float) for i, v in rows}
    for r in queries.op1_permutation_index(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        assert abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all([n for n, _ in sorted(found)] == list(range(1, len(found) + 1)) for found in got.values())


def test_search_recall_of_a_larger_set(spark, rng):
    """A share of every shard: 12 000 random directions, the hardest case, in shards of 4000 and several blocks of queries."""
    x = rng.standard_normal((12_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = search(df, query_every=100, shard_rows=4000, query_values=32 * 40).collect()
    want = nearest(enumerate(x), every=100)
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q in want for _, i in want[q]}) >= 0.9 * 20 * len(want)


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, []),
            (9, [2.0]), (None, [1.0, 1.0]), (40, [0.0, -1.0]), (1, [1.0, 0.0]), (60, None)] + [(100 + i, [1.0, 0.0]) for i in range(1, 40)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score int, q string").repartition(4)
    got = {}
    for r in search(df, shard_rows=10, query_values=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    unique = list({(i, tuple(v) if v is not None else None): (i, v) for i, v in rows}.values())
    assert got == nearest(unique)  # ties go to the smaller id, copies included
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert search(none).count() == 0 and search(df.filter("vec_id = 0")).count() == 0


def test_footrule_order(rng):
    pivots, x = rng.standard_normal((30, 8)), rng.standard_normal((200, 8))
    files, keep = InvertedFiles(x, pivots, 6), 6
    q = orders(x[:1], pivots, keep)[0]
    every = orders(x, pivots, keep)
    place = lambda o: {p: n for n, p in enumerate(o)}
    rule = [sum(abs(place(q).get(p, keep) - place(o).get(p, keep)) for p in {*q, *o}) for o in every.tolist()]
    got = files.nearest(q, 25)
    assert sorted(rule[i] for i in got) == sorted(rule)[:25]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_query(spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id) for r in rows)
    clean = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)


def insults(n):
    rng = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words_, bad = rng.choice(vocabulary, 60).tolist(), i % 7 == 0
        if bad:
            words_[int(rng.integers(60))] = "scoundrel" if i % 2 else "Villain!"
        rows.append((i, " ".join(words_), int(bad)))
    return rows


def test_toxicity_held_out_accuracy(spark):
    rows = insults(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    test = [(got[i].predicted, y) for i, _, y in rows if held(i)]
    assert sum(p == y for p, y in test) >= 0.98 * len(test)
    flipped = labels.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["x"]).expr("if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic)"))
    again = {r.doc_id: r.score for r in toxicity(docs, flipped).collect()}
    assert all(again[i] == got[i].score for i in again)  # labels of held-out rows are never read
    kept = drop_toxic(docs.withColumn("_toxicity2", docs.doc_id), labels)
    assert kept.columns == ["doc_id", "text", "_toxicity2"] and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (5, None), (6, 1)], "doc_id bigint, toxic int")
    rows = toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity(nothing, labels).count() == 0 and drop_toxic(nothing, labels).columns == nothing.columns
    assert {r.score for r in toxicity(odd, labels.limit(0)).collect()} == {0.5}
    assert drop_toxic(odd, labels).columns == odd.columns


def test_labels_of_one_id(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (2, 0), (3, None), (None, 1), (7, 1)], "doc_id bigint, toxic int")
    assert {r.doc_id: r.label for r in label_rows(rows, "toxic").collect()} == {i: y for i, y in {1: 1, 2: 0, 7: 1}.items() if not held(i)}


def test_ftrl_by_hand():
    model = Ftrl(1, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    at = np.array([0, 2])  # one feature and the intercept
    model.learn(at, 1)
    g = 0.5 - 1
    assert np.allclose(model.z[at], g) and np.allclose(model.n[at], g * g)
    rate = (1.0 + 0.5) / 0.5 + 0.2
    assert np.allclose(model.weights(at), [(0.5 - 0.1) / rate, 0.5 / rate]) and model.weights(np.array([1])) == 0


def test_word_hashes():
    import pyarrow as pa

    column = pa.array(["The cat", "", "tHE\tcat\n", "théâtre x" * 3, "cat the", "a" * 3000])
    h, text = words(column)
    by = [h[text == i].tolist() for i in range(6)]
    assert by[0] == by[2] and by[4] == by[0][::-1] and by[1] == [] and len(set(h.tolist())) == len({"the", "cat", "théâtre", "xthéâtre", "x", "a" * 3000})
    flat, offsets = text_bytes(column.slice(2, 2))
    starts, ends, _ = word_spans(flat, offsets, BLANK)
    assert (span_hashes(flat, starts, ends) == h[np.isin(text, [2, 3])]).all()


def test_quality_query(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op3_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    good = [r for r in rows if labels.get(r.doc_id) == 1]
    poor = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(not r.kept for r in good) <= 0.02 * len(good) and sum(not r.kept for r in poor) >= 0.6 * len(poor)
    assert all(0 <= r.score <= 1 and 0 < r.site < 1 and r.held_out == held(r.doc_id) for r in rows)


def test_site_posteriors_shrink(spark):
    rows = [("big", "a", i % 10 != 0) for i in range(400)] + [("bad", "a", i % 10 == 0) for i in range(400)] + [("tiny", "a", False)] + [("bad", "rare", True)]
    sites = {(r.host, r.path): r.site for r in site_posteriors(spark.createDataFrame([(h, p, int(y)) for h, p, y in rows], "host string, path string, label int")).collect()}
    prior = (sum(y for *_, y in rows) + 1) / (len(rows) + 2)
    assert abs(sites["big", "a"] - 0.9) < 0.02 and abs(sites["bad", "a"] - 0.1) < 0.02
    assert 0 < sites["tiny", "a"] < prior  # one bad document moves a sparse site a little, never to zero
    assert sites["bad", "a"] < sites["bad", "rare"] < prior  # and one good path of a bad host stays near the host


def test_fit_logistic(spark, rng):
    m = rng.random((2000, len(MEASURES)))
    p = 1 / (1 + np.exp(-(4 * m[:, 0] - 2)))
    y = rng.random(2000) < p
    weights = fit_logistic(spark.createDataFrame([(r.tolist(), int(l)) for r, l in zip(m, y)], "m array<double>, label int").repartition(3))
    x = np.concatenate([np.ones((2000, 1)), m, m * m], 1)
    assert np.corrcoef(1 / (1 + np.exp(-x @ weights)), p)[0, 1] > 0.9


def test_measures():
    import pyarrow as pa

    m = dict(zip(MEASURES, measures(pa.array(["AB cd", "", "x x x x x\nx x x x x\nx x x x x", "!!! ###"])).T))
    assert m["upper"].round(3).tolist() == [round(0.4**0.5, 3), 0, 0, 0] and m["distinct_words"].round(3).tolist() == [1, 0, round(1 / 15, 3), 1]
    assert m["repeated_lines"][2] == pytest.approx(2 / 3) and np.isfinite(np.stack([*m.values()])).all()


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (5, None), (6, 1), (7, 0), (8, 0)], "doc_id bigint, quality int")
    rows = quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality(nothing, labels).count() == 0 and drop_poor(nothing, labels).columns == nothing.columns
    assert {(r.score, r.kept) for r in quality(odd, labels.limit(0)).collect()} == {(0.5, True)}
    kept = drop_poor(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
