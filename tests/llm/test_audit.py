"""Decontamination, source divergence and periodic runs against brute-force versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from podium.llm import divergence, queries
from podium.llm.decontamination import Patterns, Words, contamination, drop_hits
from podium.llm.divergence import count_terms, source_divergence
from podium.llm.recompression import Grammar
from podium.llm.runs import find_runs, periodic_runs

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows_brute(items, size):
    out = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            out[tuple(w[i : i + size])].add(item)
    return out


def hits_brute(text, wins):
    """(words, hit places, items)"""
    w, places, items = alnum(text), set(), set()
    for n in {len(k) for k in wins}:
        for i in range(len(w) - n + 1):
            if (found := wins.get(tuple(w[i : i + n]))) is not None:
                places |= set(range(i, i + n))
                items |= {str(x) for x in found if x is not None}
    return len(w), places, sorted(items)


def check_hits(rows, texts, wins):
    for r in rows:
        n, places, items = hits_brute(texts[r.doc_id], wins)
        spans = [(s.start, s.length) for s in r.spans]
        assert r.n_words == n and {i for a, m in spans for i in range(a, a + m)} == places and r["items"] == items
        assert all(a + m < b for (a, m), (b, _) in zip(spans, spans[1:]))


def agrees(spark, sf_dir, name, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    cur = db.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(cur.fetchall(), key=str)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == want and want
    return want


def test_decontamination_query(spark, sf_dir):
    rows = agrees(spark, sf_dir, "op11_wu_manber_decontamination", ("documents", "benchmark"))
    assert sum(r[-1] for r in rows) > 2


@pytest.mark.parametrize("block_rows", [500_000, 40])
def test_decontamination_blocks(spark, block_rows, rng):
    """Windows shared by many items, short items, items with an id twice or none; one block or many."""
    words = [*"abcdefgh", "é", "日本語", "x" * 40]
    pick = lambda n: " ".join(rng.choice(words, n))
    common = pick(14)
    items = [(i, f"{common} {pick(3)}") for i in range(40)] + [(50, pick(3)), (51, "X"), (52, ""), (53, None), (None, pick(4)), (50, pick(12)), (54, "--")]
    texts = {i: pick(int(rng.integers(0, 400))) for i in range(60)} | {100: f"... {common.upper().replace(' ', ', ')}!", 101: None, 102: "", 103: "x" * 41}
    wins = windows_brute(items, 10)
    docs = spark.createDataFrame([*texts.items()], "doc_id bigint, text string").repartition(3)
    rows = contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_rows=block_rows).collect()
    assert len(rows) == len(texts)
    check_hits(rows, texts, wins)


def test_decontamination_odd_rows(spark, odd, nothing, odd_rows):
    bench = spark.createDataFrame([("i1", "brown fox jumps over the lazy dog again and again and", 3), ("i2", "two three", 4), ("i3", "W w w w", 5)], "item_id string, text string, spans int")
    rows = contamination(odd, bench).collect()
    check_hits([r for r in rows if r.doc_id not in (None, 8)], dict(odd_rows), windows_brute([(r.item_id, r.text) for r in bench.collect()], 10))
    assert len(rows) == len(odd_rows)
    by_text = {(r.doc_id, r.n_words): (r.spans, r["items"]) for r in rows}
    assert by_text[8, 30_000] == ([(0, 30_000)], ["i3"]) and by_text[5, 3] == by_text[6, 3] == ([(1, 2)], ["i2"]) and by_text[2, 0] == by_text[None, 0] == ([], [])
    assert contamination(nothing, bench).count() == 0
    empty = bench.limit(0)
    assert {(r.n_words, len(r.spans)) for r in contamination(odd, empty).collect()} == {(r.n_words, 0) for r in rows}
    left = drop_hits(odd, bench)
    assert left.columns == odd.columns and sorted((r.doc_id for r in left.collect()), key=str) == [10, 11, 2, 3, 7, 9, None]


def test_wu_manber_shifts(rng):
    """Words that no block ends with are passed over; every occurrence is found."""
    words = rng.choice([f"w{i}" for i in range(30)], 5000)
    pattern = [" ".join(words[i : i + 10]) + " " for i in (17, 1000, 4990)]
    patterns = Patterns(pa.array(pattern), 10)
    assert patterns.shift.max() == 9 and (patterns.shift == 0).sum() <= 3
    ends, number = patterns.find(Words(pa.array([" ".join(words), "", " ".join(words[990:1020])])))
    assert sorted(zip(ends.tolist(), number.tolist())) == [(26, 0), (1009, 1), (4999, 2), (5019, 1)]


def letters(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def divergence_brute(rows, least, top):
    seen, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", letters(text)
        langs[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in seen[lang].items() if n >= least]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, i.decode(), -v, n) for n, (v, i) in enumerate(items, 1)]
    return sorted(out)


def test_divergence_query(spark, sf_dir):
    agrees(spark, sf_dir, "op12_source_divergence", ("documents",))


@pytest.mark.parametrize("side,shard", [(64, 2048), (3, 5)])
def test_divergence_matrices(spark, monkeypatch, rng, side, shard):
    """Terms of all lengths, many small sources; one matrix or many."""
    monkeypatch.setattr(divergence, "_SIDE", side)
    monkeypatch.setattr(divergence, "_SHARD", shard)
    words = ["a" * n for n in range(1, 40)] + ["Aé", "日本語", "z" * 300, "b" * 16 + "c", "b" * 17, "ß"]
    rows = [(" ".join(rng.choice(words, int(rng.integers(0, 30)))) + "1,", f"l{rng.integers(2)}", f"s{rng.integers(11)}") for _ in range(200)]
    rows += [(None, None, None), ("", "l0", "empty"), ("a aa", None, "x"), ("a", "l3", "alone")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    got = source_divergence(df, least_documents=3).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == divergence_brute(rows, 3, 10)


def test_divergence_odd_rows(odd, nothing):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    for least in (1, 2, 100):
        got = source_divergence(odd, least_documents=least).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == divergence_brute(rows, least, 10) and got
    assert source_divergence(nothing).count() == 0


def test_terms_counted_in_buckets(rng):
    words = ["".join(rng.choice([*"abé"], int(rng.integers(1, 14)))) for _ in range(300)] + ["q" * n for n in (8, 9, 16, 17, 33, 1000)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 200)))) for _ in range(40)]
    group = np.arange(40, dtype=np.uint16) % 7
    want, docs = Counter(), Counter()
    for g, t in zip(group.tolist(), texts):
        want.update((g, w) for w in t.split())
        docs.update((g, w) for w in set(t.split()))
    of, term, n, df = count_terms(pa.array(texts), group)
    keys = [*zip(of.tolist(), term.to_pylist())]
    assert dict(zip(keys, n.tolist())) == want and dict(zip(keys, df.tolist())) == docs and len(set(keys)) == len(keys)


def runs_brute(w, least=24, times=3):
    out, w = {}, np.array(w)
    for p in range(1, len(w) // times + 1):
        same = np.diff(np.concatenate([[0], (w[:-p] == w[p:]).astype(int), [0]]))
        for a, b in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            if b - a + p >= max(least, times * p):
                out.setdefault((a, b - a + p), p)
    return sorted(((a, n, p) for (a, n), p in out.items()), key=lambda r: (r[0], r[2]))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed_brute(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted_brute(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_query(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in texts.items():
        w = planted_brute(i, blank_words(text))
        runs = runs_brute(w)
        best, r = None, got[i]
        for a, n, q in runs:
            if best is None or n * best[2] > best[1] * q:
                best = (a, n, q)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)) and r.collapsed_sha256 == sha(collapsed_brute(w, runs))
    assert sum(r.n_runs for r in got.values()) > 5


def test_runs_odd_rows(spark, odd, nothing, odd_rows):
    rows = periodic_runs(odd).collect()
    key = lambda r: (str(r[0]), str(r))
    want = []
    for i, t in odd_rows:
        w = blank_words(t)
        runs = [(0, 30_000, 1)] if len(w) == 30_000 else runs_brute(w)
        want.append((i, len(w), runs, collapsed_brute(w, runs)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows), key=key) == sorted(want, key=key)
    assert periodic_runs(nothing).count() == 0


def test_runs_of_random_words(rng):
    """Small alphabets, runs inside runs, many sequences at a time."""
    for _ in range(120):
        seqs = []
        for _ in range(int(rng.integers(1, 6))):
            n = int(rng.integers(0, 200))
            w = rng.integers(0, int(rng.integers(1, 4)), n)
            if n > 5 and rng.random() < 0.7:
                a, p, at = int(rng.integers(n)), 1 + int(rng.integers(n // 4)), np.arange(n)
                w = w[np.where(at >= a, a + (at - a) % p, at)]
            seqs.append(w)
        least, times = int(rng.choice([4, 8, 24])), int(rng.choice([2, 3]))
        found = find_runs(np.concatenate(seqs).astype(np.int64), np.array([len(s) for s in seqs]), least, times)
        got = [[] for _ in seqs]
        for s, *run in zip(*(x.tolist() for x in found)):
            got[s].append(tuple(run))
        assert got == [runs_brute(s, least, times) for s in seqs]


def test_grammar_extensions(rng):
    """Longest common extensions in both directions, by comparison item by item."""
    for k in (1, 2, 5):
        seqs = [np.tile(rng.integers(0, k, 7), 9), rng.integers(0, k, 50), np.zeros(0, int), rng.integers(0, k, 1)]
        grammar = Grammar(np.concatenate(seqs).astype(np.int64), np.cumsum([0, *map(len, seqs)]))
        laid, back, n = grammar.laid, grammar.reversed(), len(grammar.laid)
        for base, size in ((1, 63), (65, 50)):
            i, j = np.triu_indices(size, 1)
            right, left = grammar.forward(base + i, base + j), back.forward(n - base - i, n - base - j)
            for a, b, r, e in zip((base + i).tolist(), (base + j).tolist(), right.tolist(), left.tolist()):
                assert (laid[a : a + r] == laid[b : b + r]).all() and laid[a + r] != laid[b + r]
                assert (laid[a - e : a] == laid[b - e : b]).all() and laid[a - e - 1] != laid[b - e - 1]
