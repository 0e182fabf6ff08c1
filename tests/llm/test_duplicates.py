"""Exact, near and line duplicates, signatures and components, against brute force."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from podium.llm import components as components_module, hamming, line_dedup, queries
from podium.llm.components import components
from podium.llm.decontamination import drop_hits
from podium.llm.exact_dedup import exact_dedup
from podium.llm.hamming import Index, linked, local_roots
from podium.llm.line_dedup import SHINGLE, drop_lines, line_duplicates
from podium.llm.near_dedup import INDEX, drop_near_duplicates, near_duplicates, shingles
from podium.llm.quality import drop_poor
from podium.llm.toxicity import drop_toxic


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar(sets, percent):
    """Pairs of places of similar sets."""
    holders, pairs = defaultdict(list), set()
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                pairs.add((j, i))
    return pairs


def near_brute(rows, union_find):
    sets = [word_set(t) for _, t in rows]
    for j, i in similar(sets, 75):
        union_find.join(i, j)
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        least[union_find.find(n)].append(i)
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [x for x in least[union_find.find(n)] if x is not None]
        component = (min(ids) if ids else None) if sets[n] else i
        out.append((i, len(sets[n]), component, i == component))
    return sorted(out, key=str)


def test_near_query(spark, sf_dir, texts, union_find):
    got = sorted(map(tuple, queries.op5_minhash_near_dedup(spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == near_brute([*texts.items()], union_find)


def test_near_odd_rows(odd, nothing, odd_rows, union_find):
    got = sorted(map(tuple, near_duplicates(odd).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == near_brute(odd_rows, union_find)
    assert near_duplicates(nothing).count() == 0
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "11", "2", "3", "5", "7", "8", "9", "None"]


def test_near_family_larger_than_a_block(spark, monkeypatch, rng, union_find):
    """A hot group of near copies: members that only meet through others, in families of many blocks."""
    monkeypatch.setattr("podium.llm.hamming._BLOCK", 16)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(150):
        words = base.copy()
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            words[at] = f"x{rng.integers(1 << 30)}"
        rows.append((n, " ".join(words)))
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == near_brute(rows, union_find)


def test_shingles_are_sets_of_five_words():
    column = pa.array(["a b c d e f a b c d e", "", "a b", "A  b", "b a", "a b c d e"])
    items, cut = shingles(column)
    sets = [set(items[a:b].tolist()) for a, b in zip(cut, cut[1:])]
    assert [len(s) for s in sets] == [6, 0, 1, 1, 1, 1]
    assert sets[2] == sets[3] != sets[4] and sets[5] <= sets[0]


@pytest.mark.parametrize("index", [INDEX, Index(3, 4, 2, 11), Index(4, 3, 0, 3), Index(2, 5, 1, 9)])
def test_pigeonhole_guarantee(index, rng):
    """Signatures within the guaranteed distance share a key, whatever symbols differ."""
    for distance in range(index.guaranteed + 1):
        a = rng.integers(0, 1 << 16, (60, index.symbols)).astype(np.uint16)
        b = a.copy()
        for row in b:
            at = rng.choice(index.symbols, distance, replace=False)
            row[at] ^= rng.integers(1, 1 << 16, distance).astype(np.uint16)
        for x, y in zip(index.keys(a), index.keys(b)):
            assert set(x.tolist()) & set(y.tolist())


def test_signatures_estimate_similarity(rng):
    index = Index(40, 10, 0, 0)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    a, b = pool[:1000], pool[200:]
    s = index.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


def test_linked_matrix(rng):
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30)).astype(np.uint64)) for _ in range(60)]
    got = linked(np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets]]), 40)
    want = similar([frozenset(s.tolist()) for s in sets], 40)
    assert {(i, j) for i, j in combinations(range(60), 2) if got[i, j]} == want
    assert not linked(np.zeros(0, np.uint64), np.array([0, 0, 0]), 75).any()


def test_local_roots(rng):
    link = rng.random((80, 80)) < 0.012
    link |= link.T
    roots = local_roots(80, lambda i, others: link[i, others])
    reach = np.linalg.matrix_power((link | np.eye(80, dtype=bool)).astype(float), 80) > 0
    assert roots.tolist() == [int(np.flatnonzero(r)[0]) for r in reach]


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, rng, union_find, kind):
    edges = {"random": [tuple(map(int, e)) for e in rng.integers(0, 300, (220, 2))], "chain": [(i, i + 1) for i in range(60)],
             "star": [(i, 500) for i in range(400)] + [(7, 7)], "none": []}[kind]
    for a, b in edges:
        union_find.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: union_find.find(x) for e in edges if e[0] != e[1] for x in e}


def exact_brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_odd_rows(odd, nothing, odd_rows):
    rows = exact_dedup(odd).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == exact_brute(odd_rows)
    kept = defaultdict(int)
    for r in rows:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}  # of repeated rows, too, exactly one stays
    assert exact_dedup(nothing).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_exact_merge_rounds(documents, texts, bits):
    got = exact_dedup(documents.repartition(13), fan_in_bits=bits).select("doc_id", "keep_id", "group_size", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == exact_brute([*texts.items()])


def test_exact_stays_in_the_jvm(documents, capsys):
    exact_dedup(documents).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def line_brute(rows, union_find, least=1):
    items = []
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            b = lower(line).encode().strip(b"\x09\x0b\x0c\x0d\x20")
            if len(b) >= least:
                items.append((i, n, b))
    distinct = sorted({b for _, _, b in items})
    for j, i in similar([frozenset(b[k : k + SHINGLE] for k in range(len(b) - SHINGLE + 1)) for b in distinct], 80):
        union_find.join(i, j)
    root = {b: union_find.find(n) for n, b in enumerate(distinct)}
    first = {}
    key = lambda i, n: (i is None, i or 0, n)
    for i, n, b in items:
        first[root[b]] = min(first.get(root[b], (2, 0, 0)), key(i, n))
    out = {i: [] for i, _ in rows}
    for i, n, b in items:
        if first[root[b]] != key(i, n):
            out[i].append(n)
    return out


def test_line_query(spark, sf_dir, texts, union_find):
    got = {r.doc_id: r.dropped for r in queries.op10_line_dedup(spark, sf_dir).collect()}
    assert got == line_brute([*texts.items()], union_find)


LONG = "a line that is long enough to be compared with all the others of this small corpus"


def test_line_odd_rows(spark, odd, nothing, union_find):
    rows = [(1, f"{LONG}\n\nshort\nshort\n  {LONG.upper()}  \nsomething else that is long enough, but quite unlike it"), (2, f"{LONG} indeed\nshort"), (3, None), (4, ""),
            (5, LONG + "\n" + LONG), (None, f"x\n{LONG}\nonly the row without an id has this one here")]
    df = spark.createDataFrame([(i, t, 1, len(t or "")) for i, t in rows], "doc_id bigint, text string, dropped int, n_chars int").repartition(3)
    assert {r.doc_id: r.dropped for r in line_duplicates(df).collect()} == line_brute(rows, union_find)
    out = {r.doc_id: r for r in drop_lines(df, length_col="n_chars").collect()}
    assert out[1].text == f"{LONG}\n\nshort\nsomething else that is long enough, but quite unlike it"
    assert out[2].text == "" and out[2].n_chars == 0 and out[3].text is None and out[4].text == out[5].text == "" and out[1].dropped == 1
    assert out[None].text == "x\nonly the row without an id has this one here"
    assert drop_lines(odd).columns == odd.columns and drop_lines(odd).count() == odd.count()
    assert line_duplicates(nothing).count() == drop_lines(nothing).count() == 0


def test_repeated_rows_keep_the_same_lines(spark):
    df = spark.createDataFrame([(1, LONG), (1, LONG), (2, LONG)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in drop_lines(df).collect()) == [(1, LONG), (1, LONG), (2, "")]


def fives(line):
    return frozenset(line.encode()[k : k + 5] for k in range(len(line.encode()) - 4))


def test_lines_of_40_to_120_bytes_with_one_changed_byte(spark, rng, union_find):
    """By sets of 5 bytes, whatever length the module has: near-lines as ordinary texts have them."""
    lines = []
    for n in [*range(40, 121, 2)] * 3:
        line = "".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz "], n - 2))
        at = int(rng.integers(12, n - 12))
        lines += [f"<{line}>", f"<{line[:at]}#{line[at + 1:]}>"]
    for j, i in similar([*map(fives, lines)], 80):
        union_find.join(i, j)
    want = [n for n in range(len(lines)) if union_find.find(n) != n]
    assert len(want) > 100 and min(len(lines[n]) for n in want) <= 50
    df = spark.createDataFrame([*enumerate(lines)], "doc_id bigint, text string").repartition(3)
    assert sorted(r.doc_id for r in line_duplicates(df).collect() if r.dropped) == want


def test_short_lines_are_compared_as_a_whole(spark):
    """Exact copies go whatever their length, blank lines stay."""
    rows = [(1, "a\n\nUnits\nпривет, мир"), (2, " A \n \nunits\nb"), (3, "日本\nПривет, мир\nпривет, мир\n\nb"), (4, "日本\nabc\nabd\nunit")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert {r.doc_id: r.dropped for r in line_duplicates(df).collect()} == {1: [], 2: [0, 2], 3: [2, 4], 4: [0]}
    assert {r.doc_id: r.text for r in drop_lines(df).collect()}[2] == " \nb"


def test_sketches_rule_no_similar_line_out(rng):
    lines = []
    for n in rng.integers(20, 900, 200).tolist():
        a = rng.choice([*b"abcdefgh "], n).astype(np.uint8)
        b = a.copy()
        b[rng.integers(0, n, int(rng.integers(1, 2 + n // 25)))] = 35
        lines += [a.tobytes(), b.tobytes()[: n - int(rng.integers(0, 5))]]
    flat, ends = np.frombuffer(b"".join(lines), np.uint8), np.cumsum([*map(len, lines)])
    n, bits = line_dedup.sketches(flat, ends - [*map(len, lines)], ends)
    sets = [frozenset(x[k : k + SHINGLE] for k in range(len(x) - SHINGLE + 1)) for x in lines]
    a, b = np.triu_indices(len(lines), 1)
    near = line_dedup.Sketches(n, bits, 80).near(a, b)
    alike = np.array([100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i, j in zip(a.tolist(), b.tolist())])
    assert near[alike].all() and alike.sum() > 50 and near[~alike].mean() < 0.01


def test_families_by_pairs_and_by_matrix(monkeypatch, rng):
    sets, cut = [], [0]
    for m in (1, 2, 3, 16, 17, 40, 5):
        origin = rng.choice(10_000, 60, replace=False)
        sets += [np.unique(np.concatenate([origin[rng.random(60) > rng.choice([0.05, 0.3])], rng.choice(10_000, 3)])).astype(np.uint64) for _ in range(m)]
        cut.append(cut[-1] + m)
    sets[1] = sets[1][:0]
    items, begin = np.concatenate(sets), np.concatenate([[0], np.cumsum([*map(len, sets)])])
    want = np.arange(len(sets))
    for a, b in zip(cut[:-1], cut[1:]):
        links = linked(items[begin[a] : begin[b]], begin[a : b + 1] - begin[a], 75)
        want[a:b] = a + local_roots(b - a, lambda i, others: links[i, others])
    assert (want != np.arange(len(sets))).sum() > 10
    for few in (1, 2, 16, 64):
        monkeypatch.setattr(hamming, "_FEW", few)
        assert (hamming.family_roots(items, begin, np.array(cut), 75) == want).all()


INTERNAL = ("_1", "_2", "_k1", "_k2", "_key", "_key_", "_gone", "_dropped", "_toxicity", "_text", "key", "k", "dropped", "node")


def test_columns_of_any_name_keep_their_values(spark):
    rows = [(i, f"{LONG} {w}\nline {i} of this one\n{LONG}") for i, w in enumerate(("here", "there", "word and another word", "x y z u v w a b c"))]
    df = spark.createDataFrame([(*r, *(r[0] * 100 + n for n in range(len(INTERNAL)))) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in INTERNAL))
    df = df.withColumn("source", F.lit("a")).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    for out in (drop_lines(df), drop_near_duplicates(df), drop_poor(df, labels), drop_toxic(df, labels), drop_hits(df, df.limit(0).withColumnRenamed("doc_id", "item_id"))):
        assert out.columns == df.columns
        for r in out.collect():
            assert [r[c] for c in INTERNAL] == [r.doc_id * 100 + n for n in range(len(INTERNAL))]
    assert drop_lines(df).count() == 4


def test_buckets_are_found_in_a_stream():
    """Buckets of any size, also of cells larger than what is held at a time, from rows that come cell by cell, a third of them copies."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2)
    keys = np.concatenate([keys, keys[:150], np.repeat(keys[150:160], 7), np.repeat(keys[160], 300)])
    nodes = rng.integers(0, 1 << 63, len(keys), dtype=np.uint64)
    keys, nodes = np.append(keys, keys[::3]), np.append(nodes, nodes[::3])
    for cells, limit in ((64, 1 << 20), (64, 40), (1, 100)):
        parts = [line_dedup._dealt(keys[i::3], nodes[i::3], cells) for i in range(3)]
        rows = pa.Table.from_batches(parts).sort_by("cell").to_batches(max_chunksize=5)
        buckets = line_dedup.Buckets(limit)
        got = [r for b in rows for x in buckets.add(*line_dedup._pairs(b)) for r in x.to_pylist()]
        got += [r for x in buckets.close() for r in x.to_pylist()]
        want = {}
        for k, n in zip(keys.tolist(), nodes.view(np.int64).tolist()):
            want.setdefault(k, set()).add(n)
        want = {frozenset(x) for x in want.values() if len(x) > 1}
        large, pairs = {}, set()
        for r in got:
            if r["b"] is None:
                large.setdefault(r["key"], set()).add(r["a"])
                assert r["size"] is None or r["size"] > line_dedup._TOGETHER
            else:
                pairs.add(frozenset((r["a"], r["b"])))
        together = {frozenset(p) for x in want if len(x) <= line_dedup._TOGETHER for p in combinations(x, 2)}
        told = {frozenset(x) for x in large.values()}
        assert {x for x in want if len(x) > line_dedup._TOGETHER} <= told <= want
        assert together == pairs | {frozenset(p) for x in told if len(x) <= line_dedup._TOGETHER for p in combinations(x, 2)}
        if limit == 1 << 20:
            assert all(len(x) > line_dedup._TOGETHER for x in told) and all(r["size"] == len(large[r["key"]]) for r in got if r["b"] is None)


def test_small_graphs_end_in_one_task(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (7, 7), (-5, 60), (60, 61)]
    want = {i: 0 for i in range(41)} | {100: 90, 95: 90, 90: 90} | {-5: -5, 60: -5, 61: -5}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for held in (components_module._HELD, 0):
        monkeypatch.setattr(components_module, "_HELD", held)
        assert {r.node: r.root for r in components_module.components(frame).collect()} == want
    assert components_module.components(frame.filter("a = b")).count() == 0
