"""Encoding, bit packing, token counts, BPE and packing, against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from podium.llm import queries
from podium.llm.bitpack import Reader, Writer, bits_for, pack, pack_documents as pack_bits, unpack
from podium.llm.bpe import Bpe, bpe_round_trip
from podium.llm.encoding import Encoder
from podium.llm.packing import pack_documents
from podium.llm.token_counts import scan_flat, token_counts

ODD_TEXTS = ["", " ", "  ", " a", "a ", "a  b", "a   b\n\n c \n d", "x'sx 's '", "<|endoftext|> a <|endoftext|>", "日本 語 a", "\x1c \x1d a\x85 b", "a\t b", "a \tb", " \n", "\n \n a",
             "it's we'll  I'M", "é ́", "a\n b", "١٢ ½ ²", "foo\t\n bar", "a.\n\nb", "a 　b", "x.\n'll", "ab12'll!?don't", "\n\n\n", "\nb", "aaaaaaa aaaaaaaaaaaa", "-------", "\U0001f600\U0001f600 x"]
PIECES = st.lists(st.sampled_from([" ", "\n", "\t", "a", "B", "the", "é", "ß", "日", "'s", "'", "!", "#$", "12", "\xa0", " ", "　", "\x85", "<|", "<|endoftext|>", "\U0001f600"]), max_size=14).map("".join)


def ids_of(tool, texts):
    ids, at = tool(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@pytest.fixture(scope="module")
def fast(vocabulary):
    return Encoder(vocabulary)


@pytest.fixture(scope="module")
def own(vocabulary):
    return Bpe(vocabulary)


def test_encoders_agree_with_the_library(fast, own, library, texts):
    every = [*ODD_TEXTS, *texts.values()]
    want = [library.encode(t, add_special_tokens=False).ids for t in every]
    assert ids_of(fast.column, every) == want
    assert ids_of(own.encode, every) == want
    ids, at = own.encode(pa.array(every))
    assert [x.decode("utf-8", "replace") for x in own.expand(ids, at, own.token_bytes)] == [library.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(PIECES, min_size=1, max_size=4))
def test_encoders_agree_on_any_text(fast, own, library, texts):
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(fast.column, texts) == want and ids_of(own.encode, texts) == want


def test_special_strings_as_text(vocabulary):
    tool = Encoder(vocabulary, specials_as_text=True)
    assert 50256 not in tool.column(pa.array(["a <|endoftext|> b"]))[0]


def test_a_full_table_starts_anew(vocabulary, library):
    tool = Encoder(vocabulary)
    tool.table.limit = 5
    for text in ("one two three four", "five six seven eight nine", "one two ten"):
        assert ids_of(tool.column, [text]) == [library.encode(text, add_special_tokens=False).ids]


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_pack_unpack(bits, rng):
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = pack(ids, bits)
        assert len(data) == (n * bits + 7) // 8 and (unpack(data, n, bits) == ids).all()


def test_file_random_access(tmp_path, rng):
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (0, 5, 1000, 1, 333)]
    out = Writer(f"file://{tmp_path}/x.bits", bits_for(50257), block_ids=64)
    out.add([7, None, 9, 10, 11], np.concatenate(docs), np.array([len(d) for d in docs]))
    assert out.close() == (5, 1339)
    file = Reader(f"file://{tmp_path}/x.bits")
    assert all((file.document(i) == d).all() for i, d in enumerate(docs))
    assert (file.read(100, 500) == np.concatenate(docs)[100:600]).all() and file.absent.tolist() == [0, 1, 0, 0, 0]
    data = bytearray((tmp_path / "x.bits").read_bytes())
    data[3] ^= 1
    (tmp_path / "x.bits").write_bytes(data)
    with pytest.raises(ValueError):
        Reader(f"file://{tmp_path}/x.bits").document(2)


def packed_expectation(rows, library):
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return want


def test_bit_packing_query(spark, sf_dir, texts, library):
    got = sorted(map(tuple, queries.op4_bit_packing(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == packed_expectation(texts.items(), library)


def test_bit_packing_odd_rows(odd, nothing, odd_rows, vocabulary, library):
    got = sorted(map(tuple, pack_bits(odd, vocabulary, 2).collect()), key=lambda r: r[1])
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in packed_expectation(odd_rows, library))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    assert [r[0] for r in got] == sorted([r[0] for r in got], key=lambda i: (i is not None, i or 0))
    assert pack_bits(nothing, vocabulary, 2).count() == 0


def test_token_counts_query(spark, sf_dir, texts, library):
    got = {r.doc_id: r.n_tokens for r in queries.op7_token_counts(spark, sf_dir).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_token_counts_odd_rows(odd, nothing, odd_rows, vocabulary):
    tool = Encoder(vocabulary, specials_as_text=True).library
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts(odd, vocabulary, 50256).collect())
    assert got == sorted((str(i), len(tool.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows)
    assert token_counts(nothing, vocabulary, 50256).count() == 0


@pytest.mark.parametrize("width,block", [(2, 64), (4, 64), (2, 4096), (4, 1 << 20)])
def test_separators_across_blocks(spark, tmp_path, rng, width, block, monkeypatch):
    monkeypatch.setattr("podium.llm.token_counts._SUPER", 5)  # many groups of blocks
    want, files = [], []
    for part, unterminated in enumerate((False, True, False)):
        lengths = [int(n) for n in rng.choice([0, 0, 1, 3, 40, 500, 3000], 60)]
        flat = np.concatenate([np.append(rng.integers(0, 9, n), 9) for n in lengths]).astype(f"<u{width}")
        if unterminated:
            flat, lengths = np.append(flat, [1, 2, 3]).astype(flat.dtype), [*lengths, 3]
        (tmp_path / f"{part}").write_bytes(flat.tobytes())
        files.append((part, f"file://{tmp_path}/{part}", flat.nbytes, width))
        want += [(part, i, n) for i, n in enumerate(lengths)]
    files.append((9, f"file://{tmp_path}/none", 0, width))
    df = spark.createDataFrame(files, "part int, path string, n_bytes bigint, width int")
    assert sorted(map(tuple, scan_flat(df, 9, block).collect())) == want


def round_trip(rows, library):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def test_bpe_query(spark, sf_dir, texts, library):
    got = sorted((str(r[0]), *r[1:]) for r in map(tuple, queries.op9_bpe(spark, sf_dir).collect()))
    assert got == round_trip(texts.items(), library)


def test_bpe_odd_rows(odd, nothing, odd_rows, vocabulary, library):
    got = sorted((str(r[0]), *r[1:]) for r in map(tuple, bpe_round_trip(odd, vocabulary).collect()))
    assert got == round_trip(odd_rows, library)
    assert bpe_round_trip(nothing, vocabulary).count() == 0


def check_pieces(pieces, rows, library, window):
    by_doc, sequences = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        short += at < window
    return short


def test_packing_query(spark, sf_dir, texts, library):
    pieces = queries.op2_lexical_packing(spark, sf_dir)
    tasks = pieces.rdd.getNumPartitions()
    assert check_pieces(pieces.collect(), texts.items(), library, 1024) <= tasks


def test_packing_odd_rows(spark, odd, nothing, odd_rows, vocabulary, library):
    unique = {i: t for i, t in odd_rows if i is not None and i != 1}
    check_pieces(pack_documents(odd.filter("doc_id > 1"), vocabulary, window=16, shard_docs=2).collect(), unique.items(), library, 16)
    rows = pack_documents(odd, vocabulary, window=64).collect()
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_rows)
    assert sum(r.length for r in rows) == want
    assert pack_documents(nothing, vocabulary).count() == 0


def test_packing_takes_lexical_neighbours(spark, vocabulary):
    kinds = ["apple banana cherry", "engine piston gearbox", "violin cello trumpet"]
    rows = [(i, " ".join([kinds[i % 3]] * 4)) for i in range(30)]
    pieces = pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), vocabulary, window=60).collect()
    together = {}
    for r in pieces:
        together.setdefault(r.sequence_id, set()).add(r.doc_id % 3)
    assert sum(len(k) == 1 for k in together.values()) >= len(together) * 0.7


def test_packing_knows_long_documents_by_their_whole_text(spark, vocabulary):
    """The remainder of document 1 is like document 2, the rest of it like document 3."""
    rows = [(1, "engine piston gearbox " * 40 + "violin cello " * 4), (2, "violin cello trumpet"), (3, "engine piston gearbox")] + [(9 + i, f"nothing of that {i}") for i in range(9)]
    pieces = pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), vocabulary, window=64).collect()
    last = max((r for r in pieces if r.doc_id == 1), key=lambda r: r.start)
    assert last.start and [r.doc_id for r in sorted(pieces, key=lambda r: r.offset) if r.sequence_id == last.sequence_id][1] == 3


def test_packing_finds_neighbours_in_other_tasks_and_by_any_term(spark, vocabulary):
    """Like documents lie far apart in the input, a few in each of its tasks."""
    kinds = ["apple banana cherry", "engine piston gearbox", "violin cello trumpet", "copper silver nickel"]
    rows = [(i, " ".join([kinds[i % 4]] * 4)) for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    pieces = pack_documents(df, vocabulary, window=60, shard_docs=16).collect()
    together = {}
    for r in pieces:
        together.setdefault(r.sequence_id, set()).add(r.doc_id % 4)
    assert sum(len(k) == 1 for k in together.values()) >= len(together) * 0.6

    from podium.llm.packing import Shard

    def unit(doc, terms):
        return np.array(terms, np.uint16), (doc, 0, len(terms), np.array(terms, np.uint16), np.ones(len(terms), np.uint32))

    idf = np.linspace(2, 1, 200)
    shard = Shard([unit(0, range(60)), unit(1, range(100, 160)), unit(2, range(30, 60))], idf, 60, 1.2, 0.75)
    assert shard.neighbours(0).tolist() == [0, 2]


def test_neighbours_are_taken_from_what_is_left():
    """Taken one by one, while units are used up and leave the postings, they come as the whole ranking has them, ties included."""
    from podium.llm.packing import Shard

    rng = np.random.default_rng(8)
    texts = [np.unique(rng.zipf(1.4, 60).clip(max=400)) for _ in range(90)]
    units = [(np.zeros(1, np.uint16), (i, 0, len(t), t.astype(np.uint16), np.ones(len(t), np.uint32))) for i, t in enumerate([*texts, *texts[:30], np.array([500])])]
    whole, shard = (Shard(units, np.linspace(2, 1, 600), 30, 1.2, 0.75) for _ in range(2))
    used, postings = np.zeros(len(units), bool), len(shard.unit)
    for seed in rng.permutation(len(units)).tolist():
        used[seed] = True
        want = [i for i in whole.neighbours(seed).tolist() if not used[i]]
        assert list(shard.following(seed, used)) == want
    assert len(shard.unit) < postings / 4
