import numpy as np
import pytest


@pytest.fixture(scope="session")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


#: Every kind of row the operators promise a result for. Column names clash with those the operators use inside.
ODD = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (None, "the quick brown fox jumps over the lazy dog again and again"),
       (4, "THE quick brown fox jumps over the lazy dog again and again"), (5, "one two three"), (6, "one  two\tthree"), (7, "  \n\n "),
       (1, "the quick brown fox jumps over the lazy dog again and again"), (8, "w " * 30_000), (9, "é日本 語 \U0001f600 <|endoftext|> it's  done\n"), (None, None)]

_MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
#: Two different long words whose sums of powers are equal, whatever the base.
ODD += [(10, f"{_MORSE} a b c"), (11, f"{_MORSE.translate(str.maketrans('ab', 'ba'))} a b c")]
ODD_SCHEMA = "doc_id bigint, text string"
EXTRA = "node bigint, key string, k1 string, `n` int, `_1` int, score string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None, "k", None, 1, 2, "s", "en" if n % 2 else None, "src" if n % 3 else None, len(t or "")) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, f"{ODD_SCHEMA}, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], f"{ODD_SCHEMA}, {EXTRA}")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture
def rng():
    return np.random.default_rng(3)


class UnionFind(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


@pytest.fixture
def union_find():
    return UnionFind()
