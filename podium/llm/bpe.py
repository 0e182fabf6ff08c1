"""Byte-level BPE by a pair occurrence index, and its inverse.

Within a partition, each pair of neighbouring symbols is mapped to all its positions in all distinct words. The ranks that
occur are applied in ascending order, each to all its positions at once; the pairs that a merge creates join the lists of
their own ranks, which are always higher, and positions that a merge has changed are passed over when their turn comes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, slices
from .encoding import Encoder, byte_alphabet, cuts, ragged
from .textvec import text_bytes


#: Distinct stretches that share one pair index; bounds its memory.
_AT_ONCE = 150_000


class PairIndex:
    """Merges of a byte-level BPE model (the ``model`` part of a tokenizer file)."""

    def __init__(self, model: dict, dtype: str) -> None:
        vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.dtype, self.width = dtype, np.int64(max(vocabulary.values()) + 1)
        self.bytes = np.array([vocabulary[x] for x in byte_alphabet()], np.int64)
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.left, self.right, self.made = left, right, np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where no merge has it."""
        keys = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of ``dtype``."""
        if not words:
            return []
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size + 1)  # a border (-1) stands before each word and at the very end
        place = np.int32 if ends[-1] < 2**31 - 2 else np.int64
        symbol = np.full(ends[-1] + 1, -1, np.int32)
        inside = np.ones(len(symbol), bool)
        inside[0] = False
        inside[ends] = False
        symbol[inside] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        following, before = np.arange(1, len(symbol) + 1, dtype=place), np.arange(-1, len(symbol) - 1, dtype=place)
        occurs: dict[int, list[np.ndarray]] = {}

        def note(at: np.ndarray) -> None:
            rank = self._rank(symbol[at], symbol[following[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, where in zip(rank[np.concatenate([[0], edges])].tolist(), np.split(at, edges)):
                if r in occurs:
                    occurs[r].append(where)
                else:
                    occurs[r] = [where]
                    heapq.heappush(active, r)

        active: list[int] = []
        note(np.flatnonzero(symbol[:-1] >= 0))
        while active:
            r = heapq.heappop(active)
            lists = occurs.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (symbol[following[at]] == b)]
            if a == b and len(at) > 1:  # in a run of equal symbols every other position begins a merge
                head = np.ones(len(at), bool)
                head[1:] = following[at[:-1]] != at[1:]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            symbol[at], symbol[gone] = self.made[r], -2
            after = following[gone]
            following[at], before[after] = after, at
            note(np.unique(np.concatenate([before[at], at])))
        kept = symbol >= 0
        count = np.cumsum(kept)
        flat = symbol[kept].astype(self.dtype).tobytes()
        step = np.dtype(self.dtype).itemsize
        edges = (count[np.concatenate([[0], ends])] * step).tolist()
        return [flat[i:j] for i, j in zip(edges, edges[1:])]


class Bpe:
    """Encoding and decoding of one vocabulary file, in one process."""

    def __init__(self, path: str) -> None:
        self.tool = Encoder(path, learn=self._learn)
        if not self.tool.by_stretch:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.index = PairIndex(self.tool.spec["model"], self.tool.dtype)
        added = {t["content"]: t["id"] for t in self.tool.spec.get("added_tokens", [])}
        self.added = added
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")").split if added else None
        back = {letter: bytes([b]) for b, letter in enumerate(byte_alphabet())}
        pieces = [b""] * self.tool.vocabulary
        for token, n in (self.tool.spec["model"]["vocab"] | added).items():
            # A token with a character that stands for no byte is its own text.
            pieces[n] = b"".join([back[c] for c in token]) if all(c in back for c in token) else token.encode()
        self.token_bytes = self._table(pieces)
        self.token_names = self._table([b"%d," % n for n in range(self.tool.vocabulary)])

    @staticmethod
    def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in pieces], np.int64)
        return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths

    def _learn(self, _: Encoder, stretches: list[bytes]) -> list[bytes]:
        cut = [self.tool.pretokens(s) for s in stretches]
        words = {w: i for i, w in enumerate(dict.fromkeys(w for ws in cut for w in ws))}
        found = self.index.encode([*words])
        return [b"".join([found[words[w]] for w in ws]) for ws in cut]

    def prepare(self, batch: pa.RecordBatch, name: str = "text") -> None:
        """Encode all new stretches of a batch in one go, so that they share one pair index."""
        new: dict[int, bytes] = {}

        def learn() -> None:
            keys = np.array(sorted(new), np.uint64)
            self.tool.table.add(keys, [new[k] for k in keys.tolist()])
            new.clear()

        for part in slices(iter([batch]), 512, 2 << 20):
            flat, offsets = text_bytes(part[name])
            starts = cuts(flat, offsets)
            new |= self.tool.table.unknown(flat, starts, np.append(starts[1:], len(flat)))
            if len(new) > _AT_ONCE:
                learn()
        if new:
            learn()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the end)."""
        flat, _ = text_bytes(texts)
        held = flat.tobytes()
        if not any(s in held for s in self.tool.specials):
            return self.tool.column(texts)
        out, lengths = [], []
        for text in texts.to_pylist():
            parts = self.split(text)
            ids = [np.array([self.added[p]], self.tool.dtype) if p in self.added else self.tool.column(pa.array([p]))[0] for p in parts if p]
            out += ids
            lengths.append(sum(map(len, ids)))
        return np.concatenate(out or [np.zeros(0, self.tool.dtype)]), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)

    def expand(self, ids: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
        """Each text's ids, replaced by their entries in a byte table."""
        flat, begin, lengths = table
        size = lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])[at].tolist()
        whole = ragged(flat, begin[ids], size).tobytes()
        return [whole[a:b] for a, b in zip(ends, ends[1:])]


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the decoded text in UTF-8. Special tokens' strings in a text
    are those tokens, as the library has it by default. Null text is empty: no ids. Null and repeated ids pass through, one row per
    row. Texts of any length are encoded whole. An empty table gives no rows. Other columns are ignored. No shuffle.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe(tokenizer)
        for batch in batches:
            tool.prepare(batch)
            for part in slices(iter([batch]), 512, 1 << 20):
                ids, at = tool.encode(part["text"])
                names = [hashlib.sha256(x[:-1]).hexdigest() for x in tool.expand(ids, at, tool.token_names)]
                texts = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in tool.expand(ids, at, tool.token_bytes)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.diff(at)), pa.array(names, pa.string()), pa.array(texts, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs, id_col, text_col).mapInArrow(rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
