"""Token ids by the tokenizers library, remembered per stretch of text.

Byte-level BPE of this kind never merges across the border between a word and the space, line feed or punctuation mark
that follows it. Texts are cut there by array operations, equal stretches are found by a 64-bit hash, each new stretch
is encoded once per process, and ids are gathered from the table of stretches. Borders that could belong to a longer run of
blanks are no cuts; texts with special tokens, and other kinds of tokenizers, go to the library as they are.
"""

from __future__ import annotations

import json
import os
import string
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from .textvec import span_hashes, text_bytes

#: Pre-tokens of byte-level BPE with its built-in pattern (fixed value of that tokenizer kind).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Up to here the classes of letters, digits and blanks are the same in every Unicode release in use.
_STABLE = regex.compile(r"[\u0000-ʯ]*")
_BYTES = np.arange(256)
#: Bytes that cannot begin a blank: no control or space, no first byte of a blank beyond ASCII.
_NO_BLANK = ~np.isin(_BYTES, [*range(0, 33), 0xC2, 0xE1, 0xE2, 0xE3])
_PRINTED = (_BYTES > 32) & (_BYTES < 127)
_LETTER = np.isin(_BYTES, list(string.ascii_letters.encode()))
_MARK = np.isin(_BYTES, list(string.punctuation.encode()))


def byte_alphabet() -> list[str]:
    """The letter that stands for each byte in vocabularies of this kind: printable bytes themselves, the rest from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def cuts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the stretches of all texts: text starts, spaces and line feeds before a word, marks behind a letter."""
    n = len(flat)
    follows = np.zeros(n, bool)
    follows[:-1] = _NO_BLANK[flat[1:]]
    follows[offsets[1:][offsets[1:] > 0] - 1] = False
    cut = (flat == 32) & follows
    line = (flat == 10) & follows
    line[0:1] = False
    line[1:] &= _PRINTED[flat[:-1]]
    mark = _MARK[flat]
    mark[0:1] = False
    mark[1:] &= _LETTER[flat[:-1]]
    cut |= line | mark
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


def ragged(flat: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that begin at ``at``, one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return flat[np.repeat(at - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class StretchTable:
    """Ids of stretches, found by hash. ``learn`` encodes new ones; beyond ``limit`` stretches the table starts anew."""

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], dtype: str, limit: int = 1_500_000) -> None:
        self.learn, self.dtype, self.limit = learn, dtype, limit
        self._reset()

    def _reset(self) -> None:
        self.keys, self.at, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, self.dtype)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, stretches: list[bytes]) -> None:
        """Encode stretches whose ``keys`` (ascending, distinct) the table does not have."""
        if len(self.keys) + len(keys) > self.limit:
            self._reset()
        found = self.learn(stretches)
        lengths = np.array([len(x) for x in found], np.int32) // np.dtype(self.dtype).itemsize
        begin = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), self.dtype)])
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at, self.lengths = np.insert(self.at, where, begin), np.insert(self.lengths, where, lengths)

    def unknown(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, bytes]:
        keys, first = np.unique(span_hashes(flat, starts, ends, lower=False), return_index=True)
        fresh = ~self._find(keys)[1]
        text, of = flat.tobytes(), first[fresh]
        return dict(zip(keys[fresh].tolist(), [text[a:b] for a, b in zip(starts[of].tolist(), ends[of].tolist())]))

    def rows(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table row of each stretch; unknown ones are encoded and added first."""
        found = pa.array(span_hashes(flat, starts, ends, lower=False)).dictionary_encode()
        keys, back = found.dictionary.to_numpy(), found.indices.to_numpy()
        at, known = self._find(keys)
        if not known.all():
            if len(self.keys) + len(keys) > self.limit:
                self._reset()
                known[:] = False
            first = np.empty(len(keys), np.int64)
            first[back[::-1]] = np.arange(len(back))[::-1]
            new = np.flatnonzero(~known)
            new = new[np.argsort(keys[new])]
            text, of = flat.tobytes(), first[new]
            self.add(keys[new], [text[a:b] for a, b in zip(starts[of].tolist(), ends[of].tolist())])
            at = np.searchsorted(self.keys, keys)
        return at[back]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the stretches one after another, position of each stretch and the end)."""
        lengths = self.lengths[rows]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return ragged(self.ids, self.at[rows], lengths), ends


class Encoder:
    """``column`` gives the ids of all texts of an Arrow column, one after another, and where each text's ids begin."""

    def __init__(self, path: str, specials_as_text: bool = False, learn: Callable[[Encoder, list[bytes]], list[bytes]] | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = specials_as_text
        self.spec = json.loads(self.library.to_str())
        self.vocabulary = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype, self.kind = ("<u2", "H") if self.vocabulary <= 1 << 16 else ("<u4", "I")
        before, model = self.spec.get("pre_tokenizer") or {}, self.spec["model"]
        self.by_stretch = (
            self.spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges"))
        self.specials = [] if specials_as_text else [t["content"].encode() for t in self.spec.get("added_tokens", [])]
        self.letters = dict(enumerate(byte_alphabet()))
        self.find = regex.compile(PRETOKENS).findall
        self.table = StretchTable((lambda new: learn(self, new)) if learn else self._learn, self.dtype)

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def pretokens(self, stretch: bytes) -> list[bytes]:
        text = stretch.decode()
        return [stretch] if text[1:].isalpha() and text[0] == " " else [w.encode() for w in self.find(text)]

    def _learn(self, stretches: list[bytes]) -> list[bytes]:
        tokenize, letters, kind, out = self.library.model.tokenize, self.letters, self.kind, []
        for stretch in stretches:
            if not stretch.isascii() and not _STABLE.fullmatch(stretch.decode()):
                out.append(self.whole(stretch.decode()))  # the library's own Unicode tables decide
            else:
                out.append(array(kind, [t.id for w in self.pretokens(stretch) for t in tokenize(w.decode("latin-1").translate(letters))]).tobytes())
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, offsets = text_bytes(texts)
        held = flat.tobytes() if self.specials else b""
        if not self.by_stretch or any(s in held for s in self.specials):
            return self._one_by_one(texts, flat, offsets)
        starts = cuts(flat, offsets)
        ids, ends = self.table.gather(self.table.rows(flat, starts, np.append(starts[1:], len(flat))))
        return ids, ends[np.searchsorted(starts, offsets)]

    def _one_by_one(self, texts: pa.Array, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for i in range(len(texts)):
            text = flat[offsets[i] : offsets[i + 1]].tobytes()
            if self.by_stretch and not any(s in text for s in self.specials):
                found.append(self.column(texts.slice(i, 1))[0])
            else:
                found.append(np.frombuffer(self.whole(text.decode()), self.dtype))
        return np.concatenate(found or [np.zeros(0, self.dtype)]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)


_loaded: dict[tuple, Encoder] = {}


def encoder(path: str, specials_as_text: bool = False) -> Encoder:
    """The process's encoder of this vocabulary file; workers keep it between tasks."""
    key = (path, specials_as_text)
    if key not in _loaded:
        _loaded[key] = Encoder(path, specials_as_text)
    return _loaded[key]
