"""Encoding with a public tokenizer, word by word.

The tokenizer drops white space and never merges across it, so a text's ids are
those of its words (cut at ASCII white space) one after the other. Each distinct
word is encoded by the tokenizers library once and its ids are looked up
afterwards; test_tokens.py holds this against encoding whole texts.
"""

from __future__ import annotations

import os
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

#: The default tokenizer file, a parameter of the operators.
WORD_BPE = "word_bpe_49k.json"
#: Stands between words that are encoded together.
SEPARATOR = "\x1e"
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
LOWER = "[a-zß-öø-ÿ]+"
#: How byte-level vocabularies write bytes (a fixed rule): printable ones as they are, the others, in order, from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def tokenizer_path(name: str = WORD_BPE) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes arrays of texts; keeps the ids of at most `most_words` distinct words, and then of those met again."""

    def __init__(self, path: str, most_words: int = 750_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most_words
        alone = self.tok.encode(SEPARATOR, add_special_tokens=False).ids
        # A separator that is not one id of its own is not usable; then no id equals it and words are encoded one by one.
        self.separator = alone[0] if len(alone) == 1 else None
        # Lower-case letters pass the normalizer and the splitter as they are: the model alone gives their ids, if it does so for these.
        probe = ["a", "the", "z", "tokenizer", "qxzvkj", "abcdefghijklmnopqrstuvwxyz", "don", "s", "t", "re", "ll", "größe", "àáâãäåæçèéêëìíîï", "ðñòóôõöøùúûüýþÿß"]
        self.direct = all([t.id for t in self.tok.model.tokenize(w.encode().decode("latin-1").translate(BYTE_LETTERS))] == self.tok.encode(w, add_special_tokens=False).ids for w in probe)
        self.forget()

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Forgets all words but those in keep (numbers)."""
        old = getattr(self, "at", {})
        self.at: dict[str, int] = {}
        self.again = np.zeros(1 << 14, bool)
        if keep is None:
            self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
            self.start, self.len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
            return
        words = [w for w, k in zip(old, keep) if k]  # numbers are in the order of the dictionary
        flat, lens = self.ids[ragged(self.start[: len(keep)][keep], self.len[: len(keep)][keep])], self.len[: len(keep)][keep].copy()
        self.used = 0
        self._store(words, flat, lens)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each has."""
        if self.separator is None or any(SEPARATOR in w for w in words):
            got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter((i for x in got for i in x), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        # One text of all words is several times as fast as a text for each word.
        ids = np.array(self.tok.encode_batch_fast([f" {SEPARATOR} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(ids == self.separator)
        assert len(cut) == len(words) - 1, "the separator is no id of its own here"
        return np.delete(ids, cut), np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1

    def _store(self, words: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        n, m = len(flat), len(self.at)
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while m + len(words) > len(self.start):
            self.start, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.len))
        self.ids[self.used : self.used + n] = flat
        self.start[m : m + len(words)] = self.used + np.cumsum(lens) - lens
        self.len[m : m + len(words)] = lens
        self.at.update(zip(words, range(m, m + len(words))))
        self.used += n

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Of each word its number, or -1."""
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def _learn(self, words: list[str], own: pa.Array) -> None:
        """Letters followed by marks are two pieces to the tokenizer in any case, and ASCII letters are lowered first."""
        parted = pc.match_substring_regex(own, f"^{LETTERS}[.,;:!?]*$")
        heads = pc.if_else(parted, pc.ascii_rtrim(own, ".,;:!?"), own)
        heads = pc.if_else(pc.and_(parted, pc.string_is_ascii(own)), pc.ascii_lower(heads), heads)
        tails = pc.if_else(parted, pc.replace_substring_regex(own, f"^{LETTERS}", ""), "")
        pieces = pc.unique(pa.concat_arrays([heads, tails]))
        pieces = pieces.filter(pa.array(self._numbers(pieces.to_numpy(zero_copy_only=False).tolist()) < 0))
        if self.direct:
            lower = pc.match_substring_regex(pieces, f"^{LOWER}$")
            plain = pieces.filter(lower).to_numpy(zero_copy_only=False).tolist()
            of = self.tok.model.tokenize
            got = [[t.id for t in of(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS))] for w in plain]
            self._store(plain, np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))
            pieces = pieces.filter(pc.invert(lower))
        todo = pieces.to_numpy(zero_copy_only=False).tolist()
        for lo in range(0, len(todo), 5000):
            self._store(todo[lo : lo + 5000], *self._ids_of(todo[lo : lo + 5000]))
        fresh = self._numbers(words) < 0
        if fresh.any():
            mask = pa.array(fresh)
            parts = np.stack([self._numbers(x.filter(mask).to_numpy(zero_copy_only=False).tolist()) for x in (heads, tails)], 1)
            self._store(list(compress(words, fresh)), self.ids[ragged(self.start[parts].ravel(), self.len[parts].ravel())], self.len[parts].sum(1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and the offsets of each text's ids; null is empty."""
        if texts.null_count:
            texts = texts.fill_null("")
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
        words = lists.flatten()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.at) > self.most:
            self.forget(self.again[: len(self.at)])
            if len(self.at) > self.most // 2:
                self.forget()
        if len(self.again) < len(self.start):
            self.again = np.concatenate([self.again, np.zeros(len(self.start) - len(self.again), bool)])
        place = self._numbers(distinct)
        new = place < 0
        self.again[place[~new]] = True
        if new.any():
            words = list(compress(distinct, new))
            self._learn(words, coded.dictionary.filter(pa.array(new)))
            place[new] = self._numbers(words)
        which = place[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
        lens = self.len[which]
        flat = self.ids[ragged(self.start[which], lens)]
        ends = np.concatenate([[0], np.cumsum(lens)])
        bounds = lists.offsets.to_numpy().astype(np.int64)
        return flat, ends[bounds - bounds[0]]


def shared_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which keeps its words from task to task."""
    import tokenizers

    known = tokenizers.__dict__.setdefault("_word_encoders", {})
    if path not in known:
        known[path] = WordEncoder(path)
    return known[path]


def with_end(flat: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The id `end` appended to each text's ids."""
    n = len(offs) - 1
    out = np.empty(len(flat) + n, np.uint32)
    new = offs + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[new[1:] - 1] = False
    out[keep], out[~keep] = flat, end
    return out, new
