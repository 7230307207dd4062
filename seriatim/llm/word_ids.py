"""Ids of texts by a word-level byte-pair tokenizer that drops white space.

A text's ids are those of its words in a row, so words are looked up. New
words of plain Latin letters, digits and punctuation are merged here, all
strings of one length side by side in arrays: every round merges each string's
pair of lowest rank. All other words go to the library.
"""

from __future__ import annotations

import functools
import gc
import json
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from seriatim.llm.token_counts import byte_spelling

#: Words and parts of words that a worker remembers.
WORDS = 400_000
#: Longest part merged here, in bytes.
LONGEST = 32
_NONE = np.iinfo(np.int32).max
#: What the library's pattern makes of words in these characters, lower-cased.
_LETTERS = "a-zà-öø-ÿß"
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")


@functools.cache
def _model(file: str) -> tuple:
    """The tokenizer, ids of bytes inside and at the end of a part, merges by key, their ranks and results."""
    with open(public_tokenizers.path(file)) as f:
        model = json.load(f)["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    spelled = sorted(byte_spelling().items(), key=lambda x: x[1])
    inner = np.array([vocab[c] for c, _ in spelled], np.int64)
    last = np.array([vocab[c + end] for c, _ in spelled], np.int64)
    key = np.array([vocab[a] << 16 | vocab[b] for a, b in model["merges"]], np.int64)
    made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
    order = np.argsort(key)
    return Tokenizer.from_file(public_tokenizers.path(file)), inner, last, key[order], order.astype(np.int32), made


@functools.cache
def word_ids(file: str) -> WordIds:
    """One for all tasks of a worker process."""
    return WordIds(file)


class WordIds:
    def __init__(self, file: str) -> None:
        self.tokenizer, self.inner, self.last, self.keys, self.ranks, self.made = _model(file)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def many(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        words = [t.split() for t in texts]
        if len(self.known) > WORDS:
            self.known.clear()
        if len(self.parts) > WORDS:
            self.parts.clear()
        gc.disable()  # many small strings and no cycles
        try:
            self._learn(set().union(*words).difference(self.known))
        finally:
            gc.enable()
        known = self.known
        return [b"".join(map(known.__getitem__, w)) for w in words]

    def ids(self, text: bytes) -> bytes:
        return self.many([text])[0]

    def _learn(self, new: set[bytes]) -> None:
        one, several, other = {}, {}, []
        for w in new:
            s = w.decode()
            if s.isascii() and s.isalpha():
                one[w] = s.lower()
            elif _PLAIN.fullmatch(s) and "<|" not in s:
                several[w] = tuple(_PARTS.findall(s.lower()))
            else:
                other.append(s)
        parts, known = self.parts, self.known
        self._merge(list({*one.values(), *(p for found in several.values() for p in found)}.difference(parts)))
        known.update(zip(one, map(parts.__getitem__, one.values())))
        for w, found in several.items():
            known[w] = b"".join(map(parts.__getitem__, found))
        for s, e in zip(other, self.tokenizer.encode_batch(other, add_special_tokens=False)):
            known[s.encode()] = np.asarray(e.ids, "<u4").tobytes()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 16 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge(self, parts: list[str]) -> None:
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in parts:
            b = p.encode()
            by_size.setdefault(len(b) if len(b) <= LONGEST else 0, []).append((p, b))
        for p, _ in by_size.pop(0, []):
            self.parts[p] = np.asarray(self.tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
        for size, pairs in by_size.items():
            text = np.frombuffer(b"".join(b for _, b in pairs), np.uint8).reshape(-1, size).T
            ids = self.inner[text]
            ids[-1] = self.last[text[-1]]
            alive = self._merged(ids)
            flat = ids.T[alive.T].astype("<u4").tobytes()
            ends = 4 * np.cumsum(alive.sum(axis=0))
            for (p, _), a, b in zip(pairs, [0, *ends[:-1].tolist()], ends.tolist()):
                self.parts[p] = flat[a:b]

    def _merged(self, ids: np.ndarray) -> np.ndarray:
        """Merges the columns of ``ids`` in place; which entries are left. A merged pair stands where its first half stood."""
        size, n = ids.shape
        alive = np.ones((size, n), bool)
        if size == 1:
            return alive
        after = np.repeat(np.arange(1, size + 1)[:, None], n, axis=1)
        before = after - 2
        rank = np.full((size, n), _NONE, np.int32)
        rank[:-1] = self._rank(ids[:-1], ids[1:])
        here = np.arange(n)
        while True:
            at = rank[:, here].argmin(axis=0)
            best = rank[at, here]
            on = best < _NONE
            here, at, best = here[on], at[on], best[on]
            if not len(here):
                return alive
            gone = after[at, here]
            ids[at, here] = self.made[best]
            alive[gone, here] = False
            rank[gone, here] = _NONE
            further = after[gone, here]
            after[at, here] = further
            inside = further < size
            before[further[inside], here[inside]] = at[inside]
            right = np.minimum(further, size - 1)
            rank[at, here] = np.where(inside, self._rank(ids[at, here], ids[right, here]), _NONE)
            left = before[at, here]
            some = left >= 0
            rank[left[some], here[some]] = self._rank(ids[left[some], here[some]], ids[at[some], here[some]])
