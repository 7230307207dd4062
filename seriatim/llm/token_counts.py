"""Token counts with a whole-token shortcut.

A pre-token that is itself one token of the vocabulary needs no merging. Which
vocabulary strings encode alone as one token is proved beforehand with the
library, once a worker process. Texts fall into units that the tokenizer treats
by themselves (non-blanks with the blank before them, or blanks). A new unit is
split into pre-tokens; those in the proven set count one each, and only the
rest is merged, by the library. A worker remembers the counts of units.

The split by pattern and the library's agree on every assigned character; a
unit that holds an unassigned one is counted by the library as a whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriatim.llm.rows import buffers, slices_of, units_of

LIMIT = 1024
#: Units whose counts a worker remembers, the longest of them in bytes, and bytes worked on at once.
REMEMBERED, LONGEST, AT_ONCE = 400_000, 64, 4 << 20


@functools.cache
def tokenizer_of(file: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(file))


def byte_spelling() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@functools.cache
def whole_tokens(file: str) -> frozenset[str]:
    """Vocabulary strings proved to encode alone as one token."""
    tokenizer, spelled, strings = tokenizer_of(file), byte_spelling(), []
    for word in tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(spelled[c] for c in word).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, found) if len(e.ids) == 1)


@functools.cache
def counter_of(file: str) -> Counter:
    """One for all tasks of a worker process."""
    return Counter(file)


class Counter:
    """Token counts of many texts at once."""

    def __init__(self, file: str) -> None:
        self.tokenizer, self.whole = tokenizer_of(file), whole_tokens(file)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        # special strings count as one token wherever they stand
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[bytes, int] = {}

    def many(self, texts: list[bytes]) -> list[int]:
        units, specials = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            units.append(units_of(text) if len(parts) == 1 else [u for p in parts for u in units_of(p)])
            specials.append(len(parts) - 1)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*units).difference(self.known)
        self._learn(new)
        counts = [n + sum(map(self.known.__getitem__, u)) for n, u in zip(specials, units)]
        for unit in new:
            if len(unit) > LONGEST:
                del self.known[unit]
        return counts

    def _learn(self, units: set[bytes]) -> None:
        """Count the tokens of new units: pre-tokens that are proved to be whole count at once, the rest is merged."""
        rest: dict[str, int] = {}
        partly: list[tuple[bytes, int, list[str]]] = []
        for unit in units:
            text = unit.decode()
            # up to U+036F every character is assigned
            if not unit.isascii() and max(text) > "\u036f" and any(unicodedata.category(c) == "Cn" for c in text):
                found, merge = [], [text]
            else:
                found = self.split(text)
                merge = [p for p in found if p not in self.whole]
            if merge:
                partly.append((unit, len(found) - len(merge) if found else 0, merge))
                rest.update(dict.fromkeys(merge, 0))
            else:
                self.known[unit] = len(found)
        for part, e in zip(rest, self.tokenizer.encode_batch(list(rest), add_special_tokens=False)):
            rest[part] = len(e)
        for unit, n, merge in partly:
            self.known[unit] = n + sum(map(rest.__getitem__, merge))


def token_counts(
    docs: DataFrame,
    text: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = LIMIT,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The ``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    As the library counts without begin, end or added special tokens; special
    strings inside a text are special. A null text is empty. Ids may be null
    or repeat, every row counts by itself; columns not kept play no part, and a
    kept one named like a measure gives way to it. The tokenizer is byte-level BPE.
    """
    rest = [c for c in dict.fromkeys(keep) if c not in ("n_bytes", "n_tokens", "over_limit")]
    named = docs.select(*(F.col(c).alias(f"_c{n}") for n, c in enumerate(rest)), F.col(text).alias("_text"))
    passed, types = named.columns[:-1], dict(named.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(tokenizer)
        for batch in batches:
            counts = [n for _, texts in slices_of(batch.column("_text"), AT_ONCE) for n in counter.many(texts)]
            sizes = np.diff(buffers(batch.column("_text"))[1])
            columns = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *columns], names=[*passed, "n_bytes", "n_tokens", "over_limit"])

    found = named.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in passed), "n_bytes bigint, n_tokens bigint, over_limit boolean"]))
    return found.withColumnsRenamed(dict(zip(passed, rest)))
