"""Byte-pair encoding and decoding with a lexicon of the corpus' frequent words.

A text falls into units that the tokenizer treats by themselves: a run of
non-blanks with one blank before it, or blanks. The units that occur most in
the whole corpus are counted in Spark, encoded once, and compiled into a
minimal acyclic transducer (``lexicon``). Its file goes to the shared folder,
from where Spark hands it to every executor, and tasks map it into memory. All
units of a batch are looked up side by side; those it lacks are cut by the
tokenizer's pattern and merged here, pair of lowest rank first, which gives the
same ids whatever the lexicon holds.

The library encodes what this module does not take upon itself: units with
characters its pattern tables may know differently (unassigned ones).
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriatim.llm.lexicon import Lexicon, compiled
from seriatim.llm.rows import slices_of, units_of
from seriatim.llm.token_counts import byte_spelling
from seriatim.sources.shared import new_path, written

TOKENIZER = "byte_bpe_50k.json"
#: Units of the lexicon, and the longest of them in bytes: the bounds of its size.
WORDS, LONGEST = 250_000, 32
#: Counts a task holds before it hands them on, merged units a worker remembers, and bytes worked on at once.
HELD, REMEMBERED, AT_ONCE = 150_000, 150_000, 2 << 20
#: Signs of ASCII that the pattern takes together at the end of a word.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_NONE = np.iinfo(np.int32).max


def _special(found: dict) -> dict[bytes, int]:
    return {t["content"].encode(): t["id"] for t in found["added_tokens"]}


@functools.cache
def spelling_of(file: str) -> list[bytes]:
    """The bytes each id stands for."""
    with open(public_tokenizers.path(file)) as f:
        found = json.load(f)
    spelled, special = byte_spelling(), _special(found)
    words = {i: bytes(spelled[c] for c in w) for w, i in found["model"]["vocab"].items() if i not in special.values()}
    words |= {i: w for w, i in special.items()}
    return [words.get(i, b"") for i in range(1 + max(words))]


@functools.cache
def merges_of(file: str) -> Merges:
    """One for all tasks of a worker process."""
    return Merges(file)


class Merges:
    """Exact merging of units, one after another."""

    def __init__(self, file: str) -> None:
        self.file = file
        with open(public_tokenizers.path(file)) as f:
            found = json.load(f)
        model, spelled = found["model"], byte_spelling()
        vocab = model["vocab"]
        self.single = np.array([vocab[c] for c, _ in sorted(spelled.items(), key=lambda x: x[1])], np.int64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in model["merges"]], np.int64)
        order = np.argsort(keys)
        #: Merges by key, the rank of each, and what the merge of each rank makes.
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        self.special = _special(found)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")").split if self.special else None
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[bytes, bytes] = {}

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(public_tokenizers.path(self.file))

    def units(self, text: bytes) -> list[bytes]:
        """A text's units; a special string is one."""
        if not self.cut:
            return units_of(text)
        parts = self.cut(text)
        if len(parts) == 1:
            return units_of(text)
        return [u for n, p in enumerate(parts) for u in ([p] if n % 2 else units_of(p))]

    def of(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit, as 32-bit numbers."""
        out = list(map(self.known.get, units))
        new = [k for k, found in enumerate(out) if found is None]
        whole: list[int] = []
        cut: list[tuple[int, list]] = []
        for k in new:
            unit = units[k]
            if unit.isalpha() or unit[1:].isalpha() and unit[0] == 32:
                whole.append(k)  # letters of ASCII, perhaps after a blank: one part
            else:
                cut.append((k, self._parts(unit)))
        several = {p for _, parts in cut for p in parts if isinstance(p, bytes)}
        merged = self._merged([*map(units.__getitem__, whole), *several])
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for k in whole:
            out[k] = merged[units[k]]
        for k, parts in cut:
            out[k] = merged[parts[0]] if len(parts) == 1 and isinstance(parts[0], bytes) else b"".join([merged[p] if isinstance(p, bytes) else p.numbers for p in parts])
        known.update((units[k], out[k]) for k in new if len(units[k]) <= 4 * LONGEST)
        return out

    def _parts(self, unit: bytes) -> list[bytes | _Ready]:
        """What the pattern makes of a unit; where the library is to decide, the ids themselves."""
        if unit in self.special:
            return [_Ready([self.special[unit]])]
        text = unit.decode()
        # up to U+036F every character is assigned
        if max(text) > "\u036f" and any(unicodedata.category(c) == "Cn" for c in text):
            return [_Ready(self.tokenizer.encode(text, add_special_tokens=False).ids)]
        word = text[1:] if text[0] == " " else text
        if word.isalpha():
            return [unit]
        # most of the rest is a word with signs after it
        core = word.rstrip(_SIGNS)
        if core.isalpha():
            cut = len(unit) - (len(word) - len(core))
            return [unit[:cut], unit[cut:]]
        return [p.encode() for p in self.split(text)]

    def _merged(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each part: those of one length are merged side by side."""
        by_size: dict[int, list[bytes]] = {}
        out = {}
        for p in parts:
            if len(p) > 2 * LONGEST:
                out[p] = np.array(self._one(p), np.int32).tobytes()
            else:
                by_size.setdefault(len(p), []).append(p)
        for size, same in by_size.items():
            text = np.frombuffer(b"".join(same), np.uint8).reshape(-1, size)
            for rows, ids in self._rounds(self.single[text]):
                ids = ids.astype(np.int32)
                step, flat = 4 * ids.shape[1], ids.tobytes()
                out.update((same[r], flat[n * step : (n + 1) * step]) for n, r in enumerate(rows.tolist()))
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 16 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _rounds(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each round merges every row's first pair of lowest rank, so the table gets one column narrower; rows leave when done."""
        rows = np.arange(len(ids))
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(rows):
            at = rank.argmin(axis=1)
            here = np.arange(len(rows))
            best = rank[here, at]
            on = best < _NONE
            if not on.all():
                yield rows[~on], ids[~on]
                rows, ids, rank, at, best, here = rows[on], ids[on], rank[on], at[on], best[on], here[: on.sum()]
            ids[here, at] = self.made[best]
            width = ids.shape[1] - 1
            ids = ids[np.arange(width + 1) != (at + 1)[:, None]].reshape(len(rows), width)
            rank = rank[np.arange(width) != at[:, None]].reshape(len(rows), width - 1)
            for pair in (at - 1, at):
                some = np.flatnonzero((pair >= 0) & (pair < width - 1))
                p = pair[some]
                rank[some, p] = self._ranks(ids[some, p], ids[some, p + 1])
        if len(rows):
            yield rows, ids

    def _one(self, part: bytes) -> list[int]:
        """One long part, its pairs waiting in a heap."""
        ids = self.single[np.frombuffer(part, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[tuple[int, int, int, int]] = []

        def ask(a: int, b: int) -> None:
            if a >= 0 and b < n:
                key = ids[a] << 16 | ids[b]
                at = int(np.searchsorted(self.keys, key))
                if at < len(self.keys) and self.keys[at] == key:
                    heapq.heappush(waiting, (int(self.ranks[at]), a, ids[a], ids[b]))

        for k in range(n - 1):
            ask(k, k + 1)
        while waiting:
            rank, k, left, right = heapq.heappop(waiting)
            other = after[k]
            if ids[k] != left or other >= n or ids[other] != right:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[other] = int(self.made[rank]), -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
            ask(before[k], k)
            ask(k, after[k])
        return [i for i in ids if i >= 0]


class _Ready:
    """Ids that need no merging."""

    def __init__(self, ids: list[int]) -> None:
        self.numbers = np.array(ids, np.int32).tobytes()


class Encoder:
    """Ids of many texts at once."""

    def __init__(self, file: str, lexicon: Lexicon) -> None:
        self.merges, self.lexicon = merges_of(file), lexicon

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's bounds."""
        units = [self.merges.units(t) for t in texts]
        place = {u: n for n, u in enumerate(dict.fromkeys(itertools.chain.from_iterable(units)))}
        different = list(place)
        held, ids, bounds = self.lexicon.of(different)
        n = np.diff(bounds)
        begin = bounds[:-1].copy()
        missing = np.flatnonzero(~held)
        merged = self.merges.of([different[k] for k in missing.tolist()])
        n[missing] = sizes = np.fromiter(map(len, merged), np.int64, len(merged)) // 4
        begin[missing] = len(ids) + np.cumsum(sizes) - sizes
        ids = np.concatenate([ids, np.frombuffer(b"".join(merged), np.int32)])
        used = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(units)), np.int64, sum(map(len, units)))
        size = n[used]
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begin[used] - upto[:-1], size) + np.arange(upto[-1])
        return ids[at], upto[np.concatenate([[0], np.cumsum([len(u) for u in units], dtype=np.int64)])]


def _counted_of(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, seen = merges_of(file), Counter()

        def handed() -> pa.RecordBatch:
            short = [(u, n) for u, n in seen.items() if len(u) <= LONGEST and u not in merges.special]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in short], pa.binary()), pa.array([n for _, n in short], pa.int64())], names=["unit", "n"])

        for batch in batches:
            for _, texts in slices_of(batch.column("_text"), AT_ONCE):
                for text in texts:
                    seen.update(merges.units(text))
                if len(seen) > HELD:
                    yield handed()
        yield handed()

    return run


def frequent_units(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, words: int = WORDS) -> DataFrame:
    """The units of at most ``LONGEST`` bytes that occur most over all texts: ``unit`` and ``n``.

    As many of the ``words`` most frequent as there are above some count, so that
    units that occur equally often are in or out together. The count is read off
    a histogram: no more than the units themselves go to the driver.
    """
    named = docs.select(F.col(text).alias("_text"))
    found = named.mapInArrow(_counted_of(tokenizer), "unit binary, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = written(found.where("n > 1"), "units")
    tally = counts.groupBy("n").agg(F.count(F.lit(1)).alias("units"))
    upto = tally.withColumn("upto", F.sum("units").over(Window.orderBy(F.desc("n"))))
    least = upto.where(F.col("upto") <= words).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= least) if least is not None else counts.limit(0)


def share_lexicon(spark: SparkSession, units: list[bytes], tokenizer: str = TOKENIZER) -> str:
    """Compile a lexicon of some units and hand its file to all executors; the name tasks find it by."""
    merges = merges_of(tokenizer)
    words = sorted(set(units))
    numbers = compiled((u, tuple(np.frombuffer(ids, np.int32).tolist())) for u, ids in zip(words, merges.of(words)))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{new_path(spark, 'lexicon')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(numbers.tobytes()))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


@functools.lru_cache(1)
def _mapped(path: str) -> Lexicon:
    return Lexicon.mapped(path)


def encoded(
    docs: DataFrame,
    text: str = "text",
    tokenizer: str = TOKENIZER,
    words: int = WORDS,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The ``keep`` columns and the ``ids`` (array of int) of every whole text.

    As the library encodes without added special tokens, truncation and
    padding; special strings inside a text are special. A null or empty text
    has no ids. Every row is encoded by itself, so keys may be null or repeat
    and ties play no part; of columns not kept only the text is read, and a
    kept column named ``ids`` stands aside for the result. The tokenizer is
    byte-level BPE. The lexicon holds ``words`` units at most, counted over all
    texts, so what the driver compiles and each task maps is bounded.
    """
    spark = docs.sparkSession
    units = frequent_units(docs, text, tokenizer, words)
    name = share_lexicon(spark, [bytes(r["unit"]) for r in units.select("unit").collect()], tokenizer)
    rest = [c for c in dict.fromkeys(keep) if c != "ids"]
    named = docs.select(*(F.col(c).alias(f"_c{n}") for n, c in enumerate(rest)), F.col(text).alias("_text"))
    passed = named.columns[:-1]
    types = dict(named.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, _mapped(SparkFiles.get(name)))
        for batch in batches:
            for a, texts in slices_of(batch.column("_text"), AT_ONCE):
                ids, bounds = encoder.many(texts)
                arrays = [*(batch.column(c).slice(a, len(texts)) for c in passed), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*passed, "ids"])

    found = named.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in passed), "ids array<int>"]))
    return found.withColumnsRenamed(dict(zip(passed, rest)))


def _each(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """Each row's ids without null entries; None for a null row."""
    for row in column:
        values = row.values
        yield None if values is None else (values.drop_null() if values.null_count else values).to_numpy()


def decoded(encoded: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """``encoded`` with the text its ids stand for, as ``out``; special tokens stand for their strings.

    Null ids give null, none give an empty text, null entries and ids beyond
    the vocabulary nothing; bytes that make no character become the
    replacement character, as in the library. A column named ``out`` is replaced.
    """
    rest = [c for c in encoded.columns if c != out]
    named = encoded.select(*(F.col(c).alias(f"_c{n}") for n, c in enumerate(rest)), F.col(ids).alias("_ids"))
    passed, types = named.columns[:-1], dict(named.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = spelling_of(tokenizer)
        last = len(spelling) - 1

        def spelled(ids: np.ndarray) -> str:
            if ids.min(initial=0) < 0 or ids.max(initial=0) > last:
                ids = ids[(ids >= 0) & (ids <= last)]
            return b"".join(map(spelling.__getitem__, ids.tolist())).decode("utf-8", "replace")

        for batch in batches:
            sizes = batch.column("_ids").value_lengths().fill_null(0).to_numpy()
            upto, begin = np.cumsum(sizes), 0
            while begin < batch.num_rows:
                # as many rows as hold so many ids together, one at least
                before = upto[begin] - sizes[begin]
                end = max(begin + 1, int(np.searchsorted(upto, before + AT_ONCE // 4, side="right")))
                part = batch.slice(begin, end - begin)
                texts = [None if ids is None else spelled(ids) for ids in _each(part.column("_ids"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), pa.array(texts, pa.string())], names=[*passed, "_out"])
                begin = end

    found = named.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in passed), "_out string"]))
    return found.withColumnsRenamed(dict(zip([*passed, "_out"], [*rest, out])))
