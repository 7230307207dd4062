"""Stupid-backoff language-model scores.

In relational terms: every order has a count table of n-grams, partitioned by
hash; the n-grams of the documents, exploded, are joined to it, and what the
join finds is summed for each document. A row of either side stands for many
n-grams at once: the sorted hashes of one shard of the texts that fall into one
bucket of the table, with their numbers, and the totals in the same order. One
row for each n-gram and shard would be several times as large on disk; blocks of
differences of hashes take a few bytes an n-gram. Where there are more buckets
than n-grams in a shard, a block is one n-gram, so blocks never outnumber rows.

An n-gram that counts as often as ``least`` has parts that do, so orders go one
after the other, and a shard asks for an n-gram only if the two shorter ones in
it are frequent enough; all others back off in any case. Nothing is lost by it.

An n-gram of a group of copies is counted in its shard first, so a frequent one
is a single entry of each block; nothing is hot. Shards and buckets are as many
as the texts' bytes ask for, so a task's memory does not grow with the table.

N-grams are told apart by 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.llm.rows import slices_of

ORDER, BACKOFF, LEAST = 3, 0.4, 2
_U = np.uint64
#: Words whose hashes a task remembers, and bytes of the texts of one shard.
WORDS, SHARD = 500_000, 16 << 20
#: Bytes of texts and words that are taken apart at a time, and the bytes of a word hashed together with others.
SLICE, AT_ONCE, LONG = 1 << 20, 20_000, 64
_BYTES = np.random.default_rng(42).integers(0, 2**64, LONG * 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])


class Hashes:
    """Hashes of a text's words, lower case for ASCII."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        if len(known) > WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), _U, len(words))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts in a row, lower case for ASCII, and the number of words of each.

    A word's hash combines a random number for each of its bytes and places, so
    many words are hashed at once; longer ones than ``LONG`` go one by one.
    """
    whole = b" ".join(texts).lower()
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(whole, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    data, found = np.frombuffer(whole, np.uint8), np.zeros(len(start), _U)
    for k in range(0, len(start), AT_ONCE):
        lo, size = start[k : k + AT_ONCE], (end - start)[k : k + AT_ONCE]
        short = np.flatnonzero(size <= LONG)
        lo, size = lo[short], size[short]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        if len(short):
            found[k + short] = np.bitwise_xor.reduceat(_BYTES[place * 256 + data[place + np.repeat(lo, size)]], first)
    for k in np.flatnonzero(end - start > LONG).tolist():
        found[k] = xxhash.xxh3_64_intdigest(whole[start[k] : end[k]])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return found, np.diff(np.searchsorted(start, bounds))


def grams_of(words: np.ndarray, order: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs of ``order`` words, of all or those that start at some places; the order is part of the hash."""
    n = max(0, len(words) - order + 1) if at is None else len(at)
    h = np.full(n, _U(order * 0xD1B54A32D192ED03 % 2**64))
    for k in range(order):
        h ^= words[k : k + n] if at is None else words[at + k]
        h *= _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
    return h


class Shard:
    """The words of some texts in a row."""

    def __init__(self, table: pa.Table) -> None:
        words, sizes = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for column in table.column("_text").chunks:
            for _, texts in slices_of(column, SLICE):
                found, n = word_hashes(texts)
                words.append(found)
                sizes.append(n)
        self.sizes = np.concatenate(sizes)
        self.words = np.concatenate(words)
        kind = np.int32 if len(self.sizes) < 2**31 else np.int64
        self.text = np.repeat(np.arange(len(self.sizes), dtype=kind), self.sizes)

    def inside(self, order: int) -> np.ndarray:
        """Whether a run of so many words of one text starts at a place, for those with so many words from there on."""
        n = max(0, len(self.words) - order + 1)
        return self.text[:n] == self.text[len(self.text) - n :]

    def grams(self, order: int, shorter: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the n-grams that may be frequent, as both shorter ones in them are."""
        asked = self.inside(order)
        if shorter is not None:
            often = shorter >= least
            asked &= often[: len(asked)]
            asked &= often[1 : len(asked) + 1]
        at = np.flatnonzero(asked)
        return at, grams_of(self.words, order, at)

    def counted(self, totals: list[np.ndarray], least: int) -> Iterator[np.ndarray]:
        """For each order the counts of the n-grams that start at each word, 0 where they are too rare."""
        counts = None
        for order, total in enumerate(totals, 1):
            at, h = self.grams(order, counts, least)
            by = h.argsort()
            at = at[by]
            h = h[by]
            del by
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
            n = len(h)
            del h
            counts = np.zeros(len(self.words), np.int64)
            counts[at] = np.repeat(total, np.diff(first, append=n))
            yield counts

    def scores(self, totals: list[np.ndarray], n_words: int, least: int, backoff: float) -> np.ndarray:
        """Each text's sum of the natural logarithms of its words' scores."""
        score = before = np.zeros(0)
        for order, counts in enumerate(self.counted(totals, least), 1):
            if order == 1:
                score = np.log(counts / n_words)
            else:
                # the best score of each word so far serves where its longer history is too rare
                at = self.inside(order)
                hit = counts[: len(at)] >= least
                back = np.flatnonzero(at & ~hit) + order - 1
                score[back] += np.log(backoff)
                hit = np.flatnonzero(at & hit)
                score[hit + order - 1] = np.log(counts[hit] / np.maximum(before[hit], 1))
            before = counts
        return np.bincount(self.text, score, len(self.sizes))


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte: their upper bytes are zeros and compress away."""
    return numbers.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(block: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(block, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _packed(ordered: np.ndarray) -> bytes:
    """Ascending hashes as differences."""
    return _planes(np.diff(ordered, prepend=_U(0)))


def _unpacked(block: bytes) -> np.ndarray:
    return np.cumsum(_numbers(block).view(_U), dtype=_U)


def _cuts(buckets: int) -> np.ndarray:
    return np.array([(k << 64) // buckets for k in range(1, buckets)], _U)


_ASKED = "_bucket int, _shard int, _grams binary, _counts binary, _words bigint"
_ANSWERED = "_order int, _bucket int, _shard int, _totals binary, _all bigint"


def _asked(docs: pa.Table, totals: list[np.ndarray], least: int, buckets: int) -> pa.Table:
    """The n-grams of the next order that a shard asks for, cut into buckets."""
    shard = Shard(docs)
    order = len(totals) + 1
    counts = None
    for counts in shard.counted(totals, least):
        pass
    _, h = shard.grams(order, counts, least)
    del counts
    found, times = np.unique(h, return_counts=True)
    edges = [0, *np.searchsorted(found, _cuts(buckets)).tolist(), len(found)]
    n = docs.column("_shard")[0].as_py()
    cells = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo or order == 1]
    columns = [
        pa.array([b for b, _, _ in cells], pa.int32()),
        pa.array([n] * len(cells), pa.int32()),
        pa.array([_packed(found[lo:hi]) for _, lo, hi in cells], pa.binary()),
        pa.array([_planes(times[lo:hi].astype(np.int64)) for _, lo, hi in cells], pa.binary()),
        pa.array([len(shard.words)] * len(cells), pa.int64()),
    ]
    return pa.table(columns, names=[c.split()[0] for c in _ASKED.split(", ")])


def _none() -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    return pa.table([pa.array([], k) for k in kinds], names=[c.split()[0] for c in _ASKED.split(", ")])


def _answered_of(order: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        """Totals of one bucket in each shard's order; what is too rare to count has none."""
        asked = [_unpacked(x) for x in table.column("_grams").to_pylist()]
        times = [_numbers(x) for x in table.column("_counts").to_pylist()]
        sizes = np.cumsum([len(a) for a in asked])[:-1]
        every, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, place, np.concatenate(times))
        if order > 1:
            total[total < least] = 0
        packed = [_planes(np.ascontiguousarray(t)) for t in np.split(total[place], sizes)]
        rows = table.num_rows
        # every shard sends each bucket a block of single words, so any bucket knows the number of all words
        n_words = sum(table.column("_words").to_pylist())
        columns = [pa.array([order] * rows, pa.int32()), table.column("_bucket"), table.column("_shard"), pa.array(packed, pa.binary()), pa.array([n_words] * rows, pa.int64())]
        return pa.table(columns, names=[c.split()[0] for c in _ANSWERED.split(", ")])

    return run


def _totals(answers: pa.Table) -> list[np.ndarray]:
    """A shard's answers, order by order."""
    out: dict[int, dict[int, bytes]] = {}
    for order, bucket, block in zip(*(answers.column(c).to_pylist() for c in ("_order", "_bucket", "_totals"))):
        out.setdefault(order, {})[bucket] = block
    return [np.concatenate([np.zeros(0, np.int64), *(_numbers(b) for _, b in sorted(out.get(k, {}).items()))]) for k in range(1, max(out, default=0) + 1)]


def _scored_of(order: int, least: int, backoff: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        shard = Shard(docs)
        none = np.zeros(0, np.int64)
        totals = [*_totals(answers), *[none] * order][:order]
        sums = shard.scores(totals, answers.column("_all")[0].as_py() if answers.num_rows else 1, least, backoff)
        n = shard.sizes
        empty = n == 0
        mean = sums / np.maximum(n, 1)
        return pa.table(
            [docs.column("_id"), pa.array(n, pa.int64()), pa.array(sums, pa.float64(), mask=empty), pa.array(mean, pa.float64(), mask=empty)],
            names=["_id", "n_words", "log_score", "mean_log_score"],
        )

    return run


def scored(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    least: int = LEAST,
    backoff: float = BACKOFF,
    shards: int | None = None,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_score`` and ``mean_log_score`` of every document under the table's own model.

    A word's score is the count of its n-gram by that of its history, for the
    longest n-gram up to ``order`` counted ``least`` times or more, times
    ``backoff`` for each order given up; with no history, its share of all
    words. Logarithms are natural. A text without words, null included, has
    null scores. Ids may be null or repeat; every row is scored and counted, so
    repeated rows make their n-grams frequent; other columns play no part; an
    empty table gives no rows. ``shards``, worked out from the bytes of all
    texts where left out, is the number of parts of the texts and of buckets of
    the counts: a task holds one of either.
    """
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(text)).alias("size")).first()["size"]
        shards = max(1, -(-(size or 0) // SHARD))
    named = docs.select(
        F.col(doc_id).alias("_id"),
        F.col(text).alias("_text"),
        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(shards)).cast("int").alias("_shard"),
    )
    kind = dict(named.dtypes)["_id"]
    parts = named.groupBy("_shard")
    answers: DataFrame | None = None
    for k in range(1, order + 1):
        if answers is None:
            asked = parts.applyInArrow(lambda docs: _asked(docs, [], least, shards), _ASKED)
        else:
            asked = parts.cogroup(answers.groupBy("_shard")).applyInArrow(
                lambda docs, known: _asked(docs, _totals(known), least, shards) if docs.num_rows else _none(), _ASKED
            )
        found = asked.groupBy("_bucket").applyInArrow(_answered_of(k, least), _ANSWERED)
        answers = found if answers is None else answers.unionByName(found)
    return (
        parts.cogroup(answers.groupBy("_shard"))
        .applyInArrow(_scored_of(order, least, backoff), f"_id {kind}, n_words bigint, log_score double, mean_log_score double")
        .withColumnRenamed("_id", doc_id)
    )
