"""Near-duplicate groups by SimHash, found through segment popcounts.

A fingerprint is embedded as the numbers of set bits in its 32 segments of two
bits. The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so links of ``MOST`` bits lie within that
distance of each other; of their two halves, one is within ``MOST // 2``. Each
half is a grid whose cells are its vectors: a fingerprint stands in its own
cells and, where the parity of its bits is odd, asks the cells one step away
(two vectors one step apart differ in parity). Inside a cell, pairs are cut by
the Manhattan bound and then verified bit by bit; what leaves a cell is a
spanning star of each group found there, never its pairs.

Only different fingerprints take part, so copies cost nothing. A cell that
holds more than ``CELL`` fingerprints is dealt out again by the value of each
quarter of the bits: of four quarters, one is equal within three bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.llm.components import components
from seriatim.llm.rows import texts_of
from seriatim.sources.shared import written

MOST = 3
CELL = 4096
_U = np.uint64
_SEED = 42
_EVERY_2 = _U(0x5555555555555555)


def fingerprint(text: bytes, words: int) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    size = min(words, len(parts))
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(parts[k : k + size]), _SEED) for k in range(len(parts) - size + 1)),
        _U,
        len(parts) - size + 1,
    )
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        some = hashes[k : k + (1 << 15)].byteswap().view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str, words: int) -> DataFrame:
    """``docs`` without its text, with the ``fingerprint`` of the text as a signed number."""
    rest = [c for c in docs.columns if c != text]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != text), "fingerprint bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in texts_of(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(found, pa.int64())], names=[*rest, "fingerprint"]
            )

    return docs.mapInArrow(run, schema)


def counts_of(x: np.ndarray) -> np.ndarray:
    """The set bits of each two-bit segment, two bits a segment."""
    return x - ((x >> _U(1)) & _EVERY_2)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan distance of two embedded fingerprints."""
    total = np.zeros(len(a), np.int64)
    lane, high = _U(0x3333333333333333), _U(0x8888888888888888)
    ones, twos = _U(0x1111111111111111), _U(0x2222222222222222)
    for shift in (_U(0), _U(2)):
        apart = (((a >> shift) & lane) | high) - ((b >> shift) & lane)
        up = (apart & high) >> _U(3)
        up = up | (up << _U(1)) | (up << _U(2))
        size = (apart & up) | (~apart & ~up)
        total += np.bitwise_count(size & ones).astype(np.int64) + 2 * np.bitwise_count(size & twos).astype(np.int64)
        total += np.bitwise_count(~up & ones).astype(np.int64)
    return total


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint's own cell in both halves, and the cells one step away it has to ask."""
    for batch in batches:
        prints = batch.column("fingerprint").to_numpy().view(_U)
        for part in np.array_split(prints, max(1, len(prints) // 20000)):
            counts = counts_of(part)
            cell, fp, asks = [], [], []
            for half in (0, 1):
                own = (counts >> _U(32 * half)) & _U(0xFFFFFFFF)
                mark = _U(half << 32)
                cell.append(own | mark)
                fp.append(part)
                asks.append(np.zeros(len(part), bool))
                bits = np.bitwise_count((part >> _U(32 * half)) & _U(0xFFFFFFFF))
                odd = np.flatnonzero(bits & 1)
                for segment in range(16):
                    one = _U(1 << (2 * segment))
                    value = (own[odd] >> _U(2 * segment)) & _U(3)
                    for near, there in ((own[odd] - one, value > 0), (own[odd] + one, value < 2)):
                        cell.append(near[there] | mark)
                        fp.append(part[odd[there]])
                        asks.append(np.ones(int(there.sum()), bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cell).view(np.int64)), pa.array(np.concatenate(fp).view(np.int64)), pa.array(np.concatenate(asks))],
                names=["cell", "fp", "asks"],
            )


def _stars(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least row of each row's group once the pairs are joined."""
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return label


def _linked(most: int):
    def links(key: np.ndarray, fp: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
        label = np.arange(len(key))
        counts = counts_of(fp)
        at, far = np.flatnonzero(key[1:] == key[:-1]), 1
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        while len(at):
            a, b = at, at + far
            maybe = ~(asks[a] & asks[b])
            a, b = a[maybe], b[maybe]
            near = manhattan(counts[a], counts[b]) <= most
            a, b = a[near], b[near]
            same = np.bitwise_count(fp[a] ^ fp[b]) <= most
            if same.any():
                held.append((a[same], b[same]))
                size += int(same.sum())
            if size > 1_000_000:
                label = _stars(*(np.concatenate(x) for x in zip(*held)), label)
                held, size = [], 0
            far += 1
            at = at[at + far < len(key)]
            at = at[key[at] == key[at + far]]
        if held:
            label = _stars(*(np.concatenate(x) for x in zip(*held)), label)
        row = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays(
            [pa.array(fp[label[row]].view(np.int64)), pa.array(fp[row].view(np.int64))], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def arrays() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            table = pa.Table.from_batches(held)
            cell, sub, fp = (table.column(n).to_numpy() for n in ("cell", "sub", "fp"))
            change = np.concatenate([[False], (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1])])
            return np.cumsum(change), fp.view(_U), table.column("asks").to_numpy()

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 100_000:
                continue
            key, fp, asks = arrays()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield links(key[:cut], fp[:cut], asks[:cut])
                held = [pa.Table.from_batches(held).slice(cut).combine_chunks().to_batches()[0]]
                size = len(key) - cut
        if size:
            yield links(*arrays())

    return run


def linked(prints: DataFrame, most: int = MOST, cell_limit: int = CELL) -> DataFrame:
    """Links ``a``, ``b`` that join all of the different fingerprints of ``prints`` within ``most`` bits of each other.

    Each pair within ``most`` bits (3 at most) is joined by a path of links;
    every link is such a pair's or leads to the least of its cell's group.
    """
    if not 0 <= most <= 3:
        raise ValueError("the grid holds for 3 bits at most")
    rows = prints.mapInArrow(_cells, "cell bigint, fp bigint, asks boolean")
    crowded = rows.where("not asks").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_limit)
    quarters = F.expr("transform(sequence(0, 3), q -> q * 65536L + (shiftrightunsigned(fp, 16 * q) & 65535L))")
    dealt = rows.join(crowded, "cell", "left").select(
        "cell",
        F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(quarters)).alias("sub"),
        "fp",
        "asks",
    )
    return (
        dealt.repartition("cell", "sub")
        .sortWithinPartitions("cell", "sub", "fp", "asks")
        .mapInArrow(_linked(most), "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, most: int = MOST, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id``, the ``keep`` columns, ``fingerprint`` (signed), ``group`` and ``component_id``, one row per document.

    ``component_id`` is the least ``doc_id`` reachable over links of at most
    ``most`` differing bits, ``group`` a name of the component that is never
    null. A text without words, null included, has the
    fingerprint zero and is linked like any other. Null ids stay null and are
    never a component's id unless no other id is there; repeated rows stay.
    """
    named = docs.select(*(F.col(c) for c in dict.fromkeys((doc_id, *keep))), F.col(text).alias("_text"))
    prints = written(fingerprints(named, "_text", words), "prints")
    different = written(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("_least")), "different")
    label = components(linked(different.select("fingerprint"), most), "a", "b")
    named = different.join(label.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "_least", F.coalesce("label", "fingerprint").alias("label")
    )
    least = named.groupBy("label").agg(F.min("_least").alias("component_id"))
    of_print = named.join(least, "label").select("fingerprint", F.col("label").alias("group"), "component_id")
    return prints.join(of_print, "fingerprint")
