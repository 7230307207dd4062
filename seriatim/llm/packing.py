"""Packing of documents into fixed windows by the sum-of-squares rule.

Each task packs the documents of its partition online: a document goes to the
fill level that leaves the least sum of squared counts of partly filled
windows, looked up in an array of counts by level. Documents longer than a
window give full windows first; the rest is placed. At most ``OPEN`` windows
stay open; beyond that, and at the end of the partition, open windows are run
together and cut anew, and what is then left is cut at powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.llm.rows import texts_of
from seriatim.llm.word_ids import word_ids

WINDOW = 4096
#: Open windows of one task; with their ids they are what it holds.
OPEN = 512
#: Texts whose new words are learned together.
TOGETHER = 2500
END = 2


class Packer:
    """Windows filled piece by piece; a piece is (document, start, ids as bytes, tokens of the document)."""

    def __init__(self, window: int, first_id: int) -> None:
        self.window, self.next_id = window, first_id
        # twice the number of open windows of each fill level; a full one counts as if -1/2 stood there
        self.level = np.zeros(window + 1, np.int64)
        self.level[window] = -1
        self.at: dict[int, list[list]] = {}
        self.open = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        total = sum(len(p[2]) for p in pieces) // 4
        for doc, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), tokens, self.next_id, offset, total))
            offset += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        tokens, step = len(ids) // 4, 4 * self.window
        for a in range(0, len(ids) - step + 1, step):
            self.close([(doc, a // 4, ids[a : a + step], tokens)])
        rest = len(ids) % step
        if rest:
            self.place((doc, (len(ids) - rest) // 4, ids[len(ids) - rest :], tokens), rest // 4)
        if self.open > OPEN:
            self.close_open(False)

    def place(self, piece: tuple, size: int) -> None:
        level = self.level
        below = level[1 : self.window - size + 1]
        cost = np.where(below > 0, 2 - below + level[size + 1 :], np.iinfo(np.int64).max)
        best = len(cost) - 1 - int(np.argmin(cost[::-1])) if len(cost) else -1
        if best >= 0 and cost[best] <= 1 + level[size]:
            fill = best + 1
            pieces = self.at[fill].pop()
            level[fill] -= 2
            self.open -= 1
        else:
            fill, pieces = 0, []
        pieces.append(piece)
        fill += size
        if fill == self.window:
            self.close(pieces)
        else:
            level[fill] += 2
            self.at.setdefault(fill, []).append(pieces)
            self.open += 1

    def close_open(self, last: bool) -> None:
        """Run the open windows together, fullest first, and cut them anew."""
        queue = [p for fill in sorted(self.at, reverse=True) for pieces in self.at[fill] for p in pieces]
        self.level[: self.window] = 0
        self.at, self.open = {}, 0
        left = sum(len(p[2]) for p in queue) // 4
        room = min(self.window, left if not last or left >= self.window else 1 << (left.bit_length() - 1)) if left else 0
        held: list = []
        for doc, start, ids, tokens in queue:
            while ids:
                part = ids[: 4 * room]
                held.append((doc, start, part, tokens))
                ids, start = ids[len(part) :], start + len(part) // 4
                room -= len(part) // 4
                left -= len(part) // 4
                if not room:
                    self.close(held)
                    held = []
                    if last and 0 < left < self.window:
                        room = 1 << (left.bit_length() - 1)
                    else:
                        room = self.window
        if held:
            fill = sum(len(p[2]) for p in held) // 4
            self.level[fill] += 2
            self.at[fill] = [held]
            self.open = 1


def packed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``sequence_tokens``.

    A document is its text's ids and the id 2; a null text has only that. Each
    id lies in one piece. Every sequence holds ``window`` ids or a power of
    two. ``window`` is a power of two; the tokenizer is one that drops white
    space. Ids may be null or repeat; each row is a document of its own.
    """
    named = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = dict(named.dtypes)["_id"]
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        end = np.asarray([END], "<u4").tobytes()
        id_type = pa.int64()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) if packer.rows else [[] for _ in names]
            packer.rows = []
            types = [id_type, *[pa.int64()] * (len(names) - 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            id_type = batch.column("_id").type
            ids = batch.column("_id").to_pylist()
            texts = texts_of(batch.column("_text"))
            for k in range(0, len(texts), TOGETHER):
                for i, found in zip(ids[k : k + TOGETHER], words.many(texts[k : k + TOGETHER])):
                    packer.add(i, found + end)
                if len(packer.rows) > 20000:
                    yield rows()
        packer.close_open(True)
        yield rows()

    schema = f"_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])
    return named.mapInArrow(run, schema).withColumnRenamed("_id", doc_id)
