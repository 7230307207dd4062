"""Quality rules with compression bands.

Zstandard's ratio (compressed by plain bytes) of a whole document and of its
fixed chunks tells repetitive text (too small) and incompressible text (too
large). Short texts compress worse, so the limits depend on the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.llm.rows import texts_of

#: Bytes from which a band holds, and its least and largest ratio. Shorter texts are not judged.
BANDS = (
    (16, 0.40, 1.80),
    (64, 0.40, 1.30),
    (128, 0.40, 1.15),
    (256, 0.30, 0.95),
    (512, 0.25, 0.85),
    (1024, 0.20, 0.75),
    (4096, 0.18, 0.72),
    (16384, 0.15, 0.70),
)
CHUNK = 1024
#: The band of a chunk, and the share of chunks outside it that rejects a document.
CHUNK_BAND = (0.20, 0.75)
CHUNK_SHARE = 0.25
LEVEL = 3

SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_OUT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, chunks_outside bigint, n_chunks bigint"
)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    width = len(ids).bit_length()
    key, packed = at[:n].copy(), 1
    for k in range(1, window):
        if (packed + 1) * width > 62:
            _, key = np.unique(key, return_inverse=True)
            packed = -(-int(key.max() + 1).bit_length() // width)
        key = (key << width) | at[k : k + n]
        packed += 1
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    found = np.flatnonzero(np.isin(key, twice))
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


class Bands:
    """Compression ratios of one text after another."""

    def __init__(self) -> None:
        self.of = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def ratio(self, text: bytes) -> float:
        return len(self.of.compress(text)) / len(text)

    def verdict(self, text: bytes) -> tuple[bool, float | None, int, int]:
        """Whether the text stays, its ratio (null where not judged), chunks outside their band, chunks."""
        band = next((b for b in reversed(BANDS) if len(text) >= b[0]), None)
        if band is None:
            return True, None, 0, 0
        ratio = self.ratio(text)
        chunks = list(range(0, len(text) - CHUNK + 1, CHUNK)) if len(text) >= 2 * CHUNK else []
        if chunks and len(text) % CHUNK:
            chunks.append(len(text) - CHUNK)  # the last one ends where the text does
        outside = sum(not CHUNK_BAND[0] <= self.ratio(text[k : k + CHUNK]) <= CHUNK_BAND[1] for k in chunks)
        kept = band[1] <= ratio <= band[2] and outside <= CHUNK_SHARE * len(chunks)
        return kept, ratio, outside, len(chunks)


def measured(text: bytes, bands: Bands) -> tuple:
    words = text.split()
    n = len(words)
    points = len(text.decode("utf-8", "replace")) if not text.isascii() else len(text)
    again = repeated_words(words)
    failed = n < 10 or 100 * again > 20 * n
    kept, ratio, outside, chunks = bands.verdict(text)
    symbols = sum(map(text.count, (SYMBOLS[k : k + 1] for k in range(len(SYMBOLS)))))
    blanks = sum(map(text.count, (_BLANKS[k : k + 1] for k in range(len(_BLANKS)))))
    return n, points - blanks, symbols, repeated_lines(text), again, failed, kept and not failed, ratio, outside, chunks


def quality(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the measures of each document's whole text, with the verdict ``kept``.

    Words are what white space (ASCII) separates; a null text has none. A text
    with fewer than ten words, or with over a fifth of its words in repeated
    five-word windows, fails before its ratios count. Chunks of ``CHUNK`` bytes
    are judged from two of them on, the last one ending with the text. Ids may be
    null or repeat; every row is judged by itself, so ties and repeated rows
    play no part; an empty table gives no rows. A kept column named like a
    measure gives way to it.
    """
    names = [x.strip().split()[0] for x in _OUT.split(",")]
    rest = [c for c in dict.fromkeys(keep) if c not in names]
    named = docs.select(*(F.col(c).alias(f"_c{n}") for n, c in enumerate(rest)), F.col(text).alias("_text"))
    passed, types = named.columns[:-1], dict(named.dtypes)
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    made = [kinds[x.strip().split()[1]] for x in _OUT.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in batches:
            rows = [measured(t, bands) for t in texts_of(batch.column("_text"))]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), *(pa.array(c, k) for c, k in zip(columns, made))], names=[*passed, *names]
            )

    found = named.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in passed), _OUT]))
    return found.withColumnsRenamed(dict(zip(passed, rest)))
