"""Rows, texts and slices shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words.
BLANK = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANK}]+"

#: Blanks beyond ASCII in UTF-8, and all blanks as characters.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(rb" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]")
_WIDE_UNIT = re.compile(f" ?[^{_BLANKS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]")

#: Two independent 64-bit hashes of a row's id and text: a row's identity where ids may be null or repeat.
KEY = ("_k1", "_k2")


def keyed(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``_id``, ``_text``, the row's identity ``_k1``, ``_k2`` and the kept columns as ``_c0``, ``_c1``, ...

    Rows alike in id and text share an identity.
    """
    i, t = F.col(doc_id), F.col(text)
    return docs.select(
        i.alias("_id"),
        t.alias("_text"),
        F.xxhash64(i, t).alias("_k1"),
        F.xxhash64(F.lit(7), t, i).alias("_k2"),
        *(F.col(c).alias(f"_c{n}") for n, c in enumerate(keep)),
    )


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a batch in a row, and each text's bounds (nulls are empty)."""
    texts = pa.array(texts).fill_null("") if texts.null_count else texts
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def texts_of(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes; null is empty."""
    data, bounds = buffers(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def units_of(text: bytes) -> list[bytes]:
    """The parts of a text that byte-level tokenizers treat by themselves: non-blanks after one blank, or blanks.

    Their pattern cuts before the last blank of a run, which goes with what
    follows if it is a space, and at every other blank.
    """
    if not text.isascii() and _WIDE.search(text):
        return [u.encode() for u in _WIDE_UNIT.findall(text.decode())]
    return _UNIT.findall(text)


def slices_of(column: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch (null is empty) in rows that hold at most ``most`` bytes together, with the first one's number.

    More only for one long text; what is not yet asked for is not copied.
    """
    data, bounds = buffers(column)
    begin, n = 0, len(bounds) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + most, side="right")) - 1)
        whole = data[bounds[begin] : bounds[end]].tobytes()
        at = (bounds[begin : end + 1] - bounds[begin]).tolist()
        yield begin, [whole[a:b] for a, b in zip(at, at[1:])]
        begin = end


def binary(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """A binary array of the slices ``data[lo:hi]``."""
    size = hi - lo
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(lo - bounds[:-1], size) + np.arange(bounds[-1])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lo), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[at])]
    ).cast(pa.binary())


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def utf8_crc32(text: Column) -> Column:
    """Unsigned CRC32 of the text in UTF-8; null is empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
