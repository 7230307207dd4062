"""Language identification with bit-sliced Bloom filters of n-grams.

A gram is four bytes of the lower-cased text with everything ASCII that is no
letter turned to a blank, kept whole as a 32-bit number. A language contains a
gram if the learning rows show, with confidence, that at least ``LEAST_RATE`` of
its grams are that one. The filter's slots hold one bit a language, so that one
look-up of a gram gives all languages that contain it. A text's hits by
language, less the share that false positives bring, decide.

Learning counts all grams of all learning rows. What leaves Spark are the grams
languages contain: rates add up to one, so these are at most ``1 / LEAST_RATE``
a language, whatever the input, and the filter's size follows their number.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.llm.rows import texts_of
from seriatim.sources.shared import written

#: Slots of the filter for each gram in it, look-ups of a gram.
ROOM, LOOKUPS = 8, 3
#: The share of a language's grams that one must reach, and the standard deviations that chance is given.
LEAST_RATE, SURE = 1e-5, 1.64
#: Grams a task holds before it counts them.
HELD = 4_000_000

_U = np.uint64
_FOLD = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """The text's grams, those of one blank run aside."""
    data = text.lower().encode().translate(_FOLD)
    data = np.frombuffer(b" " + b" ".join(data.split()) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.uint32)
    return data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in set(text))


def _slots(values: np.ndarray, size: int) -> np.ndarray:
    """The places of each gram in a filter of so many slots, a column a look-up."""
    x = values.astype(_U) + _U(1)
    out = []
    for k in range(LOOKUPS):
        y = (x * _U(0x9E3779B97F4A7C15) + _U((k + 1) * 0xD1B54A32D192ED03 % 2**64)) * _U(0xBF58476D1CE4E5B9)
        out.append(((y ^ (y >> _U(29))) >> _U(8)) % _U(size))
    return np.stack(out, axis=1).astype(np.int64)


@dataclass
class Model:
    """Languages, 64 to a plane of the filter, and each one's rate of false positives."""

    names: list[str]
    planes: list[np.ndarray]
    false: np.ndarray

    @classmethod
    def of(cls, names: list[str], gram: np.ndarray, lang: np.ndarray) -> Model:
        """The filter of pairs of a gram and the number of a language that contains it."""
        slots = 1 << max(10, (ROOM * len(np.unique(gram)) - 1).bit_length())
        planes = [np.zeros(slots, _U) for _ in range(-(-len(names) // 64))]
        at = _slots(gram, slots)
        for p, plane in enumerate(planes):
            mine = lang // 64 == p
            bit = _U(1) << (lang[mine] % 64).astype(_U)
            for k in range(LOOKUPS):
                np.bitwise_or.at(plane, at[mine, k], bit)
        size = np.bincount(lang, minlength=len(names))
        return cls(names, planes, (1 - np.exp(-LOOKUPS * size / slots)) ** LOOKUPS)

    def containing(self, values: np.ndarray) -> list[np.ndarray]:
        """For each plane the bits of the languages that contain each gram."""
        out = []
        for plane in self.planes:
            at = _slots(values, len(plane))
            out.append(np.bitwise_and.reduce(plane[at], axis=1))
        return out

    def scores(self, text: str) -> np.ndarray:
        """Corrected hits by language."""
        values = grams(text)
        hits = np.zeros(len(self.names))
        for start in range(0, len(values), 1 << 16):
            for p, mask in enumerate(self.containing(values[start : start + (1 << 16)])):
                for n in range(64 * p, min(64 * p + 64, len(self.names))):
                    hits[n] += int(np.count_nonzero(mask & _U(1 << (n - 64 * p))))
        return np.maximum(0, hits - len(values) * self.false) / (1 - self.false)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text) or not self.names:
            return "und", 0.0
        scores = self.scores(text)
        total = scores.sum()
        best = int(np.argmax(scores))
        return self.names[best], float(scores[best] / total) if total > 0 else 0.0


def learned(docs: DataFrame, text: str, lang: str, learns: Column) -> Model:
    """The model of the rows where ``learns`` holds and text and language are known."""
    spark = docs.sparkSession
    rows = docs.where(learns).select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for one, values in held.items():
                gram, n = np.unique(np.concatenate(values), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for t, one in zip(texts_of(batch.column("_text")), batch.column("_lang").to_pylist()):
                values = grams(t.decode())
                held.setdefault(one, []).append(values)
                size += len(values)
                if size > HELD:
                    yield from counted()
                    size = 0
        yield from counted()

    counted = rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = written(counted, "grams")
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    names = sorted(r.lang for r in total.select("lang").collect())
    # the rate that the count is sure to stand for
    sure = F.col("n") - SURE * F.sqrt("n")
    kept = counted.join(total, "lang").where((sure > 0) & (sure >= LEAST_RATE * F.col("total"))).select("lang", "gram").toArrow()
    number = {name: n for n, name in enumerate(names)}
    lang = kept.column("lang").combine_chunks().dictionary_encode()
    of = np.array([number[x] for x in lang.dictionary.to_pylist()], np.int64)
    return Model.of(names, kept.column("gram").to_numpy(), of[lang.indices.to_numpy(zero_copy_only=False)] if len(of) else np.zeros(0, np.int64))


def identified(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5
) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document.

    Rows with ``crc32`` of the id's text divisible by ``folds`` are held out of
    learning; so are rows without text or language. A null id counts as the
    empty text. ``lang_pred`` is ``und`` for a null text or one without
    letters, or where nothing could be learned. ``score`` is the winner's
    share of all corrected hits. Repeated rows stand; other columns play no
    part.
    """
    spark = docs.sparkSession
    out = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0
    model = spark.sparkContext.broadcast(learned(docs, text, lang, ~out))
    named = docs.select(F.col(doc_id).alias("_id"), out.alias("held_out"), F.col(text).alias("_text"))
    kind = dict(named.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t.decode()) for t in texts_of(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["_id", "held_out", "lang_pred", "score"],
            )

    schema = f"_id {kind}, held_out boolean, lang_pred string, score double"
    return named.mapInArrow(run, schema).withColumnRenamed("_id", doc_id)
