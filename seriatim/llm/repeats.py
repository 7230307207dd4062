"""Exact removal of long repeated strings with suffix arrays.

Every text is its UTF-8 bytes. A byte goes if a string of ``length`` bytes
that covers it also starts anywhere else in the table, the same text included.

1. *Candidates.* Equal strings of ``length`` bytes hold the same least-hashed
   ``GRAM`` bytes, their anchor. Anchors seen once in the whole table rule out
   all windows they stand for; nothing that repeats is ruled out.
2. *Shards.* The windows of a repeated anchor go, as pieces of text, to the
   shard its hash names; an anchor with more than ``SHARD_ANCHORS`` places is
   dealt over several shards. In a shard, a suffix array by Larsson-Sadakane
   refinement and Kasai's common prefixes tell which windows are equal.
3. *Merging.* Only anchors dealt over several shards go on: each shard hands
   over one window of each kind, sorted, and the shards' runs are merged by
   binary search. Neighbouring windows go together under the bytes they share;
   those of an anchor with more than ``ROUTE_SHARDS`` shards go one by one
   under all of their bytes, so texts that differ at a passage's edge do not
   meet there.
4. A text's windows meet its bytes again and the covered bytes go.

Both joins with the texts read one shuffle of them. Copies of a passage meet
in steps bounded by ``SHARD_ANCHORS``, so no task takes a whole group; where
windows go one by one, a merged group has one row a shard. Rows alike in id and
text give their pieces once, with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.llm.rows import KEY, binary, buffers, keyed, texts_of

GRAM = 32
#: Anchors of one hash that one shard takes; more are dealt over several.
SHARD_ANCHORS = 2000
#: Window starts of one piece, at most.
PIECE = 1 << 16
#: Bytes looked at together while anchors are sought.
BLOCK = 1 << 16
#: Windows that the common prefixes are followed along in one go.
LANE = 512
#: Bytes gathered for one suffix array, and those it can take: a position takes BITS bits of a sort key.
GATHERED = 1_200_000
BITS = 21
ARRAY = 1 << BITS
#: Offsets from the anchor that are compared as one group when shards are merged.
STEP = 22
#: An anchor dealt over more shards hands over each window by itself.
ROUTE_SHARDS = 32

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    h, size = _BYTE[data], 1
    while size < GRAM:
        h = h[:-size] * _U(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
        size *= 2
    return _mixed(h)


def sliding(pick, x: np.ndarray, width: int) -> np.ndarray:
    """``pick`` over each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _minima(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Block by block: first position, gram hashes, and each window's least hash (0 where it leaves its text)."""
    ends = bounds[1:]
    for start in range(0, max(0, len(data) - length + 1), BLOCK):
        block = data[start : start + BLOCK + length - 1]
        h = gram_hashes(block)
        m = sliding(np.minimum, h, length - GRAM + 1)
        edge = np.zeros(len(m) + 1, np.int32)
        near = ends[(ends > start) & (ends < start + len(m) + length)]
        low = np.maximum(near - length + 1, np.concatenate([[0], near[:-1]])) - start
        np.add.at(edge, np.clip(low, 0, len(m)), 1)
        np.add.at(edge, np.clip(near - start, 0, len(m)), -1)
        m[np.cumsum(edge[:-1]) > 0] = 0
        yield start, h, m


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of every anchor of some window."""
    width = length - GRAM + 1
    found = [(np.zeros(0, _U), np.zeros(0, np.int64))]
    for start, h, m in _minima(data, bounds, length):
        pad = np.zeros(width - 1, _U)
        at = np.flatnonzero(sliding(np.maximum, np.concatenate([pad, m, pad]), width) == h)
        found.append((h[at], at + start))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows with one anchor hash: the hash, the first and the last window."""
    found = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start, _, m in _minima(data, bounds, length):
        first = np.concatenate([[True], m[1:] != m[:-1]])
        first[PIECE::PIECE] = True
        lo = np.flatnonzero(first)
        hi = np.concatenate([lo[1:], [len(m)]]) - 1
        kept = m[lo] != 0
        found.append((m[lo[kept]], lo[kept] + start, hi[kept] + start))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def suffix_array(data: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions with ``depth`` bytes of room in the order of those bytes, and each one's rank.

    Larsson-Sadakane: groups that agree so far are split by the ranks of what
    follows, so that the agreed length doubles in every round; a group of one
    is never looked at again, nor is a position whose room, the bytes up to
    the end of its piece, is less than what is compared. Positions whose
    ``depth`` bytes are alike share a rank and stand in ascending order.
    """
    n = len(data)
    if n >= ARRAY:
        raise ValueError("too long for one suffix array")
    mask = np.int64(ARRAY - 1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(5):
        key = (key << 8) | padded[k : k + n]
    key = (key << BITS) | np.arange(n)
    key.sort()
    rank, base, agreed = np.zeros(n + depth, np.int64), np.zeros(n, np.int64), 5
    while True:
        places, same = key & mask, key >> BITS
        first = np.concatenate([[True], same[1:] != same[:-1]])
        rank[places] = base + np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        if agreed == depth:
            break
        alone = first & np.concatenate([first[1:], [True]])
        further = min(2 * agreed, depth)
        places = places[~alone & (room[places] >= further)]
        if not len(places):
            break
        group = rank[places]
        key = (group << (2 * BITS)) | (rank[places + further - agreed] << BITS) | places
        key.sort()
        group = key >> (2 * BITS)
        begin = np.concatenate([[True], group[1:] != group[:-1]])
        base = group - np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))
        agreed = further
    own = np.flatnonzero(room >= depth)
    order = (rank[own] << BITS) | own
    order.sort()
    return order & mask, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, window: np.ndarray, most: int) -> np.ndarray:
    """For each flagged position, the bytes it shares with the flagged position before it in ``order``.

    Kasai: the next position shares at least one byte less, as long as the
    position after the one before is flagged too and comes no later in the
    order; else the bound starts anew.
    All stretches of flags advance in step;
    ``most`` bytes are told apart, and positions of one rank share them all.
    ``order`` holds the flagged positions, others get 0.
    """
    n = len(data)
    lo, hi = _spans(window)
    cuts = -(-(hi - lo + 1) // LANE)
    row = np.repeat(np.arange(len(lo)), cuts)
    starts = lo[row] + LANE * (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    counts = np.minimum(hi[row] - starts + 1, LANE)
    follows = np.concatenate([window[1:], [False]])
    padded = np.concatenate([data, np.zeros(most + 24, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[: n + most + 16].view(), (n + most + 8, 8), (1, 1))
    words = np.ascontiguousarray(words).view(_U).ravel()
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    long = np.argsort(-counts, kind="stable")
    base, counts = starts[long], counts[long]
    h = np.zeros(len(base), np.int64)
    for t in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -t, side="left"))
        i, h = base[:live] + t, h[:live]
        j = before[i]
        alike = (j >= 0) & (rank[i] == rank[j])
        h = np.maximum(h - 1, 0)
        todo = np.flatnonzero(~alike & (j >= 0))
        p, q, more = i[todo] + h[todo], j[todo] + h[todo], h[todo]
        while len(todo):
            x = words[p] ^ words[q]
            more += np.bitwise_count((x & (~x + _U(1))) - _U(1)).astype(np.int64) >> 3
            on = (x == 0) & (more < most)
            h[todo[~on]] = more[~on]
            todo, p, q, more = todo[on], p[on] + 8, q[on] + 8, more[on]
        h = np.where(alike, most, np.minimum(h, most))
        h[j < 0] = 0
        shared[i] = h
        h[~(follows[j] & (rank[j + 1] <= rank[i + 1]))] = 0
    return shared


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each stretch of true flags."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def equal_windows(data: np.ndarray, ends: np.ndarray, times: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the pieces ending at ``ends`` are there more than once, and which are the first of their kind.

    Each piece counts as often as ``times`` says.
    """
    piece = np.searchsorted(ends, np.arange(len(data)), side="right")
    room = ends[piece] - np.arange(len(data))
    order, rank = suffix_array(data, room, length)
    kinds = np.cumsum(common_prefixes(data, order, rank, room >= length, length)[order] < length)
    again, first = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(order):
        again[order] = np.bincount(kinds, times[piece[order]])[kinds] > 1
        first[order] = np.concatenate([[True], kinds[1:] != kinds[:-1]])
    return again, first


_ANCHOR = "_anchor bigint, _k1 bigint, _k2 bigint, _n bigint"
_PIECE = "_anchor bigint, _salt int, _salts int, _k1 bigint, _k2 bigint, _from bigint, _times bigint, _bytes binary"
_FOUND = "_route bigint, _owner bigint, _k1 bigint, _k2 bigint, _from bigint, _to bigint, _bytes binary"
_SPAN = "_k1 bigint, _k2 bigint, _from bigint, _to bigint"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.strip().split() for c in schema.split(",")))
    made = [c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, k in zip(columns, types)]
    return pa.RecordBatch.from_arrays(made, names=list(names))


def _anchors_of(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(batch.column("_text"))
            value, at = anchors(data, bounds, length)
            row = np.searchsorted(bounds, at, side="right") - 1
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])) if len(value) else np.zeros(0, np.int64)
            k1, k2 = (batch.column(k).to_numpy() for k in KEY)
            n = np.diff(np.concatenate([first, [len(value)]]))
            yield _batch(_ANCHOR, value[first].view(np.int64), k1[row[first]], k2[row[first]], n)

    return run


def _counts_of(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, _ = anchors(*buffers(batch.column("_text")), length)
            value, n = np.unique(value.view(np.int64), return_counts=True)
            yield _batch("_anchor bigint, _n bigint", value, n)

    return run


def _pieces_of(length: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            batch = _once(batch, seen)
            data, bounds = buffers(batch.column("_text"))
            value, lo, hi = runs(data, bounds, length)
            row = np.searchsorted(bounds, lo, side="right") - 1
            hits = batch.column("_hits")
            flat = hits.flatten()
            known = flat.field(0).to_numpy(zero_copy_only=False)
            total = flat.field(1).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(hits)), hits.value_lengths().to_numpy(zero_copy_only=False))
            # a text's anchors are looked up under its own row: both sides as sorted (row, hash) pairs
            order = np.lexsort((known, owner))
            known, total, owner = known[order], total[order], owner[order]
            at = _pair_search(owner, known, row, value.view(np.int64))
            kept = at >= 0
            value, lo, hi, row, total = value[kept], lo[kept], hi[kept], row[kept], total[at[kept]]
            k1, k2 = (batch.column(k).to_numpy()[row] for k in KEY)
            times = batch.column("_times").to_numpy()[row]
            salts = -(-total // limit)
            start = lo - bounds[row]
            salt = (_mixed(k1.view(_U) ^ _mixed(start.astype(_U))) % salts.astype(_U)).astype(np.int32)
            for a in range(0, len(lo), 20000):
                s = slice(a, a + 20000)
                texts = binary(data, lo[s], hi[s] + length)
                yield _batch(_PIECE, value[s].view(np.int64), salt[s], salts[s].astype(np.int32), k1[s], k2[s], start[s], times[s], texts)

    return run


def _once(batch: pa.RecordBatch, seen: set[tuple[int, int]]) -> pa.RecordBatch:
    """The batch with only the first of rows alike in id and text; their number stands in ``_times``."""
    many = np.flatnonzero(batch.column("_times").to_numpy() > 1).tolist()
    if not many:
        return batch
    k1, k2 = (batch.column(k).to_numpy() for k in KEY)
    kept = np.ones(batch.num_rows, bool)
    for n in many:
        key = (int(k1[n]), int(k2[n]))
        kept[n] = key not in seen
        seen.add(key)
    return batch.filter(pa.array(kept))


def _pair_search(owner: np.ndarray, known: np.ndarray, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where each (row, value) stands among the sorted (owner, known) pairs; -1 where it is not there."""
    out = np.full(len(row), -1, np.int64)
    if not len(owner) or not len(row):
        return out
    pairs = np.empty(len(owner), [("r", ">i8"), ("v", ">u8")])
    asked = np.empty(len(row), pairs.dtype)
    flip = np.int64(-(1 << 63))
    pairs["r"], pairs["v"] = owner, (known ^ flip).view(_U)
    asked["r"], asked["v"] = row, (value ^ flip).view(_U)
    pairs, asked = pairs.view("S16").ravel(), asked.view("S16").ravel()
    at = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
    same = (owner[at] == row) & (known[at] == value)
    out[same] = at[same]
    return out


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted on ``names``: about ``most`` bytes of text, more only for one group."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.column("_bytes").nbytes
        if size < most:
            continue
        table = pa.concat_tables(held).combine_chunks()
        keys = [table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]
        first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        bytes_at = np.concatenate([[0], np.cumsum(_sizes(table.column("_bytes")))])
        begin = 0
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if bytes_at[b] - bytes_at[begin] > most and a > begin:
                yield table.slice(begin, a - begin)
                begin = a
        last = int(first[-1])
        if last > begin and bytes_at[last] - bytes_at[begin] > most // 2:
            yield table.slice(begin, last - begin)
            begin = last
        held = [table.slice(begin)]
        size = int(bytes_at[-1] - bytes_at[begin])
    if held:
        table = pa.concat_tables(held).combine_chunks()
        keys = [table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]
        first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        bytes_at = np.concatenate([[0], np.cumsum(_sizes(table.column("_bytes")))])
        begin = 0
        for a, b in zip(first.tolist(), [*first[1:].tolist(), table.num_rows]):
            if bytes_at[b] - bytes_at[begin] > most and a > begin:
                yield table.slice(begin, a - begin)
                begin = a
        if table.num_rows > begin:
            yield table.slice(begin)


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.diff(buffers(c)[1]) for c in column.chunks])


def _split(table: pa.Table, most: int) -> Iterator[pa.Table]:
    """Parts of a table small enough for one suffix array; several only where one group outgrows it."""
    at = np.concatenate([[0], np.cumsum(_sizes(table.column("_bytes")))])
    begin = 0
    while begin < table.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield table.slice(begin, end - begin)
        begin = end


def _shard_of(length: int, route_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, ["_anchor", "_salt"], GATHERED):
            yield from _one_array(table, length, route_shards)

    return run


def _one_array(table: pa.Table, length: int, route_shards: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of pieces: windows found equal, and what goes on to be merged."""
    parts = list(_split(table, ARRAY - 1))
    for part, table in enumerate(parts):
        table = table.combine_chunks()
        k1, k2, start, anchor = (table.column(n).to_numpy() for n in ("_k1", "_k2", "_from", "_anchor"))
        salt, salts = table.column("_salt").to_numpy(), table.column("_salts").to_numpy()
        # pieces alike as a whole enter the array once, with their number
        seen: dict[bytes, int] = {}
        piece = np.array([seen.setdefault(t, len(seen)) for t in texts_of(table.column("_bytes").combine_chunks())])
        times = np.bincount(piece, table.column("_times").to_numpy()).astype(np.int64)
        shown = np.zeros(len(times), np.int64)
        shown[piece[::-1]] = np.arange(len(piece))[::-1]
        whole = b"".join(seen)
        data = np.frombuffer(whole, np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in seen])])
        again, first = equal_windows(data, bounds[1:], times, length)
        lo, hi = _spans(again)
        own = np.searchsorted(bounds, lo, side="right") - 1
        per_piece = np.bincount(own, minlength=len(times))
        n = per_piece[piece]
        row = np.repeat(np.arange(len(piece)), n)
        span = np.repeat((np.cumsum(per_piece) - per_piece)[piece], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        shift = start[row] - bounds[piece[row]]
        none = np.zeros(len(row), np.int64)
        yield _batch(_FOUND, k1[row] ^ k2[row], none, k1[row], k2[row], lo[span] + shift, hi[span] + shift, pa.nulls(len(row), pa.binary()))
        dealt = (salts[shown] > 1) | (len(parts) > 1)
        if not dealt.any():
            continue
        # one window of each kind goes on, under a hash of the bytes all windows near its offset share
        place = np.flatnonzero(first)
        own = np.searchsorted(bounds, place, side="right") - 1
        place, own = place[dealt[own]], own[dealt[own]]
        h = gram_hashes(data)
        mine = anchor[shown][np.searchsorted(bounds, np.arange(len(h)), side="right") - 1].view(_U)
        stand = np.append(np.flatnonzero(h == mine), len(data))
        mark = stand[np.searchsorted(stand, place)]
        inside = mark - place <= length - GRAM
        mark = np.where(inside, mark, place)
        group = (mark - place) // STEP
        core_lo = mark - group * STEP
        core_hi = mark - np.minimum(group * STEP + STEP - 1, length - GRAM) + length
        new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(group) != 0) | (np.diff(mark) != 0)])
        # equal windows have one anchor and so one number of shards: all of them go the same way,
        # as do those that do not hold their anchor
        single = (salts[shown][own] > route_shards) | ~inside
        new |= single
        core_lo, core_hi = np.where(single, place, core_lo), np.where(single, place + length, core_hi)
        at = np.flatnonzero(new)
        end = np.concatenate([at[1:], [len(place)]]) - 1
        route = np.array(
            [_digest(whole[a:b]) for a, b in zip(core_lo[at].tolist(), core_hi[at].tolist())], np.int64
        )
        r = shown[own[at]]
        shift = start[r] - bounds[own[at]]
        for a in range(0, len(at), 20000):
            s = slice(a, a + 20000)
            lo, hi = place[at[s]], place[end[s]]
            owner = (salt[r[s]].astype(np.int64) << 32) + part + 1
            yield _batch(_FOUND, route[s], owner, k1[r[s]], k2[r[s]], lo + shift[s], hi + shift[s], binary(data, lo, hi + length))


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _merged_of(length: int):
    """Windows found equal pass; the sorted runs of several shards are merged by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("_owner").to_numpy()
                done = pa.array(own == 0)
                ready.append(batch.filter(done).select(["_k1", "_k2", "_from", "_to"]))
                rest = batch.filter(pa.array(own != 0))
                if rest.num_rows:
                    yield rest
                else:
                    yield rest.slice(0, 0)

        ready: list[pa.RecordBatch] = []
        for table in _grouped(handed(), ["_route"], 1 << 20):
            yield from ready
            ready.clear()
            yield from _merge(table.combine_chunks(), length)
        yield from ready

    return run


def _merge(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    route = table.column("_route").to_numpy()
    edges = np.concatenate([[0], np.flatnonzero(route[1:] != route[:-1]) + 1, [len(route)]])
    owner, start = table.column("_owner").to_numpy(), table.column("_from").to_numpy()
    k1, k2 = table.column("_k1").to_numpy(), table.column("_k2").to_numpy()
    data, bounds = buffers(table.column("_bytes").combine_chunks())
    rows_out, place_out = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        owners = np.unique(owner[a:b])
        if len(owners) < 2:
            continue
        sorted_runs = []
        for one in owners.tolist():
            keys, rows, places = [], [], []
            for r in (np.flatnonzero(owner[a:b] == one) + a).tolist():
                view = np.lib.stride_tricks.sliding_window_view(data[bounds[r] : bounds[r + 1]], length)
                keys.append(np.ascontiguousarray(view).view(f"S{length}").ravel())
                rows.append(np.full(len(view), r))
                places.append(np.arange(len(view)) + start[r])
            keys, rows, places = np.concatenate(keys), np.concatenate(rows), np.concatenate(places)
            order = np.argsort(keys, kind="stable")
            sorted_runs.append((keys[order], rows[order], places[order]))
        found = [np.zeros(len(k), bool) for k, _, _ in sorted_runs]
        seen, of_run, of_place = sorted_runs[0][0], np.zeros(len(sorted_runs[0][0]), np.int64), np.arange(len(sorted_runs[0][0]))
        for n, (keys, _, _) in enumerate(sorted_runs[1:], 1):
            at = np.searchsorted(seen, keys)
            hit = (at < len(seen)) & (seen[np.minimum(at, len(seen) - 1)] == keys)
            found[n][hit] = True
            for m, p in zip(of_run[at[hit]].tolist(), of_place[at[hit]].tolist()):
                found[m][p] = True
            fresh = ~hit
            seen = np.insert(seen, at[fresh], keys[fresh])
            of_run = np.insert(of_run, at[fresh], n)
            of_place = np.insert(of_place, at[fresh], np.flatnonzero(fresh))
        for (_, rows, places), hit in zip(sorted_runs, found):
            rows_out.append(rows[hit])
            place_out.append(places[hit])
    if rows_out:
        rows, places = np.concatenate(rows_out), np.concatenate(place_out)
        order = np.lexsort((places, rows))
        rows, places = rows[order], places[order]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (places[1:] != places[:-1] + 1)])) if len(rows) else np.zeros(0, np.int64)
        last = np.concatenate([new[1:], [len(rows)]]) - 1
        if len(new):
            yield _batch(_SPAN, k1[rows[new]], k2[rows[new]], places[new], places[last])


def _cut(text: bytes, found: list | None, length: int) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes that went, and in how many stretches."""
    kept, end, removed, n = [], 0, 0, 0
    for s in sorted(found or (), key=lambda s: s["_from"]):
        lo, hi = s["_from"], s["_to"] + length
        if lo > end or not n:
            kept.append(text[end:lo])
            n, end = n + 1, lo
        removed += max(0, hi - end)
        end = max(end, hi)
    return b"".join([*kept, text[end:]]), removed, n


def _cut_of(length: int, passed: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("_text"))
            cut = [_cut(t, s, length) for t, s in zip(texts, batch.column("_spans").to_pylist())]
            columns = {
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array([c[1] for c in cut], pa.int64()),
                "n_spans": pa.array([c[2] for c in cut], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string()),
            }
            if with_text:
                columns["kept"] = pa.array([c[0].decode("utf-8", "ignore") for c in cut], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), *columns.values()], names=[*passed, *columns]
            )

    return run


def handed_over(
    docs: DataFrame, length: int = 200, shard_anchors: int = SHARD_ANCHORS, route_shards: int = ROUTE_SHARDS
) -> DataFrame:
    """What the shards found: equal windows, whose ``_owner`` is 0, and windows to be merged by ``_route``.

    ``docs`` as made by ``keyed``.
    """
    texts = docs.select("_text", *KEY)
    total = (
        texts.select("_text")
        .mapInArrow(_counts_of(length), "_anchor bigint, _n bigint")
        .groupBy("_anchor")
        .agg(F.sum("_n").alias("_n"))
        .where("_n > 1")
    )
    hits = (
        texts.mapInArrow(_anchors_of(length), _ANCHOR)
        .drop("_n")
        .join(total, "_anchor")
        .groupBy(*KEY)
        .agg(F.collect_set(F.struct("_anchor", "_n")).alias("_hits"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_times", F.expr("_rows DIV size(_hits)"))
        .drop("_rows")
    )
    pieces = (
        docs.join(hits.hint("shuffle_hash"), list(KEY))
        .select(*docs.columns, "_hits", "_times")
        .mapInArrow(_pieces_of(length, shard_anchors), _PIECE)
    )
    shards = pieces.repartition("_anchor", "_salt").sortWithinPartitions("_anchor", "_salt", *KEY, "_from")
    return shards.mapInArrow(_shard_of(length, route_shards), _FOUND)


def repeated_windows(
    docs: DataFrame, length: int = 200, shard_anchors: int = SHARD_ANCHORS, route_shards: int = ROUTE_SHARDS
) -> DataFrame:
    """Stretches of window starts (``_from`` to ``_to``) whose ``length`` bytes also start elsewhere, by row identity.

    ``docs`` as made by ``keyed``.
    """
    found = handed_over(docs, length, shard_anchors, route_shards)
    merged = found.repartition("_route").sortWithinPartitions("_route", "_owner", *KEY, "_from")
    return merged.mapInArrow(_merged_of(length), _SPAN)


def without_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 200,
    shard_anchors: int = SHARD_ANCHORS,
    with_text: bool = False,
    keep: tuple[str, ...] = (),
    route_shards: int = ROUTE_SHARDS,
) -> DataFrame:
    """One row per document: ``doc_id``, the ``keep`` columns, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    With ``with_text`` also what is left, as ``kept``; a character that lost
    some of its bytes is left out there. A null text is empty; null and
    repeated ids stand; repeated rows repeat each other; other columns of
    ``docs`` play no part. ``length`` is at least 64.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    docs = keyed(docs, doc_id, text, keep)
    spans = (
        repeated_windows(docs, length, shard_anchors, route_shards)
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("_from", "_to")).alias("_spans"))
    )
    types, passed = dict(docs.dtypes), ["_id", *(f"_c{n}" for n in range(len(keep)))]
    schema = ", ".join(f"{c} {types[c]}" for c in passed)
    schema += ", n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if with_text:
        schema += ", kept string"
    return (
        docs.join(spans.hint("shuffle_hash"), list(KEY), "left")
        .select(*docs.columns, "_spans")
        .mapInArrow(_cut_of(length, passed, with_text), schema)
        .withColumnsRenamed(dict(zip(passed, [doc_id, *keep])))
    )
