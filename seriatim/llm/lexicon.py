"""A lexicon of words as a minimal acyclic transducer that gives out ids.

Words are added in order. Ids move as far towards the start as all words
through an edge allow, and states alike in everything that follows are one, so
words share their endings as well as their beginnings. The finished automaton
is a flat file of 32-bit numbers that tasks map into memory, and all words of a
batch walk it side by side, byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Fixed value: the first number of a lexicon's file.
MAGIC = 0x4C455831


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Node:
    """A state that still changes: ids at its end (None where no word ends) and its edges, the last one open."""

    __slots__ = ("tail", "edges")

    def __init__(self) -> None:
        self.tail: tuple | None = None
        self.edges: list[list] = []

    def push(self, ids: tuple) -> None:
        """Put ids that an edge into this state gives up before all that follows."""
        if self.tail is not None:
            self.tail = ids + self.tail
        for edge in self.edges:
            edge[1] = ids + edge[1]


def compiled(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
    """The automaton of words, given in byte order and once each, with their ids: the numbers of its file."""
    known: dict[tuple, int] = {}
    path = [_Node()]
    last = b""

    def closed(node: _Node) -> int:
        return known.setdefault((node.tail, tuple(map(tuple, node.edges))), len(known))

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            n = closed(path.pop())
            path[-1].edges[-1][2] = n

    for word, ids in entries:
        if word <= last and (last or path[0].tail is not None):
            raise ValueError("words must rise")
        same = _shared(last, word)
        close(same)
        for k in range(same):
            edge = path[k].edges[-1]
            n = _shared(edge[1], ids)
            if n < len(edge[1]):
                path[k + 1].push(edge[1][n:])
                edge[1] = edge[1][:n]
            ids = ids[n:]
        for byte in word[same:]:
            path[-1].edges.append([byte, ids, None])
            path.append(_Node())
            ids = ()
        path[-1].tail = ids
        last = word
    close(0)
    start = closed(path[0])
    pool: dict[tuple, int] = {(): 0}
    edges, tails = [], np.full(len(known), -1, np.int32)
    for (tail, out), n in known.items():
        if tail is not None:
            tails[n] = pool.setdefault(tail, len(pool))
        edges += [(n << 8 | byte, to, pool.setdefault(ids, len(pool))) for byte, ids, to in out]
    table = np.array(edges, np.int64).reshape(-1, 3)
    table = table[np.argsort(table[:, 0])].astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in pool])])
    flat = np.array([i for x in pool for i in x])
    head = [MAGIC, start, len(table), len(known), len(pool), len(flat)]
    return np.concatenate([head, table.T.ravel(), tails, bounds, flat]).astype("<i4")


class Lexicon:
    """A finished automaton, over an array or a file mapped into memory."""

    def __init__(self, numbers: np.ndarray) -> None:
        magic, self.start, n_edges, n_states, n_pool, n_ids = numbers[:6].tolist()
        if magic != MAGIC:
            raise ValueError("no lexicon")
        cuts = np.cumsum([6, n_edges, n_edges, n_edges, n_states, n_pool + 1, n_ids])
        self.edges, self.to, self.out, self.tails, self.bounds, self.ids = (numbers[a:b] for a, b in zip(cuts, cuts[1:]))

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, "<i4", "r"))

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words the lexicon holds, and all their ids in a row with each word's bounds (others have none)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), self.start, np.int64)
        on = np.arange(len(words)) if len(self.edges) else np.zeros(0, np.int64)
        found = np.zeros(len(words), bool)
        who, what = [], []

        def give(some: np.ndarray, out: np.ndarray) -> None:
            full = out > 0
            who.append(some[full])
            what.append(out[full])

        if self.tails[self.start] >= 0:
            found[size == 0] = True
            give(np.flatnonzero(size == 0), np.repeat(self.tails[self.start], int((size == 0).sum())))
        on, depth = on[size[on] > 0], 0
        while len(on):
            key = state[on] << 8 | data[begin[on] + depth]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            on, at = on[hit], at[hit]
            state[on] = self.to[at]
            give(on, self.out[at])
            depth += 1
            over = size[on] == depth
            done = on[over]
            tail = self.tails[state[done]]
            found[done] = tail >= 0
            give(done[tail >= 0], tail[tail >= 0])
            on = on[~over]
        word, out = np.concatenate([np.zeros(0, np.int64), *who]), np.concatenate([np.zeros(0, np.int64), *what])
        order = np.argsort(word, kind="stable")
        word, out = word[order], out[order]
        kept = found[word]
        word, out = word[kept], out[kept]
        low = self.bounds[out].astype(np.int64)
        n = self.bounds[out + 1] - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        per_word = np.bincount(word, n, len(words)).astype(np.int64)
        return found, np.asarray(self.ids[at]), np.concatenate([[0], np.cumsum(per_word)])
