"""Segmentation lattices of many words of one length at once, in numpy.

The words of a batch are rows of bytes. At each position all of them go down the double-array trie together, one
step a byte, and those that fall out are dropped; so the work is one array operation for each position and
depth and not one Python step for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHARE = 1e-13  # lesser shares of a piece in a word are not counted
LONGEST = 32  # bytes of a word whose probabilities are safe from vanishing
WORDS = 1 << 16  # of a batch


def by_length(words: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, bytes) of the words of each length up to ``longest``."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes[(sizes > 0) & (sizes <= longest)]):
        rows = np.flatnonzero(sizes == size)
        step = max(1, (1 << 22) // int(size))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            data = np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8).reshape(-1, size)
            yield some, data


class Lattice:
    """The trie, the pieces of its nodes and their scores as arrays."""

    def __init__(self, base, check, value, gain, least: float, byte: dict[int, int]):
        self.base, self.check, self.value = (np.asarray(x, np.int32) for x in (base, check, value))
        self.gain, self.least = np.asarray(gain, np.float64), least
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        self.weight = np.exp(np.maximum(self.gain, -700.0)) * (self.value >= 0)
        self.rest = float(np.exp(least))

    def edges(self, data: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray | None]]]]:
        """For each position (end, rows, nodes) of the pieces from there; no nodes: a character without a piece."""
        n, size = data.shape
        columns = np.ascontiguousarray(data.T)
        for start in range(size):
            rows = np.flatnonzero((columns[start] & 0xC0) != 0x80)
            if not len(rows):
                continue
            first = columns[start][rows]
            width = 1 + (first >= 0xC0).astype(np.int8) + (first >= 0xE0) + (first >= 0xF0)
            live, state, wide = rows, np.zeros(len(rows), np.int32), width
            alone = np.zeros(n, bool)
            out: list[tuple[int, np.ndarray, np.ndarray | None]] = []
            for depth in range(1, size - start + 1):
                ahead = self.base[state] + columns[start + depth - 1][live]
                ok = np.flatnonzero(self.check[ahead] == state)
                if not len(ok):
                    break
                live, state, wide = live[ok], ahead[ok], wide[ok]
                hit = np.flatnonzero(self.value[state] >= 0)
                if len(hit):
                    out.append((start + depth, live[hit], state[hit]))
                    alone[live[hit[wide[hit] == depth]]] = True
            bare = np.flatnonzero(~alone[rows])
            for k in np.unique(width[bare]).tolist():
                out.append((start + k, rows[bare[width[bare] == k]], None))
            yield start, out

    def best(self, data: np.ndarray) -> list[bytes | None]:
        """The ids of the best segmentation of each word, None where it has a character of several bytes without a piece."""
        n, size = data.shape
        # One row a position, so that each is one array of all words.
        score = np.full((size + 1, n), -1e300)
        score[0] = 0.0
        piece, origin = np.full((size + 1, n), -1, np.int32), np.zeros((size + 1, n), np.int32)
        for start, out in self.edges(data):
            here = score[start]
            for end, rows, nodes in out:
                got = here[rows] + (self.least if nodes is None else self.gain[nodes])
                up = np.flatnonzero(got > score[end][rows])
                at = rows[up]
                score[end][at], origin[end][at] = got[up], start
                if nodes is not None:
                    piece[end][at] = self.value[nodes[up]]
                else:
                    piece[end][at] = self.byte[data[at, start]] if end == start + 1 else -1
        ids, at, number = np.empty((n, size), np.int32), np.full(n, size), np.zeros(n, np.int64)
        bare, rows = np.zeros(n, bool), np.arange(n)
        while len(rows):
            place = at[rows]
            number[rows] += 1
            found = piece[place, rows]
            bare[rows[found < 0]] = True
            ids[rows, size - number[rows]] = found
            at[rows] = origin[place, rows]
            rows = rows[at[rows] > 0]
        return [None if b else ids[i, size - k:].tobytes() for i, (k, b) in enumerate(zip(number.tolist(), bare.tolist()))]

    def expect(self, data: np.ndarray, times: np.ndarray, unit: int, total: np.ndarray) -> None:
        """Add to ``total`` how often each piece is expected in the words, each ``times`` over, in units."""
        n, size = data.shape
        ahead, behind = np.zeros((size + 1, n)), np.zeros((size + 1, n))
        ahead[0] = behind[size] = 1.0
        steps = []
        for start, out in self.edges(data):
            here = ahead[start]
            for end, rows, nodes in out:
                weight = self.rest if nodes is None else self.weight[nodes]
                ahead[end][rows] += here[rows] * weight
                steps.append((start, end, rows, nodes, weight))
        whole = ahead[size]
        for start, end, rows, nodes, weight in reversed(steps):
            way = weight * behind[end][rows]
            behind[start][rows] += way
            if nodes is not None:
                share = ahead[start][rows] * way / whole[rows]
                some = np.flatnonzero(share > SHARE)
                np.add.at(total, self.value[nodes[some]], np.rint(share[some] * unit).astype(np.int64) * times[rows[some]])
