"""Merging of adjacent symbols by rank, many words at once.

The agenda of a word holds its adjacent pairs that may merge, by rank. Words of usual length are merged side by side:
in each round every word takes the best pair off its agenda (of equals the leftmost), merges it, and enters the two
new neighbours. A word lies in a column of a small matrix, so a round is a few array operations for thousands of words,
and a word leaves when its agenda is empty.

A long word (a text without a space, say) has an agenda of its own, a heap, so that its cost grows as n log n.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

_SHIFT = 24
_NONE = np.int32(np.iinfo(np.int32).max)
LONG = 48  # symbols from which a word counts as long
ABREAST = 1 << 13  # words that are merged side by side


class MergeTable:
    def __init__(self, pairs: list[tuple[int, int, int, int]]):
        """pairs: (left symbol, right symbol, rank, merged symbol), symbols below 2**24."""
        left, right, rank, merged = np.array(pairs, np.int64).reshape(-1, 4).T
        keys = (left << _SHIFT) | right
        order = np.argsort(keys)
        self.keys = keys[order]
        # Row -1 stands for no pair.
        self.ranks = np.append(rank[order], _NONE).astype(np.int32)
        self.merged = np.append(merged[order], -1)
        # Open addressing: a pair lies in the first free place from where its hash points.
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.at = np.full(1 << self.bits, -1, np.int64)
        todo, place = np.arange(len(keys)), self._hash(self.keys)
        self.probes = 0
        while len(todo):
            free = self.at[place] < 0
            self.at[place[free]] = todo[free]
            lost = self.at[place] != todo
            todo, place = todo[lost], (place[lost] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.slot_keys = np.where(self.at >= 0, self.keys[self.at], -1) if len(keys) else np.full(1 << self.bits, -1)
        self.table = dict(zip(self.keys.tolist(), ((self.ranks[:-1].astype(np.int64) << _SHIFT) | self.merged[:-1]).tolist(), strict=True))  # rank and symbol in one

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair, -1 where there is none. Negative symbols have no pairs."""
        keys = np.where((left >= 0) & (right >= 0), (left << _SHIFT) | right, np.int64(-2))
        place = self._hash(keys)
        there = self.slot_keys[place]
        hit = there == keys
        found = np.where(hit, self.at[place], -1)
        open_ = np.flatnonzero(~hit & (there != -1) & (keys >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            here = self.slot_keys[place[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = self.at[place[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
        return found

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of consecutive words of these sizes (over 0), merged as far as they go; and the words' new sizes."""
        sizes = np.asarray(sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        out, left = symbols.astype(np.int64), sizes.copy()  # a merged word lies at its start
        order = np.argsort(sizes, kind="stable")
        n_long = int((sizes >= LONG).sum())
        usual, long = order[: len(order) - n_long], order[len(order) - n_long :]
        at = 0
        while at < len(usual):
            room = max(1, min(ABREAST, (ABREAST * 16) // int(sizes[usual[at]])))
            part = usual[at : at + room]
            part = part[: max(1, int(np.searchsorted(sizes[part], sizes[part[0]] + 2, side="right")))]
            at += len(part)
            if sizes[part[-1]] > 1:
                self._abreast(out, starts[part], sizes[part], left, part)
        for k in long.tolist():
            merged = self._by_heap(out[starts[k] : starts[k] + sizes[k]].tolist())
            out[starts[k] : starts[k] + len(merged)], left[k] = merged, len(merged)
        keep = np.arange(len(out)) - np.repeat(starts, sizes) < np.repeat(left, sizes)
        return out[keep], left

    def _abreast(self, out: np.ndarray, starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, names: np.ndarray) -> None:
        """Merges words of about the same size in place: column j of each matrix is word j, row i its i-th symbol."""
        n, rows = len(sizes), int(sizes[-1])
        row = np.arange(rows)[:, None]
        inside = row < sizes
        symbol = np.ascontiguousarray(np.where(inside, out[np.minimum(starts + row, len(out) - 1)], -1), np.int32)
        pair = np.full((rows, n), -1, np.int32)  # of the symbol and the one that follows it
        pair[:-1] = self.find(symbol[:-1].ravel().astype(np.int64), symbol[1:].ravel()).reshape(rows - 1, n)
        rank = np.ascontiguousarray(self.ranks[pair])
        after = np.ascontiguousarray(np.where(row + 1 < sizes, row + 1, rows), np.int32)  # row of the next symbol, ``rows`` for none
        ahead = np.broadcast_to((row - 1).astype(np.int32), (rows, n)).copy()  # row of the symbol before, -1 for none
        all_out = []
        while n:
            best = rank.min(axis=0)
            going = best != _NONE
            live = int(going.sum())
            if live < n - n // 3 or not live:
                done = np.flatnonzero(~going)
                all_out.append((names[done], starts[done], symbol[:, done]))
                live = np.flatnonzero(going)
                names, starts, best = names[live], starts[live], best[live]
                symbol, pair, rank, after, ahead = (np.ascontiguousarray(x[:, live]) for x in (symbol, pair, rank, after, ahead))
                n = len(live)
                if not n:
                    break
                column = np.arange(n)
            else:
                column = np.flatnonzero(going)
            at = np.zeros(n, np.int32)
            for i in range(rows - 2, 0, -1):
                at[rank[i] == best] = i
            at[rank[0] == best] = 0
            at = at[column] * np.int32(n) + column  # places in the matrices, row by row
            symbols, pairs, ranks, nexts, befores = (x.reshape(-1) for x in (symbol, pair, rank, after, ahead))
            gone = nexts[at] * np.int64(n) + column
            own = self.merged[pairs[at]]
            symbols[at] = own
            symbols[gone] = -2
            ranks[gone] = _NONE
            beyond = nexts[gone]
            nexts[at] = beyond
            more = np.flatnonzero(beyond < rows)
            beyond = beyond[more] * np.int64(n) + column[more]
            befores[beyond] = (at[more] - column[more]) // n
            before = befores[at]
            has = np.flatnonzero(before >= 0)
            before = before[has] * np.int64(n) + column[has]
            found = self.find(np.concatenate([own[more], symbols[before].astype(np.int64)]), np.concatenate([symbols[beyond], own[has]]))
            right = np.full(len(at), -1, np.int64)
            right[more] = found[: len(more)]
            pairs[at], ranks[at] = right, self.ranks[right]
            pairs[before], ranks[before] = found[len(more) :], self.ranks[found[len(more) :]]
        for who, first, symbol in all_out:
            if len(who):
                kept = (symbol != -2) & (np.arange(rows)[:, None] < left[who])
                count = kept.sum(axis=0)
                to = np.cumsum(kept, axis=0) - 1 + first
                out[to[kept]] = symbol[kept]
                left[who] = count

    def _by_heap(self, given: list[int]) -> list[int]:
        """merge() for one word. The heap has rank and place of each pair that may merge, and pairs that are gone since."""
        n, pair_at, low = len(given), self.table.get, (1 << _SHIFT) - 1
        symbols = [s if s >= 0 else low for s in given]  # no pair has that symbol
        unknown = {i: s for i, s in enumerate(given) if s < 0}
        heap = []
        for i in range(n - 1):
            if (p := pair_at((symbols[i] << _SHIFT) | symbols[i + 1])) is not None:
                heap.append((p >> _SHIFT << 40) | i)
        heapify(heap)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(low)  # stands behind the last symbol
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            p = pair_at((symbols[i] << _SHIFT) | symbols[j])
            if p is None or p >> _SHIFT != top >> 40:
                continue  # one of the two has merged with another
            symbols[i] = own = p & low
            k = after[i] = after[j]
            symbols[j] = low
            if k < n:
                ahead[k] = i
                if (p := pair_at((own << _SHIFT) | symbols[k])) is not None:
                    heappush(heap, (p >> _SHIFT << 40) | i)
            h = ahead[i]
            if h >= 0 and (p := pair_at((symbols[h] << _SHIFT) | own)) is not None:
                heappush(heap, (p >> _SHIFT << 40) | h)
        out, i = [], 0
        while i < n:
            out.append(unknown.get(i, symbols[i]) if unknown else symbols[i])
            i = after[i]
        return out
