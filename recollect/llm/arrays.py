"""Numpy helpers for work inside tasks: words of Arrow text batches as 64-bit hashes, hashed lookup
tables, ragged gathers and byte-pair merging over many short words at once."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LANE_MASK = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 8)] + [(1 << 64) - 1], dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0x9E3779B97F4A7C15)
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def hash_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte segment; ``data`` must have 8 spare bytes at its end."""
    size = ends - starts
    h = mix(size.astype(U) + U(seed * 0x51ED27 + 1))
    lanes = np.lib.stride_tricks.as_strided(data[: max(len(data) - 7, 0)].view(np.uint8), (max(len(data) - 7, 0), 8), (1, 1))
    left, at, who = size, starts, None
    while len(at):
        word = np.ascontiguousarray(lanes[at]).view(U).ravel() & LANE_MASK[np.minimum(left, 8)]
        if who is None:
            h = mix(h ^ word)
        else:
            h[who] = mix(h[who] ^ word)
        more = np.flatnonzero(left > 8)
        who = more if who is None else who[more]
        left, at = left[more] - 8, at[more] + 8
    return h


def chunks(column: pa.Array, most: int, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows holding about ``most`` bytes; each row's text
    is followed by one newline, the run by 8 zero bytes. A longer text is a run of its own."""
    column = pc.fill_null(column, "")
    size = np.asarray(pc.binary_length(column)).astype(np.int64) + 1
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
        part = column.slice(first, last - first)
        if lower:
            part = pc.ascii_lower(part)
        data = np.frombuffer(b"\n".join([*(x.as_buffer() if x.as_buffer() is not None else b"" for x in part.cast(pa.large_binary())), b"\0" * 8]), dtype=np.uint8)
        yield first, data, np.concatenate(([0], ends[first:last] - base))
        first = last


def word_bounds(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of other than ASCII white space in ``data[:size]`` (ends with white space)."""
    space = SPACE[data[:size]]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    return edge[0::2], edge[1::2]


def spread(offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i]+sizes[i]-1 of all i, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(offsets - (ends - sizes), sizes)


class HashIndex:
    """Open-addressing table from 64-bit keys to their position, built once, looked up in bulk."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.keys = np.zeros(1 << self.bits, dtype=U)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.probes = 1
        left, at = np.arange(len(keys)), self._home(keys)
        keys = keys.astype(U)
        while len(left):
            free = self.slots[at] < 0
            _, firsts = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[firsts]
            self.keys[at[took]] = keys[left[took]]
            self.slots[at[took]] = left[took]
            rest = np.ones(len(left), dtype=bool)
            rest[took] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += len(left) > 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of ``keys``, -1 where absent."""
        keys = keys.astype(U, copy=False)
        at = self._home(keys)
        out = self.slots[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        hop = at[wrong]
        while len(wrong):
            hop = (hop + 1) & ((1 << self.bits) - 1)
            got = self.slots[hop]
            out[wrong] = got
            on = (got >= 0) & (self.keys[hop] != keys[wrong])
            wrong, hop = wrong[on], hop[on]
        return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What np.unique gives with return_index and return_inverse, for hashes: one sort of the top bits
    and the place together; where two different hashes share these bits, np.unique itself."""
    bits = max(1, len(keys).bit_length())
    low = U((1 << bits) - 1)
    packed = np.sort((keys & ~low) | np.arange(len(keys), dtype=U))
    order = (packed & low).astype(np.int64)
    sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    if (new[1:] & ((packed[1:] ^ packed[:-1]) <= low)).any():
        return np.unique(keys, return_index=True, return_inverse=True)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return sorted_keys[new], order[new], back


class SegmentCache:
    """What was computed for each distinct segment, by hash: a ragged row of ids. When it holds
    ``most`` segments, those not met again since they were put in or kept are dropped, so a worker's
    memory stays bounded; results don't depend on it."""

    def __init__(self, most: int = 400_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=U)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int32)
        self.again = np.zeros(0, dtype=bool)
        self.flat = np.zeros(0, dtype=np.int32)

    def shrink(self) -> None:
        keep = np.flatnonzero(self.again)
        if len(keep) > self.most // 2:
            return self.clear()
        size = self.size[keep]
        self.flat = self.flat[spread(self.at[keep], size.astype(np.int64))]
        self.keys, self.size, self.again = self.keys[keep], size, np.zeros(len(keep), dtype=bool)
        self.at = np.cumsum(size, dtype=np.int64) - size

    def rows(self, keys: np.ndarray, compute: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, size, flat) of each key; ``compute(first)`` gives (flat ids, sizes) of the new
        segments, by the index at which each first occurs."""
        found, first, back = distinct(keys)
        if len(self.keys) + len(found) > self.most:
            self.shrink()
        pos = np.searchsorted(self.keys, found)
        known = pos < len(self.keys)
        known[known] = self.keys[pos[known]] == found[known]
        self.again[pos[known]] = True
        if not known.all():
            new = np.flatnonzero(~known)
            flat, size = compute(first[new])
            at = len(self.flat) + np.cumsum(size) - size
            where = pos[new]
            self.flat = np.concatenate((self.flat, flat.astype(np.int32)))
            self.keys = np.insert(self.keys, where, found[new])
            self.at = np.insert(self.at, where, at)
            self.size = np.insert(self.size, where, size.astype(np.int32))
            self.again = np.insert(self.again, where, False)
            pos = np.searchsorted(self.keys, found)
        return self.at[pos][back], self.size[pos][back], self.flat


class Merges:
    """Byte-pair merges: (left id, right id) -> (rank, merged id). Lower ranks first, then leftmost."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(U) << U(32)) | right.astype(U)
        self.index = HashIndex(keys)
        self.rank, self.merged = rank.astype(np.int32), merged.astype(np.int32)
        self.pairs = None
        self._raw = (left, right)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.index.find((left.astype(np.int64).astype(U) << U(32)) | right.astype(np.int64).astype(U))
        ok = at >= 0
        return np.where(ok, self.rank[at], self.NONE), np.where(ok, self.merged[at], -1)

    def one(self, left: int, right: int) -> tuple[int, int] | None:
        if self.pairs is None:
            self.pairs = {(int(a), int(b)): (int(r), int(m)) for a, b, r, m in zip(*self._raw, self.rank, self.merged, strict=True)}
        return self.pairs.get((left, right))

    def agenda(self, symbols: list[int], skip: Callable[[int, int, int], bool] | None = None) -> list[int]:
        """One word by a priority queue of candidate merges; ``skip(position, left, right)`` drops a
        candidate when it comes up. Time grows as n log n, so any length will do."""
        ids, n = list(symbols), len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (got := self.one(ids[i], ids[j])):
                heapq.heappush(queue, (got[0], i, ids[i], ids[j], got[1]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, a, b, m = heapq.heappop(queue)
            if ids[i] != a or (j := after[i]) < 0 or ids[j] != b or (skip and skip(i, a, b)):
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def many(self, flat: np.ndarray, sizes: np.ndarray, skip: Callable | None = None, longest: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Words as a ragged array of symbols -> ragged merged symbols. ``skip(row, position, left,
        right)`` takes arrays and drops candidates when they come up, so it sees the merges that are done
        and those it stops; words over ``longest`` symbols take the agenda one by one."""
        ends = np.cumsum(sizes)
        offs = ends - sizes
        order = np.argsort(sizes, kind="stable")
        got: list[np.ndarray | None] = [None] * 0
        out_flat: list[np.ndarray] = []
        out_rows: list[np.ndarray] = []
        out_size: list[np.ndarray] = []
        i = 0
        while i < len(order):
            wide = int(sizes[order[i]])
            if wide > longest:
                r = int(order[i])
                one = self.agenda(flat[offs[r] : ends[r]].tolist(), skip and (lambda p, a, b, r=r: bool(skip(np.array([r]), np.array([p]), np.array([a]), np.array([b]))[0])))
                out_rows.append(order[i : i + 1])
                out_flat.append(np.array(one, dtype=np.int32))
                out_size.append(np.array([len(one)]))
                i += 1
                continue
            top = max(wide, min(longest, wide + max(2, wide // 4)))
            j = min(int(np.searchsorted(sizes[order], top, "right")), i + max(1, 400_000 // max(top, 1)))
            rows = order[i:j]
            ids, n = self._block(flat, offs[rows], sizes[rows], rows, skip)
            out_rows.append(rows)
            out_flat.append(ids)
            out_size.append(n)
            i = j
        if not out_rows:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        del got
        rows, size, ids = np.concatenate(out_rows), np.concatenate(out_size), np.concatenate(out_flat)
        at = np.cumsum(size) - size
        back = np.empty(len(rows), dtype=np.int64)
        back[rows] = np.arange(len(rows))
        return ids[spread(at[back], size[back])], size[back]

    def _block(self, flat, offs, sizes, rows, skip):
        wide = int(sizes.max()) if len(sizes) else 0
        ids = np.full((len(rows), wide + 1), -1, dtype=np.int32)
        col = np.arange(wide)
        if wide:
            full = col[None, :] < sizes[:, None]
            ids[:, :wide][full] = flat[spread(offs, sizes)]
        spot = np.broadcast_to(np.arange(wide + 1, dtype=np.int32), ids.shape).copy()  # where each symbol began
        rank = np.full(ids.shape, self.NONE, dtype=np.int32)
        if wide > 1:
            r, c = np.nonzero(ids[:, 1:wide] >= 0)
            rank[r, c] = self.look(ids[r, c], ids[r, c + 1])[0]
        live = np.arange(len(rows))
        while wide > 1 and len(live):
            sub = rank[live]
            c = sub.argmin(axis=1)
            on = sub[np.arange(len(live)), c] != self.NONE
            live, c = live[on], c[on]
            if not len(live):
                break
            go = live
            if skip is not None:
                out = skip(rows[go], spot[go, c], ids[go, c], ids[go, c + 1])
                rank[go[out], c[out]] = self.NONE
                go, c = go[~out], c[~out]
                if not len(go):
                    continue
            _, merged = self.look(ids[go, c], ids[go, c + 1])
            src = np.arange(wide + 1)[None, :] + (np.arange(wide + 1)[None, :] > c[:, None])
            src = np.minimum(src, wide)
            ids[go] = np.take_along_axis(ids[go], src, 1)
            spot[go] = np.take_along_axis(spot[go], src, 1)
            rank[go] = np.take_along_axis(rank[go], src, 1)
            ids[go, c] = merged
            for left in (c - 1, c):
                ok = left >= 0
                rr, cc = go[ok], left[ok]
                right = ids[rr, cc + 1]
                new = np.full(len(rr), self.NONE, dtype=np.int32)
                has = right >= 0
                new[has] = self.look(ids[rr[has], cc[has]], right[has])[0]
                rank[rr, cc] = new
        keep = ids >= 0
        return ids[keep], keep.sum(axis=1)
