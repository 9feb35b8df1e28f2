"""Cuckoo filter on numpy arrays: short fingerprints, two candidate buckets, deletion, growth."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_LOAD = 0.85
MAX_ROUNDS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)  # a fixed odd multiplier


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The top 16 bits, 0 replaced by 1: a slot with 0 is free."""
    fp = (hashes >> np.uint64(48)).astype(np.uint16)
    fp[fp == 0] = 1
    return fp


class CuckooTable:
    """One table of a fixed number of buckets (a power of two)."""

    def __init__(self, buckets: int) -> None:
        if buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.mask = np.int64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.count = 0
        self.homeless: list[tuple[int, int]] = []  # (bucket, fingerprint) left when kicking ended
        self._random = np.random.default_rng(buckets)

    @property
    def room(self) -> int:
        return 0 if self.homeless else int(self.table.size * MAX_LOAD) - self.count

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(0xFFFFFFFFFFFF)).astype(np.int64) & self.mask

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ ((fp.astype(np.uint64) * _MIX >> np.uint64(20)).astype(np.int64) & self.mask)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        fp = fingerprints(hashes)
        a = self._first(hashes)
        b = self._other(a, fp)
        found = (self.table[a] == fp[:, None]).any(axis=1) | (self.table[b] == fp[:, None]).any(axis=1)
        for bucket, lost in self.homeless:
            found |= (fp == lost) & ((a == bucket) | (b == bucket))
        return found

    def _place(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Put each fingerprint in a free slot of its bucket; True where there was one."""
        order = np.argsort(bucket, kind="stable")
        sorted_buckets = bucket[order]
        starts = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        free = self.table[sorted_buckets] == 0
        fits = rank < free.sum(axis=1)
        at = np.flatnonzero(fits)
        # the rank-th free slot of the bucket
        slot = (np.cumsum(free[at], axis=1) == (rank[at] + 1)[:, None]).argmax(axis=1)
        self.table[sorted_buckets[at], slot] = fp[order[at]]
        placed = np.zeros(len(bucket), dtype=bool)
        placed[order[at]] = True
        return placed

    def insert(self, hashes: np.ndarray) -> None:
        """Insert distinct keys; the caller keeps within `room`."""
        self.count += len(hashes)
        fp = fingerprints(hashes)
        bucket = self._first(hashes)
        for step in range(MAX_ROUNDS):
            if not len(fp):
                return
            placed = self._place(bucket, fp)
            bucket, fp = bucket[~placed], fp[~placed]
            if not len(fp):
                return
            bucket = self._other(bucket, fp)
            if step == 0:
                continue  # both candidate buckets come first, then kicking
            placed = self._place(bucket, fp)
            bucket, fp = bucket[~placed], fp[~placed]
            if not len(fp):
                return
            # one kick per bucket and round: the rest waits for the next round
            one, at = np.unique(bucket, return_index=True)
            slot = self._random.integers(0, SLOTS, len(one))
            kicked = self.table[one, slot].copy()
            self.table[one, slot] = fp[at]
            wait = np.ones(len(fp), dtype=bool)
            wait[at] = False
            bucket, fp = np.r_[self._other(one, kicked), bucket[wait]], np.r_[kicked, fp[wait]]
        self.homeless += list(zip(bucket.tolist(), fp.tolist(), strict=True))

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        """Remove one fingerprint of each key; True where there was one. Delete only inserted keys."""
        gone = np.zeros(len(hashes), dtype=bool)
        fps, first = fingerprints(hashes), self._first(hashes)
        second = self._other(first, fps)
        for i, (fp, a, b) in enumerate(zip(fps, first.tolist(), second.tolist(), strict=True)):
            for lost in ((a, int(fp)), (b, int(fp))):
                if not gone[i] and lost in self.homeless:
                    self.homeless.remove(lost)
                    gone[i] = True
            for bucket in (a, b):
                slots = np.flatnonzero(self.table[bucket] == fp)
                if len(slots) and not gone[i]:
                    self.table[bucket, slots[0]] = 0
                    gone[i] = True
        self.count -= int(gone.sum())
        return gone


class GrowingCuckoo:
    """Tables of doubling size: a saturated table stays for look-ups, a new one takes insertions."""

    def __init__(self, buckets: int = 1 << 12) -> None:
        self.tables = [CuckooTable(buckets)]

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), dtype=bool)
        for t in self.tables:
            found |= t.contains(hashes)
        return found

    def insert(self, hashes: np.ndarray) -> None:
        while len(hashes):
            room = max(0, self.tables[-1].room)
            if room:
                self.tables[-1].insert(hashes[:room])
            hashes = hashes[room:]
            if len(hashes):
                self.tables.append(CuckooTable(2 * len(self.tables[-1].table)))

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        gone = np.zeros(len(hashes), dtype=bool)
        for t in reversed(self.tables):
            left = np.flatnonzero(~gone)
            if len(left):
                gone[left] = t.delete(hashes[left])
        return gone

    def __len__(self) -> int:
        return sum(t.count for t in self.tables)

    @property
    def bytes(self) -> int:
        return sum(t.table.nbytes for t in self.tables)

    def arrays(self) -> dict[str, np.ndarray]:
        """All of it as named arrays, to be stored."""
        out = {}
        for i, t in enumerate(self.tables):
            out |= {f"table{i}": t.table, f"count{i}": np.array(t.count), f"homeless{i}": np.array(t.homeless, dtype=np.int64).reshape(-1, 2)}
        return out

    @staticmethod
    def of(arrays: dict[str, np.ndarray]) -> GrowingCuckoo:
        own = GrowingCuckoo(1)
        own.tables = []
        while f"table{len(own.tables)}" in arrays:
            i = len(own.tables)
            t = CuckooTable(len(arrays[f"table{i}"]))
            t.table, t.count = arrays[f"table{i}"].copy(), int(arrays[f"count{i}"])
            t.homeless = [(int(a), int(b)) for a, b in arrays[f"homeless{i}"]]
            own.tables.append(t)
        return own


def seen_before(table: GrowingCuckoo, hashes: np.ndarray) -> np.ndarray:
    """For keys in order of arrival: was the key (or one with its fingerprint and bucket) there before?

    New keys are inserted. Within the call, earlier arrivals of the same hash count.
    """
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    known = table.contains(hashes[first])
    seen = np.ones(len(hashes), dtype=bool)
    seen[first] = known
    new = np.sort(first[~known])
    table.insert(hashes[new])
    return seen
