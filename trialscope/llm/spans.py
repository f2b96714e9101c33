"""Words as byte spans: found by a table-driven scan, hashed and compared eight bytes at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .common import mix, worker_store

#: Spans above this length are hashed and compared as whole byte strings.
LONG = 64
#: Bytes scanned at a time; a longer text is scanned block by block, with the state carried over.
BLOCK = 1 << 21
SEED = np.uint64(0x9E3779B97F4A7C15)


class Bytes:
    """A run of bytes with room behind it, readable as a little-endian 64-bit number at every place."""

    def __init__(self, data: np.ndarray):
        self.raw = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=self.raw, strides=(1,))

    def chunk(self, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k+7 of each span that has any, zero behind its end."""
        left = np.minimum(lengths - 8 * k, 8)
        return self.eights[starts + 8 * k] & _masks()[left]

    def whole(self, start: int, length: int) -> bytes:
        return self.raw[start : start + length].tobytes()


def _masks() -> np.ndarray:
    store = worker_store("masks")
    if not store:
        store["masks"] = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
    return store["masks"]


def span_hashes(data: Bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length."""
    out = mix((lengths.astype(np.uint64) + np.uint64(seed)) * SEED)
    own = np.flatnonzero(lengths <= LONG)
    k = 0
    while len(own):
        out[own] = mix((out[own] ^ data.chunk(starts[own], lengths[own], k)) * SEED)
        k += 1
        own = own[lengths[own] > 8 * k]
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(lengths > LONG):
        digest = hashlib.blake2b(data.whole(starts[i], lengths[i]), digest_size=8, key=salt).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def same_spans(a: Bytes, starts_a: np.ndarray, b: Bytes, starts_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether spans of equal ``lengths`` hold the same bytes."""
    same = np.ones(len(lengths), dtype=bool)
    own = np.flatnonzero(lengths <= LONG)
    k = 0
    while len(own):
        equal = a.chunk(starts_a[own], lengths[own], k) == b.chunk(starts_b[own], lengths[own], k)
        same[own[~equal]] = False
        k += 1
        own = own[equal & (lengths[own] > 8 * k)]
    for i in np.flatnonzero(lengths > LONG):
        same[i] = starts_a[i] == starts_b[i] and a is b or a.whole(starts_a[i], lengths[i]) == b.whole(starts_b[i], lengths[i])
    return same


def scan(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, events: np.ndarray, blank: int) -> Iterator[tuple]:
    """Run a two-state machine (outside, inside a word) over texts data[offsets[i]:offsets[i+1]], block by block.

    ``classes`` maps a byte to its class, ``events`` (state, class) to a number of event bits; class ``blank`` leads outside, all
    others inside. Every text starts outside. Yields (first byte, event bits of the block's bytes, starts, ends): the words that
    end in the block, in order; a word may have begun in an earlier one.
    """
    open_at, inside = -1, False
    borders = offsets[1:-1]
    for low in range(0, len(data), BLOCK):
        high = min(low + BLOCK, len(data))
        kind = classes[data[low:high]]
        body = kind != blank
        before = np.empty_like(body)
        before[0], before[1:] = inside, body[:-1]
        new = borders[np.searchsorted(borders, low) : np.searchsorted(borders, high)] - low
        ended = before & ~body
        ended[new] = before[new]
        before[new] = False
        starts = np.flatnonzero(body & ~before) + low
        ends = np.flatnonzero(ended) + low
        inside = bool(body[-1])
        if high == len(data) and inside:
            ends = np.append(ends, high)
        if open_at >= 0:
            starts = np.insert(starts, 0, open_at)
        open_at = -1
        if len(starts) > len(ends):
            open_at = int(starts[-1])
            starts = starts[:-1]
        yield low, events.ravel().take(kind + before * np.uint8(events.shape[1])), starts, ends


class SpanTable:
    """A hash table of (owner, word) by open addressing: a slot counts as a hit only after its bytes are compared.

    All new spans probe together; of those that meet an empty slot one takes it, and the others compare with it.
    """

    def __init__(self, data: Bytes):
        self.data = data
        self.size = 0
        self.slots = np.full(1 << 12, -1, dtype=np.int64)
        self.keys = {name: np.empty(0, np.int64) for name in ("owner", "start", "length")}
        self.hashes = np.empty(0, np.uint64)

    def _grow(self, most: int) -> None:
        """Room for ``most`` keys; keys differ from each other, so they are placed without comparing."""
        if 2 * most <= len(self.slots):
            return
        self.slots = np.full(1 << int(2 * most).bit_length(), -1, dtype=np.int64)
        own = np.arange(self.size)
        at = self._first(self.hashes[: self.size])
        while len(own):
            free = self.slots[at] < 0
            self.slots[at[free]] = own[free]
            left = self.slots[at] != own
            own, at = own[left], (at[left] + 1) & (len(self.slots) - 1)

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1)

    def insert(self, owner: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Owners of the spans that were not in the table yet."""
        n, base = len(start), self.size
        self._grow(base + n)
        hashes = mix(span_hashes(self.data, start, length) ^ (owner.astype(np.uint64) * SEED))
        held = {name: np.concatenate([self.keys[name][:base], new]) for name, new in (("owner", owner), ("start", start), ("length", length))}
        known = np.concatenate([self.hashes[:base], hashes])
        place = np.empty(n, dtype=np.int64)  # the slot a new key has taken
        fresh = np.zeros(n, dtype=bool)
        own, at = np.arange(n), self._first(hashes)
        while len(own):
            free = self.slots[at] < 0
            self.slots[at[free]] = base + own[free]
            there = self.slots[at]
            took = there == base + own
            fresh[own[took]], place[own[took]] = True, at[took]
            met = np.flatnonzero(~took)
            a, b = base + own[met], there[met]
            like = (known[a] == known[b]) & (held["owner"][a] == held["owner"][b]) & (held["length"][a] == held["length"][b])
            pair = np.flatnonzero(like)
            a, b = a[pair], b[pair]
            like[pair] = same_spans(self.data, held["start"][a], self.data, held["start"][b], held["length"][a])
            left = met[~like]
            own, at = own[left], (at[left] + 1) & (len(self.slots) - 1)
        kept = np.flatnonzero(fresh)
        self.slots[place[kept]] = base + np.arange(len(kept))
        index = np.concatenate([np.arange(base), base + kept])
        self.keys = {name: column[index] for name, column in held.items()}
        self.hashes, self.size = known[index], base + len(kept)
        return owner[kept]
