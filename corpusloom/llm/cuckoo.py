"""A cuckoo filter whose slots point at the stored keys, so that hits are verified and a resize needs no input."""

from __future__ import annotations

from array import array

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Index of live digests with insertion, deletion and exact verification.

    Each bucket has four slots. A slot holds a 16-bit tag (the filter) and the number of a stored entry
    (the content of that bucket). A tag match is only a candidate: the stored key decides. When an insertion
    kicks too often, or the load passes 90 %, the bucket count doubles and all stored keys are placed anew.
    """

    def __init__(self, buckets: int = 64) -> None:
        self.keys: list[bytes | None] = []
        self.values: list[list] = []
        self.free: list[int] = []
        self.live = 0
        self.resizes = 0
        self.false_hits = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = array("H", bytes(2 * SLOTS * buckets))
        self.entry = array("q", bytes(8 * SLOTS * buckets))

    def _place(self, key: bytes) -> tuple[int, int]:
        """Tag (never 0, which marks an empty slot) and first bucket; keys begin with a digest, so their bytes are uniform."""
        tag = int.from_bytes(key[:2], "little") or 1
        return tag, int.from_bytes(key[2:10], "little") & self.mask

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def find(self, key: bytes) -> int:
        """The slot that holds key, or -1."""
        tag, first = self._place(key)
        for bucket in (first, self._other(first, tag)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[slot] == tag:
                    if self.keys[self.entry[slot]] == key:
                        return slot
                    self.false_hits += 1
        return -1

    def get(self, key: bytes) -> list | None:
        slot = self.find(key)
        return None if slot < 0 else self.values[self.entry[slot]]

    def insert(self, key: bytes, value: list) -> None:
        """key must not be live; replace a live one by delete and insert."""
        if self.free:
            at = self.free.pop()
            self.keys[at], self.values[at] = key, value
        else:
            at = len(self.keys)
            self.keys.append(key)
            self.values.append(value)
        self.live += 1
        if self.live > 0.9 * SLOTS * (self.mask + 1) or not self._seat(key, at):
            self._grow()

    def _seat(self, key: bytes, at: int) -> bool:
        tag, bucket = self._place(key)
        for b in (bucket, self._other(bucket, tag)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.entry[slot] = tag, at
                    return True
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            at, self.entry[slot] = self.entry[slot], at
            bucket = self._other(bucket, tag)
            for s in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[s]:
                    self.tags[s], self.entry[s] = tag, at
                    return True
        return False  # the last one kicked has no seat: the caller grows, which seats every stored key

    def _grow(self) -> None:
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._seat(key, at) for at, key in enumerate(self.keys) if key is not None):
                return

    def delete(self, key: bytes) -> bool:
        slot = self.find(key)
        if slot < 0:
            return False
        at = self.entry[slot]
        self.tags[slot] = 0
        self.keys[at] = None
        self.values[at] = []
        self.free.append(at)
        self.live -= 1
        return True

    def items(self):
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)
