"""Codes of many texts at once: equal parts of texts are encoded once, and whole arrays are put together from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of texts that are taken at a time, and parts of them; a longer text is taken alone.
TAKEN, BLOCK = 8 << 20, 1 << 21
#: Parts that a worker remembers, in two generations, and the bytes of the longest that is remembered.
MEMO, MEMO_BYTES = 600_000, 256


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs data[start[i] : start[i] + size[i]], one after the other."""
    end = np.cumsum(size)
    return data[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def groups(sizes: Sequence[int], limit: int = TAKEN) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose sizes add up to `limit` at most, or of one text."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


class Codes:
    """Numbers of the parts of texts. `encode` gives those of one part, which must not depend on what is around it."""

    def __init__(self, encode: Callable[[bytes], Sequence[int]], kind: str):
        self.encode, self.kind = encode, np.dtype(kind)
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _find(self, parts: list[bytes]) -> list[bytes]:
        found = list(map(self.memo.get, parts))
        for i in [i for i, f in enumerate(found) if f is None]:
            part = parts[i]
            found[i] = self.old.get(part)
            if found[i] is None:
                found[i] = np.array(self.encode(part), self.kind).tobytes()
            if len(part) <= MEMO_BYTES:
                self.memo[part] = found[i]
        if len(self.memo) >= MEMO:
            self.memo, self.old = {}, self.memo
        return found

    def __call__(self, raw: bytes, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of raw, cut before each place of `first`, and how many come before each part, with the total at the end."""
        numbers, counts = [np.zeros(0, self.kind)], [np.zeros(1, np.int64)]
        ends = np.append(first[1:], len(raw))
        for at in range(0, len(first), BLOCK):
            a, b = first[at : at + BLOCK], ends[at : at + BLOCK]
            base = int(a[0])
            offsets = np.append(a - base, b[-1] - base).astype(np.int32)
            parts = pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(memoryview(raw)[base : int(b[-1])])]).dictionary_encode()
            found = self._find(parts.dictionary.to_pylist())
            size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
            which = parts.indices.to_numpy()
            numbers.append(gather(np.frombuffer(b"".join(found), self.kind), (np.cumsum(size) - size)[which], size[which]))
            counts.append(size[which])
        return np.concatenate(numbers), np.cumsum(np.concatenate(counts))
