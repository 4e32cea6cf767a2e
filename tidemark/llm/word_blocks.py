"""Words of a block and the order in which it asks hash buckets about them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from tidemark.llm.blocks import expand, squeeze

_KINDS = [np.dtype(k) for k in ("u1", "u2", "u4", "i8")]


def split_words(payload: bytes) -> list[bytes]:
    """Words of a compressed list; words hold no blank."""
    data = expand(payload)
    return data.split(b" ") if data else []


def word_order(words: list[bytes], buckets: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words in asking order, and the bucket of each in that order."""
    bucket = np.array([xxhash.xxh3_64_intdigest(w, seed) % buckets for w in words], np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal numbers in an ordered array."""
    used, starts = np.unique(bucket, return_index=True)
    for b, lo, hi in zip(used.tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
        yield b, slice(lo, hi)


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, each in the narrowest type that holds it, byte plane by byte plane, compressed."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        kind = next(i for i, k in enumerate(_KINDS) if most <= np.iinfo(k).max)
        planes = np.ascontiguousarray(x.astype(_KINDS[kind])).view(np.uint8).reshape(len(x), _KINDS[kind].itemsize).T
        parts += [np.array([kind, len(x)], np.int64).tobytes(), planes.tobytes()]
    return squeeze(b"".join(parts), 3)


def unpack_numbers(payload: bytes) -> list[np.ndarray]:
    data, at, out = expand(payload), 8, []
    for _ in range(int(np.frombuffer(data, np.int64, 1)[0])):
        kind, size = np.frombuffer(data, np.int64, 2, at).tolist()
        wide = _KINDS[kind].itemsize
        planes = np.frombuffer(data, np.uint8, size * wide, at + 16).reshape(wide, size)
        out.append(np.ascontiguousarray(planes.T).view(_KINDS[kind]).reshape(-1).astype(np.int64))
        at += 16 + size * wide
    return out
