"""Byte-level BPE over whole lines: encoding with a segment tree over adjacent pair ranks, and decoding.

Each distinct pre-token of a stretch of lines is encoded once. All its adjacent pairs are the leaves of a segment tree
whose nodes keep the smallest (rank, position); the root is therefore the leftmost lowest-rank merge. A merge changes
at most three leaves, and only their paths to the root are recomputed. Trees of pre-tokens of similar length are held
side by side in one array and advance together; the ones whose root holds no rank are finished.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import chunks, line_rows, number_column
from tidemark.llm.settings import tidy

# Fixed value: the pattern of byte-level BPE that splits a text before merging.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_STRETCH_BYTES = 4 << 20  # text handled at once
_CACHE_ENTRIES = 400_000  # distinct pre-tokens a task remembers; beyond it they are encoded again
_NO_MERGE = np.iinfo(np.int64).max
_ENCODERS: dict[str, "PairRankEncoder"] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in names]
    names |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class PairRankEncoder:
    """The vocabulary and merges of one tokenizer file, and the pre-tokens encoded so far in this worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.byte_ids = np.array([vocabulary[c] for c in byte_characters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        keys = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in pairs], np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[self.order], self.order.astype(np.int64)
        self.merged_id = merged  # by rank
        special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.special = special
        self.split = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.pattern = regex.compile(PRE_TOKEN)
        pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in vocabulary.items()}
        pieces |= {i: s.encode() for s, i in special.items()}
        size = max(pieces) + 1
        self.piece_size = np.array([len(pieces.get(i, b"")) for i in range(size)], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(size)), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {s: i for i, s in enumerate(self.special)}
        self.sizes = np.ones(len(self.special), np.int64)
        self.ids = np.array(list(self.special.values()), np.int32)
        self.starts = np.arange(len(self.special), dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _NO_MERGE where there is none."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], _NO_MERGE)

    def merge_all(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode rows of byte ids (padded with -1 to one width): flat token ids in order, and their number by row."""
        n, width = ids.shape
        leaves = 1 << max(1, (width - 1).bit_length())
        shift = leaves.bit_length()
        right_of = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        left_of = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        right_of[right_of >= size[:, None]] = -1
        tree = np.full((n, 2 * leaves), _NO_MERGE, np.int64)

        def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            other = right_of[rows, at]
            rank = self.rank(ids[rows, at], np.where(other >= 0, ids[rows, np.maximum(other, 0)], -1))
            return np.where(rank == _NO_MERGE, _NO_MERGE, (rank << shift) | at)

        rows, at = np.nonzero(right_of >= 0)
        tree[rows, leaves + at] = leaf(rows, at)
        level = leaves
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = leaves + at
            tree[rows, node] = value
            while (node := node >> 1)[0] >= 1:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        active = np.nonzero(tree[:, 1] != _NO_MERGE)[0]
        while len(active):
            root = tree[active, 1]
            at = (root & ((1 << shift) - 1)).astype(np.int32)
            gone = right_of[active, at]
            ids[active, at] = self.merged_id[root >> shift]
            after = right_of[active, gone]
            right_of[active, at] = after
            has = after >= 0
            left_of[active[has], after[has]] = at[has]
            ids[active, gone] = -1
            update(active, gone, np.full(len(active), _NO_MERGE))
            update(active, at, leaf(active, at))
            before = left_of[active, at]
            has = before >= 0
            if has.any():
                update(active[has], before[has], leaf(active[has], before[has]))
            active = active[tree[active, 1] != _NO_MERGE]
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def learn(self, fresh: list[str]) -> None:
        """Encode pre-tokens that were not seen yet and remember their ids."""
        raw = [p.encode() for p in fresh]
        length = np.array([len(r) for r in raw], np.int64)
        order = np.argsort(length, kind="stable")
        sizes, flat, names = [], [], []
        at = 0
        while at < len(order):
            width = int(length[order[at]])
            bound = max(8, 1 << (width - 1).bit_length()) if width > 1 else 8
            most = max(1, min(20_000, 400_000 // bound))
            end = min(int(np.searchsorted(length[order], bound, side="right")), at + most)
            rows = order[at:end]
            width = int(length[rows[-1]])
            ids = np.full((len(rows), width), -1, np.int32)
            ids[np.arange(width) < length[rows][:, None]] = self.byte_ids[
                np.frombuffer(b"".join(raw[r] for r in rows), np.uint8)
            ]
            tokens, counts = self.merge_all(ids, length[rows])
            flat.append(tokens)
            sizes.append(counts)
            names.extend(fresh[r] for r in rows)
            at = end
        base = len(self.sizes)
        self.codes.update(zip(names, range(base, base + len(names))))
        new_sizes = np.concatenate(sizes)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(new_sizes) - new_sizes])
        self.sizes = np.concatenate([self.sizes, new_sizes])
        self.ids = np.concatenate([self.ids, *flat])

    def pre_tokens(self, text: str) -> list[str]:
        if self.split is None or not self.split.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for found in self.split.finditer(text):
            out += self.pattern.findall(text[at : found.start()])
            out.append(found[0])
            at = found.end()
        return out + self.pattern.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of all texts, and the number of each text."""
        if len(self.codes) > _CACHE_ENTRIES:
            self.forget()
        parts = [self.pre_tokens(t) for t in texts]
        tokens = [p for part in parts for p in part]
        fresh = {t for t in tokens if t not in self.codes}
        if fresh:
            self.learn(sorted(fresh))
        codes = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, len(tokens))
        flat = ranges(self.starts[codes], self.sizes[codes])
        total = np.concatenate([[0], np.cumsum(self.sizes[codes])])
        ends = np.cumsum([len(p) for p in parts])
        counts = np.diff(total[np.concatenate([[0], ends]).astype(np.int64)])
        return self.ids[flat], counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become replacement characters."""
        data = self.piece_bytes[ranges(self.piece_start[ids], self.piece_size[ids])].tobytes()
        total = np.concatenate([[0], np.cumsum(self.piece_size[ids])])
        ends = total[np.cumsum(counts)] if len(counts) else []
        out, at = [], 0
        for end in ends:
            out.append(data[at:end].decode("utf-8", "replace"))
            at = end
        return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + size), one range after the other."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def encoder(path: str) -> PairRankEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PairRankEncoder(path)
    return _ENCODERS[path]


def encode_transaction_lines(lines: DataFrame, tokenizer: str) -> DataFrame:
    """Token ids of raw transaction lines, and the text that these ids decode to.

    `lines` needs line_number (whole number) and line (string), as the reader of gzipped transaction lines gives them;
    other columns are ignored. `tokenizer` is the path of a byte-level BPE file, readable on every executor.
    Returns one row for each row of `lines`: line_number, token_ids (array of int), decoded (string).

    Special tokens are not added; their strings inside a line become their single id, as is the library's default.
    A null or empty line has no ids and decodes to the empty string. Null and repeated line numbers are kept as they
    are. Extra columns, whatever their names, change nothing. There is no shuffle, and lines are handled in stretches of
    about four megabytes, so memory does not grow with the table; a single longer line is one stretch.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        for batch in batches:
            numbers, raw = line_rows(batch)
            for lo, hi in chunks([len(r) for r in raw], _STRETCH_BYTES):
                ids, counts = tool.encode([r.decode() for r in raw[lo:hi]])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        number_column(numbers[lo:hi]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))),
                        pa.array(tool.decode(ids, counts), pa.string()),
                    ],
                    names=["line_number", "token_ids", "decoded"],
                )
        tool.forget()  # a worker outlives its task

    rows = lines.select(F.col("line_number").cast("long"), F.col("line").cast("string"))
    return rows.mapInArrow(tidy(encoded), "line_number long, token_ids array<int>, decoded string")
