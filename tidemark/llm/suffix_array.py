"""Removal of long byte strings that an earlier line holds, by a partitioned suffix array.

Two equal strings of 50 bytes hold the same 16-byte token with the smallest hash, so suffixes are looked at by such
leading tokens. Splitters sampled from the tokens cut their order into a bounded number of ranges, and a range with many
tokens deals whole tokens to several buckets; each bucket sorts the suffixes of each name by multikey quicksort over eight bytes at a time. Suffixes whose token is so frequent that several buckets share it are compared
across these buckets afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import expand
from tidemark.llm.bpe import ranges
from tidemark.llm.repeats import Runs, cover, multikey_quicksort, stretches, without_repeats
from tidemark.llm.settings import tidy

TOKEN = 16  # bytes of a leading token; two key parts of the sort
_LONGEST_RUN = 64
_SLICE = 1 << 18
_RANGES = 4096  # ranges of leading tokens; more buckets than that share them out
_SAMPLE_BLOCKS, _SAMPLE_TOKENS = 32, 3072  # the sample for splitters, about 24 tokens a range whatever the input's size

_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(16).integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def token_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each 16-byte token along the last axis."""
    value = _BYTE[data]
    for i, step in enumerate((1, 2, 4, 8)):
        value = value[..., :-step] * _FACTORS[i] + value[..., step:]
    value ^= value >> np.uint64(29)
    value *= _FACTORS[4]
    value ^= value >> np.uint64(32)
    return value


def _smallest(value: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours."""
    step = 1
    while step * 2 <= width:
        value = np.minimum(value[:-step], value[step:])
        step *= 2
    return np.minimum(value[: len(value) - (width - step)], value[width - step :]) if width > step else value


class ByteScheme:
    """Units are bytes; a window is named by its smallest token hash."""

    def __init__(self, window: int):
        if window < TOKEN:
            raise ValueError(f"windows need {TOKEN} bytes or more")
        self.window = window
        self.splitters = np.zeros(0, f"S{TOKEN}")

    def prepare(self, blocks: DataFrame, buckets: int) -> None:
        """Sample leading tokens and cut their order into ranges, one a bucket up to `_RANGES`."""
        stride = max(1, blocks.count() // _SAMPLE_BLOCKS)
        cut = min(buckets, _RANGES)

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for sizes, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    runs, text = self.runs(expand(body), np.frombuffer(sizes, np.int64))
                    # Evenly over the block; a token counts once for a block, as its texts are put together there.
                    each, place = np.unique(runs.name, return_index=True)
                    some = place[np.linspace(0, len(each) - 1, min(len(each), _SAMPLE_TOKENS)).astype(np.int64)] if len(each) else place
                    yield pa.RecordBatch.from_arrays([pa.array(self._tokens(text, runs, some), pa.binary())], ["token"])

        sample = (
            blocks.where(F.pmod(F.xxhash64("block_id"), F.lit(stride)) == 0)
            .select("sizes", "body")
            .mapInArrow(tidy(tokens), "token binary")
            .collect()
        )
        ordered = sorted(bytes(r["token"]) for r in sample)
        cuts = [ordered[len(ordered) * i // cut] for i in range(1, cut)] if ordered else []
        self.splitters = np.array(cuts, f"S{TOKEN}")

    def runs(self, body: bytes, sizes: np.ndarray) -> tuple[Runs, bytes]:
        data = np.frombuffer(body, np.uint8)
        ends = np.cumsum(sizes)
        parts = []
        for at in range(0, max(0, len(data) - self.window + 1), _SLICE):
            part = data[at : at + _SLICE + self.window - 1]
            name = _smallest(token_hashes(part), self.window - TOKEN + 1)
            # A window must end in the line it starts in.
            line = np.searchsorted(ends, np.arange(at, at + len(name)), side="right")
            valid = np.arange(at, at + len(name)) + self.window <= ends[line]
            begin = valid.copy()
            begin[1:] &= ~valid[:-1] | (name[1:] != name[:-1])
            first = np.nonzero(begin)[0]
            stop = valid.copy()
            stop[:-1] &= ~valid[1:] | (name[1:] != name[:-1])
            count = np.nonzero(stop)[0] - first + 1
            pieces = -(-count // _LONGEST_RUN)
            number = ranges(np.zeros(len(first), np.int64), pieces)
            first = np.repeat(first, pieces) + number * _LONGEST_RUN
            count = np.minimum(np.repeat(count, pieces) - number * _LONGEST_RUN, _LONGEST_RUN)
            parts.append((line[first], at + first, count, name[first]))
        if not parts:
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        line, first, count, name = (np.concatenate(x) for x in zip(*parts))
        return Runs(line, first, count, name, first, first + count - 1 + self.window), body

    def _tokens(self, text: bytes, runs: Runs, chosen: np.ndarray) -> list[bytes]:
        """The token that names each chosen run."""
        data = np.frombuffer(text, np.uint8)
        out = []
        for lo in range(0, len(chosen), 4096):
            first = runs.first[chosen[lo : lo + 4096]]
            windows = data[first[:, None] + np.arange(self.window)]
            at = first + np.argmin(token_hashes(windows), axis=1)
            out += [text[i : i + TOKEN] for i in at.tolist()]
        return out

    def bucket(self, text: bytes, runs: Runs, chosen: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of each chosen run: the range of its token, and among the range's buckets one by the token's hash."""
        tokens = np.array(self._tokens(text, runs, chosen), f"S{TOKEN}")
        place, cut = np.searchsorted(self.splitters, tokens, side="right"), len(self.splitters) + 1
        low, high = place * buckets // cut, (place + 1) * buckets // cut
        return low + (runs.name[chosen] % np.maximum(high - low, 1).astype(np.uint64)).astype(np.int64)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        return np.array([len(t) for t in texts], np.int64) - self.window + 1

    def windows(self, texts: list[bytes], name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = self.lengths(texts)
        base = np.cumsum([0, *(len(t) for t in texts[:-1])])
        start = ranges(base, count)
        eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(texts), np.uint8), 8)
        depth = -(-self.window // 8)
        # The last part overlaps the one before it, so that no byte after the window counts.
        offset = np.array([*(8 * i for i in range(depth - 1)), self.window - 8])

        def key(items: np.ndarray, level: np.ndarray) -> np.ndarray:
            return eight[start[items] + offset[level]].view(">u8")[:, 0].astype(np.uint64)

        # The windows of a name are sorted on their own, so that what all texts hold is not put in order first.
        named = np.add.reduceat(count, np.unique(name, return_index=True)[1])
        _, kind = multikey_quicksort(key, len(start), depth, named)
        return np.repeat(np.arange(len(texts)), count), start - np.repeat(base, count), kind

    def window_bytes(self, text: bytes, place: int) -> bytes:
        return text[place : place + self.window]

    def rest(self, body: bytes, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple]:
        covered = cover(len(body), first, last, self.window)
        data = np.frombuffer(body, np.uint8)
        out, at = [], 0
        for size in sizes.tolist():
            own = covered[at : at + size]
            out.append((size, int(own.sum()), stretches(own), data[at : at + size][~own].tobytes()))
            at += size
        return out


def remove_repeated_bytes(
    lines: DataFrame, *, window: int = 50, pieces_of: int = 4096, carry: str | None = None
) -> DataFrame:
    """Raw transaction lines without the byte strings that a line with a smaller number holds as well.

    `lines` needs line_number (whole number) and line (string). A byte is removed if it lies in a string of `window`
    bytes of its line that also starts in a line with a smaller number. Strings overlap, never cross lines, and are
    judged on the input, not on what is left. Returns one row for each row of `lines`: line_number, n_units (bytes),
    n_removed, n_spans (maximal removed stretches), kept (binary: the bytes left, which may cut a character) and line_md5
    (of the input line, which tells rows of one number apart).

    A null line is empty. A null line number counts as larger than all others. Rows with one number remove nothing
    from each other. Extra columns are ignored, but for a string column named by `carry`, which comes back with its line; an
    empty table gives no rows. Lines are whole whatever their length.
    """
    return without_repeats(lines, ByteScheme(window), pieces_of=pieces_of, carry=carry)
