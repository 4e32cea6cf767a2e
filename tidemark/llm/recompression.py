"""Removal of long word sequences that an earlier line holds, by recompression.

Two rounds rewrite every line: runs of one symbol become a symbol, then pairs whose left symbol falls into the left and
whose right symbol falls into the right half of the alphabet become a symbol. A pair is decided by its own two
symbols, and a run by its neighbours, so equal sequences get equal symbols everywhere but near their ends. Each symbol
carries the stretch of words that decided it. Names are fingerprints of what they stand for: the same run or pair has
the same name in every block, and the Spark round that follows finds the names that several lines share. The words
under the shared high-level symbols are then compared as they are.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.bpe import ranges
from tidemark.llm.repeats import Runs, cover, multikey_quicksort, stretches, without_repeats

ROUNDS = 2
_FACTORS = np.random.default_rng(13).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(31))
    value = value * _FACTORS[0]
    return value ^ (value >> np.uint64(29))


class Symbols:
    """Symbols of a block in order: name, line, and the first and last word that decided the symbol."""

    def __init__(self, name, line, low, high):
        self.name, self.line, self.low, self.high = name, line, low, high


def compress_runs(symbols: Symbols) -> Symbols:
    """Replace each maximal run of one symbol; a symbol then also depends on both its neighbours."""
    name, line = symbols.name, symbols.line
    if not len(name):
        return symbols
    begin = np.ones(len(name), bool)
    begin[1:] = (name[1:] != name[:-1]) | (line[1:] != line[:-1])
    first = np.nonzero(begin)[0]
    last = np.append(first[1:], len(name)) - 1
    times = (last - first + 1).astype(np.uint64)
    run = np.where(times > 1, _mix(name[first] * _FACTORS[1] + times * _FACTORS[2]), name[first])
    low, high = _beside(symbols, first, last)
    return Symbols(run, line[first], low, high)


def _beside(symbols: Symbols, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Deciding words of stretches first..last with both neighbours; beyond its line's ends nothing can decide."""
    low, high, line = symbols.low, symbols.high, symbols.line
    n = len(low)
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    inside_left = (first > 0) & (line[before] == line[first])
    inside_right = (last < n - 1) & (line[after] == line[last])
    return (
        np.where(inside_left, low[before], low[first] - 1),
        np.where(inside_right, high[after], high[last] + 1),
    )


def compress_pairs(symbols: Symbols, salt: int) -> Symbols:
    """Replace each pair of a left-half and a right-half symbol; a symbol left alone depends on why it has no partner."""
    name, line = symbols.name, symbols.line
    if not len(name):
        return symbols
    left = (_mix(name ^ _FACTORS[3 + salt]) >> np.uint64(63)) == 0
    joined = np.zeros(len(name), bool)  # the symbol is the left of a pair
    joined[:-1] = left[:-1] & ~left[1:] & (line[:-1] == line[1:])
    taken = np.zeros(len(name), bool)
    taken[1:] = joined[:-1]
    first = np.nonzero(~taken)[0]
    last = first + joined[first]
    pair = _mix(name[first] * _FACTORS[5] + name[last] * _FACTORS[6])
    low, high = symbols.low[first], symbols.high[last]
    beside_low, beside_high = _beside(symbols, first, last)
    alone = ~joined[first]
    # A left symbol without a partner was decided by its right neighbour, a right symbol by its left one.
    low = np.where(alone & ~left[first], np.minimum(low, beside_low), low)
    high = np.where(alone & left[first], np.maximum(high, beside_high), high)
    return Symbols(np.where(joined[first], pair, name[first]), line[first], low, high)


class WordScheme:
    """Units are words; a window is named by the smallest of the highest symbols that it decides alone."""

    def __init__(self, window: int):
        self.window = window

    def prepare(self, blocks: DataFrame, buckets: int) -> None:
        pass

    def _words(self, body: bytes, sizes: np.ndarray) -> list[list[bytes]]:
        ends = np.cumsum(sizes).tolist()
        return [body[e - s : e].split() for e, s in zip(ends, sizes.tolist())]

    def runs(self, body: bytes, sizes: np.ndarray) -> tuple[Runs, bytes]:
        parts = self._words(body, sizes)
        flat = [w for part in parts for w in part]
        counts = np.array([len(p) for p in parts], np.int64)
        line = np.repeat(np.arange(len(parts)), counts)
        codes: dict[bytes, int] = {}
        code = np.fromiter((codes.setdefault(w, len(codes)) for w in flat), np.int64, len(flat))
        named = np.array([xxhash.xxh3_64_intdigest(w) for w in codes], np.uint64)
        word = named[code] if len(code) else np.zeros(0, np.uint64)
        place = np.arange(len(flat))
        # Fingerprint of any stretch of words from running sums.
        power = np.ones(len(flat) + 1, np.uint64)
        power[1:] = np.cumprod(np.full(len(flat), _FACTORS[7]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(word * power[:-1])])
        inverse = np.cumprod(np.full(len(flat) + 1, _inverse(int(_FACTORS[7])), np.uint64)) * _FACTORS[7]

        ends = np.cumsum(counts)
        window_first = place[place + self.window <= ends[line]] if len(flat) else place
        name = np.zeros(len(window_first), np.uint64)
        open_ = np.ones(len(window_first), bool)
        levels = [Symbols(word, line, place, place)]
        for salt in range(ROUNDS):
            levels.append(compress_pairs(compress_runs(levels[-1]), salt))
        for level in range(ROUNDS, -1, -1):
            at = np.nonzero(open_)[0]
            if not len(at):
                break
            symbols = levels[level]
            # Symbols decided inside the window: their first and last deciding words never fall from one to the next.
            lo = np.searchsorted(symbols.low, window_first[at], side="left")
            hi = np.searchsorted(symbols.high, window_first[at] + self.window - 1, side="right")
            some = hi > lo
            at, lo, hi = at[some], lo[some], hi[some]
            low, high = np.clip(symbols.low, 0, len(flat)), np.clip(symbols.high + 1, 0, len(flat))
            stretch = (sums[high] - sums[low]) * inverse[low]
            own = _mix(stretch * _FACTORS[2] + np.uint64(level))
            name[at] = _range_min(own, lo, hi)
            open_[at] = False
        begin = np.ones(len(window_first), bool)
        begin[1:] = (name[1:] != name[:-1]) | (window_first[1:] != window_first[:-1] + 1)
        # The gap between lines is at least a window less one wide, unless windows are single words.
        first_line = line[window_first] if len(flat) else place
        begin[1:] |= first_line[1:] != first_line[:-1]
        head = np.nonzero(begin)[0]
        count = np.append(head[1:], len(window_first)) - head
        pieces = -(-count // 64)
        number = ranges(np.zeros(len(head), np.int64), pieces)
        count = np.minimum(np.repeat(count, pieces) - number * 64, 64)
        first = np.repeat(window_first[head], pieces) + number * 64
        text = b" ".join(flat)
        length = np.array([len(w) for w in flat], np.int64)
        stop = np.cumsum(length) + place  # end of each word in the joined text
        last = first + count - 1 + self.window - 1
        empty = np.zeros(0, np.int64)
        lo, hi = ((stop - length)[first], stop[last]) if len(first) else (empty, empty)
        return Runs(np.repeat(first_line[head], pieces), first, count, np.repeat(name[head], pieces), lo, hi), text

    def bucket(self, text: bytes, runs: Runs, chosen: np.ndarray, buckets: int) -> np.ndarray:
        return (runs.name[chosen] % np.uint64(buckets)).astype(np.int64)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        return np.array([t.count(b" ") for t in texts], np.int64) + 2 - self.window

    def windows(self, texts: list[bytes], name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [t.split(b" ") for t in texts]
        codes: dict[bytes, int] = {}
        size = np.array([len(p) for p in parts], np.int64)
        word = np.fromiter((codes.setdefault(w, len(codes)) for p in parts for w in p), np.int64, int(size.sum()))
        base, count = np.cumsum(size) - size, size - self.window + 1
        start = ranges(base, count)
        depth = -(-self.window // 2)
        offset = np.array([*(2 * i for i in range(depth - 1)), max(0, self.window - 2)])
        following = np.append(word[1:], 0) if self.window > 1 else np.zeros(len(word), np.int64)
        two = (word << 32) | following

        def key(items: np.ndarray, level: np.ndarray) -> np.ndarray:
            return two[start[items] + offset[level]]

        _, kind = multikey_quicksort(key, len(start), depth)
        return np.repeat(np.arange(len(texts)), count), start - np.repeat(base, count), kind

    def window_bytes(self, text: bytes, place: int) -> bytes:
        return b" ".join(text.split(b" ")[place : place + self.window])

    def rest(self, body: bytes, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple]:
        parts = self._words(body, sizes)
        covered = cover(sum(map(len, parts)), first, last, self.window)
        out, at = [], 0
        for words in parts:
            own = covered[at : at + len(words)]
            kept = b" ".join([w for w, gone in zip(words, own.tolist()) if not gone] if own.any() else words)
            out.append((len(words), int(own.sum()), stretches(own), kept))
            at += len(words)
        return out


def _inverse(odd: int) -> int:
    """The number that times `odd` is 1 in 64-bit arithmetic."""
    return pow(odd, -1, 1 << 64)


def _range_min(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of value[lo:hi] for ranges that aren't empty."""
    width = hi - lo
    out = np.full(len(lo), _TOP)
    step, table = 1, value
    while len(table) and (width >= step).any():
        here = (width >= step) & (width < 2 * step)
        out[here] = np.minimum(table[lo[here]], table[hi[here] - step])
        if len(table) <= step:
            break
        table = np.minimum(table[:-step], table[step:])
        step *= 2
    return out


def remove_repeated_words(lines: DataFrame, *, window: int = 13, pieces_of: int = 4096) -> DataFrame:
    """Raw transaction lines without the word sequences that a line with a smaller number holds as well.

    `lines` needs line_number (whole number) and line (string); words are runs of bytes other than ASCII white space. A
    word is removed if it lies in `window` consecutive words of its line that also start in a line with a smaller
    number, judged on the input. Returns one row for each row of `lines`: line_number, n_units (words), n_removed,
    n_spans (maximal removed stretches), kept (binary: the words left, joined by one space) and line_md5 (of the input
    line).

    A null line has no words. A null line number counts as larger than all others. Rows with one number remove nothing
    from each other. Extra columns are ignored; an empty table gives no rows. Lines are whole whatever their length.
    """
    return without_repeats(lines, WordScheme(window), pieces_of=pieces_of)
