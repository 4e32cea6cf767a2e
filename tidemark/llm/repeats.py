"""Windows that also start in an earlier line: the frame shared by the byte-wise and the word-wise operator.

1. Every window of a line is given a name that depends on its content alone; neighbouring windows often have the same
   name, and such a run of windows is handled as one. Blocks ask, by name, whether another line has the name too.
2. Runs with a shared name send their text to a bucket. Within a block and again within a bucket, equal texts are put
   together first, so that thousands of copies travel as one text with the smallest line number.
3. A bucket sorts the windows of the remaining different texts; equal windows of a smaller line are the matches.
4. A name held by very many blocks, or with more different texts than a bucket should hold, is dealt to several buckets,
   whose first windows are then compared across buckets.

Only names, texts of shared runs and covered spans move. No step holds more than one block or one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import NO_NUMBER, buckets_for, carried_column, expand, number_column, pack, squeeze
from tidemark.llm.bpe import ranges
from tidemark.llm.settings import release, tidy
from tidemark.sources.scratch import materialise

_NAME_BYTES = 8 << 20  # text per bucket of names
_TEXT_BYTES = 4 << 20  # text per bucket of shared runs
_RESULT = "line_number long, n_units long, n_removed long, n_spans long, kept binary, line_md5 string"
_PIECE = "bucket int, block_id long, spans boolean, payload binary"


class Runs:
    """Runs of windows of one block: line index, first window, number of windows, name, and the run's text."""

    def __init__(self, line, first, count, name, text_lo, text_hi):
        self.line, self.first, self.count, self.name = line, first, count, name
        self.text_lo, self.text_hi = text_lo, text_hi


class Scheme(Protocol):
    """How lines are cut into units, and how windows of units are named, dealt, ordered and removed."""

    window: int

    def prepare(self, blocks: DataFrame, buckets: int) -> None:
        """Look at the blocks once before they are asked."""

    def runs(self, body: bytes, sizes: np.ndarray) -> tuple[Runs, bytes]:
        """Runs of a block, and the bytes that their text positions refer to."""

    def bucket(self, text: bytes, runs: Runs, chosen: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of each chosen run."""

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Number of windows of each text."""

    def windows(self, texts: list[bytes], name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts of a bucket, in the order of their names: the text of each window, its place in the text, and a class;
        equal windows share it. Equal windows have equal names."""

    def window_bytes(self, text: bytes, place: int) -> bytes:
        """One window of a text, as bytes that only equal windows have."""

    def rest(self, body: bytes, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple]:
        """Per line: units, removed units, removed stretches, and what is left."""


def names_of(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names of a block in order, and whether two of its lines hold the name."""
    order = np.lexsort((runs.line, runs.name))
    name, line = runs.name[order], runs.line[order]
    start = np.ones(len(name), bool)
    start[1:] = name[1:] != name[:-1]
    other = np.zeros(len(name), bool)
    other[1:] = ~start[1:] & (line[1:] != line[:-1])
    at = np.nonzero(start)[0]
    return name[at], np.add.reduceat(other, at) > 0 if len(at) else np.zeros(0, bool)


def text_sizes(text: bytes, runs: Runs) -> np.ndarray:
    """For each distinct name of a block in order, the bytes of its different texts as a power of two that holds them."""
    names, code, times = np.unique(runs.name, return_inverse=True, return_counts=True)
    size = (runs.text_hi - runs.text_lo).astype(np.int64)
    counts = np.ones(len(size), bool)
    # Only a name of several runs can have one text twice.
    several = np.nonzero(times[code] > 1)[0]
    seen: set[tuple[int, bytes]] = set()
    for i, c, lo, hi in zip(several.tolist(), code[several].tolist(), runs.text_lo[several].tolist(), runs.text_hi[several].tolist()):
        one = (c, text[lo:hi])
        counts[i] = one not in seen
        seen.add(one)
    total = np.bincount(code[counts], weights=size[counts], minlength=len(names))
    return np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "block_id": pa.int64(), "spans": pa.bool_(), "payload": pa.binary()}
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    return np.frombuffer(row["numbers"], np.int64), np.frombuffer(row["sizes"], np.int64), expand(row["body"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _of_name(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each name, and what tells it from others of its bucket: 40 bits, in the order of names.

    Buckets grow in number with the text, so 40 bits more are always enough to keep chance agreements rare; they would
    cost a look at windows that then differ, nothing else.
    """
    scaled = (names >> np.uint64(32)) * np.uint64(buckets)
    low = names >> np.uint64(24) & np.uint64(255)
    return (scaled >> np.uint64(32)).astype(np.int64), (scaled & np.uint64(0xFFFFFFFF)) << np.uint64(8) | low


def _planes(values: np.ndarray, width: int | None = None) -> bytes:
    """Whole numbers byte by byte, all first bytes first: sorted and small numbers compress better so."""
    size = values.dtype.itemsize
    data = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), size)
    return data[:, : width or size].T.tobytes()


def _from_planes(data: bytes, kind: type, count: int, at: int, width: int | None = None) -> np.ndarray:
    size = np.dtype(kind).itemsize
    out = np.zeros((count, size), np.uint8)
    out[:, : width or size] = np.frombuffer(data, np.uint8, count * (width or size), at).reshape(-1, count).T
    return out.view(kind)[:, 0] if count else np.zeros(0, kind)


def _asked(names: np.ndarray, sizes: np.ndarray, twice: np.ndarray) -> bytes:
    return squeeze(len(names).to_bytes(8, "little") + _planes(names, 5) + sizes.tobytes() + np.packbits(twice).tobytes())


def _answer(group: pa.Table, pieces_of: int, piece_bytes: int) -> pa.Table:
    """For each asked name: 0 if one line has it, else into how many pieces its texts are dealt."""
    asked = [expand(p) for p in group["payload"].to_pylist()]
    counts = [int(np.frombuffer(a, np.int64, 1)[0]) for a in asked]
    names = np.concatenate([_from_planes(a, np.uint64, n, 8, 5) for a, n in zip(asked, counts)])
    sizes = np.concatenate([np.frombuffer(a, np.uint8, n, 8 + 5 * n) for a, n in zip(asked, counts)])
    twice = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8, -1, 8 + 6 * n), count=n) for a, n in zip(asked, counts)])
    _, code, times = np.unique(names, return_inverse=True, return_counts=True)
    several = np.bincount(code, weights=twice, minlength=len(times)) > 0
    held = np.bincount(code, weights=np.exp2(sizes), minlength=len(times))
    wanted = np.maximum(-(-times // pieces_of), np.ceil(held / piece_bytes).astype(np.int64))
    pieces = np.where((times > 1) | several, np.minimum(wanted, 65_535), 0).astype(np.uint16)[code]
    ends = np.cumsum(counts)
    return pa.table(
        {
            "block_id": group["block_id"],
            "bucket": group["bucket"],
            "answer": pa.array([squeeze(pieces[e - n : e].tobytes()) for e, n in zip(ends, counts)], pa.binary()),
        }
    )


def _find(row: dict, scheme: Scheme, name_buckets: int, buckets: int) -> list[tuple]:
    """The texts of a block's shared runs by bucket, and the spans that it knows by itself, which any bucket passes on."""
    numbers, sizes, body = _block(row)
    runs, text = scheme.runs(body, sizes)
    names, _ = names_of(runs)
    parts = [np.frombuffer(expand(a["answer"]), np.uint16) for a in sorted(row["answers"] or [], key=lambda a: a["bucket"])]
    pieces = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
    if len(pieces) != len(names):
        raise ValueError(f"{len(pieces)} answers for {len(names)} names")
    pieces = pieces[np.searchsorted(names, runs.name)] if len(names) else pieces
    chosen = np.nonzero(pieces)[0]
    if not len(chosen):
        return []
    # Equal texts of the block become one class, which the smallest line number stands for.
    classes: dict[bytes, int] = {}
    spans = zip(runs.text_lo[chosen].tolist(), runs.text_hi[chosen].tolist())
    code = np.fromiter((classes.setdefault(text[lo:hi], len(classes)) for lo, hi in spans), np.int64, len(chosen))
    number = numbers[runs.line[chosen]]
    least = np.full(len(classes), NO_NUMBER)
    np.minimum.at(least, code, number)
    out = []
    later = number > least[code]
    if later.any():
        spans = _pack_spans(runs.first[chosen[later]], runs.count[chosen[later]])
        out.append((row["block_id"] % buckets, row["block_id"], True, spans))
    stays = np.nonzero(~later)[0]
    stays = stays[np.argsort(code[stays], kind="stable")]
    head = stays[np.unique(code[stays], return_index=True)[1]]  # the first run of each class
    bucket = scheme.bucket(text, runs, chosen[head], buckets)
    share = pieces[chosen[head]].astype(np.int64)
    bucket = (bucket + (row["block_id"] * 2_654_435_761 >> 8) % (1 << 40) % share) % buckets
    uses = np.bincount(code[stays], minlength=len(classes))
    starts = np.cumsum(uses) - uses
    texts = list(classes)
    order = np.argsort(bucket, kind="stable")
    used, cuts = np.unique(bucket[order], return_index=True)
    for b, own in zip(used.tolist(), np.split(order, cuts[1:])):
        payload = [
            np.array([len(own), uses[own].sum()], np.int64),
            least[own],
            (runs.name[chosen[head[own]]] >> np.uint64(32)).astype(np.uint32),
            share[own].astype(np.uint16),
            uses[own].astype(np.int32),
            np.array([len(texts[c]) for c in own], np.int32),
            runs.first[chosen[stays[ranges(starts[own], uses[own])]]].astype(np.int32),  # Spark's values end at two gigabytes
        ]
        data = payload[0].tobytes() + b"".join(map(_planes, payload[1:])) + b"".join(texts[c] for c in own)
        out.append((b, row["block_id"], False, squeeze(data, 3)))
    return out


def _pack_spans(first: np.ndarray, count: np.ndarray) -> bytes:
    return squeeze(np.concatenate([first, first + count - 1]).astype(np.int64).tobytes())


def _unpack_texts(data: bytes) -> tuple:
    n, m = np.frombuffer(data, np.int64, 2)
    at = 16
    columns = []
    for kind, size in ((np.int64, n), (np.uint32, n), (np.uint16, n), (np.int32, n), (np.int32, n), (np.int32, m)):
        columns.append(_from_planes(data, kind, int(size), at))
        at += columns[-1].nbytes
    ends = at + np.cumsum(columns[4].astype(np.int64))
    starts = ends - columns[4]
    return (*columns[:4], columns[5], [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())])


def _resolve(group: pa.Table, scheme: Scheme) -> pa.Table:
    """Covered spans by block, and first windows of names that other buckets hold too."""
    least, names, share, uses, first, texts, block = [], [], [], [], [], [], []
    out_block, out_payload = [], []
    for b, spans, payload in zip(*(group[c].to_pylist() for c in ("block_id", "spans", "payload"))):
        if spans:
            out_block.append(b)
            out_payload.append(payload)
            continue
        part = _unpack_texts(expand(payload))
        for kept, column in zip((least, names, share, uses, first), part[:5]):
            kept.append(column)
        texts += part[5]
        block += [b] * len(part[5])
    if not texts:
        return _found(out_block, out_payload, [])
    least, names, share, uses, first = (np.concatenate(x) for x in (least, names, share, uses, first))
    block = np.array(block, np.int64)
    starts = np.cumsum(uses.astype(np.int64)) - uses
    # Equal texts of several blocks: all but the smallest line are covered.
    classes: dict[bytes, int] = {}
    code = np.fromiter((classes.setdefault(t, len(classes)) for t in texts), np.int64, len(texts))
    smallest = np.full(len(classes), NO_NUMBER)
    np.minimum.at(smallest, code, least)
    class_name = np.zeros(len(classes), np.uint32)  # half a name is enough to tell which texts need a look
    class_name[code] = names
    class_share = np.zeros(len(classes), np.int64)
    np.maximum.at(class_share, code, share)
    distinct = list(classes)
    span_block, span_first, span_last = [], [], []

    def covered(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Cover windows lo..hi of each use of the texts in rows."""
        many = uses[rows].astype(np.int64)
        at = first[ranges(starts[rows], many)].astype(np.int64)
        span_block.append(np.repeat(block[rows], many))
        span_first.append(at + np.repeat(lo, many))
        span_last.append(at + np.repeat(hi, many))

    later = np.nonzero(least > smallest[code])[0]
    if len(later):
        lengths = scheme.lengths([texts[r] for r in later])
        covered(later, np.zeros(len(later), np.int64), lengths - 1)
    # Windows of different texts with one name, against each other.
    _, name_code, name_times = np.unique(class_name, return_inverse=True, return_counts=True)
    open_classes = np.nonzero((name_times[name_code] > 1) | (class_share > 1))[0]
    open_classes = open_classes[np.argsort(name_code[open_classes], kind="stable")]
    edge: list[tuple] = []
    if len(open_classes):
        text_of, place, kind = scheme.windows([distinct[c] for c in open_classes], name_code[open_classes])
        owner = open_classes[text_of]
        best = np.full(int(kind.max()) + 1 if len(kind) else 0, NO_NUMBER)
        np.minimum.at(best, kind, smallest[owner])
        hit = smallest[owner] > best[kind]
        standing = np.nonzero(least == smallest[code])[0]  # texts whose uses are still open
        by_class = standing[np.argsort(code[standing], kind="stable")]
        class_uses = np.bincount(code[standing], minlength=len(distinct))
        class_start = np.cumsum(class_uses) - class_uses
        if hit.any():
            where = np.nonzero(hit)[0]  # by text and place already
            begin = np.ones(len(where), bool)
            begin[1:] = (text_of[where[1:]] != text_of[where[:-1]]) | (place[where[1:]] != place[where[:-1]] + 1)
            lo = where[begin]
            hi = where[np.append(np.nonzero(begin)[0][1:] - 1, len(where) - 1)]
            rows = by_class[ranges(class_start[owner[lo]], class_uses[owner[lo]])]
            covered(rows, np.repeat(place[lo], class_uses[owner[lo]]), np.repeat(place[hi], class_uses[owner[lo]]))
        for w in np.nonzero(~hit & (class_share[owner] > 1))[0]:
            c = owner[w]
            for r in by_class[class_start[c] : class_start[c] + class_uses[c]]:
                for at in first[starts[r] : starts[r] + uses[r]]:
                    window = scheme.window_bytes(distinct[c], int(place[w]))
                    edge.append((int(block[r]), int(smallest[c]), int(at + place[w]), window))
    if span_block:
        by = np.concatenate(span_block)
        lo, hi = np.concatenate(span_first), np.concatenate(span_last)
        order = np.argsort(by, kind="stable")
        used, cuts = np.unique(by[order], return_index=True)
        for b, own in zip(used.tolist(), np.split(order, cuts[1:])):
            out_block.append(b)
            out_payload.append(_pack_spans(lo[own], hi[own] - lo[own] + 1))
    return _found(out_block, out_payload, edge)


def _found(blocks: list[int], payloads: list[bytes], edge: list[tuple]) -> pa.Table:
    none = [None] * len(blocks)
    return pa.table(
        {
            "block_id": pa.array(blocks + [e[0] for e in edge], pa.int64()),
            "payload": pa.array(payloads + [None] * len(edge), pa.binary()),
            "number": pa.array(none + [e[1] for e in edge], pa.int64()),
            "first": pa.array(none + [e[2] for e in edge], pa.int64()),
            "window": pa.array(none + [e[3] for e in edge], pa.binary()),
        }
    )


def without_repeats(
    lines: DataFrame, scheme: Scheme, *, pieces_of: int = 4096, piece_bytes: int = _TEXT_BYTES, carry: str | None = None
) -> DataFrame:
    """line_number, n_units, n_removed, n_spans, kept and line_md5 of each line; see the operators for the contract.

    A string column named by `carry` comes back beside its line, so that no join has to bring the two together.
    A name is dealt to one more bucket for each `pieces_of` blocks that hold it, or for each `piece_bytes` bytes of different
    texts that blocks have for it, whichever gives more buckets.
    """
    blocks = pack(lines, carry)
    name_buckets, buckets = buckets_for(blocks, _NAME_BYTES), buckets_for(blocks, _TEXT_BYTES)
    scheme.prepare(blocks, buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, sizes, body = _block(row)
            runs, text = scheme.runs(body, sizes)
            names, twice = names_of(runs)
            if len(names):
                bucket, short = _of_name(names, name_buckets)
                used, cuts = np.unique(bucket, return_index=True)
                held = text_sizes(text, runs)
                parts = zip(used.tolist(), *(np.split(x, cuts[1:]) for x in (short, held, twice)))
                yield _batch(
                    [
                        (b, row["block_id"], False, _asked(n, h, t))
                        for b, n, h, t in parts
                    ]
                )

    def answer(group: pa.Table) -> pa.Table:
        try:
            return _answer(group, pieces_of, piece_bytes)
        finally:
            release()

    def resolve(group: pa.Table) -> pa.Table:
        try:
            return _resolve(group, scheme)
        finally:
            release()

    answers = (
        blocks.select("block_id", "numbers", "sizes", "body")
        .mapInArrow(tidy(ask), _PIECE)
        .groupBy("bucket")
        .applyInArrow(answer, "block_id long, bucket int, answer binary")
        .groupBy("block_id")
        .agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if rows := _find(row, scheme, name_buckets, buckets):
                yield _batch(rows)

    resolved = materialise(
        blocks.join(answers, "block_id")
        .select("block_id", "numbers", "sizes", "body", "answers")
        .mapInArrow(tidy(find), _PIECE)
        .groupBy("bucket")
        .applyInArrow(
            resolve,
            "block_id long, payload binary, number long, first long, window binary",
        )
    )
    # Windows of names that were dealt to several buckets: the smallest line of all buckets keeps them.
    edges = resolved.where(F.col("window").isNotNull())
    least = edges.groupBy("window").agg(F.min("number").alias("least"))
    across = (
        edges.join(least, "window")
        .where(F.col("number") > F.col("least"))
        .groupBy("block_id")
        .agg(F.collect_list("first").alias("alone"))
    )
    spans = (
        resolved.where(F.col("payload").isNotNull())
        .groupBy("block_id")
        .agg(F.collect_list("payload").alias("spans"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            numbers, sizes, body = _block(row)
            parts = [np.frombuffer(expand(p), np.int64) for p in row["spans"] or []]
            alone = np.array(row["alone"] or [], np.int64)
            first = np.concatenate([p[: len(p) // 2] for p in parts] + [alone])
            last = np.concatenate([p[len(p) // 2 :] for p in parts] + [alone])
            rest = scheme.rest(body, sizes, first, last)
            ends = np.cumsum(sizes).tolist()
            digests = [hashlib.md5(body[e - s : e]).hexdigest() for e, s in zip(ends, sizes.tolist())]
            columns = {
                "line_number": number_column(numbers),
                **{c: pa.array([r[i] for r in rest], pa.int64()) for i, c in enumerate(("n_units", "n_removed", "n_spans"))},
                "kept": pa.array([r[3] for r in rest], pa.binary()),
                "line_md5": pa.array(digests, pa.string()),
            }
            if carry:
                columns[carry] = carried_column(row["carried"])
            yield pa.RecordBatch.from_pydict(columns)

    return (
        blocks.join(spans, "block_id", "left")
        .join(across, "block_id", "left")
        .select("numbers", "sizes", "body", *(["carried"] if carry else []), "spans", "alone")
        .mapInArrow(tidy(finish), _RESULT + (f", `{carry}` string" if carry else ""))
    )


def stretches(covered: np.ndarray) -> int:
    """Number of maximal runs of true."""
    return int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()) if len(covered) else 0


def cover(size: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Units covered by windows first..last."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, last + window, -1)
    return np.cumsum(change[:size]) > 0


def multikey_quicksort(key, size: int, depth: int, segments: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of items by `depth` key parts, and for each item a class that only equal items share.

    `key(items, level)` gives one whole number for each item at its level. All segments are split around their own
    pivots at once: smaller and larger parts stay at their level, equal parts go on to the next one. `segments` are the
    lengths of stretches of items, of which no two hold equal ones; items are then ordered within each.
    """
    order = np.arange(size)
    kind = np.full(size, -1, np.int64)
    length = np.array([size] if segments is None else segments, np.int64)
    length = length[length > 0]
    start, level = np.cumsum(length) - length, np.zeros(len(length), np.int64)
    while len(start):
        done = (level == depth) | (length == 1)
        at = ranges(start[done], length[done])
        kind[order[at]] = np.repeat(start[done], length[done])
        start, length, level = start[~done], length[~done], level[~done]
        if not len(start):
            break
        at = ranges(start, length)
        segment = np.repeat(np.arange(len(start)), length)
        items = order[at]
        value = key(items, level[segment])
        base = np.cumsum(length) - length
        three = np.sort(np.stack([value[base], value[base + length // 2], value[base + length - 1]]), axis=0)
        pivot = three[1][segment]
        less, same = value < pivot, value == pivot
        n_less, n_same = np.add.reduceat(less, base, dtype=np.int64), np.add.reduceat(same, base, dtype=np.int64)
        before_less, before_same = np.cumsum(less) - less, np.cumsum(same) - same
        rank_less = before_less - before_less[base][segment]
        rank_same = before_same - before_same[base][segment]
        rank_more = at - start[segment] - rank_less - rank_same
        place = np.where(
            less, rank_less, np.where(same, n_less[segment] + rank_same, (n_less + n_same)[segment] + rank_more)
        )
        order[start[segment] + place] = items
        n_more = length - n_less - n_same
        start = np.concatenate([start, start + n_less, start + n_less + n_same])
        length = np.concatenate([n_less, n_same, n_more])
        level = np.concatenate([level, level + 1, level])
        some = length > 0
        start, length, level = start[some], length[some], level[some]
    return order, kind
