"""Near-duplicate lines by HyperMinHash.

A line's set of word shingles is kept as 256 registers. A register belongs to a share of the hash space and holds the
smallest hash in it as 6 bits of leading zeros and 10 bits of mantissa. Bands of registers find candidates; a Jaccard
estimate corrected for registers that agree by chance drops most wrong ones; full sets decide the rest.

Lines with equal sets are one class first. Within a bucket of a band, classes are compared with the smallest class, and
once these links are known only classes that are still in different groups are compared. No group's pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import chunks, line_rows, number_column
from tidemark.llm.settings import tidy
from tidemark.sources.scratch import materialise

REGISTERS = 256
MANTISSA_BITS = 10
_REGISTER_BITS = 8
_STRETCH_BYTES = 2 << 20
_CHUNK = 1024  # classes of a bucket that are compared at once
_SHORT = 5  # bytes of a shingle hash that travel to the comparison; every link found by them is confirmed on words
_MISS = 1e-8  # chance that a pair at the threshold shares no band
_FACTORS = np.random.default_rng(3).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_rows(similarity: float) -> int:
    """Registers of a band: the most that miss a pair at the threshold with a chance of at most one in 10^8."""
    fitting = [r for r in range(1, 17) if (1 - similarity**r) ** (REGISTERS // r) <= _MISS]
    return max(fitting, default=1)


def _mix(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(31))
    value = value * _FACTORS[0]
    value = value ^ (value >> np.uint64(29))
    value = value * _FACTORS[1]
    return value ^ (value >> np.uint64(32))


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, flat, and their number by text.

    A-Z become small. A text with fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    parts = [t.lower().split() for t in texts]
    codes: dict[bytes, int] = {}
    n = np.array([len(p) for p in parts], np.int64)
    code = np.fromiter((codes.setdefault(w, len(codes)) for p in parts for w in p), np.int64, int(n.sum()))
    named = np.array([xxhash.xxh3_64_intdigest(w) for w in codes], np.uint64)
    word = named[code] if len(code) else np.zeros(0, np.uint64)
    shingles = np.maximum(n - width + 1, np.minimum(n, 1))
    line = np.repeat(np.arange(len(parts)), shingles)
    first = np.cumsum(n) - n
    start = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
    end = np.minimum(start + width, np.repeat(first + n, shingles))
    value = np.zeros(len(start), np.uint64)
    for i in range(width):
        here = start + i < end
        at = np.minimum(start + i, max(0, len(word) - 1))
        # The place counts, and a missing word differs from any word.
        value = _mix(value * _FACTORS[2 + i % 14] + np.where(here, word[at], np.uint64(i)))
    order = np.lexsort((value, line))
    value, line = value[order], line[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (line[1:] != line[:-1])
    return value[fresh], np.bincount(line[fresh], minlength=len(parts))


def registers(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers of sets given by their hashes in order: 0 is empty, else leading zeros and mantissa of the smallest."""
    out = np.zeros((len(counts), REGISTERS), np.uint16)
    line = np.repeat(np.arange(len(counts)), counts)
    share = (value >> np.uint64(64 - _REGISTER_BITS)).astype(np.int64)
    head = np.ones(len(value), bool)
    head[1:] = (line[1:] != line[:-1]) | (share[1:] != share[:-1])  # hashes are in order, so the first is the smallest
    rest = (value[head] << np.uint64(_REGISTER_BITS)).astype(np.float64) + 1.0
    fraction, exponent = np.frexp(rest)
    zeros = np.clip(64 - exponent, 0, 62)
    mantissa = np.minimum(((fraction - 0.5) * (2 << MANTISSA_BITS)).astype(np.int64), (1 << MANTISSA_BITS) - 1)
    out[line[head], share[head]] = (((63 - zeros) << MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


def filled(sketches: np.ndarray) -> np.ndarray:
    """Registers with the empty ones borrowed from others, each along its own fixed random order; for banding only."""
    random = np.random.default_rng(256)
    out = sketches.copy()
    for _ in range(4 * REGISTERS):
        empty = out == 0
        if not empty.any():
            break
        rows = np.nonzero(empty.any(axis=1))[0]
        out[rows] = np.where(empty[rows], sketches[rows][:, random.integers(0, REGISTERS, REGISTERS)], out[rows])
    for shift in range(1, REGISTERS):  # sets of very few shingles
        if (out != 0).all():
            break
        out = np.where(out == 0, np.roll(sketches, shift, axis=1), out)
    return out


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each set and band."""
    bands = REGISTERS // rows
    full = filled(sketches)[:, : bands * rows].reshape(len(sketches), bands, rows).astype(np.uint64)
    key = np.zeros((len(sketches), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = _mix(key * _FACTORS[3] + full[:, :, i])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, without the agreements to be expected by chance."""
    some = (a != 0) | (b != 0)
    union = np.maximum(some.sum(axis=1), 1)
    same = ((a == b) & some).sum(axis=1)
    # Smallest hashes of a share follow exponentials of these rates; cells of one level are equally wide.
    rate_a, rate_b = size_a[:, None] / REGISTERS, size_b[:, None] / REGISTERS
    top = 2.0 ** -np.arange(0, 40)[None, :]
    both = rate_a + rate_b
    chance = (
        rate_a * rate_b / both * (top / 2) / (1 << MANTISSA_BITS) * (np.exp(-both * top / 2) - np.exp(-both * top))
    ).sum(axis=1)
    share = same / union
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _least_estimate(similarity: float, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Below this estimate a pair is not checked: five standard errors under the threshold, from the registers in use."""
    used = REGISTERS * (1 - np.exp(-np.maximum(size_a, size_b) / REGISTERS))
    return similarity - 5 * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1)) - 0.02


def _sketch_column(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def link_lines(
    lines: DataFrame, *, shingle_words: int, similarity_percent: int, chunk: int = _CHUNK
) -> DataFrame:
    """Groups of near-duplicate raw transaction lines.

    `lines` needs line_number (whole number) and line (string). A line's set holds its distinct shingles of
    `shingle_words` words, A-Z made small; words are runs of bytes other than ASCII white space. Lines are linked if
    100 * intersection >= `similarity_percent` * union, which is confirmed on full sets. Returns one row for each row of
    `lines`: line_number, n_shingles, component_id (smallest line number reachable over links, its own included) and
    kept (line_number = component_id).

    Null and empty lines, and lines without words, have no shingles and no links. Rows with a null line number are
    linked with nothing and have a null component_id and kept true. Rows with one line number are one node. Extra
    columns are ignored; an empty table gives no rows. `chunk` only sets how many classes are compared at once.
    """
    spark = lines.sparkSession
    rows = lines.select(F.col("line_number").cast("long"), F.col("line").cast("string"))
    similarity = similarity_percent / 100

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, raw = line_rows(batch)
            for lo, hi in chunks([len(r) for r in raw], _STRETCH_BYTES):
                value, counts = shingle_hashes(raw[lo:hi], shingle_words)
                kept = registers(value, counts)
                ends = np.cumsum(counts)
                digests = [xxhash.xxh3_128_digest(value[e - c : e].tobytes()) for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        number_column(numbers[lo:hi]),
                        pa.array(counts.astype(np.int64)),
                        pa.array(digests, pa.binary()),
                        pa.array([s.tobytes() for s in kept], pa.binary()),
                    ],
                    names=["line_number", "n_shingles", "set_id", "sketch"],
                )

    sketches = materialise(
        rows.mapInArrow(tidy(sketched), "line_number long, n_shingles long, set_id binary, sketch binary")
    )
    linkable = sketches.where((F.col("n_shingles") > 0) & F.col("line_number").isNotNull())
    # One class for each distinct set; its smallest line stands for it.
    classes = materialise(
        linkable.groupBy("set_id")
        .agg(F.min(F.struct("line_number", "n_shingles", "sketch")).alias("least"))
        .select("set_id", "least.line_number", "least.n_shingles", "least.sketch")
    )
    members = linkable.select("set_id", "line_number").join(
        classes.select("set_id", F.col("line_number").alias("class_id")), "set_id"
    )
    copies = members.where(F.col("line_number") != F.col("class_id")).select(
        F.col("line_number").alias("a"), F.col("class_id").alias("b")
    )
    band = band_rows(similarity)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                keys = band_keys(_sketch_column(part.column(1)), band)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel()),
                        pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])),
                    ],
                    names=["band", "class_id"],
                )

    bands = classes.select("line_number", "sketch").mapInArrow(tidy(banded), "band long, class_id long")
    # Buckets of two classes or more; the others can't hold a pair.
    shared = (
        bands.groupBy("band")
        .agg(F.min("class_id").alias("head"), F.count("*").alias("n"))
        .where((F.col("n") > 1))
        .select("band", "head")
    )
    buckets = materialise(bands.join(shared, "band"))
    first_pairs = (
        buckets.where(F.col("head") != F.col("class_id"))
        .select(F.col("head").alias("a"), F.col("class_id").alias("b"))
        .distinct()
    )
    asked = buckets.select(F.col("class_id").alias("line_number")).distinct()
    texts = materialise(rows.join(asked, "line_number", "left_semi"))
    checked = _estimated(first_pairs, classes, similarity)
    links = materialise(_confirmed(checked, texts, shingle_words, similarity_percent))
    groups = materialise(components(links))

    # Classes of one bucket in different groups: compare those outside the head's group with all the others.
    group_of = groups.select(F.col("node").alias("class_id"), "component")
    grouped = (
        buckets.join(group_of, "class_id", "left")
        .withColumn("component", F.coalesce("component", "class_id"))
        .select("band", "class_id", "head", "component")
    )
    mixed = (
        grouped.groupBy("band")
        .agg(
            F.count("*").alias("n"),
            F.min("component").alias("lowest"),
            F.max("component").alias("highest"),
            F.max(F.when(F.col("class_id") == F.col("head"), F.col("component"))).alias("main"),
        )
        .where((F.col("n") > 2) & (F.col("lowest") != F.col("highest")))
    )
    open_rows = materialise(
        grouped.join(mixed.select("band", "main"), "band").select(
            "band",
            "class_id",
            "component",
            (F.col("component") != F.col("main")).alias("outside"),
            (F.col("class_id") == F.col("head")).alias("is_head"),
        )
    )
    sizes = open_rows.groupBy("band").agg(
        F.ceil(F.count_if("outside") / chunk).alias("outer"), F.ceil(F.count_if(~F.col("outside")) / chunk).alias("inner")
    )
    hashed = F.xxhash64("class_id")
    dealt = open_rows.select("band", "class_id", "component", "outside", "is_head").join(sizes, "band")
    # An outer class meets every chunk of its bucket, an inner one only the outer chunks.
    own = F.when(F.col("outside"), F.pmod(hashed, "outer")).otherwise(F.col("outer") + F.pmod(hashed, "inner"))
    against = F.when(
        F.col("outside"), F.sequence(F.lit(0).cast("long"), F.col("outer") + F.col("inner") - 1)
    ).otherwise(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1))
    cells = (
        dealt.withColumn("own", own)
        .withColumn("other", F.explode(against))
        .select(
            "band",
            F.least("own", "other").alias("left"),
            F.greatest("own", "other").alias("right"),
            "own",
            "class_id",
            "component",
            "is_head",
        )
    )

    def hashed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, raw = line_rows(batch)
            for lo, hi in chunks([len(r) for r in raw], _STRETCH_BYTES):
                value, counts = shingle_hashes(raw[lo:hi], shingle_words)
                short = np.ascontiguousarray(value.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :_SHORT].tobytes()
                ends = _SHORT * np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers[lo:hi]),
                        pa.array([s.tobytes() for s in registers(value, counts)], pa.binary()),
                        pa.array([short[e - _SHORT * c : e] for e, c in zip(ends.tolist(), counts.tolist())], pa.binary()),
                    ],
                    names=["class_id", "sketch", "shingles"],
                )

    sets = texts.mapInArrow(tidy(hashed_sets), "class_id long, sketch binary, shingles binary")
    more = (
        cells.join(sets, "class_id")
        .groupBy("band", "left", "right")
        .applyInArrow(lambda group: _across_groups(group, band, similarity_percent), "a long, b long")
        .distinct()
    )
    more_links = materialise(_confirmed(more, texts, shingle_words, similarity_percent))
    final = materialise(components(links.unionByName(more_links).unionByName(copies)))
    found = sketches.select("line_number", "n_shingles")
    return (
        found.join(final.withColumnRenamed("node", "line_number"), "line_number", "left")
        .select(
            "line_number",
            "n_shingles",
            F.coalesce("component", "line_number").alias("component_id"),
            F.coalesce(F.coalesce("component", "line_number") == F.col("line_number"), F.lit(True)).alias("kept"),
        )
    )


def _estimated(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose estimate is not clearly below the threshold."""
    side = classes.select("line_number", "n_shingles", "sketch")
    both = pairs.join(side.toDF("b", "size_b", "sketch_b"), "b").join(side.toDF("a", "size_a", "sketch_a"), "a")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                size_a, size_b = (part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
                value = estimate(_sketch_column(part.column(4)), _sketch_column(part.column(5)), size_a, size_b)
                close = value >= _least_estimate(similarity, size_a, size_b)
                close &= np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-6
                yield part.select([0, 1]).filter(pa.array(close))

    columns = ("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
    return both.select(*columns).mapInArrow(tidy(near), "a long, b long")


def _across_groups(group: pa.Table, rows: int, similarity_percent: int) -> pa.Table:
    """Links between two chunks of a bucket that join different groups.

    A pair is looked at in the first band that it shares, and not where one is the head, whose pairs are known. A link
    joins its groups at once, so that at most one link is given for each two groups.
    """
    own, head = group["own"].to_numpy(), group["is_head"].to_numpy(zero_copy_only=False)
    number, component = group["class_id"].to_numpy(), group["component"].to_numpy().copy()
    sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    shingles = group["shingles"].to_pylist()
    size = np.array([len(x) // _SHORT for x in shingles], np.int64)
    keys = band_keys(sketch, rows)
    place = int((keys[0] == group["band"][0].as_py()).argmax())
    left, right = (np.nonzero((own == group[side][0].as_py()) & ~head)[0] for side in ("left", "right"))
    sets: dict[int, frozenset] = {}

    def members(i: int) -> frozenset:
        if i not in sets:
            sets[i] = frozenset(shingles[i][at : at + _SHORT] for at in range(0, len(shingles[i]), _SHORT))
        return sets[i]

    out_a, out_b = [], []
    for i in left:
        j = right[component[right] != component[i]]
        j = j[100 * np.minimum(size[j], size[i]) >= similarity_percent * np.maximum(size[j], size[i])]
        j = j[(keys[j] == keys[i]).argmax(axis=1) == place] if len(j) else j
        if not len(j):
            continue
        own_size, other_size = np.full(len(j), float(size[i])), size[j].astype(float)
        value = estimate(np.broadcast_to(sketch[i], (len(j), REGISTERS)), sketch[j], own_size, other_size)
        for k in j[value >= _least_estimate(similarity_percent / 100, own_size, other_size)]:
            if component[k] == component[i]:
                continue
            shared = len(members(i) & members(k))
            if 100 * shared >= similarity_percent * (size[i] + size[k] - shared):
                out_a.append(min(number[i], number[k]))
                out_b.append(max(number[i], number[k]))
                component[component == component[k]] = component[i]
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity_percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets of words are similar enough."""
    both = (
        pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, set] = (b"", set())
        for batch in batches:
            keep = []
            for text_a, text_b in zip(*(batch.column(i).cast(pa.binary()) for i in (2, 3))):
                a, b = text_a.as_py(), text_b.as_py()
                if a != last[0]:
                    last = (a, full_set(a, shingle_words))
                other = full_set(b, shingle_words)
                shared = len(last[1] & other)
                keep.append(100 * shared >= similarity_percent * (len(last[1]) + len(other) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(close), "a long, b long").distinct()


def full_set(text: bytes, width: int) -> set[bytes]:
    """The distinct shingles of a text, as their words."""
    words = text.lower().split()
    if len(words) <= width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def components(links: DataFrame) -> DataFrame:
    """node and component (smallest node it reaches) for every node of the links (a, b).

    Each round gives a node the smallest label of itself and its neighbours and then that label's own label, so that
    long chains shorten by half. Rounds are written to the checkpoint folder; they end when no label changes.
    """
    edges = materialise(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("before")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        step = materialise(
            lower.join(jump, "component", "left").select(
                "node", F.least("component", F.coalesce("beyond", "component")).alias("component"), "before"
            )
        )
        changed = step.where(F.col("component") != F.col("before")).limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
