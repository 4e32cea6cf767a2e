"""Phrases that occur together, mined by set-oriented joins of occurrence relations.

The relation of length 1 holds each word of each piece of text with its place, in the order of piece and position; the
relation of length k + 1 is the merge join of the relation of length k with the words at the next position of the same
piece, after phrases below the wanted count have left both. A relation is kept in blocks of text, written once for each
length; inside a block the merge join is a shift of sorted arrays, since no piece leaves its block. Counting groups is a
shuffle: blocks send their different phrases with counts to hash buckets, and a bucket answers which are frequent. Most
pairs of frequent words are rare, so pairs are first counted by hash slot; a pair whose slot stays below the wanted count
cannot be frequent, and the relation is cut between its words.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count as counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import buckets_for, expand, squeeze
from tidemark.llm.settings import release, tidy
from tidemark.llm.word_blocks import pack_numbers, runs, split_words, unpack_numbers, word_order
from tidemark.sources.scratch import materialise

_BLOCK_BYTES = 8 << 20
_BUCKET_BYTES = 16 << 20
_KNOWN = -1  # the bucket that stands for a block's frequent words
_SLOTS = 1 << 20  # hash slots of a bucket, about half as many as its text has words
_BREAK = b"\n"
# Lower case for A-Z; every character that ends a piece becomes a line break.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 9)
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, 0x09, 0x0A]] = True

_BLOCKS = "block_id long, phrase_group string, n_bytes long, n_words long, words binary, counts binary, places binary"
_ASKED = "bucket int, block_id long, phrase_group string, payload binary"
_ANSWERED = "bucket int, block_id long, payload binary"
_STEP = (
    "kind string, bucket int, block_id long, phrase_group string, payload binary, phrase binary, length int, "
    "phrase_id long, a long, firsts array<long>, rests array<long>"
)


def mine_phrases(
    lines: DataFrame,
    *,
    group: str = "label",
    min_count: int = 30,
    max_words: int = 4,
    drop_percent: int = 80,
    top: int = 2000,
    missing_group: str = "und",
) -> DataFrame:
    """The best-scored phrases of 2 to `max_words` words of raw transaction lines, for each value of `group`.

    `lines` needs line (string) and the column `group`, such as the label of a deployment's lines; null groups count as
    `missing_group`. Letters A-Z are lower-cased, lines are split at .,;:!? and line breaks into pieces and those at
    blanks and tabs into words. Phrases with a count `a` of at least `min_count` are candidates; cut after its first k
    words, a candidate has the counts l and r of its parts and the score floor(2000000 * a / (l + r)). The lowest cut
    counts, ties to the smallest k. A candidate inside a longer one whose count is at least `drop_percent` percent of
    its own is dropped, be the longer one dropped or not.

    Returns `group` as string, rank, phrase, a, l, r, n (words of the group) and score, the first `top` of each group by
    score and a, falling, and phrase. Counts and scores are exact: counts are 64-bit, products decimals.

    Null and empty lines have no words. Repeated lines count each time. Extra columns are ignored; an empty table gives
    no rows. Lines are whole; a block of more than 8 MB is cut between pieces.
    """
    rows = lines.select(
        F.coalesce(F.col(group).cast("string"), F.lit(missing_group)).alias("phrase_group"), F.col("line").cast("string")
    )
    blocks = materialise(rows.mapInArrow(tidy(_write_blocks), _BLOCKS))
    buckets = buckets_for(blocks, _BUCKET_BYTES)
    asked = blocks.select("block_id", "phrase_group", "words", "counts").mapInArrow(tidy(_ask_words(buckets)), _ASKED)
    relation = blocks.select("block_id", "phrase_group", "words", "places").groupBy("block_id")
    known = asked.groupBy("bucket").applyInArrow(_answer_words(min_count, buckets), _ANSWERED)
    step = materialise(relation.cogroup(known.groupBy("block_id")).applyInArrow(_ask_slots(buckets), _STEP))
    hot = _asked_of(step).groupBy("bucket").applyInArrow(_answer_slots(min_count), _ANSWERED)
    known = step.where(F.col("kind") == "state").select(F.lit(_KNOWN).alias("bucket"), "block_id", "payload")
    step = materialise(relation.cogroup(hot.unionByName(known).groupBy("block_id")).applyInArrow(_sift(buckets), _STEP))
    steps = []
    for length in range(2, max_words + 1):
        answers = _asked_of(step).groupBy("bucket").applyInArrow(_answer_pairs(min_count, buckets), _ANSWERED)
        advance = _advance(length, max_words, drop_percent, buckets)
        step = materialise(_state_of(step).groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(advance, _STEP))
        steps.append(step)
    result = reduce(DataFrame.unionByName, steps)
    # Each phrase comes from one block; longer ones name the phrases inside them that must go.
    dropped = result.where(F.col("kind") == "drop").select("length", "phrase_id").distinct()
    found = result.where(F.col("kind") == "found").join(dropped, ["length", "phrase_id"], "left_anti")
    words = blocks.groupBy("phrase_group").agg(F.sum("n_words").alias("n"))
    return _best(found, top).join(words, "phrase_group").select(
        F.col("phrase_group").alias(group), "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _state_of(step: DataFrame) -> DataFrame:
    return step.where(F.col("kind") == "state").select("block_id", "payload")


def _asked_of(step: DataFrame) -> DataFrame:
    return step.where(F.col("kind") == "ask").select("bucket", "block_id", "phrase_group", "payload")


def _best(found: DataFrame, top: int) -> DataFrame:
    """Scores of all cuts, the lowest of each phrase, and the first phrases of each group."""
    score = "cast(2000000 as decimal(20,0)) * a div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    cuts = F.expr(
        "transform(arrays_zip(firsts, rests), (c, i) -> named_struct('score', "
        + score.replace("cast(l ", "cast(c.firsts ").replace("cast(r ", "cast(c.rests ")
        + ", 'k', i + 1, 'l', c.firsts, 'r', c.rests))"
    )
    scored = found.select("phrase_group", F.col("phrase").cast("string"), "a", F.array_min(cuts).alias("cut")).select(
        "phrase_group", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score")
    )
    # The limit on the rank is applied before the shuffle too, so a group brings at most `top` rows of each task.
    order = Window.partitionBy("phrase_group").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Relations of length 1: lines of one group are gathered until they fill a block."""
    numbers = counter(TaskContext.get().partitionId() << 33)
    gathered: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for batch in batches:
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if line:
                gathered[name].append(line)
                size += len(line)
        if size >= _BLOCK_BYTES:
            yield from _blocks_of(gathered, numbers)
            gathered.clear()
            size = 0
    yield from _blocks_of(gathered, numbers)


def _blocks_of(gathered: dict[str, list[bytes]], numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
    for name, texts in gathered.items():
        data = _BREAK.join(texts).translate(_PLAIN)
        at = 0
        while at < len(data):
            end = len(data) if len(data) - at <= 2 * _BLOCK_BYTES else data.find(_BREAK, at + _BLOCK_BYTES)
            end = len(data) if end < 0 else end
            yield _block(next(numbers), name, data[at:end])
            at = end + 1


def _block(number: int, name: str, data: bytes) -> pa.RecordBatch:
    """Words of a block by falling count, their counts, and which word stands at each place; -1 lies between pieces."""
    codes: dict[bytes, int] = defaultdict(counter().__next__)
    words = data.split()
    flat = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
    raw = np.frombuffer(data, np.uint8)
    gap = _GAPS[raw]
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    piece = np.searchsorted(np.flatnonzero(raw == 0x0A), starts)
    places = np.full(len(flat) + np.count_nonzero(np.diff(piece)), -1, np.int32)
    places[np.arange(len(flat)) + np.cumsum(np.diff(piece, prepend=piece[:1]) != 0)] = flat
    counts = np.bincount(flat, minlength=len(codes)).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    names = list(codes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([name], pa.string()),
            pa.array([len(data)], pa.int64()),
            pa.array([len(flat)], pa.int64()),
            pa.array([squeeze(b" ".join([names[i] for i in order.tolist()]))], pa.binary()),
            pa.array([pack_numbers(counts[order])], pa.binary()),
            pa.array([pack_numbers(rank[places] + 1)], pa.binary()),
        ],
        names=["block_id", "phrase_group", "n_bytes", "n_words", "words", "counts", "places"],
    )


def _seed(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode())


def _ask_words(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.array(split_words(row["words"]), object)
                counts = unpack_numbers(row["counts"])[0]
                order, bucket = word_order(words.tolist(), buckets, _seed(row["phrase_group"]))
                out = [(b, b" ".join(words[order[s]]), counts[order[s]]) for b, s in runs(bucket)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in out], pa.int32()),
                        pa.array([row["block_id"]] * len(out), pa.int64()),
                        pa.array([row["phrase_group"]] * len(out), pa.string()),
                        pa.array([squeeze(pickle.dumps((w, pack_numbers(n)))) for _, w, n in out], pa.binary()),
                    ],
                    names=["bucket", "block_id", "phrase_group", "payload"],
                )

    return asked


def _answer_words(min_count: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def answered(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block_id"])
        codes: dict[tuple[str, bytes], int] = defaultdict(counter().__next__)
        asked, counts = [], []
        for row in rows:
            words, packed = pickle.loads(expand(row["payload"]))
            n = unpack_numbers(packed)[0]
            asked.append(np.fromiter((codes[row["phrase_group"], w] for w in words.split(b" ")), np.int64, len(n)))
            counts.append(n)
        # Numbers follow the order of the words, so that a task that runs again gives the same.
        place = np.empty(len(codes), np.int64)
        place[[codes[key] for key in sorted(codes)]] = np.arange(len(codes))
        return _answer(rows, [place[a] for a in asked], counts, min_count, buckets)

    return _released(answered)


def _answer_pairs(min_count: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def answered(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block_id"])
        asked = [unpack_numbers(row["payload"]) for row in rows]
        both = _pair_codes(np.concatenate([np.cumsum(a[0]) for a in asked]), np.concatenate([a[1] for a in asked]))
        codes = np.unique(both, return_inverse=True)[1].reshape(-1)
        ends = np.cumsum([len(a[0]) for a in asked])[:-1]
        return _answer(rows, np.split(codes, ends), [a[2] for a in asked], min_count, buckets)

    return _released(answered)


def _released(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group that gives its memory back afterwards."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return function(group)
        finally:
            release()

    return run


def _pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers, in the order of pairs."""
    wide = int(second.max(initial=0)) + 1
    if (int(first.max(initial=0)) + 1) * wide >= 1 << 63:
        first, second = (np.unique(x, return_inverse=True)[1].reshape(-1) for x in (first, second))
        wide = int(second.max(initial=0)) + 1
    return first.astype(np.int64) * wide + second


def _answer(
    rows: list[dict], codes: list[np.ndarray], counts: list[np.ndarray], min_count: int, buckets: int
) -> pa.Table:
    """For each block of a bucket: which asked phrases are frequent, their numbers and counts, and who speaks for them.

    A number is a phrase's place among the frequent ones of its bucket, times the number of buckets, plus the bucket.
    The block of the smallest number that asked for a phrase reports it.
    """
    flat = np.concatenate(codes)
    total = np.zeros(int(flat.max(initial=-1)) + 1, np.int64)
    np.add.at(total, flat, np.concatenate(counts))
    frequent = total >= min_count
    number = (np.cumsum(frequent) - 1) * buckets + (rows[0]["bucket"] if rows else 0)
    speaker = np.full(len(total), len(rows), np.int64)
    out = []
    for i, asked in enumerate(codes):
        known = np.flatnonzero(frequent[asked])
        its = asked[known]
        speaks = speaker[its] == len(rows)
        speaker[its] = np.minimum(speaker[its], i)
        out.append(pack_numbers(known, number[its], total[its], speaks))
    return pa.table(
        {
            "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
            "block_id": pa.array([r["block_id"] for r in rows], pa.int64()),
            "payload": pa.array(out, pa.binary()),
        }
    )


def _advance(length: int, max_words: int, drop_percent: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """From the answers on phrases of `length` words to the frequent ones' reports and the questions on longer ones.

    A block's state has, for each shorter length, which frequent phrase starts at each place, and the numbers and counts
    of those phrases. The open questions follow from it.
    """

    def advanced(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            raise ValueError("answers without a block")
        block, state = left["block_id"][0].as_py(), _loaded(left["payload"][0].as_py())
        levels = state["levels"]
        start, which, phrase, _, _, bucket = _questions(levels, buckets)
        known, ids, counts, speaks = _known(right, {b: s.start for b, s in runs(bucket)})
        renamed = np.full(len(phrase) + 1, -1, np.int32)
        renamed[known] = np.arange(len(known))
        at = np.full(len(levels[0][0]), -1, np.int32)
        at[start] = renamed[which]
        levels.append((at, ids, counts))
        out = _rows_out()
        _report(out, state["name"], state["words"], levels, speaks.astype(bool), drop_percent)
        if length < max_words:
            _ask_longer(out, block, state, buckets)
        return pa.table(out, schema=_STEP_SCHEMA)

    return advanced


def _known(answers: pa.Table, starts: dict[int, int]) -> tuple[np.ndarray, ...]:
    """Frequent phrases among a block's questions: place in asking order, number, count, and whether it speaks."""
    rows = sorted((r for r in answers.to_pylist() if r["bucket"] != _KNOWN), key=lambda r: r["bucket"])
    parts = [unpack_numbers(r["payload"]) for r in rows]
    for row, part in zip(rows, parts):
        part[0] = part[0] + starts[row["bucket"]]
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))


_STEP_SCHEMA = pa.schema(
    [
        ("kind", pa.string()), ("bucket", pa.int32()), ("block_id", pa.int64()), ("phrase_group", pa.string()),
        ("payload", pa.binary()), ("phrase", pa.binary()), ("length", pa.int32()), ("phrase_id", pa.int64()),
        ("a", pa.int64()), ("firsts", pa.list_(pa.int64())), ("rests", pa.list_(pa.int64())),
    ]
)


def _rows_out() -> dict[str, list]:
    return {name: [] for name in _STEP_SCHEMA.names}


def _put(out: dict[str, list], **values) -> None:
    for name, column in out.items():
        column.append(values.get(name))


def _first_state(left: pa.Table, buckets: int) -> tuple[dict, np.ndarray, np.ndarray, dict[int, int]]:
    """State of a block without any length, which word stands at each place, the words in asking order, and where each
    bucket's words start in it."""
    row = left.to_pylist()[0]
    words = split_words(row["words"])
    order, bucket = word_order(words, buckets, _seed(row["phrase_group"]))
    state = {"name": row["phrase_group"], "words": words, "levels": []}
    return state, unpack_numbers(row["places"])[0] - 1, order, {b: s.start for b, s in runs(bucket)}


def _with_words(state: dict, at: np.ndarray, order: np.ndarray, known: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
    """Put in the relation of length 1, without infrequent words; frequent ones keep their order by count."""
    words = order[known]
    by_count = np.argsort(words)
    renamed = np.full(len(state["words"]) + 1, -1, np.int32)
    renamed[words[by_count]] = np.arange(len(words))
    state["words"] = [state["words"][i] for i in words[by_count].tolist()]
    state["levels"] = [(renamed[at], ids[by_count], counts[by_count])]


def _packed(name: str, words: list[bytes], levels: list[tuple]) -> bytes:
    """A state: the words at each place, and for longer phrases which phrase and word they consist of."""
    at = levels[0][0]
    parts = [pack_numbers(at.astype(np.int64) + 1, *levels[0][1:])]
    for shorter, (places, ids, counts) in zip(levels, levels[1:]):
        first = np.zeros(len(ids), np.int64)
        where = np.flatnonzero(places >= 0)[::-1]
        first[places[where]] = where
        parts.append(pack_numbers(shorter[0][first], at[first + len(parts)], ids, counts))
    return squeeze(pickle.dumps((name, b" ".join(words), parts)), 3)


def _loaded(payload: bytes) -> dict:
    """A state with the phrases at each place, found again from the phrase and word they consist of."""
    name, words, parts = pickle.loads(expand(payload))
    at, ids, counts = unpack_numbers(parts[0])
    levels = [((at - 1).astype(np.int32), ids, counts)]
    for part in parts[1:]:
        shorter, word, ids, counts = unpack_numbers(part)
        known = shorter * len(levels[0][1]) + word
        order = np.argsort(known)
        places = np.full(len(at), -1, np.int32)
        before, after = levels[-1][0][: len(at) - len(levels)], levels[0][0][len(levels) :]
        start = np.flatnonzero((before >= 0) & (after >= 0))
        code = before[start].astype(np.int64) * len(levels[0][1]) + after[start]
        if len(known):
            near = np.minimum(np.searchsorted(known[order], code), len(known) - 1)
            hit = known[order][near] == code
            places[start[hit]] = order[near[hit]]
        levels.append((places, ids, counts))
    return {"name": name, "words": words.split(b" ") if words else [], "levels": levels}


def _report(
    out: dict[str, list], name: str, words: list[bytes], levels: list[tuple], speaks: np.ndarray, drop_percent: int
) -> None:
    """Rows of the frequent phrases that this block speaks for, and of the phrases inside them that must go."""
    length = len(levels)
    at, ids, counts = levels[-1]
    first = np.full(len(ids), -1, np.int64)
    where = np.flatnonzero(at >= 0)[::-1]
    first[at[where]] = where
    for phrase in np.flatnonzero(speaks).tolist():
        start, a = int(first[phrase]), int(counts[phrase])

        def count_of(offset: int, size: int) -> tuple[int, int]:
            places, numbers, totals = levels[size - 1]
            inside = places[start + offset]
            return int(numbers[inside]), int(totals[inside])

        text = b" ".join(words[levels[0][0][start + i]] for i in range(length))
        cuts = range(1, length)
        _put(
            out, kind="found", phrase_group=name, phrase=text, length=length, phrase_id=int(ids[phrase]), a=a,
            firsts=[count_of(0, k)[1] for k in cuts], rests=[count_of(k, length - k)[1] for k in cuts],
        )
        for size in range(2, length):
            for offset in range(length - size + 1):
                number, total = count_of(offset, size)
                if 100 * a >= drop_percent * total:
                    _put(out, kind="drop", length=size, phrase_id=number)


def _mixed(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    mixed = (phrase.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def _questions(levels: list[tuple], buckets: int) -> tuple[np.ndarray, ...]:
    """Merge join with the next word, where both the phrase and the one a word later are frequent.

    Returns the places that ask, the question of each, and the questions in asking order: phrase, word, times, bucket.
    """
    (word_at, word_ids, _), (at, ids, _) = levels[0], levels[-1]
    start = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    pair, which, times = np.unique(
        at[start].astype(np.int64) * len(word_ids) + word_at[start + len(levels)], return_inverse=True, return_counts=True
    )
    phrase, word = ids[pair // max(1, len(word_ids))], word_ids[pair % max(1, len(word_ids))]
    bucket = ((_mixed(phrase, word) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket * (int(phrase.max(initial=0)) + 1) + phrase, kind="stable")
    place = np.empty(len(pair), np.int32)
    place[order] = np.arange(len(pair))
    return start, place[which.reshape(-1)], phrase[order], word[order], times[order], bucket[order]


def _slots_of(phrase: np.ndarray, word: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Different hash slots of the pairs of one bucket, and the place of each pair's slot among them."""
    slot = (_mixed(phrase[part], word[part]) & np.uint64(_SLOTS - 1)).astype(np.int64)
    used, place = np.unique(slot, return_inverse=True)
    return used, place.reshape(-1)


def _ask_slots(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Counts of a block's pairs of frequent words by hash slot, and its frequent words."""

    def asked(left: pa.Table, right: pa.Table) -> pa.Table:
        block, out = left["block_id"][0].as_py(), _rows_out()
        state, at, order, starts = _first_state(left, buckets)
        known, ids, counts, _ = _known(right, starts)
        _with_words(state, at, order, known, ids, counts)
        _, _, phrase, word, times, bucket = _questions(state["levels"], buckets)
        for b, s in runs(bucket):
            used, place = _slots_of(phrase, word, s)
            total = np.zeros(len(used), np.int64)
            np.add.at(total, place, times[s])
            _put(out, kind="ask", bucket=b, block_id=block, payload=pack_numbers(np.diff(used, prepend=0), total))
        _put(out, kind="state", block_id=block, payload=pack_numbers(known, ids, counts))
        return pa.table(out, schema=_STEP_SCHEMA)

    return asked


def _answer_slots(min_count: int) -> Callable[[pa.Table], pa.Table]:
    """Which of the asked slots of a bucket reach the wanted count."""

    def answered(group: pa.Table) -> pa.Table:
        total, asked = np.zeros(_SLOTS, np.int64), []
        for payload in group["payload"].to_pylist():
            gaps, counts = unpack_numbers(payload)
            asked.append(np.cumsum(gaps))
            np.add.at(total, asked[-1], counts)
        bits = [squeeze(np.packbits(total[a] >= min_count).tobytes()) for a in asked]
        return pa.table({"bucket": group["bucket"], "block_id": group["block_id"], "payload": pa.array(bits, pa.binary())})

    return _released(answered)


def _sift(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Cut the relation between words whose pair cannot be frequent, and ask about the pairs that are left."""

    def sifted(left: pa.Table, right: pa.Table) -> pa.Table:
        state, at, order, _ = _first_state(left, buckets)
        answers = {r["bucket"]: r["payload"] for r in right.to_pylist()}
        _with_words(state, at, order, *unpack_numbers(answers.pop(_KNOWN)))
        start, which, phrase, word, _, bucket = _questions(state["levels"], buckets)
        bits = {b: np.frombuffer(expand(payload), np.uint8) for b, payload in answers.items()}
        hot = np.zeros(len(phrase), bool)
        for b, s in runs(bucket):
            used, place = _slots_of(phrase, word, s)
            hot[s] = np.unpackbits(bits[b], count=len(used)).astype(bool)[place]
        (at, ids, counts) = state["levels"][0]
        joined = np.zeros(len(at), bool)
        joined[start[hot[which]]] = True
        # A word keeps its place if it is joined to the next or the one before; -1 follows the last of each chain.
        kept = joined.copy()
        kept[1:] |= joined[:-1]
        times = np.where(joined[kept], 1, 2)
        places = np.repeat(at[kept], times)
        places[np.cumsum(times)[times == 2] - 1] = -1
        out = _rows_out()
        state["levels"] = [(places, ids, counts)]
        _ask_longer(out, left["block_id"][0].as_py(), state, buckets)
        return pa.table(out, schema=_STEP_SCHEMA)

    return sifted


def _ask_longer(out: dict[str, list], block: int, state: dict, buckets: int) -> None:
    """Questions on phrases of one more word, and the state without what no question needs."""
    levels = state["levels"]
    start, _, phrase, word, times, bucket = _questions(levels, buckets)
    if not len(start):
        return
    for b, s in runs(bucket):
        asked = pack_numbers(np.diff(phrase[s], prepend=0), word[s], times[s])
        _put(out, kind="ask", bucket=b, block_id=block, phrase_group=state["name"], payload=asked)
    # Places that no question covers are cut out; one -1 keeps what is left apart.
    covered = np.zeros(len(levels[0][0]) + 1, bool)
    for i in range(len(levels) + 1):
        covered[start + i] = True
    left = covered.copy()
    left[1:] |= covered[:-1]
    kept = []
    inside = covered.copy()
    for size, (places, ids, counts) in enumerate(levels, start=1):
        if size > 1:  # a phrase stays where all its words do
            inside[: 1 - size] &= covered[size - 1 :]
            inside[1 - size :] = False
        places = np.where(inside, np.append(places, np.int32(-1)), np.int32(-1))[left]
        used = np.zeros(len(ids) + 1, bool)
        used[places] = True
        used[-1] = False
        renamed = np.where(used, np.cumsum(used) - 1, -1).astype(np.int32)
        kept.append((renamed[places], ids[used[:-1]], counts[used[:-1]]))
        if len(kept) == 1:
            words = [w for w, u in zip(state["words"], used.tolist()) if u]
    _put(out, kind="state", block_id=block, phrase_group=state["name"], payload=_packed(state["name"], words, kept))
