"""Language-model scores of raw transaction lines by a class-based bigram model.

Words are clustered by the exchange method: each word moves to the class that raises the likelihood of the training
lines most, given how often classes follow each other. Blocks of lines keep their bigrams; hash buckets keep the words.
In a round, buckets tell blocks the classes of their words, blocks send back how often each word is next to each class,
and buckets move their words one group after the other, most frequent first, on a copy of the class counts. A round
whose classes fit the training lines no better than those before is not taken. What travels to the driver is the matrix
of class counts, whose size is fixed by the number of classes.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import buckets_for, chunks, expand, line_rows, number_column, squeeze
from tidemark.llm.settings import release, tidy
from tidemark.llm.word_blocks import runs, split_words, word_order
from tidemark.sources.scratch import materialise

_BLOCK_BYTES = 4 << 20  # a block's words times twice the classes are held as one matrix
_BUCKET_BYTES = 8 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Classes with a fixed meaning: the end of a line, and words that training lines hold rarely or never.
_END_CLASS, _RARE_CLASS, _FIRST_FREE = 0, 1, 2
_DISCOUNT = 0.5
_CHUNK_WORDS, _CHUNK_SHARE = 1024, 200

_BLOCKS = (
    "block_id long, n_bytes long, numbers binary, lengths binary, held_out binary, words binary, counts binary, "
    "tokens binary, train_lines long"
)
_ASKED = "kind string, bucket int, block_id long, payload binary"
_LEXICON = "kind string, bucket int, place int, amount long, n_types long, n_tokens long, n_once long, payload binary"
_ROUND = "kind string, bucket int, block_id long, payload binary"
_ANSWERED = "bucket int, block_id long, payload binary"
_SCORED = (
    "line_number long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


@dataclass(frozen=True)
class Totals:
    """Counts of the training lines: tokens, different tokens, words seen once, lines."""

    tokens: int
    types: int
    once: int
    lines: int


def score_lines(
    lines: DataFrame, *, classes: int = 64, rounds: int = 3, rare_below: int = 3, folds: int = 5, held_out_fold: int = 1
) -> DataFrame:
    """log10 probability of each raw transaction line under a class-based bigram model of the training lines.

    `lines` needs line_number (whole number) and line (string). Lines whose crc32(line_number as text) modulo `folds` is
    `held_out_fold` are held out; the model learns from all others. Letters A-Z are lower-cased; tokens are the words
    between white space, then one end. A token's probability is that of its class after the class of the token before
    (absolute discounting towards the class's own share), times its share of its class. Words seen fewer than
    `rare_below` times in training share the class of unknown words, where an unknown word weighs as much as all words
    seen once; all other words are clustered into classes by exchange, in at most `rounds` rounds. `classes` counts the
    class of ends and that of rare words. Probabilities of all known words, the end and one unknown word add up to 1.

    Returns, for each row: line_number, held_out, n_tokens, n_known (tokens that training lines hold), train_tokens,
    base_score (sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens) and score; the perplexity of a line is
    10 ** (-score / n_tokens).

    Null and empty lines have one token, the end. Lines of null number are training lines. Repeated rows and numbers
    count and return each time; extra columns are ignored; an empty table gives no rows. If no line is left for
    training, all words are unknown and classes equally likely. Lines are whole, whatever their length.
    """
    if classes < _FIRST_FREE + 1:
        raise ValueError("at least one class must be free")
    held_out = F.pmod(F.crc32(F.col("line_number").cast("long").cast("string").cast("binary")), F.lit(folds)) == held_out_fold
    rows = lines.select(
        F.col("line_number").cast("long"), F.col("line").cast("string"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    blocks = materialise(rows.mapInArrow(tidy(_write_blocks), _BLOCKS))
    buckets = buckets_for(blocks, _BUCKET_BYTES)
    asked = materialise(blocks.select("block_id", "words", "counts", "tokens", "lengths", "held_out").mapInArrow(tidy(_ask(buckets)), _ASKED))
    lexicon = materialise(
        asked.where(F.col("kind") == "ask").groupBy("bucket").applyInArrow(_count_words(classes, rare_below), _LEXICON)
    )
    totals = _totals(lexicon, blocks)
    state = materialise(_with_seeds(lexicon, classes, rare_below))
    bigrams = asked.where(F.col("kind") == "bigrams").select("block_id", "payload")
    state, matrix = _exchange(bigrams, state, classes, rounds)
    answers = _told(state, with_counts=True)
    scored = blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(
        _score(_model(matrix, totals, classes, rare_below), totals, buckets), _SCORED
    )
    return scored


def _write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers_of = counter(TaskContext.get().partitionId() << 33)
    kept: list[tuple[np.ndarray, list[bytes], np.ndarray]] = []
    size = 0
    for batch in batches:
        numbers, texts = line_rows(batch)
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in chunks([len(t) for t in texts], _BLOCK_BYTES):
            kept.append((numbers[lo:hi], texts[lo:hi], held[lo:hi]))
            size += sum(map(len, texts[lo:hi]))
            if size >= _BLOCK_BYTES:
                yield _block(next(numbers_of), kept)
                kept, size = [], 0
    if kept:
        yield _block(next(numbers_of), kept)


def _block(number: int, kept: list[tuple[np.ndarray, list[bytes], np.ndarray]]) -> pa.RecordBatch:
    """Words of a block, how often its training lines hold each, and the words of each line by their place."""
    numbers = np.concatenate([k[0] for k in kept])
    held = np.concatenate([k[2] for k in kept])
    codes: dict[bytes, int] = defaultdict(counter().__next__)
    parts, n_bytes = [], 0
    for _, texts, _ in kept:
        for text in texts:
            words = text.translate(_LOWER).split()
            n_bytes += len(text)
            parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
    lengths = np.array([len(p) for p in parts], np.int64)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    trained = np.repeat(~held, lengths)
    counts = np.bincount(tokens[trained], minlength=len(codes)).astype(np.int64)
    data = [numbers, lengths, held, None, counts, tokens]
    packed = [pa.array([squeeze(x.tobytes() if x is not None else b" ".join(codes))], pa.binary()) for x in data]
    head = [pa.array([number], pa.int64()), pa.array([n_bytes], pa.int64())]
    return pa.RecordBatch.from_arrays(
        [*head, *packed, pa.array([int((~held).sum())], pa.int64())],
        names=["block_id", "n_bytes", "numbers", "lengths", "held_out", "words", "counts", "tokens", "train_lines"],
    )


def _sequence(row: dict, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all lines in a row with an end after each line, the ends' places, and which lines are held out.

    Words are numbered by `place`; the end is the number after the last word.
    """
    lengths = np.frombuffer(expand(row["lengths"]), np.int64)
    held = np.frombuffer(expand(row["held_out"]), bool)
    words = place[np.frombuffer(expand(row["tokens"]), np.int32)]
    ends = np.cumsum(lengths + 1) - 1
    out = np.full(len(words) + len(lengths), len(place), np.int64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = words
    return out, ends, held


def _places(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, bucket = word_order(words, buckets)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return order, bucket, place


def _ask(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Questions about the words of each block, and its training bigrams, a line's first word after an end."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = split_words(row["words"])
                counts = np.frombuffer(expand(row["counts"]), np.int64)
                order, bucket, place = _places(words, buckets)
                names = np.array(words, object)
                out = [
                    ("ask", b, squeeze(pickle.dumps((b" ".join(names[order[s]]), counts[order[s]])))) for b, s in runs(bucket)
                ]
                token, ends, held = _sequence(row, place)
                before = np.concatenate([[len(words)], token[:-1]])
                trained = np.repeat(~held, np.diff(ends, prepend=-1))
                pair, times = np.unique(before[trained] * (len(words) + 1) + token[trained], return_counts=True)
                first, second = np.divmod(pair, len(words) + 1)
                starts = {b: s.start for b, s in runs(bucket)}
                data = (len(words), starts, np.diff(first, prepend=0).astype(np.int32), second.astype(np.int32), times.astype(np.int32))
                out.append(("bigrams", -1, squeeze(pickle.dumps(data))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in out], pa.string()),
                        pa.array([x[1] for x in out], pa.int32()),
                        pa.array([row["block_id"]] * len(out), pa.int64()),
                        pa.array([x[2] for x in out], pa.binary()),
                    ],
                    names=["kind", "bucket", "block_id", "payload"],
                )

    return asked


def _count_words(classes: int, rare_below: int) -> Callable[[pa.Table], pa.Table]:
    """Training counts of a bucket's words, who asked for which, and its most frequent words."""

    def counted(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block_id"])
        codes: dict[bytes, int] = defaultdict(counter().__next__)
        places, counts = [], []
        for row in rows:
            words, n = pickle.loads(expand(row["payload"]))
            places.append(np.fromiter(map(codes.__getitem__, words.split(b" ")), np.int32, len(n)))
            counts.append(n)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, np.concatenate(places), np.concatenate(counts))
        # Words are numbered by falling count and then by their letters, which a task that runs again finds alike.
        words = np.array(list(codes), object)
        order = np.array(sorted(range(len(words)), key=lambda i: (-total[i], words[i])), np.int64)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        total = total[order]
        state = {"blocks": [r["block_id"] for r in rows], "asked": [place[p] for p in places], "counts": total}
        bucket = rows[0]["bucket"]
        most = [("top", bucket, i, int(n), 0, 0, 0, None) for i, n in enumerate(total[:classes].tolist()) if n >= rare_below]
        known = total > 0
        out = [("state", bucket, -1, 0, int(known.sum()), int(total.sum()), int((total == 1).sum()), _pack(state)), *most]
        return _table(_LEXICON_SCHEMA, out)

    return _released(counted)


_LEXICON_SCHEMA = pa.schema(
    [
        ("kind", pa.string()), ("bucket", pa.int32()), ("place", pa.int32()), ("amount", pa.int64()),
        ("n_types", pa.int64()), ("n_tokens", pa.int64()), ("n_once", pa.int64()), ("payload", pa.binary()),
    ]
)
_ROUND_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block_id", pa.int64()), ("payload", pa.binary())])
_ANSWER_SCHEMA = pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("payload", pa.binary())])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _pack(data: object) -> bytes:
    return squeeze(pickle.dumps(data))


def _unpack(payload: bytes):
    return pickle.loads(expand(payload))


def _released(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        try:
            return function(group)
        finally:
            release()

    return run


def _totals(lexicon: DataFrame, blocks: DataFrame) -> Totals:
    sums = lexicon.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_types").alias("types"), F.sum("n_once").alias("once")).first()
    lines = blocks.agg(F.sum("train_lines")).first()[0] or 0
    return Totals((sums["tokens"] or 0) + lines, (sums["types"] or 0) + (lines > 0), sums["once"] or 0, lines)


def _with_seeds(lexicon: DataFrame, classes: int, rare_below: int) -> DataFrame:
    """First classes: each of the most frequent words its own, all other frequent words the last one."""
    top = lexicon.where(F.col("kind") == "top").orderBy(F.desc("amount"), "bucket", "place").limit(classes - _FIRST_FREE - 1)
    seeds = defaultdict(list)
    for number, row in enumerate(top.select("bucket", "place").collect()):  # fewer than there are classes
        seeds[row["bucket"]].append((row["place"], _FIRST_FREE + number))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                state = _unpack(row["payload"])
                found = np.where(state["counts"] >= rare_below, classes - 1, _RARE_CLASS).astype(np.int32)
                for place, number in seeds[row["bucket"]]:
                    found[place] = number
                yield _table(_ROUND_SCHEMA, [("state", row["bucket"], -1, _pack(state | {"classes": found}))]).to_batches()[0]

    return lexicon.where(F.col("kind") == "state").select("bucket", "payload").mapInArrow(tidy(seeded), _ROUND)


def _told(state: DataFrame, with_counts: bool = False) -> DataFrame:
    """Answers to the blocks: the class (and training count) of each asked word."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = _unpack(row["payload"])
                for block, asked in zip(known["blocks"], known["asked"]):
                    data = (known["classes"][asked].astype(np.uint16), known["counts"][asked] if with_counts else None)
                    yield _table(_ANSWER_SCHEMA, [(row["bucket"], block, _pack(data))]).to_batches()[0]

    return state.select("bucket", "payload").mapInArrow(tidy(told), _ANSWERED)


def _exchange(bigrams: DataFrame, state: DataFrame, classes: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Rounds of exchange until one brings nothing or all are done; the words' last classes and their class counts."""
    best = None
    for number in range(rounds + 1):
        seen = materialise(
            bigrams.groupBy("block_id")
            .cogroup(_told(state).groupBy("block_id"))
            .applyInArrow(_neighbours(classes, last=number == rounds), _ROUND)
        )
        matrix = _summed(seen.where(F.col("kind") == "matrix"), classes)
        fit = _fit(matrix)
        if best is not None and fit <= best[0]:
            break
        best = fit, state, matrix
        if number < rounds:
            vectors = seen.where(F.col("kind") == "vectors").select("bucket", "block_id", "payload")
            states = state.select("bucket", "payload")
            state = materialise(
                states.groupBy("bucket").cogroup(vectors.groupBy("bucket")).applyInArrow(_move_words(matrix, number), _ROUND)
            )
    return best[1], best[2]


def _neighbours(classes: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Class bigram counts of a block, and how often each of its words stands before and after each class."""

    def seen(left: pa.Table, right: pa.Table) -> pa.Table:
        size, starts, first, second, times = _unpack(left["payload"][0].as_py())
        first = np.cumsum(first.astype(np.int64))
        of = np.full(size + 1, _END_CLASS, np.int64)
        answers = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        for row in answers:
            found = _unpack(row["payload"])[0]
            of[starts[row["bucket"]] : starts[row["bucket"]] + len(found)] = found
        matrix = np.bincount(of[first] * classes + of[second], times, classes * classes)
        block = left["block_id"][0].as_py()
        out = [("matrix", -1, block, squeeze(matrix.astype(np.int64).tobytes()))]
        if not last:
            wide = 2 * classes
            own = first != second
            times = times[own]
            cells = np.bincount(first[own] * wide + of[second[own]], times, (size + 1) * wide)
            cells += np.bincount(second[own] * wide + classes + of[first[own]], times, (size + 1) * wide)
            cells = cells.reshape(size + 1, wide)
            cells[of < _FIRST_FREE] = 0  # ends and rare words don't move
            for row in answers:
                lo = starts[row["bucket"]]
                part = cells[lo : lo + len(_unpack(row["payload"])[0])].ravel()
                at = np.flatnonzero(part)
                if len(at):
                    data = np.diff(at, prepend=0).astype(np.int32), part[at].astype(np.int32)
                    out.append(("vectors", row["bucket"], block, _pack(data)))
        return _table(_ROUND_SCHEMA, out)

    return seen


def _summed(matrices: DataFrame, classes: int) -> np.ndarray:
    """Class bigram counts of all blocks: classes x classes numbers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                total += np.frombuffer(expand(payload), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "amount"])

    cells = matrices.select("payload").mapInArrow(tidy(summed), "cell long, amount long")
    out = np.zeros(classes * classes)
    for row in cells.groupBy("cell").agg(F.sum("amount").alias("amount")).collect():
        out[row["cell"]] = row["amount"]
    return out.reshape(classes, classes)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _fit(matrix: np.ndarray) -> float:
    """The part of the training lines' log likelihood that depends on the classes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(axis=0)).sum() - _xlogx(matrix.sum(axis=1)).sum())


def _move_words(matrix: np.ndarray, number: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Exchange of a bucket's words, in the order of their counts, on a copy of the class counts."""
    classes = len(matrix)

    def moved(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            bucket, state = left["bucket"][0].as_py(), _unpack(left["payload"][0].as_py())
            words, cells, amounts = _vectors(state, right.to_pylist(), 2 * classes)
            if number:  # buckets don't see each other's moves; later rounds move every other word
                turn = (words + number) % 2 == 0
                words, cells, amounts = words[turn], cells[turn], amounts[turn]
            state["classes"] = exchange(matrix.copy(), state["classes"], state["counts"], words, cells, amounts)
            return _table(_ROUND_SCHEMA, [("state", bucket, -1, _pack(state))])
        finally:
            release()

    return moved


def _vectors(state: dict, rows: list[dict], wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's vectors from those of its blocks: word, class it follows or is followed by, and count, in order."""
    asked = dict(zip(state["blocks"], state["asked"]))
    keys, amounts = [], []
    for row in rows:
        at, amount = _unpack(row["payload"])
        place, cell = np.divmod(np.cumsum(at.astype(np.int64)), wide)
        keys.append(asked[row["block_id"]][place].astype(np.int64) * wide + cell)
        amounts.append(amount)
    if not keys:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which.reshape(-1), np.concatenate(amounts), len(key))
    word, cell = np.divmod(key, wide)
    return word, cell, total


def exchange(
    matrix: np.ndarray, of: np.ndarray, counts: np.ndarray, words: np.ndarray, cells: np.ndarray, amounts: np.ndarray
) -> np.ndarray:
    """Classes after each word has moved to the class where it raises the fit of the class counts most.

    `words`, `cells` and `amounts` are the words' neighbours in the order of words: cell c is a word before class c, cell
    classes + c a word after it. Words are dealt in groups that hold at most a 200th of all neighbours, or one word.
    """
    classes, of = len(matrix), of.copy()
    starts = np.flatnonzero(np.diff(words, prepend=-1))
    mass = np.add.reduceat(amounts, starts) if len(starts) else np.zeros(0)
    most = mass.sum() / _CHUNK_SHARE
    ends = [*starts[1:].tolist(), len(words)]
    lo = 0
    while lo < len(starts):
        hi, held = lo + 1, mass[lo]
        while hi < len(starts) and hi - lo < _CHUNK_WORDS and held + mass[hi] <= most:
            held += mass[hi]
            hi += 1
        part = slice(starts[lo], ends[hi - 1])
        row = np.repeat(np.arange(hi - lo), np.diff([*starts[lo:hi], ends[hi - 1]]))
        own = np.zeros((hi - lo, 2 * classes))
        own[row, cells[part]] = amounts[part]
        _move(matrix, of, words[starts[lo:hi]], own, row, cells[part], amounts[part])
        lo = hi
    return of


def _move(
    matrix: np.ndarray, of: np.ndarray, words: np.ndarray, own: np.ndarray, row: np.ndarray, cell: np.ndarray, amount: np.ndarray
) -> None:
    """Move a group of words at once and change the class counts."""
    classes = len(matrix)
    both = np.concatenate([matrix.T, matrix])  # row c: all classes before class c; row classes + c: all after it
    fits = _xlogx(both)
    gain = np.zeros((len(words), classes))
    before = both[cell]
    np.add.at(gain, row, _xlogx(before + amount[:, None]) - fits[cell])
    here = of[words]
    # Staying is weighed as leaving and coming back, on counts without the word.
    with_it = before[np.arange(len(cell)), here[row]]
    stay = np.bincount(row, _xlogx(with_it) - _xlogx(np.maximum(with_it - amount, 0)), len(words))
    after, follow = own[:, :classes].sum(axis=1), own[:, classes:].sum(axis=1)
    for sums, mine in ((matrix.sum(axis=1), after), (matrix.sum(axis=0), follow)):
        gain -= _xlogx(sums + mine[:, None]) - _xlogx(sums)
        stay -= _xlogx(sums[here]) - _xlogx(np.maximum(sums[here] - mine, 0))
    gain[:, :_FIRST_FREE] = -np.inf
    each = np.arange(len(words))
    gain[each, here] = stay
    best = gain.argmax(axis=1)
    go = np.flatnonzero(gain[each, best] > stay + 1e-9 * np.abs(stay))
    for w in go.tolist():
        old, new = here[w], best[w]
        matrix[old] -= own[w, :classes]
        matrix[new] += own[w, :classes]
        matrix[:, old] -= own[w, classes:]
        matrix[:, new] += own[w, classes:]
    np.maximum(matrix, 0, out=matrix)
    of[words[go]] = best[go]


@dataclass(frozen=True)
class ClassModel:
    """log10 of the class after a class, of a class's tokens, and of an unknown word in the class of rare words."""

    follow: np.ndarray
    tokens: np.ndarray
    unknown: float


def _model(matrix: np.ndarray, totals: Totals, classes: int, rare_below: int) -> ClassModel:
    tokens = matrix.sum(axis=0)
    share = (tokens + 0.5) / (tokens.sum() + 0.5 * classes)
    before = matrix.sum(axis=1, keepdims=True)
    kept = np.maximum(matrix - _DISCOUNT, 0)
    rest = np.minimum(matrix, _DISCOUNT).sum(axis=1, keepdims=True)
    follow = np.where(before > 0, (kept + rest * share) / np.maximum(before, 1), share)
    new = totals.once + 0.5
    weight = tokens.copy()
    weight[_RARE_CLASS] += new
    with np.errstate(divide="ignore"):
        return ClassModel(np.log10(follow), np.log10(weight), float(np.log10(new) - np.log10(weight[_RARE_CLASS])))


def _score(model: ClassModel, totals: Totals, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return _score_block(left.to_pylist()[0], right.to_pylist(), model, totals, buckets)
        finally:
            release()

    return scored


def _score_block(row: dict, answers: list[dict], model: ClassModel, totals: Totals, buckets: int) -> pa.Table:
    words = split_words(row["words"])
    _, bucket, place = _places(words, buckets)
    starts = {b: s.start for b, s in runs(bucket)}
    of = np.full(len(words) + 1, _END_CLASS, np.int64)
    counts = np.full(len(words) + 1, totals.lines, np.int64)
    for answer in answers:
        classes, known = _unpack(answer["payload"])
        at = slice(starts[answer["bucket"]], starts[answer["bucket"]] + len(classes))
        of[at], counts[at] = classes, known
    with np.errstate(divide="ignore", invalid="ignore"):
        emitted = np.where(counts > 0, np.log10(counts) - model.tokens[of], model.unknown)
    emitted[-1] = 0.0  # the end is the only token of its class
    token, ends, held = _sequence(row, place)
    before = np.concatenate([[len(words)], token[:-1]])
    log = model.follow[of[before], of[token]] + emitted[token]
    base = np.log10((counts + 0.5) / (totals.tokens + 0.5 * (totals.types + 1)))[token]
    first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    numbers = np.frombuffer(expand(row["numbers"]), np.int64)
    return pa.table(
        {
            "line_number": number_column(numbers),
            "held_out": pa.array(held),
            "n_tokens": pa.array(ends - first + 1),
            "n_known": pa.array(np.add.reduceat((counts > 0)[token].astype(np.int64), first)),
            "train_tokens": pa.array(np.full(len(ends), totals.tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, first)),
            "score": pa.array(np.add.reduceat(log, first)),
        }
    )
