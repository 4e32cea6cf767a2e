import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import no_lines, odd_lines, ordered
from tidemark.llm.recompression import Symbols, WordScheme, compress_pairs, compress_runs, remove_repeated_words
from tidemark.llm.blocks import expand, squeeze
from tidemark.llm.repeats import Runs, _answer, _asked, multikey_quicksort, text_sizes, without_repeats
from tidemark.llm import suffix_array
from tidemark.llm.suffix_array import ByteScheme, remove_repeated_bytes


def brute_force(rows, window, words):
    units = [(n if n is not None else 1 << 63, n, (t or "").encode()) for n, t in rows]
    units = [(k, n, u.split() if words else u) for k, n, u in units]
    key = (lambda u, i: tuple(u[i : i + window])) if words else (lambda u, i: u[i : i + window])
    first = {}
    for k, _, u in units:
        for i in range(len(u) - window + 1):
            first[key(u, i)] = min(first.get(key(u, i), 1 << 64), k)
    out = []
    for k, n, u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if first[key(u, i)] < k:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(u, gone) if not g]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        data = b" ".join(kept) if words else bytes(kept)
        out.append((n, len(u), sum(gone), spans, hashlib.sha256(data).hexdigest()))
    return ordered(out)


def found(lines, operator, window, **options):
    columns = ("line_number", "n_units", "n_removed", "n_spans", F.sha2("kept", 256))
    return ordered(operator(lines, window=window, **options).select(*columns).collect())


def repetitive_lines(seed):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "the", "of", "é", "x\n", "word"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = [text(rng.randrange(80)) for _ in range(6)]
    rows = []
    for i in range(60):
        head = rng.choice(["", "a" * rng.randrange(300), "ab" * rng.randrange(90), "a " * rng.randrange(60), text(50)])
        rows.append((i, head + rng.choice(shared)[rng.randrange(30) :] + rng.choice(["", text(8)]) + rng.choice(shared)))
    return rows + [(None, shared[0] * 2), (500, None), (501, ""), (3, shared[1] * 3), (3, shared[1] * 3)]


@pytest.mark.parametrize("operator, window, words", [(remove_repeated_bytes, 50, False), (remove_repeated_words, 13, True)])
@pytest.mark.parametrize("pieces_of", [4096, 1])
def test_removal_is_that_of_brute_force(spark, operator, window, words, pieces_of):
    rows = repetitive_lines(pieces_of)
    lines = spark.createDataFrame(rows, "line_number long, line string").repartition(3)
    assert found(lines, operator, window, pieces_of=pieces_of) == brute_force(rows, window, words)


@pytest.mark.parametrize("operator, window, words", [(remove_repeated_bytes, 50, False), (remove_repeated_words, 13, True)])
def test_odd_lines(spark, operator, window, words):
    lines = odd_lines(spark)
    rows = [(r["line_number"], r["line"]) for r in lines.collect()]
    assert found(lines, operator, window) == brute_force(rows, window, words)
    assert found(no_lines(spark), operator, window) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=300), st.integers(1, 4))
def test_multikey_quicksort_orders_and_classes_items(values, depth):
    keys = np.array(values + values[: len(values) % depth] * depth)[: len(values) // depth * depth].reshape(-1, depth)
    order, kind = multikey_quicksort(lambda items, level: keys[items, level], len(keys), depth)
    rows = [tuple(keys[i]) for i in order]
    assert rows == sorted(map(tuple, keys.tolist()))
    classes = {}
    for i, row in enumerate(keys.tolist()):
        assert classes.setdefault(tuple(row), kind[i]) == kind[i]
    assert len(set(kind.tolist())) == len({tuple(r) for r in keys.tolist()})


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=13), st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
def test_equal_windows_have_equal_names_wherever_they_stand(window, before, after):
    scheme = WordScheme(13)
    alone = " ".join(map(str, window)).encode()
    inside = " ".join(map(str, before + window + after)).encode()
    runs, _ = scheme.runs(alone + inside, np.array([len(alone), len(inside)]))
    named = {}
    for line, first, count, name in zip(runs.line, runs.first, runs.count, runs.name):
        for at in range(first, first + count):
            named[int(line), int(at)] = name
    assert named[0, 0] == named[1, 13 + len(before)]


def test_rounds_shorten_lines():
    rng = np.random.default_rng(2)
    name = rng.integers(1, 1 << 60, 5000, dtype=np.uint64)
    place = np.arange(5000)
    symbols = Symbols(name, np.zeros(5000, np.int64), place, place)
    for salt in range(2):
        symbols = compress_pairs(compress_runs(symbols), salt)
    assert len(symbols.name) < 0.65 * 5000
    assert (np.diff(symbols.low) >= 0).all() and (np.diff(symbols.high) >= 0).all()


def test_a_name_is_dealt_by_the_bytes_of_its_different_texts():
    # One name with 500 different texts of 20 bytes and 500 copies of one text, and a name of one text.
    different = b"".join(b"%020d" % i for i in range(500))
    text = different + b"x" * 20 * 500 + b"y" * 20
    at = np.arange(1001) * 20
    name = np.array([1] * 1000 + [2], np.uint64)
    runs = Runs(np.arange(1001), at, np.ones(1001, int), name, at, at + 20)
    sizes = text_sizes(text, runs)
    assert sizes.tolist() == [14, 5]  # 10,020 and 20 bytes
    asked = _asked(np.unique(name), sizes, np.array([True, False]))
    group = pa.table({"block_id": [0, 1], "bucket": pa.array([0, 0], pa.int32()), "payload": [asked, asked]})
    pieces = [np.frombuffer(expand(a), np.uint16).tolist() for a in _answer(group, 4096, 4096)["answer"].to_pylist()]
    assert pieces == [[8, 1], [8, 1]]


@pytest.mark.parametrize("scheme, words", [(ByteScheme(50), False), (WordScheme(13), True)])
def test_pieces_by_bytes_give_what_brute_force_gives(spark, scheme, words):
    rows = repetitive_lines(9)
    lines = spark.createDataFrame(rows, "line_number long, line string").repartition(5)
    kept = without_repeats(lines, scheme, piece_bytes=100)
    columns = ("line_number", "n_units", "n_removed", "n_spans", F.sha2("kept", 256))
    assert ordered(kept.select(*columns).collect()) == brute_force(rows, scheme.window, words)


@pytest.mark.parametrize("ranges, buckets", [(4, 37), (4096, 37), (1, 5)])
def test_ranges_of_tokens_share_out_the_buckets(spark, monkeypatch, ranges, buckets):
    monkeypatch.setattr(suffix_array, "_RANGES", ranges)
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    sizes = np.full(60, 1000)
    blocks = spark.createDataFrame(
        [(i, sizes.tobytes(), squeeze(text)) for i in range(3)], "block_id long, sizes binary, body binary"
    )
    scheme = ByteScheme(50)
    scheme.prepare(blocks, buckets)
    assert len(scheme.splitters) == min(ranges, buckets) - 1
    runs, body = scheme.runs(text, sizes)
    bucket = scheme.bucket(body, runs, np.arange(len(runs.name)), buckets)
    counts = np.bincount(bucket, minlength=buckets)
    assert len(counts) == buckets and counts.min() > 0 and counts.max() < 4 * counts.mean()
    for name in np.unique(runs.name)[:200]:
        assert len(set(bucket[runs.name == name].tolist())) == 1


def test_few_ranges_and_many_buckets_give_what_brute_force_gives(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "_RANGES", 3)
    monkeypatch.setattr("tidemark.llm.repeats.buckets_for", lambda blocks, size: 29)
    rows = repetitive_lines(12)
    lines = spark.createDataFrame(rows, "line_number long, line string").repartition(5)
    assert found(lines, remove_repeated_bytes, 50) == brute_force(rows, 50, False)


def test_windows_of_a_name_are_sorted_on_their_own():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 3, (600, 4)).astype(np.uint64)
    segment = np.sort(rng.integers(0, 9, 600))
    looked = []

    def key(items, level):
        looked.append(len(items))
        return keys[items, level]

    order, kind = multikey_quicksort(key, 600, 4, np.bincount(segment, minlength=11))
    assert segment[order].tolist() == segment.tolist()  # items stay in their segment
    rows = [tuple(r) for r in keys.tolist()]
    assert [rows[i] for i in order] == [r for s in range(9) for r in sorted(rows[i] for i in np.nonzero(segment == s)[0])]
    classes = {}
    assert all(classes.setdefault((s, r), k) == k for s, r, k in zip(segment.tolist(), rows, kind.tolist()))
    assert len(set(classes.values())) == len(classes)
    apart, looked[:] = sum(looked), []
    multikey_quicksort(lambda items, level: key(items, level) + (segment[items] * 3).astype(np.uint64) * (level == 0), 600, 4)
    assert apart < sum(looked)
