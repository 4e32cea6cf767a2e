"""Token counts of whole lines from one count per distinct pre-token.

Words of a line are its pre-tokens: the vocabulary has no piece with a word mark behind another character, so no merge
crosses the start of a word. Each block of lines keeps its frequencies by line and word, and asks for the number of
pieces of its distinct words; the word table is partitioned by hash, so each distinct word of a partition is encoded
once, whichever blocks ask. Answers are joined back to the frequencies and summed. No line's ids ever exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import chunks, expand, line_rows, number_column, squeeze
from tidemark.llm.settings import release, tidy
from tidemark.sources.scratch import materialise

_BLOCK_BYTES = 4 << 20
_BUCKET_BYTES = 8 << 20  # text whose distinct words share a bucket, whatever the size of the table
_FREQUENCIES = -1  # the bucket that stands for a block's own frequencies
_WORD = regex.compile("[ ▁]+[^ ▁]*")
_ASKED = "bucket int, block_id long, n_bytes long, payload binary"


@lru_cache(maxsize=2)
def _pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, after a check that its words can be counted one by one."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if mark in piece.lstrip(mark) and not (model.is_control(i) or model.is_unknown(i)):
            raise ValueError(f"piece {piece!r} crosses a word start; words can't be counted alone")
    if model.encode("a  b", out_type=str) == model.encode("a b", out_type=str) or model.encode("①", out_type=str) == model.encode("1", out_type=str):
        raise ValueError("the model rewrites text before splitting; words can't be counted alone")
    return model


def _words(text: str) -> list[str]:
    """Pre-tokens of a line; the model puts one word mark before the text, and spaces are word marks."""
    return _WORD.findall(" " + text) if text else []


def count_tokens(lines: DataFrame, model: str, *, limit: int = 4096, word_buckets: int | None = None) -> DataFrame:
    """Number of tokens of each raw transaction line.

    `lines` needs line_number (whole number) and line (string), as the reader of gzipped transaction lines gives them.
    `model` is the path of a sentencepiece BPE model without text normalisation, readable on every executor; begin and
    end tokens are not counted. Returns line_number, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > `limit`), one
    row for each row of `lines`.

    Null and empty lines have 0 bytes and 0 tokens. Null and repeated line numbers are kept as they are; extra columns
    are ignored; an empty table gives no rows. Lines are whole, whatever their length.
    """

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            numbers, raw = line_rows(batch)
            for lo, hi in chunks([len(r) for r in raw], _BLOCK_BYTES):
                yield _ask(block, numbers[lo:hi], raw[lo:hi], buckets)
                block += 1

    rows = lines.select(F.col("line_number").cast("long"), F.col("line").cast("string"))
    size = rows.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    buckets = word_buckets or max(32, -(-size // _BUCKET_BYTES))
    questions = materialise(rows.mapInArrow(tidy(asked), _ASKED))

    def answered(group: pa.Table) -> pa.Table:
        try:
            return _answer(group, _pieces(model))
        finally:
            release()

    answers = (
        questions.where(F.col("bucket") != _FREQUENCIES)
        .groupBy("bucket")
        .applyInArrow(answered, "block_id long, bucket int, counts binary")
        .groupBy("block_id")
        .agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    )
    frequencies = questions.where(F.col("bucket") == _FREQUENCIES).select("block_id", "payload")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _sum(payload, answers or [], limit)

    return (
        frequencies.join(answers, "block_id", "left")
        .select("payload", "answers")
        .mapInArrow(tidy(summed), "line_number long, n_bytes long, n_tokens long, over_limit boolean")
    )


def _ask(block: int, numbers: np.ndarray, raw: list[bytes], buckets: int) -> pa.RecordBatch:
    """A block's frequencies by line and word, and its distinct words dealt to buckets by hash."""
    parts = [_words(r.decode()) for r in raw]
    codes: dict[str, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for part in parts for w in part), np.int64)
    line = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    words = np.array([w.encode() for w in codes], object)
    bucket = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words], np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    pair, times = np.unique(line * max(1, len(words)) + place[flat] if len(flat) else flat, return_counts=True)
    head = np.array([len(numbers), len(pair), len(words)], np.int64)
    lengths = np.array([len(r) for r in raw], np.int64)
    data = [head, numbers, lengths, np.diff(pair, prepend=0).astype(np.int32), times.astype(np.int32)]
    out = [(_FREQUENCIES, int(lengths.sum()), squeeze(b"".join(x.tobytes() for x in data)))]
    used, starts = np.unique(bucket[order], return_index=True)
    for b, own in zip(used.tolist(), np.split(order, starts[1:]) if len(used) else []):
        out.append((b, 0, squeeze(b"\x00".join(w.replace(b"\x01", b"\x01\x01").replace(b"\x00", b"\x01\x02") for w in words[own]))))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in out], pa.int32()),
            pa.array([block] * len(out), pa.int64()),
            pa.array([x[1] for x in out], pa.int64()),
            pa.array([x[2] for x in out], pa.binary()),
        ],
        names=["bucket", "block_id", "n_bytes", "payload"],
    )


def _answer(group: pa.Table, model: sentencepiece.SentencePieceProcessor) -> pa.Table:
    """Pieces of each asked word, in asking order; a word that several blocks ask for is encoded once."""
    asked = [expand(p).split(b"\x00") for p in group["payload"].to_pylist()]
    codes: dict[bytes, int] = {}
    places = [np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)) for words in asked]
    pieces = np.zeros(len(codes), np.int32)
    words = [w.replace(b"\x01\x02", b"\x00").replace(b"\x01\x01", b"\x01").decode()[1:] for w in codes]
    for at in range(0, len(words), 20_000):
        # The model puts back the word mark that [1:] took off; an empty rest is a lone word mark, which it drops.
        part = words[at : at + 20_000]
        pieces[at : at + len(part)] = [len(ids) if w else 1 for w, ids in zip(part, model.encode(part, num_threads=1))]
    return pa.table(
        {
            "block_id": group["block_id"],
            "bucket": group["bucket"],
            "counts": pa.array([squeeze(pieces[p].tobytes()) for p in places], pa.binary()),
        }
    )


def _sum(payload: bytes, answers: list[dict], limit: int) -> pa.RecordBatch:
    """Frequencies times pieces, added up by line."""
    data = expand(payload)
    n_lines, n_pairs, n_words = np.frombuffer(data, np.int64, 3)
    numbers = np.frombuffer(data, np.int64, n_lines, 24)
    lengths = np.frombuffer(data, np.int64, n_lines, 24 + 8 * n_lines)
    at = 24 + 16 * n_lines
    pair = np.cumsum(np.frombuffer(data, np.int32, n_pairs, at).astype(np.int64))
    times = np.frombuffer(data, np.int32, n_pairs, at + 4 * n_pairs)
    parts = [np.frombuffer(expand(a["counts"]), np.int32) for a in sorted(answers, key=lambda a: a["bucket"])]
    pieces = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    if len(pieces) != n_words:
        raise ValueError(f"{len(pieces)} answers for {n_words} words")
    tokens = np.zeros(n_lines, np.int64)
    if n_pairs:
        np.add.at(tokens, pair // n_words, times.astype(np.int64) * pieces[pair % n_words])
    return pa.RecordBatch.from_arrays(
        [number_column(numbers), pa.array(lengths), pa.array(tokens), pa.array(tokens > limit)],
        names=["line_number", "n_bytes", "n_tokens", "over_limit"],
    )
