import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import no_lines, odd_lines, ordered
from tidemark.llm import class_bigrams
from tidemark.llm.class_bigrams import Totals, exchange, score_lines
from tidemark.llm.collocations import mine_phrases
from tidemark.llm.queries import QUERIES
from tidemark.sources.tables import read_lines

LINES = "line_number long, line string, score double"


def tokens_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def held_out(number):
    return number is not None and zlib.crc32(str(number).encode()) % 5 == 1


def base_of(rows):
    """Contract columns by brute force: number, held out, tokens, known tokens, training tokens, base score."""
    trained = Counter(t for number, text in rows if not held_out(number) for t in tokens_of(text))
    total, types = sum(trained.values()), len(trained)
    out = []
    for number, text in rows:
        tokens = tokens_of(text)
        base = sum(math.log10((trained[t] + 0.5) / (total + 0.5 * (types + 1))) for t in tokens)
        out.append((number, held_out(number), len(tokens), sum(trained[t] > 0 for t in tokens), total, round(base, 6)))
    return out


def found_of(result):
    columns = ("line_number", "held_out", "n_tokens", "n_known", "train_tokens")
    return [(*[r[c] for c in columns], round(r["base_score"], 6)) for r in result]


def grammar(seed, rows):
    """Lines of two word kinds in turn, so that the class of a word tells the next word's class."""
    rng = random.Random(seed)
    first, second = [f"mint{i}" for i in range(40)], [f"Pool{i}" for i in range(40)]
    lines = []
    for i in range(rows):
        lines.append((i, " ".join(rng.choice(first if k % 2 == 0 else second) for k in range(rng.randrange(3, 30)))))
    return lines


def test_counts_and_base_scores_are_those_of_brute_force(spark):
    lines = odd_lines(spark, [(20 + i, t) for i, (_, t) in enumerate(grammar(1, 60))])
    rows = [(r["line_number"], r["line"]) for r in lines.collect()]
    result = score_lines(lines, classes=8).collect()
    assert ordered(found_of(result)) == ordered(base_of(rows))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in result)


def test_classes_lower_the_perplexity_of_held_out_lines(spark):
    lines = spark.createDataFrame([(*r, 0.5) for r in grammar(2, 500)], LINES).repartition(5)
    result = [r for r in score_lines(lines, classes=12).collect() if r["held_out"]]
    base, score = (sum(r[c] for r in result) for c in ("base_score", "score"))
    words = sum(r["n_tokens"] for r in result)
    assert words > 1000 and (score - base) / words > 0.2


def brute_scores(rows, of, classes, rare_below):
    """Scores from the formulas of the docstring, for known classes of the words."""
    trained = Counter(t for number, text in rows if not held_out(number) for t in tokens_of(text))
    place = lambda t: 0 if t is None else 1 if trained[t] < rare_below else of[t]
    follow = Counter()
    for number, text in rows:
        if not held_out(number):
            chain = [0, *[place(t) for t in tokens_of(text)]]
            follow.update(zip(chain, chain[1:]))
    into = Counter()
    for (_, c), n in follow.items():
        into[c] += n
    total = sum(into.values())
    once = sum(n == 1 for n in trained.values())

    def score(text):
        sum_, before = 0.0, 0
        for t in tokens_of(text):
            c = place(t)
            out = sum(n for (a, _), n in follow.items() if a == before)
            kinds = sum(min(n, 0.5) for (a, _), n in follow.items() if a == before)
            share = (into[c] + 0.5) / (total + 0.5 * classes)
            p = (max(follow[before, c] - 0.5, 0) + kinds * share) / out if out else share
            weight = into[c] + (once + 0.5 if c == 1 else 0)
            sum_ += math.log10(p * (trained[t] or once + 0.5) / weight) if t is not None else math.log10(p)
            before = c
        return sum_

    return [(number, round(score(text), 6)) for number, text in rows]


def test_scores_are_those_of_brute_force_for_the_found_classes(spark, monkeypatch):
    """Without rounds each seed word has its own class and all others the last one."""
    rows = grammar(3, 40) + [(900, "mint1 never never once"), (901, None), (902, "mint1")]
    lines = spark.createDataFrame([(*r, 0.5) for r in rows], LINES).repartition(3)
    trained = Counter(t for number, text in rows if not held_out(number) for t in tokens_of(text) if t)
    result = score_lines(lines, classes=3, rounds=0).collect()
    wanted = brute_scores(rows, dict.fromkeys(trained, 2), 3, 3)
    assert ordered((r["line_number"], round(r["score"], 6)) for r in result) == ordered(wanted)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 9, (6, 6)).astype(float)
    matrix[2] = 0
    model = class_bigrams._model(matrix, Totals(int(matrix.sum()), 30, 7, 3), 6, 3)
    assert np.allclose((10**model.follow).sum(axis=1), 1)
    known = 10 ** (np.log10(matrix.sum(axis=0)[1]) - model.tokens[1])
    assert math.isclose(known + 10**model.unknown, 1)


def test_exchange_never_lowers_the_fit_when_words_move_one_by_one(monkeypatch):
    rng = random.Random(5)
    chain = [rng.choice([0, 2, 4, 6] if k % 2 else [1, 3, 5, 7]) for k in range(4000)]
    pairs = Counter(zip(chain, chain[1:]))
    classes, of = 5, np.array([2, 3, 4, 4, 4, 4, 4, 4])

    def counted(of):
        matrix = np.zeros((classes, classes))
        for (a, b), n in pairs.items():
            matrix[of[a], of[b]] += n
        return matrix

    monkeypatch.setattr(class_bigrams, "_CHUNK_WORDS", 1)
    fits = [class_bigrams._fit(counted(of))]
    for _ in range(3):
        near = Counter()
        for (a, b), n in pairs.items():
            if a != b:
                near[a, of[b]] += n
                near[b, classes + of[a]] += n
        keys = sorted(near)
        words, cells = (np.array(x) for x in zip(*keys))
        of = exchange(counted(of), of, np.ones(8), words, cells, np.array([float(near[k]) for k in keys]))
        fits.append(class_bigrams._fit(counted(of)))
    assert fits == sorted(fits) and fits[-1] > fits[0] + 100
    assert {tuple(sorted({int(of[w]) for w in range(8) if w % 2 == side})) for side in (0, 1)} and not (
        {int(of[w]) for w in (0, 2, 4, 6)} & {int(of[w]) for w in (1, 3, 5, 7)}
    )


def test_tables_without_lines_or_training_lines(spark):
    assert score_lines(no_lines(spark)).count() == 0
    alone = next(i for i in range(100) if held_out(i))
    row = score_lines(spark.createDataFrame([(alone, "Swap mint", 0.0)], LINES)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and math.isfinite(row["score"])
    assert math.isclose(row["base_score"], 0.0, abs_tol=1e-12)
    with pytest.raises(ValueError):
        score_lines(no_lines(spark), classes=2)


def test_query_is_that_of_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = QUERIES["op11_brown_ngrams"](spark, sf_dir).withColumnRenamed("doc_id", "line_number").collect()
    assert ordered(found_of(found)) == ordered(base_of(rows))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lines_of_the_gzip_reader_are_scored_and_mined(spark, tmp_path):
    import gzip

    texts = [f'{{"slot": {i}, "logMessages": ["Program log: Instruction: Buy"]}}' for i in range(40)]
    with gzip.open(tmp_path / "raw.jsonl.gz", "wt", encoding="utf-8") as handle:
        handle.write("\n".join(texts) + "\n")
    lines = read_lines(spark, str(tmp_path / "raw.jsonl.gz")).withColumnRenamed("value", "line")
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    assert ordered(found_of(score_lines(lines, classes=5).collect())) == ordered(base_of(rows))
    mined = mine_phrases(lines.withColumn("label", F.lit(1)), min_count=40)
    assert {(r.label, r.phrase, r.a) for r in mined.collect()} == {("1", '["program log', 40)}
