import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import ordered
from tidemark.llm import collocations
from tidemark.llm.collocations import mine_phrases
from tidemark.llm.queries import QUERIES

LINES = "line_number long, line string, label string, phrase string, score long"
COLUMNS = ("label", "rank", "phrase", "a", "l", "r", "n", "score")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_count, top, drop_percent=80, max_words=4):
    counts, total = defaultdict(Counter), Counter()
    for group, text in rows:
        group = "und" if group is None else group
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[group] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts[group][tuple(words[i : i + k])] += 1
    out = []
    for group, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        dropped = set()
        for longer, a in candidates.items():
            for k in range(2, len(longer)):
                for i in range(len(longer) - k + 1):
                    if 100 * a >= drop_percent * f[longer[i : i + k]]:
                        dropped.add(longer[i : i + k])
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, text, left, right) in enumerate(sorted(scored)[:top], start=1):
            out.append((group, rank, text.decode(), -a, left, right, total[group], -score))
    return out


def mined(table, **kwargs):
    return ordered(mine_phrases(table, **kwargs).select(*COLUMNS).collect())


def sample(seed, rows=120):
    rng = random.Random(seed)
    words = ["Swap", "MINT", "mint", "Program", "log", "é", "été", "漢字", "x\x00y", "\x1c", "out", "in", "of", "pool"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " :", "!?", "\x0b", "\r\n"]
    out = []
    for _ in range(rows):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choice(["program log out", "swap in pool", "mint mint mint", *words]) + rng.choice(ends))
        out.append((rng.choice(["1", "1", "0", None]), "".join(parts)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_are_those_of_brute_force(spark, seed):
    rows = sample(seed) + [("1", None), (None, ""), ("0", " \t"), ("2", "only one line of words"), *sample(seed, 30)]
    table = spark.createDataFrame([(i, r[1], r[0], "p", 1) for i, r in enumerate(rows)], LINES).repartition(7)
    assert mined(table, min_count=4, top=25) == ordered(brute(rows, 4, 25))
    assert mined(table, min_count=9, top=5, drop_percent=50) == ordered(brute(rows, 9, 5, 50))
    assert mined(table, min_count=4, top=9, max_words=2) == ordered(brute(rows, 4, 9, max_words=2))


def test_small_blocks_and_many_buckets_change_nothing(spark, monkeypatch):
    rows = sample(3)
    table = spark.createDataFrame([(i, r[1], r[0], "p", 1) for i, r in enumerate(rows)], LINES).repartition(2)
    wanted = brute(rows, 4, 50)
    monkeypatch.setattr(collocations, "_BUCKET_BYTES", 300)
    assert mined(table, min_count=4, top=50) == ordered(wanted)
    data = b"\n".join(t.encode() for _, t in rows)
    monkeypatch.setattr(collocations, "_BLOCK_BYTES", 100)
    blocks = [b for b in collocations._blocks_of({"1": [data]}, iter(range(10**6)))]
    assert len(blocks) > 10
    whole = sum(b.column(3)[0].as_py() for b in blocks)
    assert whole == len(data.translate(collocations._PLAIN).split())


def test_pairs_of_wide_numbers_keep_their_order():
    first = np.array([1 << 40, 3, 1 << 40, 3, 5])
    second = np.array([1 << 41, 7, 2, 7, 0])
    codes = collocations._pair_codes(first, second)
    pairs = list(zip(first.tolist(), second.tolist()))
    assert [sorted(set(pairs)).index(p) for p in pairs] == np.unique(codes, return_inverse=True)[1].reshape(-1).tolist()


def test_large_counts_stay_exact(spark):
    rows = [("g", b"a b", 5_000_000_000_001, [9_000_000_000_001], [5_000_000_000_001])]
    found = spark.createDataFrame(rows, "phrase_group string, phrase binary, a long, firsts array<long>, rests array<long>")
    assert collocations._best(found, 9).first()["score"] == 2000000 * 5_000_000_000_001 // 14_000_000_000_002


def test_no_lines(spark):
    assert mined(spark.createDataFrame([], LINES)) == []
    assert mined(spark.createDataFrame([(1, None, None, "p", 1), (2, "few words", "1", "p", 1)], LINES)) == []


def test_query_is_that_of_brute_force(spark, sf_dir):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = QUERIES["op12_setm_collocations"](spark, sf_dir).select("lang", *COLUMNS[1:]).collect()
    assert ordered(found) == ordered(brute(rows, 30, 2000)) and found
