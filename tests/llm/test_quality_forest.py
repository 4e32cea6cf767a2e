import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import no_lines, odd_lines, ordered
from tidemark.llm.quality_forest import calibrate_cut, judge_lines, rule_statistics

LABELS = "line_number long, good int"


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    rows = [r for r in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", r)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(rows) - len(set(rows)),
        len(covered),
    )


def test_statistics_are_those_of_brute_force(spark):
    extra = [(20, "a b c a b c a"), (21, "a a a a"), (22, "x\ny\nx\n\nx"), (23, "é# ü*   漢$%&|<>"), (24, "a b")]
    extra += [(25, "one two three one two\nthree"), (26, "\x1c\x85 a\x0bb\x0cc")]
    lines = odd_lines(spark, extra)
    columns = ("line_number", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = rule_statistics(lines).select(*columns).collect()
    assert ordered(found) == ordered((r["line_number"], *counted(r["line"])) for r in lines.collect())


def test_large_vocabularies_need_more_than_one_number(monkeypatch):
    import numpy as np

    from tidemark.llm.quality_forest import _in_repeated_windows

    ids = np.array([0, 1, 2, 5, 0, 1, 2, 7, 1, 2, 0])
    assert _in_repeated_windows(ids, 8) == _in_repeated_windows(ids, 1 << 40) == 6


def sample(spark, offset, rows=600):
    """Nine ordinary lines to one of shouting or symbols; every line has a label."""
    data, labels = [], []
    for i in range(rows):
        words = [f"word{(i * 7 + j * j) % 97}x{j % 11}" for j in range(60 + i % 40)]
        bad = i % 10 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 20 else [w + "###" for w in words]
        data.append((offset + i, " ".join(words)))
        labels.append((offset + i, int(not bad)))
    return spark.createDataFrame(data, "line_number long, line string"), spark.createDataFrame(labels, LABELS)


def test_held_out_lines_are_judged_by_what_the_labels_taught(spark):
    lines, labels = sample(spark, 0)
    held_out, truth = sample(spark, 10_000, 300)
    judged = judge_lines(lines.unionByName(held_out), labels).join(truth, "line_number")
    right = judged.where(F.col("kept") == (F.col("good") == 1)).count()
    assert right == 300


def test_without_labels_only_base_rules_reject(spark):
    lines, _ = sample(spark, 0, 100)
    short = spark.createDataFrame([(900, "too short"), (901, "a b c " * 40)], "line_number long, line string")
    judged = judge_lines(lines.unionByName(short), spark.createDataFrame([], LABELS)).collect()
    assert {r["line_number"] for r in judged if not r["kept"]} == {900, 901}
    assert all(r["kept"] != r["base_failed"] for r in judged)


def test_the_cut_keeps_the_wanted_share_of_good_lines(spark):
    scored = spark.createDataFrame([(i, i / 100) for i in range(100)], "line_number long, anomaly double")
    labels = spark.createDataFrame([(i, int(i < 50 or i == 90)) for i in range(100)] + [(None, 1), (200, 0)], LABELS)
    assert 0.49 < calibrate_cut(scored, labels, keep_share=0.9) <= 0.50
    assert calibrate_cut(scored, labels, keep_share=1.0) > 0.90


def test_odd_lines(spark):
    lines = odd_lines(spark)
    labels = spark.createDataFrame([(7, 1), (7, 1), (1, 0), (None, 0), (8, None)], LABELS)
    judged = judge_lines(lines, labels).collect()
    assert ordered([(r["line_number"], r["n_words"]) for r in judged]) == ordered(
        (r["line_number"], counted(r["line"])[0]) for r in lines.collect()
    )
    assert judge_lines(no_lines(spark), labels).count() == 0
