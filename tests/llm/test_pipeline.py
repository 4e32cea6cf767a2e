import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_hyper_minhash import brute_force as brute_groups
from tests.llm.test_repeats import brute_force as brute_repeats
from tidemark.llm.quality_forest import judge_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_all_but_the_last_stage_keep_the_columns(spark, sf_dir, documents):
    docs = documents
    for name, run in corpus_pipeline.STAGES[:-1]:
        docs = run(spark, docs, sf_dir)
        assert docs.columns == documents.columns, name
    assert docs.dtypes == documents.dtypes


def test_quality_rules_move_no_texts_and_judge_each_row(spark, sf_dir, documents):
    """The kept rows come back whole, without a join with the verdicts, and rows of one number are judged each on its own."""
    number = documents.agg(F.max("doc_id")).first()[0] + 1
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(number, text, "l", None, 9), (number, "short", "l", "s", 1), (None, text, None, "s", None), (None, None, "l", "s", 0)]
    rows += [(2**63 - 1, text + " \u20ac", "l", "s", 2)]
    docs = documents.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(rows, SCHEMA))
    found = stage("quality_rules")(spark, docs, sf_dir)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    kept = found.collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    odd = [tuple(r) for r in kept if r[0] is None or r[0] >= number]
    assert sorted(odd, key=key) == sorted([rows[0], rows[2], rows[4]], key=key)
    assert {tuple(r) for r in kept} <= {tuple(r) for r in docs.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("line_number"), F.col("quality").alias("good"))
    verdicts = judge_lines(corpus_pipeline.lines_of(docs), labels)
    assert verdicts.where("kept").count() == len(kept)


def test_near_duplicates_keep_the_smallest_of_each_group(spark, sf_dir, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    wanted = {r[0] for r in brute_groups(rows, 5, 80) if r[3]}
    assert {r["doc_id"] for r in stage("near_duplicates")(spark, documents, sf_dir).collect()} == wanted


def test_repeated_passages_are_cut(spark, sf_dir, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = {r["doc_id"]: r for r in stage("repeated_passages")(spark, documents, sf_dir).collect()}
    texts = dict(rows)
    for number, _, removed, _, digest in brute_repeats(rows, 50, False):
        if not removed:
            assert found[number]["text"] == texts[number]
        elif texts[number].isascii():
            assert hashlib.sha256(found[number]["text"].encode()).hexdigest() == digest
        assert found[number]["n_chars"] == len(found[number]["text"])


def test_rows_of_one_number_are_cut_each_on_its_own(spark, sf_dir):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, shared, "en", "a", 0), (5, "one " + shared, "en", "a", 0), (5, "two " + shared, "en", "a", 0)]
    rows += [(5, "one " + shared, "en", "a", 0), (5, "short", "en", "a", 0), (None, "null " + shared, None, None, None)]
    found = stage("repeated_passages")(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == [
        (0, "null"), (1, shared), (5, "one "), (5, "one "), (5, "short"), (5, "two ")
    ]
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_repeated_passages_move_no_texts_by_document(spark, sf_dir):
    """The other columns come back with the lines: nothing is exchanged by document, and odd values stay as they are."""
    rows = [(2**63 - 1, "a\n\"b", 'l"\\', "s\u20ac\n", 9), (7, None, None, "", None), (8, "", "", None, 0), (None, "é", "de", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = stage("repeated_passages")(spark, docs, sf_dir)
    key = lambda r: (r[0] is None, r[0] or 0)
    lengths = [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(lengths, key=key)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("block_id" in line or "window" in line for line in joins)


def test_run_decodes_what_it_encodes(spark, sf_dir):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tool.no_truncation()
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows
    for row in rows:
        assert tool.encode(row["text"], add_special_tokens=False).ids == row["token_ids"]
        assert row["n_tokens"] == len(row["token_ids"])


def test_cut_characters_go(spark):
    data = spark.createDataFrame([(bytearray("é漢x".encode()[1:-2]),), (bytearray("aé".encode()[:-1]),)], "kept binary")
    found = [r[0] for r in data.select(corpus_pipeline.whole_characters(F.col("kept"))).collect()]
    assert found == ["", "a"]


def test_odd_documents(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "x " * 60, "en", "src1", 1), (2, "", "en", "src2", 0)]
    text = " ".join(f"w{i}" for i in range(80))
    rows += [(3, text, "en", "src3", 5), (3, text, "en", "src3", 5), (None, text + " y", None, "src", 5)]
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for name, run in corpus_pipeline.STAGES:
            docs = run(spark, docs, sf_dir)
            docs.count()
