"""Queries of the training-data operators: each maps given tables to an operator's columns and its result back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.address_rules import judge_addresses
from tidemark.llm.bpe import encode_transaction_lines
from tidemark.llm.class_bigrams import score_lines
from tidemark.llm.collocations import mine_phrases
from tidemark.llm.cover_tree import nearest_deployments
from tidemark.llm.hyper_minhash import link_lines
from tidemark.llm.oracles import NEAREST_SQL, REPEATED_BYTES_SQL, REPEATED_WORDS_SQL, linked_sql, phrases_sql
from tidemark.llm.quality_forest import judge_lines
from tidemark.llm.recompression import remove_repeated_words
from tidemark.llm.revisits import resolve_revisits
from tidemark.llm.source_mix import mix_lines
from tidemark.llm.suffix_array import remove_repeated_bytes
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.settings import prepare_text
from tidemark.llm.whitening import whiten_deployments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: run(prepare_text(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents as raw transaction lines."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(F.col("doc_id").alias("line_number"), F.col("text").alias("line"))


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(document_lines(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumnRenamed("line_number", "doc_id")


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures of each given page: a full response in the minute of its id, and a revisit half a day later."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    minute = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        F.lit("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        minute.alias("warc_date"),
        F.lit(200).alias("http_status"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Age"), F.lit("0")
        ).alias("http_headers"),
        F.col("html").alias("payload"),
    )
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("warc_type"),
        F.col("url").alias("target_uri"),
        (minute + F.expr("INTERVAL 12 HOURS")).alias("warc_date"),
        F.lit(304).alias("http_status"),
        F.create_map(
            F.lit("content-type"), F.lit("none"), F.lit("Etag"), F.concat(F.lit("W/"), tag), F.lit("Age"), F.lit("9")
        ).alias("http_headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


# The same captures, addresses and lookups in SQL; the latest earlier response by an as-of join.
REVISITS_SQL = r"""
WITH tagged AS (
  SELECT page_id, url, html, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
    regexp_replace(regexp_extract(url, '^[^:/?#]+://([\s\S]*)$', 1), '#[\s\S]*$', '') AS rest
  FROM pages
), cut AS (
  SELECT *, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '(/|\.html)$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?([\s\S]*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS kept
  FROM tagged
), named AS (
  SELECT page_id, html, tag, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), '^www\.', ''), ':(80|443)?$', '') || path ||
    CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS uri
  FROM cut
), found AS (
  SELECT r.page_id, r.uri, r.tag, f.page_id AS full_id, f.tag AS full_tag, f.html AS full_html
  FROM named r ASOF LEFT JOIN named f ON r.uri = f.uri AND r.page_id + 720 > f.page_id
)
SELECT page_id * 2 AS record_id, uri AS canonical_uri, CAST(NULL AS BIGINT) AS refers_to, 'full' AS outcome,
  200 AS http_status, 'age: 0|content-type: text/html|etag: ' || tag AS headers, md5(html) AS payload_md5
FROM named
UNION ALL
SELECT page_id * 2 + 1, uri, full_id * 2,
  CASE WHEN full_id IS NULL THEN 'no_response' WHEN tag = full_tag THEN 'resolved' ELSE 'changed' END,
  CASE WHEN tag = full_tag THEN 200 ELSE 304 END,
  CASE WHEN tag = full_tag THEN 'age: 9|content-type: text/html|etag: W/' || tag
    ELSE 'age: 9|content-type: none|etag: W/' || tag END,
  CASE WHEN tag = full_tag THEN md5(full_html) END
FROM found
"""


@query("op2_warc_revisits", REVISITS_SQL)
def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(
        F.array_sort(F.map_entries("http_headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return resolve_revisits(page_captures(spark, sf_dir)).select(
        "record_id",
        "canonical_uri",
        "refers_to",
        "outcome",
        "http_status",
        F.array_join(lines, "|").alias("headers"),
        F.md5(F.col("payload").cast("binary")).alias("payload_md5"),
    )


@query("op3_hyper_minhash", linked_sql())
def op3_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_lines(document_lines(spark, sf_dir), shingle_words=3, similarity_percent=85)
    return linked.withColumnRenamed("line_number", "doc_id")


@query("op4_suffix_array", REPEATED_BYTES_SQL)
def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(document_lines(spark, sf_dir), window=50).select(
        F.col("line_number").alias("doc_id"),
        F.col("n_units").alias("n_bytes"),
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# Weights of the source tree: nodes without a row weigh 1.
MIX_WEIGHTS = [
    ("domain", "group0", 4),
    ("domain", "group1", 3),
    ("domain", "group2", 2),
    ("lang", "en", 5),
    ("lang", "de", 2),
    ("lang", "fr", 2),
    ("source", "src0", 2),
    ("source", "src7", 0),
]
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 2, 17


Weights = list[tuple[str, str, int]]


def document_domain():
    """The given sources have no domain; every fourth source number shares one."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("group"), (number.try_cast("long") % 4).cast("string"))).otherwise("other")


def _mix_sql() -> str:
    weights = ", ".join(f"('{level}', '{name}', {weight})" for level, name, weight in MIX_WEIGHTS)
    steps, due = [], "root"
    for depth, level in enumerate(("domain", "lang", "source"), start=1):
        path = ", ".join(("domain", "lang", "source")[:depth])
        parent = ", ".join(("domain", "lang", "source")[: depth - 1]) or "1"
        join = f"JOIN {due} USING ({parent})" if depth > 1 else "CROSS JOIN root"
        steps.append(
            f"""n{depth} AS (
  SELECT {path}, room, due, coalesce(w.weight, 1)::HUGEINT AS weight
  FROM (SELECT {path}, sum(tokens)::HUGEINT * {MIX_EPOCHS} AS room FROM leaves GROUP BY {path}) {join}
  LEFT JOIN weights w ON w.level = '{level}' AND w.name = {level}
), o{depth} AS (
  SELECT *, coalesce(sum(room) OVER (p ORDER BY room::DOUBLE / nullif(weight, 0)::DOUBLE NULLS LAST, {level}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
    (sum(weight) OVER (p ORDER BY room::DOUBLE / nullif(weight, 0)::DOUBLE NULLS LAST, {level}
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS after
  FROM n{depth} WINDOW p AS (PARTITION BY {parent})
), f{depth} AS (
  SELECT *, weight > 0 AND room * after <= weight * (due - before) AS filled FROM o{depth}
), b{depth} AS (
  SELECT {path}, CASE WHEN filled THEN room WHEN weight > 0 THEN
      weight * (due - coalesce(sum(room) FILTER (filled) OVER (PARTITION BY {parent}), 0)::HUGEINT)
      // nullif((sum(weight) FILTER (NOT filled) OVER (PARTITION BY {parent}))::HUGEINT, 0) ELSE 0 END AS due
  FROM f{depth}
)"""
        )
        due = f"b{depth}"
    return f"""
WITH weights(level, name, weight) AS (VALUES {weights}), lines AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) <> ''
      THEN 'group' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4) ELSE 'other' END AS domain,
    (length(coalesce(text, '')) + 3) // 4 AS n_tokens
  FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM lines GROUP BY ALL),
root AS (SELECT sum(tokens)::HUGEINT * {MIX_PERCENT} // 100 AS due FROM leaves),
{", ".join(steps)}, plan AS (
  SELECT domain, lang, source, (due // greatest(tokens, 1))::BIGINT AS whole,
    (due % greatest(tokens, 1))::BIGINT AS rest FROM leaves JOIN b3 USING (domain, lang, source)
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('{MIX_SEED}/' || whole || '/' || doc_id), n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AND rest > 0 AS more
  FROM lines JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, whole + more::BIGINT AS n_epochs FROM summed WHERE whole + more::BIGINT > 0
"""


def mixed_documents(
    spark: SparkSession, documents: DataFrame, node_weights: Weights, percent: int, epochs: int
) -> DataFrame:
    """Documents mixed to the weights, at four characters a token."""
    weights = spark.createDataFrame(node_weights, "level string, name string, weight long")
    lines = documents.withColumn("domain", document_domain()).withColumn(
        "n_tokens", F.expr("(length(coalesce(text, '')) + 3) div 4")
    )
    lines = lines.withColumnRenamed("doc_id", "line_number")
    mixed = mix_lines(lines, weights, total_percent=percent, epochs=epochs, seed=MIX_SEED)
    return mixed.withColumnRenamed("line_number", "doc_id")


@query("op5_source_mix", _mix_sql())
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed_documents(spark, documents, MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS).select(
        "doc_id", "domain", "lang", "source", "n_tokens", "n_epochs"
    )


@query("op6_recompression", REPEATED_WORDS_SQL)
def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(document_lines(spark, sf_dir), window=13).select(
        F.col("line_number").alias("doc_id"),
        F.col("n_units").alias("n_words"),
        "n_removed",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op7_cover_tree", NEAREST_SQL)
def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    value = F.transform("embedding", lambda x: x.cast("double"))
    unusable = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    deployments = embeddings.where(F.col("embedding").isNotNull() & ~unusable).select(
        F.col("vec_id").alias("deployment_id"),
        F.transform(value, lambda x: F.floor(F.lit(1024.0) * x).cast("double")).alias("features"),
    )
    queries = deployments.where(F.col("deployment_id") % 100 == 0)
    found = nearest_deployments(deployments, queries, k=10)
    return found.select("query_id", "rank", F.col("deployment_id").alias("vec_id"), "score")


# Listed rules: verdict, host, path.
ADDRESS_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query("op8_url_rules")
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    deployments = pages.select(F.col("page_id").alias("tx_hash"), F.col("url").alias("metadata_uri"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("tx_hash"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")
    )
    return judge_addresses(deployments, ADDRESS_RULES, labels).withColumnRenamed("tx_hash", "page_id")


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return encode_transaction_lines(document_lines(spark, sf_dir), tokenizer).select(
        F.col("line_number").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("line_number"), F.col("quality").alias("good")
    )
    return judge_lines(document_lines(spark, sf_dir), labels).select(
        F.col("line_number").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "anomaly",
    )


@query("op11_brown_ngrams")
def op11_brown_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_lines(document_lines(spark, sf_dir)).withColumnRenamed("line_number", "doc_id")


@query("op12_setm_collocations", phrases_sql())
def op12_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mine_phrases(documents.select("lang", F.col("text").alias("line")), group="lang")


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    deployments = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("token_address"), F.col("embedding").alias("features")
    )
    # The exact deviation is a decimal; where it passes 64 bits the query has null.
    return whiten_deployments(deployments, components=4, scale=256.0).select(
        F.col("token_address").alias("vec_id"),
        "component",
        "n",
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
    )
