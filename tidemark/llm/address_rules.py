"""Filtering metadata addresses by listed rules and by association rules mined from labelled ones.

An address becomes a set of tokens: the parts of its host and the words of its path and query. FP-growth mines token
combinations that go with the label "block"; rules below the wanted support or confidence are pruned, and so is a rule
that another with fewer tokens makes needless. Rules are matched by an inverted index: a rule fits when all its tokens
are among those of the address.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "label:block"


def address_host(address: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z made small; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(address, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def address_path(address: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(address, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def address_tokens(address: Column) -> Column:
    """Distinct tokens: scheme, each part of the host with its place from the right, words of path and query."""
    text = F.coalesce(address, F.lit(""))
    parts = F.reverse(F.split(address_host(address), r"\."))
    hosts = F.transform(parts, lambda part, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), part))
    # Numbers name a page, not a kind of page, so all of them are one token.
    words = F.split(F.regexp_replace(F.lower(address_path(address)), "[0-9]+", "0"), r"[^\p{L}\p{N}]+")
    query = F.split(F.regexp_replace(F.lower(F.regexp_extract(text, r"\?([^#]*)", 1)), "[0-9]+", "0"), "[&;]")
    scheme = F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(text, r"^([\s\S]*?)://", 1)))
    tokens = F.concat(
        F.array(scheme),
        F.filter(hosts, lambda h: ~h.endswith(":")),
        F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit("path:"), w)),
        F.transform(F.filter(query, lambda q: q != ""), lambda q: F.concat(F.lit("query:"), q)),
    )
    return F.when(text.contains("://"), F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def listed_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest listed rule (verdict, host, path) that fits, as struct(rule, verdict); null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's. The list is written into the plan.
    """
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting = F.when(fits, value).otherwise(fitting)
    return fitting


def mine_rules(
    labelled: DataFrame, *, min_support: float, min_confidence: float, min_rows: int = 20
) -> DataFrame:
    """Token combinations that go with blocked addresses.

    `labelled` has tokens (array of string) and blocked (boolean, null unknown). Returns rule_id, tokens, n_tokens,
    support (share of labelled addresses that hold the tokens and are blocked) and confidence (blocked share of those
    that hold the tokens), for combinations of any number of tokens that reach both bounds and are held by
    `min_rows` blocked addresses or more, so that few labels can't make a rule. A rule is dropped if a part of its tokens
    is a rule as well.
    """
    items = F.when(F.col("blocked"), F.array_append("tokens", F.lit(_BLOCK))).otherwise(F.col("tokens"))
    baskets = materialise(labelled.where(F.col("blocked").isNotNull()).select(items.alias("items")))
    support = min(1.0, max(min_support, min_rows / max(1, baskets.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = (
        model.associationRules.where(F.array_contains("consequent", _BLOCK))
        .select(F.array_sort("antecedent").alias("tokens"), "support", "confidence")
        .withColumn("rule_id", F.xxhash64("tokens"))
        .withColumn("n_tokens", F.size("tokens"))
    )
    # A rule that holds another one's tokens says nothing more. Rules of few tokens come first, so that only rules without
    # a part are compared with longer ones; parts are found over shared tokens.
    waiting, kept = materialise(rules), []
    while (size := waiting.agg(F.min("n_tokens")).first()[0]) is not None:
        least = waiting.where(F.col("n_tokens") == size)
        longer = waiting.where(F.col("n_tokens") > size)
        kept.append(least)
        parts = least.select(F.col("rule_id").alias("part_id"), F.explode("tokens").alias("token"))
        needless = (
            longer.select("rule_id", F.explode("tokens").alias("token"))
            .join(parts, "token")
            .groupBy("rule_id", "part_id")
            .agg(F.count("*").alias("shared"))
            .where(F.col("shared") == size)
            .select("rule_id")
            .distinct()
        )
        waiting = materialise(longer.join(needless, "rule_id", "left_anti"))
    return materialise(reduce(DataFrame.unionByName, kept)) if kept else waiting


def judge_addresses(
    deployments: DataFrame,
    rules: list[tuple[str, str, str]],
    labels: DataFrame,
    *,
    min_support: float = 0.001,
    min_confidence: float = 0.8,
    min_rows: int = 20,
) -> DataFrame:
    """Verdict on the metadata address of each deployment.

    `deployments` needs tx_hash and metadata_uri, `labels` tx_hash and blocked (boolean, null unknown). `rules` lists
    (verdict, host, path); the longest that fits decides. Association rules for "block" are mined from the labelled
    addresses and decide on the addresses that no listed rule fits: they are allowed unless a mined rule fits. Returns one row for each row of `deployments`:
    tx_hash, host, path, rule (null if none fits), verdict (allow or block), mined_rule (the matched rule's tokens of the
    highest confidence, null if none or not asked).

    A null address, or one without ://, has an empty host and path, no tokens, and is allowed. Null and repeated tx_hash
    stay as they are; of several labels for one tx_hash "blocked" counts. Extra columns are ignored; an empty table gives
    no rows. Without labels nothing is mined.
    """
    parsed = deployments.select(
        "tx_hash",
        address_host(F.col("metadata_uri")).alias("host"),
        address_path(F.col("metadata_uri")).alias("path"),
        address_tokens(F.col("metadata_uri")).alias("tokens"),
    )
    parsed = materialise(parsed.withColumn("listed", listed_rule(rules, F.col("host"), F.col("path"))))
    # Both sides grow with the input, and tokens compress so well that file sizes would pass for small ones.
    known = labels.groupBy("tx_hash").agg(F.max("blocked").alias("blocked")).hint("merge")
    labelled = parsed.where(F.size("tokens") > 0).join(known, "tx_hash").select("tokens", "blocked")
    mined = mine_rules(labelled, min_support=min_support, min_confidence=min_confidence, min_rows=min_rows)
    # Addresses with the same tokens are matched once.
    open_sets = (
        parsed.where(F.col("listed").isNull() & (F.size("tokens") > 0))
        .select(F.array_sort("tokens").alias("tokens"))
        .distinct()
        .withColumn("set_id", F.md5(F.to_json("tokens")))
    )
    index = mined.select("rule_id", "n_tokens", "confidence", "support", F.explode("tokens").alias("token"))
    best = F.max(F.struct("confidence", "support", F.col("rule_id")))
    matched = (
        open_sets.select("set_id", F.explode("tokens").alias("token"))
        .join(index, "token")
        .groupBy("set_id", "rule_id", "n_tokens", "confidence", "support")
        .agg(F.count("*").alias("held"))
        .where(F.col("held") == F.col("n_tokens"))
        .groupBy("set_id")
        .agg(best.alias("best"))
        .join(mined.select(F.col("rule_id").alias("_rule"), F.array_join("tokens", " ").alias("mined_rule")), F.col("best.rule_id") == F.col("_rule"))
        .select("set_id", "mined_rule")
    )
    asked = F.when(F.col("listed").isNull() & (F.size("tokens") > 0), F.md5(F.to_json(F.array_sort("tokens"))))
    parsed = parsed.withColumn("set_id", asked)
    # Addresses without a question have no set; they would all meet in one task of the join.
    unasked = parsed.where(F.col("set_id").isNull()).withColumn("mined_rule", F.lit(None).cast("string"))
    return (
        parsed.where(F.col("set_id").isNotNull())
        .join(matched, "set_id", "left")
        .unionByName(unasked)
        .select(
            "tx_hash",
            "host",
            "path",
            F.col("listed.rule").alias("rule"),
            F.coalesce(
                F.col("listed.verdict"), F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
            ).alias("verdict"),
            "mined_rule",
        )
    )
