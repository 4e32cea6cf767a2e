"""Not-modified revisits of web captures: find the response that a revisit confirms, and make it whole again.

Lookups follow the order of (canonical address, time, record) in ranges of equal size, so an address with very many
captures is spread over tasks; each range hands its last full response per address on to the ranges after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import join_unique
from tidemark.sources.scratch import materialise

# Fields of a stored response that a not-modified answer may not replace.
KEPT_FIELDS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)

# Query parameters that don't change the page.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_address(address: Column) -> Column:
    """One form for addresses of a page.

    Scheme, user, leading www., default port, fragment, tracking parameters and a final slash or .html go; the host
    becomes small and the parameters sorted. Null, or text without ://, is null.
    """
    rest = F.regexp_replace(F.regexp_extract(address, r"^[^:/?#]+://([\s\S]*)$", 1), r"#[\s\S]*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), r"^www\.", ""), ":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"(/|\.html)$", "")
    query = F.regexp_extract(rest, r"\?([\s\S]*)$", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda part: (part != "") & ~F.lower(part).rlike(TRACKING))
    )
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(address.contains("://"), F.concat(host, path, query))


def _small_names(headers: Column) -> Column:
    """Header names small; of names that become equal the first in the order of names stays."""
    entries = F.transform(
        F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(
        F.transform(names, lambda n: F.struct(n.alias("key"), F.filter(entries, lambda e: e["key"] == n)[0]["value"].alias("value")))
    )


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(
    captures: DataFrame, *, ranges: int | None = None, rows_per_task: int | None = None
) -> DataFrame:
    """Full responses and resolved not-modified revisits.

    The project keeps no web captures, so the operator is general. `captures` needs record_id (long), warc_type
    (response or revisit), target_uri, warc_date (timestamp), http_status (int), http_headers (map of strings) and
    payload (string). A full response is a response of status 200; a revisit has status 304. For each revisit the latest
    full response of its canonical address is looked up that comes before it in (warc_date, record_id). The revisit's ETag
    must equal the response's (weak comparison); without one, its Last-Modified must. If they do, the revisit gets the
    response's payload and headers, with the fields that HTTP permits to change taken from the revisit.

    Returns one row for each row of `captures`: record_id, canonical_uri, warc_type, warc_date, refers_to, outcome (full,
    other, resolved, no_response, no_validator, changed), http_status, http_headers (small names), payload. Unresolved
    revisits keep their own headers and payload, and refers_to names the response that was looked at, if any.

    Rows without canonical address, date or record id never refer and are never referred to. Of several responses with
    one record id the first by date, then by a hash of its payload, counts; repeated revisits are each resolved. Extra columns are ignored; an
    empty table gives no rows. A response to which more than `rows_per_task` revisits refer (2,000,000 by default) is joined in
    pieces.
    """
    spark = captures.sparkSession
    known = materialise(
        captures.select(
            F.col("record_id").cast("long"),
            canonical_address(F.col("target_uri")).alias("canonical_uri"),
            "warc_type",
            "warc_date",
            F.col("http_status").cast("int"),
            _small_names(F.col("http_headers")).alias("http_headers"),
            "payload",
        )
    )
    is_full = (F.col("warc_type") == "response") & (F.col("http_status") == 200)
    is_revisit = (F.col("warc_type") == "revisit") & (F.col("http_status") == 304)
    order = ("warc_date", "record_id")
    placed = known.where(
        F.col("canonical_uri").isNotNull() & F.col("warc_date").isNotNull() & F.col("record_id").isNotNull()
    )
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = materialise(
        placed.where(is_full | is_revisit)
        .select("canonical_uri", *order, is_full.alias("full"))
        .repartitionByRange(count, "canonical_uri", *order, "full")
        .withColumn("range", F.spark_partition_id())
    )
    full_at = F.when(F.col("full"), F.struct(*order))
    before = Window.partitionBy("range", "canonical_uri").orderBy(*order, F.desc("full"))
    here = events.withColumn("found", F.last(full_at, True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    earlier = Window.partitionBy("canonical_uri").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        events.groupBy("canonical_uri", "range")
        .agg(F.max(full_at).alias("last"))
        .withColumn("carried", F.last("last", True).over(earlier))
        .where(F.col("carried").isNotNull())
        .select("canonical_uri", "range", "carried")
    )
    matched = (
        here.where(~F.col("full"))
        .join(carried, ["canonical_uri", "range"], "left")
        .select("canonical_uri", *order, F.coalesce("found", "carried")["record_id"].alias("refers_to"))
        .distinct()
    )
    first = F.min_by(F.struct("http_headers", "payload"), F.struct("warc_date", F.xxhash64("payload")))
    stored = (
        placed.where(is_full)
        .groupBy(F.col("record_id").alias("refers_to"))
        .agg(first.alias("stored"))
        .select(
            "refers_to",
            F.col("stored.http_headers").alias("stored_headers"),
            F.col("stored.payload").alias("stored_payload"),
        )
    )
    revisits = materialise(known.where(is_revisit).join(matched, ["canonical_uri", *order], "left"))
    # Revisits without an earlier response have nothing to join; they would all meet in one task.
    alone = revisits.where(F.col("refers_to").isNull())
    looked = join_unique(revisits.where(F.col("refers_to").isNotNull()), stored, ["refers_to"], "left", rows_per_task=rows_per_task)
    tag, stored_tag = F.col("http_headers")["etag"], F.col("stored_headers")["etag"]
    date, stored_date = F.col("http_headers")["last-modified"], F.col("stored_headers")["last-modified"]
    same = F.when(tag.isNotNull(), F.coalesce(_weak(tag) == _weak(stored_tag), F.lit(False))).otherwise(
        F.coalesce(date == stored_date, F.lit(False))
    )
    outcome = F.when(tag.isNull() & date.isNull(), "no_validator").when(same, "resolved").otherwise("changed")
    fresh = F.map_filter("http_headers", lambda name, _: ~name.isin(*KEPT_FIELDS))
    merged = F.map_concat(
        F.map_filter("stored_headers", lambda name, _: ~F.array_contains(F.map_keys(fresh), name)), fresh
    )
    columns = ("record_id", "canonical_uri", "warc_type", "warc_date", "refers_to", "outcome")
    resolved = looked.withColumn("outcome", outcome).withColumn("_ok", F.col("outcome") == "resolved")
    return (
        known.where(~is_revisit | F.col("warc_type").isNull() | F.col("http_status").isNull())
        .withColumn("refers_to", F.lit(None).cast("long"))
        .withColumn("outcome", F.when(is_full, "full").otherwise("other"))
        .select(*columns, "http_status", "http_headers", "payload")
        .unionByName(
            alone.withColumn("outcome", F.lit("no_response")).select(*columns, "http_status", "http_headers", "payload")
        )
        .unionByName(
            resolved.select(
                *columns,
                F.when(F.col("_ok"), 200).otherwise(F.col("http_status")).alias("http_status"),
                F.when(F.col("_ok"), merged).otherwise(F.col("http_headers")).alias("http_headers"),
                F.when(F.col("_ok"), F.col("stored_payload")).otherwise(F.col("payload")).alias("payload"),
            )
        )
    )
