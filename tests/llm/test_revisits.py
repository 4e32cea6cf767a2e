from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.llm.revisits import KEPT_FIELDS, canonical_address, resolve_revisits

SCHEMA = (
    "record_id long, warc_type string, target_uri string, warc_date timestamp, http_status int, "
    "http_headers map<string,string>, payload string, range int, found string"
)
START = datetime(2024, 1, 1)


def capture(number, kind, address, minute, headers, payload=None, status=None):
    status = status or {"response": 200, "revisit": 304}[kind]
    when = None if minute is None else START + timedelta(minutes=minute)
    return (number, kind, address, when, status, headers, payload, 1, "x")


def resolved(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r["record_id"]: r for r in resolve_revisits(table, **options).collect()}


def test_addresses_of_one_page_have_one_form(spark):
    cases = {
        "HTTPS://user@WWW.Example.COM:443/a/B.html?b=2&utm_source=x&a=1#top": "example.com/a/B?a=1&b=2",
        "http://example.com/": "example.com",
        "http://example.com:8080/a/?ref=z": "example.com:8080/a",
        "no address": None,
        "": None,
    }
    table = spark.createDataFrame([(a,) for a in cases] + [(None,)], "address string")
    found = {r[0]: r[1] for r in table.select("address", canonical_address(F.col("address"))).collect()}
    assert found == cases | {None: None}


def test_the_latest_earlier_response_is_confirmed_and_merged(spark):
    page = "http://a.org/x"
    rows = [
        capture(1, "response", page, 0, {"ETag": '"1"', "Content-Type": "text/html", "X": "old"}, "first"),
        capture(2, "response", page + "#part", 10, {"etag": 'W/"2"', "Content-Length": "9"}, "second"),
        capture(3, "response", page, 15, {"ETag": '"9"'}, "missing", status=404),
        capture(4, "revisit", page, 5, {"ETag": '"1"', "x": "new", "content-type": "none", "Connection": "close"}),
        capture(5, "revisit", "https://www.a.org/x/", 20, {"Etag": '"2"', "Age": "7"}),
        capture(6, "revisit", page, 21, {"ETag": '"1"'}, "own"),
        capture(7, "revisit", page, 22, {}),
        capture(8, "revisit", "http://b.org/", 22, {"ETag": '"1"'}),
        capture(9, "response", page, 30, {"ETag": '"1"'}, "later"),
    ]
    found = resolved(spark, rows)
    assert {n: (r["outcome"], r["refers_to"]) for n, r in found.items()} == {
        1: ("full", None),
        2: ("full", None),
        3: ("other", None),
        4: ("resolved", 1),
        5: ("resolved", 2),
        6: ("changed", 2),
        7: ("no_validator", 2),
        8: ("no_response", None),
        9: ("full", None),
    }
    assert found[4]["http_headers"] == {"etag": '"1"', "content-type": "text/html", "x": "new"}
    assert (found[4]["payload"], found[4]["http_status"]) == ("first", 200)
    assert found[5]["http_headers"] == {"etag": '"2"', "content-length": "9", "age": "7"}
    assert (found[6]["payload"], found[6]["http_status"]) == ("own", 304)


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_one_address_may_fill_many_ranges(spark, ranges):
    rows, wanted, last = [], {}, {}
    for i in range(300):
        address = "http://hot.org/" if i % 3 else f"http://cold{i % 9}.org/"
        if i % 10 in (0, 5):
            rows.append(capture(i, "response", address, i // 2, {"Last-Modified": "d"}, str(i)))
            last[address] = i
        else:
            rows.append(capture(i, "revisit", address, i // 2, {"last-modified": "d"}))
            wanted[i] = last.get(address)
    found = resolved(spark, rows, ranges=ranges)
    assert {n: found[n]["refers_to"] for n in wanted} == wanted
    assert all((r["payload"] == str(r["refers_to"])) for r in found.values() if r["outcome"] == "resolved")


def test_one_response_may_have_very_many_revisits(spark):
    rows = [capture(0, "response", "http://hot.org/", 0, {"ETag": "1"}, "x" * 5_000_000)]
    rows += [capture(i, "revisit", "http://hot.org/", i, {"ETag": "1"}) for i in range(1, 40)]
    rows += [capture(i, "revisit", f"http://alone{i}.org/", i, {"ETag": "1"}, "own") for i in range(40, 60)]
    rows += [capture(7, "revisit", "http://hot.org/", 7, {"ETag": "1"})]
    table = spark.createDataFrame(rows, SCHEMA)
    found = resolve_revisits(table, rows_per_task=5).select("record_id", "outcome", "refers_to", F.length("payload").alias("n")).collect()
    wanted = [(0, "full", None, 5_000_000)] + [(i, "resolved", 0, 5_000_000) for i in [*range(1, 40), 7]]
    wanted += [(i, "no_response", None, 3) for i in range(40, 60)]
    assert sorted(tuple(r) for r in found) == sorted(wanted)


def test_odd_captures(spark):
    page = "http://a.org/x"
    rows = [
        capture(1, "response", page, 0, None, None),
        capture(1, "response", page, 0, None, None),
        capture(2, "revisit", page, 1, None),
        capture(2, "revisit", page, 1, None),
        capture(None, "response", page, 0, {"ETag": "1"}, "x"),
        capture(3, "revisit", page, None, {"ETag": "1"}),
        capture(4, "revisit", None, 3, {"ETag": "1", "Etag": "2"}),
        (5, None, page, START, None, {}, None, 1, "x"),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    found = resolve_revisits(table).collect()
    assert len(found) == len(rows)
    assert {(r["record_id"], r["outcome"]) for r in found} == {
        (1, "full"),
        (2, "no_validator"),
        (None, "full"),
        (3, "no_response"),
        (4, "no_response"),
        (5, "other"),
    }
    assert resolve_revisits(table.limit(0)).count() == 0


def test_kept_fields_are_small_and_ordered():
    assert list(KEPT_FIELDS) == sorted(f.lower() for f in KEPT_FIELDS)
