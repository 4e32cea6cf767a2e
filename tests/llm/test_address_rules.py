import re
from itertools import combinations

import pytest

from tests.llm.helpers import ordered
from tidemark.llm.address_rules import judge_addresses, mine_rules

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
]
LABELS = "tx_hash long, blocked boolean"
DEPLOYMENTS = "tx_hash long, metadata_uri string, host string, rule string"


def listed(address):
    found = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", address or "")
    host, path = (found[1], found[2]) if found else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = [
        (len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fitting)[1:] if fitting else (None, None)))


def judged(spark, addresses, labels=(), **options):
    table = spark.createDataFrame([(i, a, "x", "y") for i, a in enumerate(addresses)], DEPLOYMENTS)
    return judge_addresses(table, RULES, spark.createDataFrame(list(labels), LABELS), **options)


def test_the_longest_listed_rule_decides(spark):
    addresses = [
        "https://A.com/", "https://a.com", "http://a.COM?x=/", "http://b.example.com/en/1", "http://example.com/en/",
        "http://www.example.com/en/1", "http://x.www.example.com/en/", "http://www.example.com/de/", "http://example.com/en",
        "http://a.net/es/1#x", "http://net/es/", "http://a.net/en/es/", "http://anet/es/", "http://notcom/", "com/",
        "", None, "http://", "://a.com/x", "a://b://c.com/", "http://a.com:80/", "HTTP://ÄA.com/Ä?b#c", "x\n://a.com/y",
    ]
    found = judged(spark, addresses).collect()
    wanted = [(i, h, p, r, v or "allow") for i, (h, p, r, v) in enumerate(map(listed, addresses))]
    assert ordered((r["tx_hash"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found) == ordered(wanted)


def test_mined_rules_are_those_of_brute_force(spark):
    baskets = [
        ({f"a{i % 3}", f"b{i % 4}", f"c{i % 5}"}, None if i == 7 else (i % 3 == 0 and i % 4 != 1) or i % 5 == 2) for i in range(240)
    ]
    table = spark.createDataFrame([(sorted(t), b) for t, b in baskets], "tokens array<string>, blocked boolean")
    found = mine_rules(table, min_support=0.02, min_confidence=0.7, min_rows=3)
    known = [(t, b) for t, b in baskets if b is not None]
    strong = {}
    for size in (1, 2, 3):
        for tokens in {c for t, _ in known for c in combinations(sorted(t), size)}:
            holding = [b for t, b in known if set(tokens) <= t]
            if sum(holding) >= max(0.02 * len(known), 3) and sum(holding) >= 0.7 * len(holding):
                strong[tokens] = sum(holding) / len(holding)
    least = {t: c for t, c in strong.items() if not any(set(o) < set(t) for o in strong)}
    assert {tuple(r["tokens"]): round(r["confidence"], 9) for r in found.collect()} == {t: round(c, 9) for t, c in least.items()}


def test_labels_teach_addresses_without_listed_rule(spark):
    addresses = [f"http://{'bets' if i % 2 else 'news'}.example.org/{i}" for i in range(100)] + ["http://bets.other.org/1"]
    labels = [(i, i % 2 == 1) for i in range(80)] + [(3, None), (500, True), (None, True)]
    found = judged(spark, addresses, labels, min_rows=10).collect()
    assert {r["tx_hash"] for r in found if r["verdict"] == "block"} == {i for i in range(100) if i % 2} | {100}
    few = judged(spark, addresses, labels, min_rows=60).collect()
    assert {r["verdict"] for r in few} == {"allow"}


def test_rules_may_need_five_tokens(spark):
    # Blocked are those with all of five tokens; each other address lacks one of them.
    baskets = [([f"t{j}" for j in range(5) if i % 6 == 5 or j != i % 6], i % 6 == 5) for i in range(120)]
    table = spark.createDataFrame(baskets, "tokens array<string>, blocked boolean")
    found = mine_rules(table, min_support=0.02, min_confidence=0.8, min_rows=3).collect()
    assert [r["tokens"] for r in found] == [[f"t{j}" for j in range(5)]]


@pytest.mark.parametrize("rows", [0, 3])
def test_odd_rows(spark, rows):
    table = spark.createDataFrame([(None, "http://a.net/es/", "x", "y"), (1, None, "x", "y"), (1, None, "x", "y")], DEPLOYMENTS)
    found = judge_addresses(table.limit(rows), RULES, spark.createDataFrame([], LABELS)).collect()
    wanted = [(None, "a.net", "block"), (1, "", "allow"), (1, "", "allow")][:rows]
    assert ordered((r["tx_hash"], r["host"], r["verdict"]) for r in found) == ordered(wanted)
