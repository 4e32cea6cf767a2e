from tests.llm.helpers import ordered
from tidemark.llm.source_mix import leaf_budgets, mix_lines

WEIGHTS = "level string, name string, weight long"
ROWS = "line_number long, domain string, lang string, source string, n_tokens long, _row string, n_epochs string"


def budgets(spark, leaves, weights, percent, epochs=1):
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    found = leaf_budgets(table, spark.createDataFrame(weights, WEIGHTS), total_percent=percent, epochs=epochs)
    return {(r["domain"], r["lang"], r["source"]): r["budget"] for r in found.collect()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 1000)]
    # 1505 tokens: 752 for each domain; web: 376 for each language; en: a has 10, b takes the rest.
    found = budgets(spark, leaves, [], 50)
    assert found == {
        ("web", "en", "a"): 10,
        ("web", "en", "b"): 366,
        ("web", "de", "c"): 376,
        ("books", "en", "d"): 752,
    }


def test_what_no_sibling_can_use_goes_to_the_ancestors_other_children(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 20), ("web", "de", "c", 5000), ("books", "en", "d", 970)]
    found = budgets(spark, leaves, [("domain", "web", 3), ("source", "a", 9)], 50)
    assert found == {("web", "en", "a"): 10, ("web", "en", "b"): 20, ("web", "de", "c"): 2220, ("books", "en", "d"): 750}


def test_weights_of_nothing_and_more_epochs(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 100), ("web", "en", "c", 100)]
    weights = [("source", "a", 0), ("source", "b", 3), ("source", "c", 1), ("source", "c", 1), ("lang", "xx", 7)]
    assert budgets(spark, leaves, weights, 100, epochs=2) == {("web", "en", "a"): 0, ("web", "en", "b"): 200, ("web", "en", "c"): 100}


def test_a_branch_of_weight_nothing_takes_no_budget_from_others(spark):
    # All of books is a leaf of weight 0; its half of the budget goes to web.
    leaves = [("web", "en", "a", 1000), ("books", "en", "b", 1000), ("books", "de", "c", 10)]
    found = budgets(spark, leaves, [("source", "b", 0), ("lang", "de", 3)], 50)
    assert found == {("web", "en", "a"): 995, ("books", "en", "b"): 0, ("books", "de", "c"): 10}


def test_leaves_read_whole_epochs_and_a_prefix(spark):
    rows = [(i, "web", "en", "a", 10, "x", "y") for i in range(40)] + [(100 + i, "web", "en", "b", 10, "x", "y") for i in range(200)]
    lines = spark.createDataFrame(rows, ROWS)
    weights = spark.createDataFrame([("source", "a", 9), ("source", "b", 1)], WEIGHTS)
    chosen = mix_lines(lines, weights, total_percent=45, epochs=4, seed=3)
    found = chosen.collect()
    assert chosen.columns == [c for c in lines.columns if c != "n_epochs"] + ["n_epochs"]
    by_source = {s: [r for r in found if r["source"] == s] for s in "ab"}
    # 1080 tokens: 972 for a, which are two epochs of 400 and 17 lines more; 108 for b.
    assert sorted(r["n_epochs"] for r in by_source["a"]) == [2] * 23 + [3] * 17
    assert [r["n_epochs"] for r in by_source["b"]] == [1] * 10
    again = mix_lines(lines.repartition(5), weights, total_percent=45, epochs=4, seed=3).collect()
    other = mix_lines(lines, weights, total_percent=45, epochs=4, seed=4).collect()
    assert ordered(found) == ordered(again) != ordered(other)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, 5, "x", "y"),
        (1, None, None, None, 5, "x", "y"),
        (None, "web", "en", "a", 7, "x", "y"),
        (2, "web", "en", "a", None, "x", "y"),
        (3, "web", "en", "a", -4, "x", "y"),
        (4, "empty", "en", "a", 0, "x", "y"),
    ]
    lines = spark.createDataFrame(rows, ROWS)
    found = mix_lines(lines, spark.createDataFrame([], WEIGHTS), total_percent=100).collect()
    # A whole epoch has all lines of a leaf with tokens; the leaf without tokens has no budget.
    assert ordered((r["line_number"], r["domain"]) for r in found) == ordered(
        [(1, None), (1, None), (None, "web"), (2, "web"), (3, "web")]
    )
    assert mix_lines(lines.limit(0), spark.createDataFrame([], WEIGHTS), total_percent=100).count() == 0
