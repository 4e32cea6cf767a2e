"""Small tables that hold the cases every text operator must stand."""

import random

LINES = "line_number long, line string, block_id string, kept string"


def odd_lines(spark, extra=()):
    """Null and repeated line numbers, null and empty lines, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(4)
    words = ["swap", "mint", "été", "program", "log:", "\n", "漢字", "###"]
    long_line = " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(3000))
    rows = [(1, "swap mint"), (1, "swap mint"), (2, None), (3, ""), (None, "swap mint"), (None, None), (7, long_line)]
    rows += [(8, long_line), (9, " \t\r\n"), *extra]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], LINES).repartition(3)


def no_lines(spark):
    return spark.createDataFrame([], LINES)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
