import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    from lumenrank.session import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(1, None), (2, ""), (3, "One"), (4, "one"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"),
            (6, " \t\n"), (7, "é" * 5), (8, "x " * 50_000), (9, "  odd \x00 text 日本語."), (10, "a b c d e f")]
    return spark.createDataFrame([(i, t, 1, "s", 0.5, 2) for i, t in rows],
                                 "doc_id long, text string, score int, TEXT string, component_id double, _n int")


@pytest.fixture(scope="session")
def families(spark):
    """Near copies around bases, many of them close to the threshold, and loose texts."""
    random.seed(3)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(2):
        base = [random.choice(words) for _ in range(100)]
        for _ in range(45):
            w = base[:]
            for _ in range(random.randint(0, 18)):
                w[random.randrange(len(w))] = random.choice(words)
            rows.append(" ".join(w))
    rows += [" ".join(random.choice(words) for _ in range(random.randint(0, 30))) for _ in range(40)]
    return list(enumerate(rows))
