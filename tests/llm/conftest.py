import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, bucket long, start int"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so", "ti") for b in ("ba", "de", "fi", "go", "lu", "ne", "s", "t")]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(words))


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty, blank, short, repeated and long texts, repeated and null ids, clashing names."""
    texts = [None, "", " \n\t", "one", prose(1, 40), prose(1, 40), prose(2, 60) + "\n" + prose(3, 30), prose(4, 30_000), "é😀 " * 30]
    rows = [(i, t, None if i == 3 else "en", "s", len(t or ""), f"n{i}", 7, i) for i, t in enumerate(texts)]
    rows += [rows[4], (None, prose(5, 50), "en", None, 3, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "node").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def bench(spark):
    items = [(0, prose(2, 60)), (1, "one"), (2, None), (3, ""), (4, prose(2, 60)), (None, prose(9, 20))]
    return spark.createDataFrame(items, "item_id long, text string")
