import random

import pytest

SF_CHECK = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def _shipped():
    from tidecast.llm import ship_by_value
    ship_by_value()


@pytest.fixture(scope="session")
def edge_rows():
    """doc_id, text, lang, source, and columns whose names clash with added ones."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "été", "straße", "idiot", "x1"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60) + "."
    long_text = " ".join(f"w{i} {rng.choice(words)}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "a b c d", say(40), say(40), passage, passage,
             say(30) + ". " + passage + " " + say(20), passage[:-1] + " extra end.", long_text,
             long_text + " tail", "!!! ??? ...", "same line here now ok\nsame line here now ok\nother",
             "日本語 テキスト x", "* bullet\n- more\n• third", "a" * 5000]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None)[i % 3], "z", 1) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s1", "z", 1), (6, "other text of the same id " + say(20), "fr", "s2", "z", 1),
             (None, passage, None, None, None, None), (None, None, "en", "s1", None, None)]
    return rows


EDGE_SCHEMA = ("doc_id long, text string, lang string, source string, score string, n_words int")


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
