"""The lexicon as a table against the lexicon as a list: untidy terms, repeated ids, long phrases, no lexicon."""

import random

import pytest

from tidecast.operators import sentiment as SN

LEX = "term STRING, cls STRING"


def both(spark, docs, pairs, keep=("id",)):
    df = spark.createDataFrame(docs, "id INT, text STRING").repartition(3)
    out = []
    for lexicon in (pairs, spark.createDataFrame(pairs, LEX)):
        rows = SN.lexicon_scores(df, "text", lexicon, keep=keep).collect()
        out.append(sorted((tuple(r) for r in rows), key=str))
    return out


def test_blanks_are_squeezed_and_equal_terms_agree(spark):
    pairs = [(" good ", "positive"), ("lack  of", "revert"), ("nice", "positive"), ("NICE\t", "negative"), ("", "positive"), (None, "positive"), ("x", None)]
    a, b = both(spark, [(1, "good lack of nice"), (2, None), (3, ""), (4, "x")], pairs)
    assert a == b
    got = {r[0]: r for r in a}
    assert got[1][1] == 4 and got[1][2] == 0.0  # one positive, and the greatest class of "nice", positive, turned by "lack of"


def test_repeated_ids_keep_their_own_scores(spark):
    a, b = both(spark, [(1, "good"), (1, "x bad bad"), (1, "good"), (None, "bad"), (None, None)], list(SN.DEFAULT_LEXICON))
    assert a == b
    assert sorted(r[2] for r in b if r[0] == 1) == [-2.0, 1.0, 1.0]


def test_random_phrases_match_the_list(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e"]
    classes = ["positive", "negative", "revert", "increment", "decrement"]
    pairs = [(" ".join(rng.choice(words[:3]) for _ in range(rng.randint(1, 6))), rng.choice(classes)) for _ in range(40)]
    docs = [(i % 20, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(60)]
    a, b = both(spark, docs, pairs)
    assert a == b and any(r[2] for r in a)


def test_an_empty_lexicon_and_trie_shape(spark):
    a, b = both(spark, [(1, "good")], [("  ", "positive")])
    assert a == b and a[0][1] == 1
    trie = {(r.node, r.word): (r.next, r.n, r.cls, r.more) for r in SN.lexicon_trie(
        spark.createDataFrame([("a b c", "positive"), ("a b", "negative"), ("z", "revert")], LEX)).collect()}
    assert trie == {("", "a"): ("a", 1, None, True), ("a", "b"): ("a b", 2, "negative", True), ("a b", "c"): ("a b c", 3, "positive", False),
                    ("", "z"): ("z", 1, "revert", False)}


def test_only_tokens_that_may_begin_a_term_become_rows(spark):
    df = spark.createDataFrame([(1, "the good of the day " * 50)], "id INT, text STRING")
    from pyspark.sql import functions as F
    a = df.select("id", F.split("text", " ").alias("_t"))
    gate = SN._gate(SN.lexicon_trie(spark.createDataFrame([("good day", "positive")], LEX)))
    assert a.select(F.size(F.filter("_t", gate))).first()[0] == 50


@pytest.mark.parametrize("n", [300])
def test_a_frequent_phrase_in_a_long_text(spark, n):
    a, b = both(spark, [(1, "not good at all " * n)], [("good at all", "positive"), ("not", "revert"), ("good", "negative")])
    assert a == b and a[0][2] == -1.0 * n
