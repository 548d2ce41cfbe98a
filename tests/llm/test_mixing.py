import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from logweave.llm import mixing

W = mixing.Weights({"a": 0.7, "b": 0.3}, {"en": 0.5, "de": 0.5}, {}, 0.2)


def test_share_out():
    assert mixing.share_out(10, [1, 1], [100, 100]) == [5, 5]
    assert mixing.share_out(10, [1, 1], [2, 100]) == [2, 8]
    assert mixing.share_out(11, [1, 1, 2], [3, 100, 1]) == [3, 7, 1]
    assert mixing.share_out(50, [0, 1], [30, 10]) == [30, 10]
    assert mixing.share_out(20, [0, 1], [30, 10]) == [10, 10]
    assert mixing.share_out(10, [1, 1, 1], [9, 9, 9]) == [4, 3, 3]
    assert mixing.share_out(5, [], []) == []


def test_siblings_before_ancestors():
    tokens = {("a", "en", "s1"): 10, ("a", "de", "s2"): 100, ("b", "en", "s3"): 1000}
    given = mixing.allocate(tokens, mixing.Weights({"a": 1, "b": 1}, {}, {}), 120, 1)
    # a gets 60: s1 can use 10 of its 30, its sibling takes the other 20; b is not touched
    assert given == {("a", "en", "s1"): 10, ("a", "de", "s2"): 50, ("b", "en", "s3"): 60}
    given = mixing.allocate(tokens, mixing.Weights({"a": 1, "b": 1}, {}, {}), 400, 1)
    assert given == {("a", "en", "s1"): 10, ("a", "de", "s2"): 100, ("b", "en", "s3"): 290}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(spark, rows, weights, budget, max_epochs, seed):
    """Streams laid out in full: every leaf sorted by the engine's hash, cut by a running sum."""
    leaves = defaultdict(list)
    for doc, text, lang, source in rows:
        leaves[(source[:1] if source else "", lang or "", source or "")].append((doc if doc is not None else -(2**63), text))
    tokens = {k: sum(words(t) for _, t in v) for k, v in leaves.items()}
    given = mixing.allocate(tokens, weights, budget, max_epochs)
    out = []
    texts = sorted({x for v in leaves.values() for x in v}, key=str)
    asked = spark.createDataFrame([(e, i, t) for e in range(max_epochs) for i, t in texts], "e int, i bigint, t string").select("e", "i", "t", F.xxhash64("t").alias("b"))
    keys = {(r.e, r.i, r.t): (r.k, r.i, r.b) for r in asked.select("*", F.xxhash64(F.lit(seed), "e", "i", "b").alias("k")).collect()}
    for leaf, docs in leaves.items():
        left = given[leaf]
        for e in range(max_epochs):
            if tokens[leaf] and left <= 0:
                break
            whole = left >= tokens[leaf]
            for doc, text in sorted(docs, key=lambda x: keys[(e, *x)]):
                n = words(text)
                take = min(n, left) if tokens[leaf] else 0
                if take or n == 0 and (left > 0 or not tokens[leaf] or whole):
                    out.append((leaf[0], doc, e, n, take))
                left -= take
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))), rng.choice(["en", "de", None]), rng.choice(["a1", "a1", "a1", "a2", "b1", "c9", None])) for i in range(500)]
    rows += [(None, "x y", "en", "a1"), (900, None, "fr", "z0"), (901, "", "fr", "z0")]
    rows += [(None, "lost id " * 3, "en", "a1")] * 90 + [(7, "same id", "de", "b1")] * 60 + [(7, "same id, other text", "de", "b1")] * 20 + [(None, None, "en", "a1")] * 30
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("epoch", F.lit("clash")).repartition(4)
    for budget, epochs in ((4000, 1), (9000, 3), (100, 2), (10**7, 2), (0, 1)):
        got = mixing.mix(df, W, F.substring("source", 1, 1), budget=budget, max_epochs=epochs, seed=5)
        got = sorted((r.domain, r.doc_id if r.doc_id is not None else -(2**63), r.epoch, r.n_tokens, r.take_tokens) for r in got.collect())
        assert got == sorted(brute(spark, rows, W, budget, epochs, 5))


@pytest.mark.parametrize("budget", [10, 100, 123, 555, 999])
def test_every_leaf_spends_its_budget(spark, budget):
    rows = [(None, "a b c d e f g h i j", "en", "a1")] * 10 + [(1, "a b c", "de", "a1")] * 40 + [(k % 3, "x " * (k % 7), "fr", "b1") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    tokens = Counter()
    for _, t, lang, source in rows:
        tokens[(source[:1], lang, source)] += words(t)
    given = mixing.allocate(tokens, W, budget, 2)
    got = Counter()
    for r in mixing.mix(df, W, F.substring("source", 1, 1), budget=budget, max_epochs=2).collect():
        got[(r.domain, r.lang, r.source)] += r.take_tokens
        assert r.take_tokens <= r.n_tokens
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in given.items() if v}
    assert sum(got.values()) == min(budget, 2 * sum(tokens.values()))


def test_clashing_columns_and_long_texts(spark):
    names = ["id", "x0", "n", "row", "key", "mixing_helper", "Mixing_Helper_plan", "__id", "range", "take_tokens"]
    df = spark.createDataFrame([(1, "w " * 300_000, "en", "a1", *names), (2, "v", "en", "a1", *names)], "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mix(df, W, F.lit("a"), share=0.5, max_epochs=1)
    assert [c for c in names if c not in got.columns] == []
    assert sum(r.take_tokens for r in got.select("take_tokens").collect()) == 150_000


def test_share_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d", "en", "a1"), (1, "a b c d", "en", "a1")], "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(df, W, F.lit("a"), share=0.5, max_epochs=1).collect()
    assert [r.take_tokens for r in got] == [4]
    assert mixing.mix(df.limit(0), W, F.lit("a"), share=0.5).collect() == []
    assert spark.range(1).select(mixing.first_tokens(F.lit(" a\n b c "), F.lit(2))).first()[0] == "a b"
    assert int(Fraction("0.1") * 10**6) == 100000
