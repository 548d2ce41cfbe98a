import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import bloom_lm as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def make_rows(n=400):
    rng = random.Random(8)
    vocabulary = ["of", "the", "Ärger", "ß", "a"] + [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rng.randrange(0, 60))
        if rng.random() < 0.6:
            words += rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "never seen words here"), (3, rows[3][1])]


def plain_scores(rows):
    """Log probabilities of all tokens by reading the definition, with dictionaries in the filter's place."""
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    texts = [tokens(x) for d, x in rows if not held(d)]
    counts = Counter(t for ts in texts for t in ts)
    pairs = Counter((a, b) for ts in texts for a, b in zip([None, *ts], ts, strict=False))

    def quantised(c):
        return float(c) if c < 3 else 2 * 1.5 ** (math.floor(math.log(c / 2) / math.log(1.5) + 1e-9) + 0.5)

    mass, followers = Counter(), Counter()
    for (a, _), c in pairs.items():
        mass[a] += quantised(c)
        followers[a] += 1
    once, twice = (sum(c == k for c in pairs.values()) for k in (1, 2))
    discount = min(0.9, max(0.1, once / (once + 2 * twice)))
    n, v = sum(counts.values()), len(counts)

    def probability(a, b):
        plain = (counts[b] + 0.1) / (n + 0.1 * (v + 1))
        if a not in mass:
            return plain
        c = pairs[a, b]
        return (quantised(c) - discount if c else 0.0) / mass[a] + discount * followers[a] / mass[a] * plain

    return probability, counts


@pytest.mark.parametrize("frequent,most", [(1 << 20, 128 << 20), (40, 128 << 20), (0, 128 << 20), (40, 100)])
def test_base_and_score_are_those_of_plain_counts(spark, frequent, most):
    rows = make_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, h string").repartition(3)
    # so many bits an entry that the filter makes no mistake here
    got = sorted(lm.score(df, bits=1500.0, frequent_words=frequent, max_filter_bytes=most).collect(), key=lambda r: r.doc_id)
    probability, _ = plain_scores(rows)
    for (_, text), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        ts = tokens(text)
        assert abs(r.score - sum(math.log10(probability(a, b)) for a, b in zip([None, *ts], ts, strict=False))) < 1e-6
    got = sorted(lm.score(df, frequent_words=frequent, max_filter_bytes=most).collect(), key=lambda r: r.doc_id)
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for (d, text), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d, held(d), len(ts), sum(counts[t] > 0 for t in ts), n)
        assert abs(r.base_score - base) < 1e-6 and r.score <= 1e-12
    out = [r for r in got if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_after_a_context_add_up_to_one(spark):
    rows = make_rows()
    probability, counts = plain_scores(rows)
    for context in [None, "of", "the", "w3", "w399"]:
        assert abs(sum(probability(context, t) for t in [*counts, "never seen"]) - 1) < 1e-9
    texts = spark.createDataFrame([(x,) for d, x in rows if zlib.crc32(str(d).encode()) % 10], "text string").repartition(3)
    for bits, off in ((1500.0, 1e-6), (12.0, 0.2)):
        model = lm.train(texts, bits=bits)[0]
        words = [t for t in counts if t is not None]
        for context in ("of", "the", "w3", "w40"):
            stream = np.concatenate([lm.token_stream(pa.array([f"{context} {t}" for t in [*words, "never-seen"]]))[0], lm.token_stream(pa.array([context]))[0]])
            found = model.look_up(stream, lambda grams, bucket, places: model.counts.levels(grams, bucket))
            p = model.probability(found["level"], found["mass"], found["followers"], found["count"])
            after = np.array([*[i for i in range(1, 3 * (len(words) + 1), 3)], len(stream) - 1])
            assert -1e-6 < p[after].sum() - 1 < off


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    got = sorted(lm.score(df).collect(), key=lambda r: r.n_tokens)
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 1, 0, 0, 0.0), (True, 3, 0, 0, 0.0)]
    assert lm.score(df.limit(0)).collect() == []


def test_filter_levels_are_never_too_low():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    counts = rng.integers(1, 400, 20000)
    level = lm.entries_of(counts)
    size = int(level.sum() * 12) // 8 * 8 + 64
    body = np.zeros(size // 8, dtype=np.uint8)
    for g, q in zip(grams, level, strict=True):
        for step in range(1, q + 1):
            a, b = lm.CountFilter.hashes(np.array([g]), step)
            for probe in range(lm.PROBES):
                at = int(lm.CountFilter.place(a, b, size, probe)[0])
                body[at >> 3] |= 1 << (at & 7)
    made = lm.CountFilter.segment(grams, counts, 12)
    assert made[0] == size and (made[1] == body).all()
    found = lm.CountFilter(body, np.array([0]), np.array([size])).levels(grams, np.zeros(len(grams), dtype=np.int64))
    assert (found >= level).all() and (found == level).mean() > 0.99


def test_levels():
    assert lm.levels_of(np.array([0, 1, 2, 3, 4, 5])).tolist() == [0, 0, 1, 2, 2, 3]


@pytest.mark.parametrize("frequent", [1 << 20, 40])
def test_a_filter_too_large_to_broadcast_scores_alike(spark, frequent):
    df = spark.createDataFrame(make_rows(), "doc_id bigint, text string").repartition(3)
    whole, cut = (sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score(df, max_filter_bytes=most, frequent_words=frequent).collect()) for most in (256 << 20, 100))
    assert [x[:3] for x in whole] == [x[:3] for x in cut]
    assert np.allclose([x[3:] for x in whole], [x[3:] for x in cut], rtol=0, atol=1e-9)


def test_pairs_counted_once_are_known(spark):
    rows = [(i, f"left{i} right{i}") for i in range(300)]
    model = lm.train(spark.createDataFrame(rows, "id bigint, text string").repartition(3))[0]
    stream = np.concatenate([lm.token_stream(pa.array([t]))[0] for _, t in rows])
    found = model.look_up(stream, lambda grams, bucket, places: model.counts.levels(grams, bucket))
    assert (found["mass"] > 0).all() and (found["level"] > 0).all()
    assert lm.entries_of(np.array([0, 1, 2, 3, 4, 5])).tolist() == [0, 1, 2, 3, 3, 4]


def test_a_context_is_in_all_parts_of_its_group():
    layout = lm.Layout.of(67)
    rng = np.random.default_rng(2)
    before, after = rng.integers(0, 2**63, 3, dtype=np.uint64), rng.integers(0, 2**48, 500, dtype=np.uint64)
    for b in before:
        used = set(layout.of_pair(np.full(500, b), after).tolist())
        assert len(used) == layout.parts == 8 and {x // layout.parts for x in used} == {int(lm._slot(np.array([b]), layout.groups)[0])}


def test_repeats_long_texts_and_clashing_columns(spark):
    rows = [(1, "a b c", 1, 2), (1, "a b c", 1, 2), (2, "a b " * 400_000, 3, 4), (None, "A\tB", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, bucket int, score int")
    got = sorted(lm.score(df).collect(), key=lambda r: r.n_tokens)
    assert [r.n_tokens for r in got] == [3, 4, 4, 800_001] and got[1] == got[2]
    assert got[0].score > got[0].base_score


def test_the_driver_never_holds_the_whole_filter(spark):
    rng = random.Random(4)
    rows = [(" ".join(f"w{rng.randrange(3000)}" for _ in range(200)),) for _ in range(400)]
    texts = spark.createDataFrame(rows, "text string").repartition(8)
    lm.train(texts)  # what a first run needs is no part of the filter
    conf, key, most = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize", 16 << 20
    conf.set(key, str(most))
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}  # else so small a table is one split or few
    usual = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        before = anonymous_bytes()
        model = lm.train(texts, bits=4000.0)[0]
        assert model.counts.bits.nbytes > 2 * most and anonymous_bytes() - before < most
    finally:
        conf.remove(key)
        for k, v in usual.items():
            spark.conf.set(k, v)
    again = pickle.loads(pickle.dumps(model, protocol=pickle.HIGHEST_PROTOCOL)).counts
    assert type(again.bits) is np.ndarray and (again.bits == model.counts.bits).all()
    stream = lm.token_stream(pa.array([x for (x,) in rows]))[0]
    found = model.look_up(stream, lambda grams, bucket, places: again.levels(grams, bucket))
    pairs = Counter(zip([lm.END, *stream.tolist()], stream.tolist(), strict=False))
    counts = np.array([pairs[p] for p in zip(found["context"].tolist(), stream.tolist(), strict=True)])
    assert (found["level"] == lm.entries_of(counts)).all()


def anonymous_bytes():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(line.split()[1]) << 10 for line in f if line.startswith("Pss_Anon:"))
