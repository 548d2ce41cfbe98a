import random
import re
import zlib

import numpy as np
import pytest

from logweave.llm import toxicity as tox


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    enc = tox.Encoder.fresh(3, 4, rng)
    for k in "wubv":
        setattr(enc, k, getattr(enc, k).astype(np.float64))
    x = rng.normal(size=(5, 6, 3))
    mask = (np.arange(6)[None, :] < np.array([6, 1, 3, 5, 2])[:, None]).astype(np.float64)
    aim = rng.normal(size=(5, 8))
    value = lambda: float((enc.forward(x, mask)[0] * aim).sum())
    dx, grads = enc.backward(aim, enc.forward(x, mask)[1])
    for array, grad in [(x, dx), *((getattr(enc, k), g) for k, g in zip("wubv", grads, strict=True))]:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in array.shape)
            old = array[at]
            array[at] = old + 1e-3
            up = value()
            array[at] = old - 1e-3
            down = value()
            array[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3


def test_windows_overlap_and_cover():
    for n in (0, 1, 8, 24, 25, 40, 41, 1000):
        starts = list(tox.window_starts(n))
        covered = {i for s in starts for i in range(s, min(n, s + tox.WINDOW))}
        assert starts[0] == 0 and covered == set(range(n))
    assert tox.words_of("A" * 40 + " b") == ["a" * 16, "a" * 16, "a" * 8, "b"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    part = lambda k: "".join(rng.choice(["ta", "re", "on", "mi", "lu", "so"]) for _ in range(k))
    out = []
    for i in range(700):
        words = [part(rng.randrange(1, 5)) for _ in range(rng.randrange(5, 120))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["zgrx", "vokk"]) + part(rng.randrange(0, 2)))
        out.append((i, " ".join(words), y))
    return out


@pytest.fixture(scope="module")
def net(rows):
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    own = [r for r in rows if not held(r[0])]
    return tox.fit([r[1] for r in own], [r[2] for r in own], 0.3)


def test_held_out_accuracy(rows, net):
    other = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    p = net.scores([r[1] for r in other])
    y = np.array([r[2] for r in other])
    assert ((p >= 0.3) == (y == 1)).mean() > 0.93


def test_batches_and_masks_do_not_change_scores(rows, net):
    texts = [r[1] for r in rows[:20]] + [None, "", "\n", "x" * 5000, "日本語 🙂", "word " * 3000]
    alone = np.array([float(net.scores([t])[0]) for t in texts])
    assert np.allclose(net.scores(texts), alone, atol=1e-4) and ((alone >= 0) & (alone <= 1)).all()


def plain_window_logit(net, words):
    """One window by reading the definition: a loop over places, directions and gates."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def encode(e, inputs):
        h_size, n = e.hidden, len(inputs)
        states = [[None] * n, [None] * n]
        for d in (0, 1):
            h = np.zeros(h_size)
            for t in range(n) if d == 0 else range(n - 1, -1, -1):
                x, s = inputs[t] @ e.w[d] + e.b[d], h @ e.u[d]
                z, r = sigmoid(x[:h_size] + s[:h_size]), sigmoid(x[h_size : 2 * h_size] + s[h_size : 2 * h_size])
                c = np.tanh(x[2 * h_size :] + r * s[2 * h_size :])
                h = (1 - z) * c + z * h
                states[d][t] = h
        both = [np.concatenate([a, b]) for a, b in zip(*states, strict=True)]
        if not both:
            return np.zeros(2 * h_size)
        weight = np.exp([x @ e.v for x in both])
        return sum(w * x for w, x in zip(weight / weight.sum(), both, strict=True))

    inputs = []
    for w in words:
        letters = [net.letters[ord(c) if ord(c) < 256 else 256 + ord(c) % (tox.LETTERS - 256)] for c in w]
        inputs.append(np.concatenate([encode(net.inner, letters), net.words[net.vocabulary.get(re.sub(r"^[\W_]+|[\W_]+$", "", w), 0)]]))
    return float(encode(net.outer, inputs) @ net.top + net.bias[0])


def test_scores_are_those_of_a_plain_forward_pass(rows, net):
    a, b = net.scale
    for text in [rows[5][1], rows[11][1] + " zgrxta", "one", "", "Ünï-cödé 日本語 " + "y" * 40]:
        words = tox.words_of(text)
        best = max(plain_window_logit(net, words[s : s + tox.WINDOW]) for s in tox.window_starts(len(words)))
        assert abs(float(net.scores([text])[0]) - 1 / (1 + np.exp(-(a * best + b)))) < 1e-4


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 23, 24, 25, 40, 41, 500, 1003])
def test_runs_of_words_have_the_windows_of_the_text(n):
    rng = random.Random(n)
    words = [f"w{i}" + "x" * rng.randrange(0, 12) for i in range(n)]
    text = "".join(w + rng.choice([" ", "  ", "\n"]) for w in words)
    want = [words[s : s + tox.WINDOW] for s in tox.window_starts(n)]
    for chars in (1, 30, 200, 10**6):
        runs = list(tox.word_runs(text, chars))
        assert [r[s : s + tox.WINDOW] for r in runs for s in tox.window_starts(len(r))] == want


def test_long_text_and_every_frequent_word(net, monkeypatch):
    text = "mi lu so " * 4000 + "zgrxta vokkmi zgrxre" + " ta re on" * 4000
    whole = net.text_logits([text])[0]
    monkeypatch.setattr(tox, "RUN_CHARS", 1000)
    monkeypatch.setattr(tox.word_runs, "__defaults__", (1000,))
    assert np.allclose(net.worst([text]), whole, atol=1e-4)
    many = " ".join(f"v{i}" for i in range(40_000))
    made = tox.fit([many, many, many, many + " bad bad", many + " bad"], [0, 0, 0, 1, 1], 0.3, rounds=1)
    assert len(made.vocabulary) >= 40_000


def test_query_and_odd_rows(spark, rows, net, tmp_path):
    from pyspark.sql import functions as F

    from logweave.llm.queries import QUERIES

    docs = spark.createDataFrame([(*r[:2], "x") for r in rows] + [(5000, None, None), (None, "a", "b"), (5001, "", "q")], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5000, 1, None), (None, 1, 1), (3, 0, rows[3][2])], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op1_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
    sample, share = tox.sample_labels(docs, labels, 50)
    assert len(sample) == 100 and not any(zlib.crc32(str(d).encode()) % 4 == 2 for d, _, _ in sample)
    again = docs.unionAll(spark.createDataFrame([(rows[0][0], "a smaller text", "x")], docs.schema))
    texts = {d: t for d, t, _ in tox.sample_labels(again, labels, 10**6)[0]}
    assert texts.get(rows[0][0], "a smaller text") == min("a smaller text", rows[0][1])
    few, _ = tox.sample_labels(docs, labels, 10**6, fit_bytes=4000)
    assert few and all(sum(len(t.encode()) for _, t, k in few if k == y) <= 2000 for y in (0, 1))
    assert tox.score(docs.withColumn("score", F.lit("clash")).limit(0), net).collect() == []


def test_one_label_only():
    assert (tox.fit(["a", "b"], [0, 0], 0.1).scores(["a", "zz"]) < 0.1).all()
    assert (tox.fit([], [], 0.1).scores(["a"]) < 0.1).all()
