import random
import zlib

import numpy as np
import pytest

from logweave.llm import packing

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.json")


def reference(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "\n\n  x", "it's we'll I'D", "a\x1cb\x85c　d", "<|endoftext|> x", "a <|endoftext|> b", "a<|endoftext|", "<|endoftext|><|endoftext|>", "日本語 テキスト", "naïve ßé ÿ—“quoted” €5 ½ ²", "͸῰", "x" * 3000, "\xa0 \xa0a \t b", "👍🏽 ok", "1234567 ٣٤"]


def test_ids_are_the_tokenizers(path):
    tokens, want = packing.load_tokens(path), reference(path)
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice(["a", "b", " ", "c", "d", "é", "'", "s", "t", "!", "\n", "\t", " ", "1", "2", "_", "ß", "—", "<|endoftext|>", "<|"]) for _ in range(rng.randrange(200))) for _ in range(300)]
    assert tokens.fast is not None
    for t in texts:
        assert tokens.encode(t).tolist() == want(t)


def plain_difference(sizes, windows):
    """The same rule on full lists: merge the two partial partitions of the largest imbalance, fullest with emptiest."""
    parts = [(sorted([(s, [i])] + [(0, [])] * (windows - 1), key=lambda x: -x[0]), k) for k, (i, s) in enumerate(enumerate(sizes))]
    tick = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0][0] - p[0][-1][0]), p[1]))
        (a, _), (b, _), *parts = parts
        merged = [(x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        parts.append((sorted(merged, key=lambda x: -x[0]), tick))
        tick += 1
    return sorted(s for s, _ in parts[0][0])


@pytest.mark.parametrize("n,windows", [(2, 2), (9, 3), (40, 7), (60, 4), (25, 12)])
def test_differencing_is_that_of_full_lists(n, windows):
    rng = random.Random(n * windows)
    sizes = rng.sample(range(1, 4000), n)
    sums = np.bincount(packing.difference(sizes, windows), weights=sizes, minlength=windows)
    assert sorted(sums.astype(int).tolist()) == plain_difference(sizes, windows)


@pytest.mark.parametrize("n,windows", [(1, 1), (5, 2), (40, 7), (300, 20), (10, 30)])
def test_differencing_is_level(n, windows):
    rng = random.Random(n)
    sizes = [rng.randrange(1, 60) for _ in range(n)]
    window = packing.difference(sizes, windows)
    sums = np.bincount(window, weights=sizes, minlength=windows)
    assert len(window) == n and sums.sum() == sum(sizes) and window.max() < windows
    if n >= 10 * windows:
        assert sums.max() - sums.min() <= 2


def test_windows_rise_with_capacity():
    window, n = packing.divide([6, 6, 6], 10)
    assert n == 3 and sorted(window.tolist()) == [0, 1, 2]


def check_pieces(rows, texts, encode, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.array([*encode(texts[doc] or ""), 0], dtype="<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_pack_covers_every_id_once(spark, path):
    rng = random.Random(1)
    words = ["alpha", "Ünder", "x1", "\n", "it's", "☃", "of the"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 900))) for i in range(150)}
    texts |= {1000 + k: t for k, t in enumerate(ODD)} | {2000: None, 2001: "long " * 9000}
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id bigint, text string, start int").repartition(3)
    rows = packing.pack(df, path).collect()
    check_pieces(rows, texts, reference(path), 1024)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 1024) * 1.05 + 3
    assert packing.pack(df.limit(0), path).collect() == []
    with_ids = packing.pack(df, path, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in with_ids)


def test_repeated_and_nameless_rows(spark, path):
    rows = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id bigint, text string"), path).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 1] and {r.length for r in rows} == {3}
