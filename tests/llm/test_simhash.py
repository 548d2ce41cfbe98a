import random
import re

import numpy as np
import pytest
import xxhash

from logweave.llm import simhash
from logweave.llm.components import connected, connected_local

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_fingerprint_matches_plain_form():
    for text in (None, "", " \n", "One", "one TWO", "a b c", "Ä ß É\x1fx y", "the cat " * 700, "É" * 5000):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("crowd", [60, 5000])
def test_links_find_every_pair(spark, crowd):
    rng = random.Random(crowd)
    base = [rng.getrandbits(64) for _ in range(crowd // 8)]
    fps = {f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for f in base for _ in range(4)}
    hub = rng.getrandbits(64)
    fps |= {hub ^ sum(1 << b for b in rng.sample(range(12), rng.randrange(0, 9))) for _ in range(crowd)}
    fps = sorted(fps)
    arr = np.array(fps, dtype=np.uint64)
    pairs = [(i, j) for i in range(len(fps)) for j in (np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 2) + i + 1).tolist()]
    classes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp bigint, rep bigint").repartition(3)
    found = [(r.a, r.b) for r in simhash.links(classes).collect()]
    assert components(len(fps), found) == components(len(fps), pairs)


@pytest.mark.parametrize("crowd", [40, 300])
def test_crowded_keys_are_compared_in_blocks(spark, crowd):
    rng = random.Random(crowd)
    hub = rng.getrandbits(64)
    fps = sorted({hub ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(0, 7))) for _ in range(900)})
    arr = np.array(fps, dtype=np.uint64)
    pairs = [(i, j) for i in range(len(fps)) for j in (np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 2) + i + 1).tolist()]
    classes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp bigint, rep bigint").repartition(3)
    found = [(r.a, r.b) for r in simhash.links(classes, crowd=crowd).collect()]
    assert components(len(fps), found) == components(len(fps), pairs)
    assert all(bin(fps[a] ^ fps[b]).count("1") > 0 for a, b in found)


def test_components_of_chain_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(259, 300)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 200 for i in [*range(200, 260), 300]}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    assert connected_local(4, np.array([3, 1]), np.array([1, 0])).tolist() == [0, 0, 2, 0]


def test_whole_operator(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 80))) for _ in range(80)]
    texts += [texts[0], texts[0] + " x", None, "", "  "]
    rows = [(i * 2 + 1, t, "clash") for i, t in enumerate(texts)] + [(1, texts[0], "clash"), (None, "odd", None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(3)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    comp = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    want = [(i * 2 + 1, f"{f:016x}", comp[i] * 2 + 1) for i, f in enumerate(fps)] + [(1, f"{fps[0]:016x}", 1)]
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(want)
    assert [(r.fingerprint, r.component_id) for r in got if r.doc_id is None] == [(f"{plain_fingerprint('odd'):016x}", None)]


def jaccard_groups(rows, shingle=5, at=0.8):
    sets = {}
    for d, t in rows:
        words = WORD.findall((t or "").lower())
        sets[d] = {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} or {tuple(words)}
    ids = sorted(sets)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids)) if len(sets[ids[i]] & sets[ids[j]]) >= at * len(sets[ids[i]] | sets[ids[j]])]
    comp = components(len(ids), pairs)
    return {d: ids[c] for d, c in zip(ids, comp, strict=True)}


def test_similar_groups_match_exact_jaccard(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.randrange(60, 300))]
        for k in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 40]) if k else 0):
                words[rng.randrange(len(words))] = word()
            rows.append((g * 10 + k + 1, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "\n"), (903, "one two"), (904, "One  TWO"), (905, "one two three")]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "n", "y"), (1, rows[0][1], "z")], "doc_id bigint, text string, fp string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert got == jaccard_groups(rows)
    kept = simhash.keep_one(df).collect()
    assert sorted(r.doc_id or -1 for r in kept) == sorted([-1, *(d for d, c in got.items() if d == c)])
    assert len(kept) == 1 + len({c for c in got.values()})
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp"} and simhash.similar_groups(df.limit(0)).collect() == []


def test_pairs_in_the_middle_of_large_families_are_found(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    edited = lambda words, at: [word() if i in at else w for i, w in enumerate(words)]
    spots = lambda n: set(rng.sample(range(5, 295, 5), n))
    rows = []
    for f in range(2):
        base = [word() for _ in range(300)]
        texts = [edited(base, spots(3 if k in (120, 180) else 9)) for k in range(300)]
        rows += [(f * 1000 + k, " ".join(w)) for k, w in enumerate(texts)]
    want = jaccard_groups(rows)
    assert want[180] == 120 and want[1180] == 1120
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_common_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, top, 60).astype("<u4")) for top in [90] * 30 + [4000] * 30]
    both = simhash._common(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(60) for j in range(60) if i != j)
