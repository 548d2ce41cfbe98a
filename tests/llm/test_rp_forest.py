import numpy as np

from logweave.llm import rp_forest


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    body = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in rows:
        if i % every == 0:
            d = np.sqrt(((body - np.asarray(v, dtype=np.float64)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 32))
    body = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 32))).astype(np.float32)
    rows = [(i, body[i].tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = answers(rp_forest.nearest(df, sample_rows=1500, leaf_size=32, block=50, query_block=3))
    want = brute(rows, 10, 100)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q, found in got.items():
        for v, s in found:
            assert abs(s - np.sqrt(((body[q].astype(float) - body[v].astype(float)) ** 2).sum())) < 1e-12


def test_copies_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i), 1.0, 0.0]) for i in range(30)]
    odd = [(2000, None), (2100, [0.0, 0.0, 0.0]), (2200, [1.0, None, 2.0]), (2300, [float("nan"), 1.0, 1.0]), (2400, [float("inf"), 1.0, 1.0]), (2500, [1.0, 2.0]), (2600, []), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd + rows[:3]], "vec_id bigint, embedding array<float>, rank string").repartition(3)
    got, want = answers(rp_forest.nearest(df)), brute(rows, 10, 100)
    assert {q: [x for x, _ in v] for q, v in got.items()} == {q: [x for x, _ in v] for q, v in want.items()}
    assert got[300][0] == (0, 0.0)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id bigint, embedding array<float>")
    assert answers(rp_forest.nearest(df)) == {0: [(5, 1.0)]}
    assert rp_forest.nearest(df.limit(0)).collect() == []
