import hashlib
import random
import re

import numpy as np
import pytest

from logweave.llm.substring_dedup import dedup_substrings, pack_sorted, unpack_sorted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    first = {}
    split = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        split[doc] = words
        for p in range(len(words) - width + 1):
            key = tuple(words[p : p + width])
            first[key] = min(first.get(key, (doc, p)), (doc, p))
    out = {}
    for doc, words in split.items():
        gone = set()
        for p in range(len(words) - width + 1):
            if first[tuple(words[p : p + width])] < (doc, p):
                gone.update(range(p, p + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = (len(words), len(gone), kept)
    return out


def make_rows(seed, n=60):
    rng = random.Random(seed)
    passage = " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(60))
    rows = []
    for doc in range(n):
        words = [rng.choice(["x", "yé", "z", "the", "ß"]) + str(rng.randrange(9)) for _ in range(rng.randrange(0, 90))]
        text = " ".join(words)
        if rng.random() < 0.5:
            text = text + rng.choice([" ", "\n", "\t \r"]) + passage[: rng.randrange(10, len(passage))] + "  tail"
        if rows and rng.random() < 0.2:
            text = rng.choice(rows)[1]
        rows.append((doc * 3, text))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "rep " * 100), (1004, "\x1c\x85 a\xa0b " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,width", [(1, 20), (2, 5)])
def test_matches_brute_force(spark, seed, width):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in dedup_substrings(df, width).collect()}
    assert got == brute(rows, width)


def test_tiny_sketch_loses_nothing(spark):
    rows = make_rows(3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in dedup_substrings(df, 20, max_sketch_bits=9).collect()}
    assert got == brute(rows, 20)


def test_odd_rows_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, text, 7, "p"), (1, text, 8, "q"), (2, text, 9, None), (None, None, None, None)], "doc_id bigint, text string, n_words int, bucket string")
    got = sorted(((r.doc_id or -1), r.n_words, r.n_removed, r.bucket or "") for r in dedup_substrings(df).collect())
    assert got == [(-1, 0, 0, ""), (1, 25, 0, "p"), (1, 25, 0, "q"), (2, 25, 25, "")]
    assert dedup_substrings(df.limit(0)).collect() == []


def test_hot_ids_and_clashing_columns(spark):
    """A third of all rows without an id, many with one id: one document each, whose rows are in several buckets."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**12)}"
    passage = " ".join(word() for _ in range(30))
    rows = [(None, f"{passage} {word()} {word()}") for _ in range(1700)] + [(7, f"{word()} {passage} {word()}") for _ in range(1500)] + [(100 + i, " ".join(word() for _ in range(25)) + (" " + passage if i % 9 == 0 else "")) for i in range(400)]
    names = ["dedup_bucket", "Dedup_Bucket_", "bucket", "__bucket"]
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names)).repartition(6)
    got = dedup_substrings(df).collect()
    assert len(got) == len(rows) and all([r[n] for n in names] == names for r in got)
    # the passage starts first in the document without an id, at word 0; there it stays
    assert {r.n_removed for r in got if r.doc_id is None} == {0}
    assert {r.n_removed for r in got if r.doc_id == 7} == {30}
    assert {(r.doc_id - 100) % 9 == 0: r.n_removed for r in got if (r.doc_id or 0) >= 100} == {True: 30, False: 0}


def test_gap_coding_round_trip():
    for values in ([], [0], [255], [0, 1, 2], [254, 509, 510, 2000, 100000]):
        assert unpack_sorted(pack_sorted(np.array(values, dtype=np.uint32))).tolist() == values


def test_query_digest(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from logweave.llm.queries import ORACLES, QUERIES

    rows = make_rows(5)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op7_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got == {d: (n, m, hashlib.sha256(k.encode()).hexdigest()) for d, (n, m, k) in brute(rows, 20).items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {d: tuple(v) for d, *v in con.execute(ORACLES["op7_substring_dedup"]).fetchall()} == got
