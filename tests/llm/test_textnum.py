import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import cluster, textnum

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet=st.sampled_from("ab Zé☃\n\t\r\x0b\x0c\x1c\x85\xa0 "), max_size=30) | st.none()


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(0, 3))
def test_words_are_found_and_hashed_by_value(texts, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    words = textnum.find_words(column)
    raw = [(t or "").encode() for t in column.to_pylist()]
    want = [WORD.findall(t) for t in raw]
    got = [bytes(words.data[a:b]) for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == [w for ws in want for w in ws] and words.counts.tolist() == [len(ws) for ws in want]
    hashes = words.hashes().tolist()
    by_word = dict(zip(got, hashes, strict=True))
    assert [by_word[w] for w in got] == hashes and len(set(by_word.values())) == len(by_word)
    low = words.hashes(lower=True).tolist()
    assert len(set(low)) == len({w.lower() for w in got})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 21))
def test_windows_hash_their_sequence(values, width):
    h = textnum.mix64(np.array(values, dtype=np.uint64))
    found = textnum.windows(h, width).tolist()
    keys = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(found) == len(keys) and len(set(zip(keys, found, strict=True))) == len(set(keys)) == len(set(found))


def test_windows_stay_in_their_text():
    words = textnum.find_words(pa.array(["a b c", None, "d", "e f"]))
    at, owner = textnum.within_texts(words, 2)
    assert at.tolist() == [0, 1, 4] and owner.tolist() == [0, 0, 3]


def test_chunks_cover_the_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10, None, "y" * 50, "", "z" * 5, "z" * 5]})
    assert [p.num_rows for p in textnum.chunks(batch, "text", 12)] == [2, 1, 3]
    assert list(textnum.chunks(batch.slice(0, 0), "text")) == []


def test_buckets_are_prime(spark):
    assert [cluster.next_prime(n) for n in (0, 2, 8, 13, 90)] == [2, 2, 11, 13, 97]
    assert cluster.bucket_count(spark.range(10)) == 13
