"""Removal of repeated word runs: a count-min prefilter, then exact grouping.

A window is `width` consecutive words of one text.  Pass one builds a count-min
sketch of all windows: every task sketches its own share, the shares are merged
by sketch segment, and since only "once" and "more than once" matter a merged
cell is one bit.  Counts are never underestimated, so a window that really
repeats is always marked.  Pass two ships only marked windows, grouped exactly
by a 96-bit hash of their word sequence, and finds those that start earlier.

Volumes: the sketch takes about one byte a window, row and task on the way and
`max_sketch_bits` bits a row when broadcast.  Above that size more windows are
marked needlessly; the result stays the same.  In pass two a task sends at most
one row a distinct window, so a passage in a third of all texts costs one row a
task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import bucket_count, free_names, release_memory, released_pair, releasing, small_batches
from .textnum import chunks, find_words, mix64, windows, within_texts

SEGMENTS = 64
FLUSH_WINDOWS = 1_000_000
NO_ID = np.iinfo(np.int64).min
_SALTS = (np.uint64(0), np.uint64(0x9FB21C651E98DF25))


def pack_sorted(values: np.ndarray) -> bytes:
    """Distinct ascending integers as gaps of one byte each; 255 says that the gap goes on."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    more, rest = np.divmod(gaps, 255)
    out = np.full(int(more.sum()) + len(values), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(raw != 255)
    return np.cumsum(raw, dtype=np.int64)[last] + np.arange(len(last))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix64(h ^ _SALTS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _sketch(texts: DataFrame, width: int, bits: int) -> np.ndarray:
    """Merged sketch: for each row, packed bits of the cells with a count above one."""
    part_bits = bits - int(math.log2(SEGMENTS))

    def share(batches):
        held, size = [], 0

        def flush():
            h = np.concatenate(held)
            for row in range(len(_SALTS)):
                cells = np.sort(_cells(h, row, bits))
                fresh = np.ones(len(cells), dtype=bool)
                fresh[1:] = cells[1:] != cells[:-1]
                again = np.zeros(len(cells), dtype=bool)
                again[1:] = ~fresh[1:]
                once = cells[fresh]
                twice = np.unique(cells[again])
                edges = (np.arange(SEGMENTS + 1, dtype=np.uint64) << np.uint64(part_bits)).astype(np.uint64)
                a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
                low = np.uint32((1 << part_bits) - 1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(row * SEGMENTS + np.arange(SEGMENTS), pa.int32()),
                        "once": pa.array([pack_sorted(once[i:j] & low) for i, j in zip(a, a[1:], strict=False)], pa.binary()),
                        "twice": pa.array([pack_sorted(twice[i:j] & low) for i, j in zip(b, b[1:], strict=False)], pa.binary()),
                    }
                )

        for batch in batches:
            for piece in chunks(batch, "text"):
                words = find_words(piece.column("text"))
                at, _ = within_texts(words, width)
                if len(at):
                    held.append(windows(words.hashes(), width)[at])
                    size += len(at)
                if size >= FLUSH_WINDOWS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << part_bits, dtype=bool), np.zeros(1 << part_bits, dtype=bool)
        for batch in batches:
            for o, t in zip(batch.column("once"), batch.column("twice"), strict=True):
                cells = unpack_sorted(o.as_py())
                twice[cells[once[cells]]] = True
                once[cells] = True
                twice[unpack_sorted(t.as_py())] = True
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})
        release_memory()

    shares = texts.select("text").mapInArrow(releasing(share), "part int, once binary, twice binary")
    merged = np.zeros((len(_SALTS) * SEGMENTS, (1 << part_bits) // 8), dtype=np.uint8)
    for part, packed in shares.groupBy("part").applyInArrow(merge, "part int, bits binary").toLocalIterator():
        merged[part] = np.frombuffer(packed, dtype=np.uint8)
    return merged.reshape(len(_SALTS), -1)


def _repeats(h: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    kept = np.arange(len(h))
    for row in range(len(sketch)):
        cells = _cells(h[kept], row, bits)
        kept = kept[(sketch[row][cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & 1 == 1]
    return kept


def _squeeze(values: np.ndarray, kind: str) -> bytes:
    return pa.compress(values.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _expand(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind) if n else np.empty(0, dtype=kind)


_PACKED = "bucket int, n int, one binary, two binary, doc binary, pos binary"


def _later(one: np.ndarray, two: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first row of each key, and of the rows that start later than it."""
    if not len(one):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    order = np.lexsort((pos, doc, two, one))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = same & ((doc[order] != doc[order[head]]) | (pos[order] != pos[order[head]]))
    return order[~same], order[later]


def _packed_rows(bucket: np.ndarray, buckets: int, doc: np.ndarray, pos: np.ndarray, one: np.ndarray | None = None, two: np.ndarray | None = None):
    """A batch with one row for each bucket in use."""
    order = np.lexsort((pos, doc, bucket))
    bucket, doc, pos = bucket[order], doc[order], pos[order]
    one, two = (x[order] if x is not None else None for x in (one, two))
    used, begin = np.unique(bucket, return_index=True)
    spans = list(zip(begin, [*begin[1:], len(bucket)], strict=True))
    none = [None] * len(spans)
    yield pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(used, pa.int32()),
            "n": pa.array([b - a for a, b in spans], pa.int32()),
            "one": pa.array([one[a:b].tobytes() for a, b in spans] if one is not None else none, pa.binary()),
            "two": pa.array([two[a:b].tobytes() for a, b in spans] if two is not None else none, pa.binary()),
            "doc": pa.array([_squeeze(doc[a:b], "<i8") for a, b in spans], pa.binary()),
            "pos": pa.array([_squeeze(pos[a:b], "<i4") for a, b in spans], pa.binary()),
        }
    )


def _unpacked(rows: pa.Table | pa.RecordBatch):
    for n, one, two, doc, pos in zip(*(rows.column(c).to_pylist() for c in ("n", "one", "two", "doc", "pos")), strict=True):
        yield (np.frombuffer(one, dtype="<u8") if one is not None else None, np.frombuffer(two, dtype="<u4") if two is not None else None, _expand(doc, n, "<i8"), _expand(pos, n, "<i4"))


def _hot_ids(texts: DataFrame, rows: int, buckets: int) -> dict[int, int]:
    """Ids with more rows than a bucket's even share, and over how many buckets theirs go; fewer than `buckets` ids."""
    even = max(1000, -(-rows // buckets))
    counts = texts.groupBy(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id")).count().where(F.col("count") > even)
    return {r.id: min(buckets, -(-r["count"] // even)) for r in counts.collect()}


def _mark_rows(doc: np.ndarray, pos: np.ndarray, buckets: int, hot: dict[int, int]):
    """Packed marks by bucket, those of a hot id for each of its buckets."""
    bucket = np.mod(doc, buckets)
    for name, n in hot.items():
        own = np.flatnonzero(doc == name)
        if len(own):
            more = np.arange(1, n)
            bucket = np.concatenate([bucket, np.tile((name + more) % buckets, (len(own), 1)).T.ravel()])
            doc, pos = np.concatenate([doc, np.tile(doc[own], n - 1)]), np.concatenate([pos, np.tile(pos[own], n - 1)])
    yield from _packed_rows(bucket.astype(np.int32), buckets, doc, pos)


def _marks(texts: DataFrame, width: int, sketch: np.ndarray, bits: int, buckets: int, hot: dict[int, int]) -> DataFrame:
    """Packed (doc, pos) of every window that also starts earlier, by bucket of the doc."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def candidates(batches):
        held, size = [], 0

        def flush():
            one, two, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            first, later = _later(one, two, doc, pos)
            yield from _packed_rows((one[first] % np.uint64(buckets)).astype(np.int32), buckets, doc[first], pos[first], one[first], two[first])
            if len(later):
                yield from _packed_rows(np.mod(doc[later], buckets).astype(np.int32), buckets, doc[later], pos[later])

        for batch in batches:
            for piece in chunks(batch, "text"):
                words = find_words(piece.column("text"))
                at, owner = within_texts(words, width)
                if not len(at):
                    continue
                hashes = words.hashes()
                one = windows(hashes, width)[at]
                kept = _repeats(one, shared.value, bits)
                if not len(kept):
                    continue
                two = (windows(hashes, width, base=0xE7037ED1A0B428DB)[at[kept]] >> np.uint64(32)).astype(np.uint32)
                ids = piece.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((one[kept], two, ids[owner[kept]], (at[kept] - words.first[owner[kept]]).astype(np.int32)))
                size += len(kept)
                if size >= FLUSH_WINDOWS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def decide(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, keyed = [], []
        for batch in batches:
            for one, two, doc, pos in _unpacked(batch):
                (passed if one is None else keyed).append((one, two, doc, pos))
        docs, places = [x[2] for x in passed], [x[3] for x in passed]
        if keyed:
            one, two, doc, pos = (np.concatenate(x) for x in zip(*keyed, strict=True))
            _, later = _later(one, two, doc, pos)
            docs.append(doc[later])
            places.append(pos[later])
        doc, pos = np.concatenate(docs), np.concatenate(places)
        if len(doc):
            yield from _mark_rows(doc, pos, buckets, hot)
        release_memory()

    return texts.select("doc_id", "text").mapInArrow(releasing(candidates), _PACKED).groupBy("bucket").applyInArrow(decide, _PACKED).select("bucket", "n", "one", "two", "doc", "pos")


def kept_words(texts: pa.Array, rows_of: dict[int, np.ndarray], width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without the words that the marked windows cover, words joined by one space; also words and removed words."""
    words = find_words(texts)
    counts = words.counts
    change = np.zeros(len(words.starts) + width + 1, dtype=np.int32)
    for row, pos in rows_of.items():
        pos = pos[pos + width <= counts[row]] + words.first[row]
        np.add.at(change, pos, 1)
        np.add.at(change, pos + width, -1)
    keep = np.cumsum(change)[: len(words.starts)] == 0
    left = np.concatenate(([0], np.cumsum(keep)))[words.first]
    starts, sizes = words.starts[keep], (words.ends - words.starts)[keep] + 1
    stop = np.cumsum(sizes)
    out = np.empty(0, dtype=np.uint8)
    if len(starts):
        place = np.repeat(starts - (stop - sizes), sizes) + np.arange(stop[-1])
        out = words.data[np.minimum(place, len(words.data) - 1)]
        out[stop - 1] = 0x20
    edge = np.concatenate(([0], stop))[left]
    body = out.tobytes()
    made = [body[a : b - 1] if b > a else b"" for a, b in zip(edge, edge[1:], strict=False)]
    return pa.array(made, pa.binary()).cast(pa.string()), counts, counts - np.diff(left)


def dedup_substrings(docs: DataFrame, width: int = 20, max_sketch_bits: int = 30) -> DataFrame:
    """Remove every word covered by a window whose word sequence also starts earlier.

    Earlier means a smaller doc_id, or the same doc_id and an earlier word.
    Needs columns doc_id (integer) and text; all columns pass through and
    n_words, n_removed (bigint) and kept (string) are added, replacing columns
    of those names.  All windows are judged on the input.

    Null texts have no words and an empty `kept`.  Texts shorter than `width`
    words lose nothing.  Rows that share a doc_id count as one document: equal
    windows at the same word of both are the same window, and both rows get the
    document's marks.  A null doc_id counts as the smallest id.  A text of any
    length is read whole.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    names = ("n_words", "n_removed", "kept")
    keep = [c for c in docs.columns if c not in names]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = min(max_sketch_bits, max(16, math.ceil(math.log2((size[0] or 0) / 6 + 2))))
    buckets = bucket_count(docs)
    hot = _hot_ids(texts, size[1], buckets)
    sketch = _sketch(texts, width, bits)
    marks = _marks(texts, width, sketch, bits, buckets, hot)
    (me,) = free_names(docs, "dedup_bucket")
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NO_ID)))
    spread = F.lit(0)
    if hot:
        table = F.create_map(*(F.lit(x) for item in hot.items() for x in item))
        # by input split, so that a repeated task deals its rows alike
        spread = F.pmod(F.spark_partition_id(), F.coalesce(F.element_at(table, doc_id), F.lit(1)))
    bucket = F.pmod(F.pmod(doc_id, F.lit(buckets)) + spread, F.lit(buckets)).cast("int")
    rows = docs.select(bucket.alias(me), *(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def apply(mine: pa.Table, found: pa.Table) -> pa.Table:
        doc, pos = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in zip(*((d, p) for _, _, d, p in _unpacked(found)), strict=True)) if len(found) else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32))
        order = np.argsort(doc, kind="stable")
        doc, pos = doc[order], pos[order].astype(np.int64)
        parts = [[], [], []]
        for batch in mine.combine_chunks().to_batches():
            for piece in chunks(batch, "text"):
                ids = piece.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                a, b = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
                made = kept_words(piece.column("text"), {r: pos[a[r] : b[r]] for r in np.flatnonzero(b > a)}, width)
                for have, new in zip(parts, made, strict=True):
                    have.append(new)
        columns = [mine.column(c) for c in keep]
        n_words, n_removed = (pa.array(np.concatenate(x) if x else [], pa.int64()) for x in parts[1:])
        kept = pa.chunked_array(parts[0], pa.string())
        return pa.Table.from_arrays([*columns, n_words, n_removed, kept], schema.fieldNames())

    return rows.groupBy(me).cogroup(marks.groupBy("bucket")).applyInArrow(released_pair(apply), schema)
