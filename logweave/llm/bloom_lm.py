"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs are quantised on a logarithmic scale.  A pair at level q is
entered q times, as (pair, 1) to (pair, q); a reader probes (pair, 1), (pair, 2),
... until a probe fails and so finds the level.  A wrong answer can only make a
level too high, and ever less likely so.

The filter is cut into one segment for each hash bucket, and the reducers that
sum a bucket's counts build its segment and keep nothing else of its pairs.  It takes `bits` bits an entry at any
size.  Up to `max_filter_bytes` the whole is broadcast; a larger one stays in its
segments, and the pairs of the texts are sent there and their levels back.

A pair's probability is its quantised count, less a discount, over the sum of
the quantised counts of all pairs of its context; what the discount leaves goes
to the exact unigram probabilities.  So the probabilities of all words after a
context, the unknown word being one, add up to one, but for the filter's false
positives.  Pairs are dealt by context, and their buckets by follower, so that
the reducers have those sums, too; the discount comes from the numbers of pairs
counted once and twice.

Counts and sums of the most frequent words travel with the model.  Those of all
others are asked for by hash: a share of the texts sends each of its rare words
once to the word's bucket, and the answers back to the tokens that wait for them.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import bucket_count, checkpoint, release_memory, released, released_pair, releasing, small_batches, steady
from .textnum import chunks, find_words, mix64

END = np.uint64(0x6C62272E07BB0142)  # the token that ends each text, and the context of its first word
FLUSH_TOKENS = 800_000
SCORE_TOKENS = 400_000
PULL_BYTES = 2 << 20  # of the filter that the driver asks for at once
STEP = 1.5  # ratio of neighbouring quantised counts
LEAST = 2  # smallest count of the logarithmic scale; a count of one is a level of its own below it
PROBES = 6
LEVELS = 64


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Quantised level of each count, 0 below LEAST."""
    safe = np.maximum(counts, 1) / LEAST
    return np.where(counts >= LEAST, np.floor(np.log(safe) / math.log(STEP) + 1e-9).astype(np.int64) + 1, 0)


def entries_of(counts: np.ndarray) -> np.ndarray:
    """How often each count is entered: once for a count of one, then once more for each quantised level."""
    return np.where(counts > 0, levels_of(counts) + 1, 0)


_MIDDLE = np.array([0.0, 1.0] + [LEAST * STEP ** (q - 0.5) if q > 1 else float(LEAST) for q in range(1, LEVELS - 1)])


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and the number of tokens of each text."""
    words = find_words(texts)
    counts = words.counts
    stream = np.full(len(words.starts) + len(counts), END, dtype=np.uint64)
    stream[np.arange(len(words.starts)) + words.owner()] = words.hashes(lower=True)
    return stream, counts + 1


def follower(token: np.ndarray) -> np.ndarray:
    """The 48 bits that stand for a token after its context."""
    return token >> np.uint64(16)


def pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hash of a context and the follower bits of the token after it."""
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + after)


def _slot(hashes: np.ndarray, n: int) -> np.ndarray:
    """One of n buckets for each hash, ascending with it."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Buckets: `groups` times `parts` for words and as many for pairs; a word's group is that of its pairs, too.

    A word is in one part of its group, the pairs that begin with it are in all parts.
    """

    groups: int
    parts: int

    @classmethod
    def of(cls, buckets: int) -> Layout:
        parts = max(1, math.isqrt(buckets))
        return cls(-(-buckets // parts), parts)

    @property
    def words(self) -> int:
        return self.groups * self.parts

    @property
    def pairs(self) -> int:
        return self.groups * self.parts

    def of_pair(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return _slot(before, self.groups) * self.parts + (after % np.uint64(self.parts)).astype(np.int64)


def _pack(values: np.ndarray, kind: str) -> bytes:
    return pa.compress(values.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind) if n else np.empty(0, dtype=kind)


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket begins in it."""
    by = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return by, np.searchsorted(bucket[by], np.arange(buckets + 1))


def _distinct_pairs(distinct: np.ndarray, at: np.ndarray, inverse: bool = False) -> tuple[np.ndarray, ...]:
    """Places, among the distinct tokens, of context and token of each distinct pair, with its count or each token's pair."""
    before = np.concatenate((np.searchsorted(distinct, [END]), at[:-1]))
    codes = before * len(distinct) + at
    codes, other = np.unique(codes, return_inverse=inverse, return_counts=not inverse)
    return *np.divmod(codes, len(distinct)), other


_SHARE = "bucket int, n int, hashes binary, counts binary, ctx binary, runs binary"
_GRAMS = "bucket int, n int, total bigint, hashes binary, counts binary, once bigint, twice bigint, size bigint, body binary, m int, ctx binary, mass binary, followers binary"


def count_grams(texts: DataFrame, layout: Layout, bits: float) -> DataFrame:
    """What the texts say, by bucket: packed counts of words; of pairs the filter's segment, and sum and number of followers of their contexts."""

    def share(batches):
        held, size = [], 0

        def flush():
            distinct, at, counts = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            edges = np.searchsorted(_slot(distinct, layout.words), np.arange(layout.words + 1))
            spans = [(b, i, j) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if i < j]
            none = [None] * len(spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in spans], pa.int32()), pa.array([j - i for _, i, j in spans], pa.int32()), pa.array([distinct[i:j].tobytes() for _, i, j in spans], pa.binary()), pa.array([_pack(counts[i:j], "<u4") for _, i, j in spans], pa.binary()), pa.array(none, pa.binary()), pa.array(none, pa.binary())],
                ["bucket", "n", "hashes", "counts", "ctx", "runs"],
            )
            first, second, counts = _distinct_pairs(distinct, at)
            after = follower(distinct[second])
            by, edges = _by_bucket(layout.of_pair(distinct[first], after), layout.pairs)
            rows = []
            for b in np.flatnonzero(edges[1:] > edges[:-1]):
                own = by[edges[b] : edges[b + 1]]
                begin = np.flatnonzero(np.diff(first[own], prepend=-1))
                runs = np.diff(np.append(begin, len(own)))
                # contexts and runs cost little; a follower is six bytes
                rows.append((layout.words + int(b), len(own), after[own].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), _pack(counts[own], "<u4"), distinct[first[own[begin]]].tobytes(), _pack(runs, "<u4")))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "n", "hashes", "counts", "ctx", "runs"])

        for batch in batches:
            for piece in chunks(batch, "text"):
                stream, _ = token_stream(piece.column("text"))
                held.append(stream)
                size += len(stream)
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def read(row: dict) -> tuple[np.ndarray, ...]:
        """Hashes, counts and, of pairs, contexts."""
        counts = _unpack(row["counts"], row["n"], "<u4").astype(np.int64)
        if row["ctx"] is None:
            return np.frombuffer(row["hashes"], dtype="<u8"), counts
        after = np.zeros((row["n"], 8), dtype=np.uint8)
        after[:, :6] = np.frombuffer(row["hashes"], dtype=np.uint8).reshape(-1, 6)
        ctx = np.frombuffer(row["ctx"], dtype="<u8")
        ctx = np.repeat(ctx, _unpack(row["runs"], len(ctx), "<u4"))
        return pair_hash(ctx, after.view("<u8").ravel()), counts, ctx

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, waiting, size, sums = key[0].as_py(), [], 0, None

        def summed():
            grams = [np.concatenate(x) for x in zip(*([sums] if sums else []), *waiting, strict=True)]
            order = np.argsort(grams[0])
            hashes, counts = grams[0][order], grams[1][order]
            begin = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            return (hashes[begin], np.add.reduceat(counts, begin), *(x[order[begin]] for x in grams[2:]))

        for batch in batches:
            for row in batch.to_pylist():
                waiting.append(read(row))
                size += row["n"]
                if size > (len(sums[0]) if sums else 0) + 300_000:  # merge now and then, each time at least doubling
                    sums = summed()
                    waiting, size = [], 0
        hashes, counts, *ctx = summed() if waiting else sums
        row = {"bucket": bucket, "n": len(hashes), "total": int(counts.sum()), "hashes": None, "counts": None, "once": int((counts == 1).sum()), "twice": int((counts == 2).sum()), "size": 0, "body": None, "m": 0, "ctx": None, "mass": None, "followers": None}
        if ctx:
            names, at = np.unique(ctx[0], return_inverse=True)
            size, body = CountFilter.segment(hashes, counts, bits)
            row |= {"size": size, "body": body.tobytes(), "m": len(names), "ctx": names.tobytes(), "mass": np.bincount(at, weights=_MIDDLE[entries_of(counts)]).tobytes(), "followers": _pack(np.bincount(at), "<i8")}
        else:
            row |= {"hashes": hashes.tobytes(), "counts": _pack(counts, "<i8")}
        kinds = {"bucket": pa.int32(), "n": pa.int32(), "m": pa.int32(), **dict.fromkeys(("total", "once", "twice", "size"), pa.int64())}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(name, kinds.get(name, pa.binary())) for name in row]))
        release_memory()

    return texts.select("text").mapInArrow(releasing(share), _SHARE).groupBy("bucket").applyInArrow(merge, _GRAMS)


def _context_sums(grams: DataFrame, layout: Layout, wanted: Broadcast) -> DataFrame:
    """Those contexts that are wanted (`h`), sums (`m`) and numbers (`f`) of their followers, over all parts of a group."""

    def add(batches_of_group: pa.Table) -> pa.Table:
        parts = [_contexts(r) for r in batches_of_group.to_pylist()]
        ctx, mass, followers = (np.concatenate(x) for x in zip(*parts, strict=True))
        names, at = np.unique(ctx, return_inverse=True)
        # picked here and not by a map that follows: that would take a second worker a core, and all would load the model later
        keep = np.isin(names, wanted.value)
        sums = names, np.bincount(at, weights=mass), np.bincount(at, weights=followers).astype("<i8")
        return pa.table({k: pa.array([x[keep].tobytes()], pa.binary()) for k, x in zip("hmf", sums, strict=True)})

    packed = grams.where(F.col("bucket") >= layout.words).select(F.floor((F.col("bucket") - layout.words) / layout.parts).alias("group"), "m", "ctx", "mass", "followers")
    return packed.groupBy("group").applyInArrow(released(add), "h binary, m binary, f binary")


def _contexts(row: dict) -> tuple[np.ndarray, ...]:
    return np.frombuffer(row["ctx"], dtype="<u8"), np.frombuffer(row["mass"], dtype="<f8"), _unpack(row["followers"], row["m"], "<i8")


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if values.max(initial=0) < 1 << 32 else values


def _grams(batch: pa.RecordBatch):
    for bucket, n, h, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "n", "hashes", "counts")), strict=True):
        yield bucket, np.frombuffer(h, dtype="<u8"), _unpack(c, n, "<i8")


@dataclass
class CountFilter:
    """The log-frequency filter: bit segments side by side, one for each bucket of pairs."""

    bits: np.ndarray
    begin: np.ndarray  # first byte of each segment
    size: np.ndarray  # bits of each segment

    @staticmethod
    def hashes(grams: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
        """The two hashes of (n-gram, level) from which all its probes come."""
        a = mix64(grams + np.uint64(0xD1B54A32D192ED03) * np.asarray(level, dtype=np.uint64))
        return a, (a << np.uint64(31) | a >> np.uint64(33)) | np.uint64(1)

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, size, probe: int) -> np.ndarray:
        """Bit of one probe, in a segment of `size` bits (fewer than 2**32)."""
        return ((a + np.uint64(probe) * b) >> np.uint64(32)) * np.asarray(size, dtype=np.uint64) >> np.uint64(32)

    @classmethod
    def segment(cls, grams: np.ndarray, counts: np.ndarray, bits: float) -> tuple[int, np.ndarray]:
        """Size in bits and bytes of the segment that holds the counts."""
        level = entries_of(counts)
        size = int(level.sum() * bits) // 8 * 8 + 64 if level.any() else 0
        body = np.zeros(size // 8, dtype=np.uint8)
        for step in range(1, int(level.max(initial=0)) + 1):
            a, b = cls.hashes(grams[level >= step], step)
            for probe in range(PROBES):
                at = cls.place(a, b, size, probe)
                np.bitwise_or.at(body, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        return size, body

    def levels(self, grams: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Level of each n-gram, found by probing level after level until one is missing."""
        out = np.zeros(len(grams), dtype=np.int64)
        alive = np.flatnonzero(self.size[segment] > 0)
        begin, size, grams = self.begin[segment[alive]], self.size[segment[alive]].astype(np.uint64), grams[alive]
        for level in range(1, LEVELS):
            a, b = self.hashes(grams, level)
            for probe in range(PROBES):
                at = self.place(a, b, size, probe)
                held = np.flatnonzero(self.bits[begin + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                alive, begin, size, grams, a, b = (x[held] for x in (alive, begin, size, grams, a, b))
            if not len(alive):
                break
            out[alive] = level
        return out


@dataclass
class Model:
    counts: CountFilter | None  # none if the filter stays in its segments
    layout: Layout
    words: np.ndarray  # hashes of the most frequent words, ascending
    word_counts: np.ndarray
    mass: np.ndarray  # sum of the quantised counts of the pairs that begin with each
    followers: np.ndarray  # number of those pairs
    complete: bool  # whether `words` are all words of the training texts
    tokens: int
    vocabulary: int
    discount: float

    def unigram(self, count):
        return (count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1))

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Places of tokens among the frequent words, else -1."""
        if not len(self.words):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, at, -1)

    def look_up(self, stream: np.ndarray, levels: Callable) -> dict[str, np.ndarray]:
        """For each token: its count, its context, that one's sum and followers (-1 where not at hand), and the pair's level.

        Every distinct pair of the stream is looked up once, by `levels` of
        pairs, their buckets and their places among all of it.
        """
        distinct, at = np.unique(stream, return_inverse=True)
        first, second, pair_at = _distinct_pairs(distinct, at, inverse=True)
        place = self.places(distinct)
        none = 0 if self.complete else -1
        count, mass, followers = (np.where(place >= 0, x[place].astype(t), none) if len(x) else np.full(len(place), none, dtype=t) for x, t in ((self.word_counts, np.int64), (self.mass, np.float64), (self.followers, np.int64)))
        # a pair of an unknown word was never seen
        likely = np.flatnonzero((count[first] != 0) & (count[second] != 0))
        before, after = distinct[first[likely]], follower(distinct[second[likely]])
        level = np.zeros(len(first), dtype=np.int64)
        level[likely] = levels(pair_hash(before, after), self.layout.of_pair(before, after), likely)
        context = first[pair_at]
        return {"count": count[at], "context": distinct[context], "mass": mass[context], "followers": followers[context], "level": level[pair_at]}

    def probability(self, level: np.ndarray, mass: np.ndarray, followers: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of tokens after their contexts; one without pairs leaves all to the unigrams."""
        known = mass > 0
        back = np.divide(self.discount * followers, mass, out=np.ones(len(mass)), where=known)
        share = np.divide(np.maximum(_MIDDLE[level] - self.discount, 0.0), mass, out=np.zeros(len(mass)), where=known)
        # false positives apart, no pair has more
        return np.minimum(share, 1 - back) + back * self.unigram(count)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, dict]]:
    for k, body in enumerate(batch.column("body")):
        given = batch.column("given")[k].as_py() if "given" in batch.schema.names else []
        yield pa.ipc.open_stream(body.as_buffer()).read_next_batch(), {g["bucket"]: g["levels"] for g in given or []}


def _pairs_by_bucket(piece: pa.RecordBatch, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct pairs of a piece, their order by bucket, and where each bucket begins in it."""
    distinct, at = np.unique(token_stream(piece.column("text"))[0], return_inverse=True)
    first, second, _ = _distinct_pairs(distinct, at)
    before, after = distinct[first], follower(distinct[second])
    return pair_hash(before, after), *_by_bucket(layout.of_pair(before, after), layout.pairs)


def _routed(rows: DataFrame, segments: DataFrame, layout: Layout) -> DataFrame:
    """Pieces of the rows (`body`) with the levels of all their pairs by bucket (`given`), probed segment by segment."""

    def named(batches):
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in chunks(batch, "text"):
                yield name, piece
                name += 1

    def pack(batches):
        for name, piece in named(batches):
            sink = pa.BufferOutputStream()
            # a copy, so that it has the bytes of its own rows only
            own = piece.take(pa.array(np.arange(piece.num_rows)))
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(own)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["piece", "body"])

    def ask(batches):
        for name, piece in named(batches):
            grams, by, edges = _pairs_by_bucket(piece, layout)
            used = np.flatnonzero(edges[1:] > edges[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([name] * len(used), pa.int64()), pa.array([grams[by[edges[b] : edges[b + 1]]].tobytes() for b in used], pa.binary())], ["bucket", "piece", "grams"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        levels = []
        body, size = (held.column("body")[0].as_buffer(), held.column("size")[0].as_py()) if len(held) else (b"", 0)
        part = CountFilter(np.frombuffer(body, dtype=np.uint8), np.array([0]), np.array([size]))
        for packed in asked.column("grams"):
            grams = np.frombuffer(packed.as_buffer(), dtype="<u8")
            levels.append(_pack(part.levels(grams, np.zeros(len(grams), dtype=np.int64)), "<u1"))
        return pa.table({"piece": asked.column("piece"), "bucket": asked.column("bucket"), "levels": pa.array(levels, pa.binary())})

    # both passes make the same pieces
    rows = steady(rows)
    bodies = rows.mapInArrow(releasing(pack), "piece bigint, body binary")
    asked = rows.mapInArrow(releasing(ask), "bucket int, piece bigint, grams binary")
    answers = asked.groupBy("bucket").cogroup(segments.groupBy("bucket")).applyInArrow(released_pair(answer), "piece bigint, bucket int, levels binary")
    given = answers.groupBy("piece").agg(F.collect_list(F.struct("bucket", "levels")).alias("given"))
    return bodies.join(given, "piece", "left").select("body", "given")


def _pieces(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, Callable]]:
    """Pieces of texts, each with the function that finds the levels of its pairs."""
    for batch in batches:
        if model.counts is not None:
            for piece in chunks(batch, "text"):
                yield piece, lambda grams, bucket, places: model.counts.levels(grams, bucket)
            continue
        for piece, given in _read(batch):

            def levels(grams, bucket, places, piece=piece, given=given):
                whole, by, edges = _pairs_by_bucket(piece, model.layout)
                out = np.zeros(len(whole), dtype=np.int64)
                for b in np.flatnonzero(edges[1:] > edges[:-1]):
                    out[by[edges[b] : edges[b + 1]]] = _unpack(given[b], int(edges[b + 1] - edges[b]), "<u1")
                return out[places]

            yield piece, levels


def _whole_filter(grams: DataFrame, layout: Layout, total: int) -> CountFilter:
    """The filter of `total` bytes from its segments, whose sizes the caller has summed.

    They come to the driver by splits, small ones together, and it keeps the
    whole in a file without a name, from which the broadcast is written.
    """
    made = grams.where(F.col("bucket") >= layout.words).select((F.col("bucket") - layout.words).alias("bucket"), "size", "body")
    made = made.coalesce(max(1, -(-total // PULL_BYTES)))
    size, begin, at = np.zeros(layout.pairs, dtype=np.int64), np.zeros(layout.pairs, dtype=np.int64), 0
    with tempfile.TemporaryFile() as whole:
        for row in made.toLocalIterator(prefetchPartitions=True):
            size[row.bucket], begin[row.bucket] = row.size, at
            at += whole.write(row.body)
        whole.flush()
        # a plain array on the mapping is pickled without a copy
        body = np.asarray(np.memmap(whole, dtype=np.uint8, mode="r", shape=(at,))) if at else np.empty(0, dtype=np.uint8)
    return CountFilter(body, begin, size)


def train(texts: DataFrame, bits: float = 12.0, max_filter_bytes: int = 128 << 20, frequent_words: int = 1 << 20) -> tuple[Model, DataFrame, DataFrame | None]:
    """Model of the column `text`, what was counted, and the filter's segments if it is not broadcast."""
    layout = Layout.of(bucket_count(texts))
    grams = checkpoint(count_grams(texts, layout, bits))
    words, pairs = grams.where(F.col("bucket") < layout.words), grams.where(F.col("bucket") >= layout.words)
    sums = words.agg(F.sum("total"), F.sum("n")).first()
    tokens, vocabulary = int(sums[0] or 0), int(sums[1] or 0)
    once, twice, size = (int(x or 0) for x in pairs.agg(F.sum("once"), F.sum("twice"), F.sum("size")).first())
    discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    counts = segments = None
    if size <= 8 * max_filter_bytes:
        counts = _whole_filter(grams, layout, size // 8)
    else:
        segments = pairs.select((F.col("bucket") - layout.words).alias("bucket"), "size", "body")
    packed = words.select("bucket", "n", "hashes", "counts")
    floor = 0
    if vocabulary > frequent_words:

        def spread(batches):
            for batch in batches:
                for _, _, c in _grams(batch):
                    value, n = np.unique(entries_of(c), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["level", "n"])

        by_level = {r.level: r.n for r in packed.mapInArrow(spread, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n")).collect()}
        floor, room = LEVELS, frequent_words
        while floor > 0 and by_level.get(floor - 1, 0) <= room:
            floor -= 1
            room -= by_level.get(floor, 0)

    def frequent(batches):
        for batch in batches:
            for _, h, c in _grams(batch):
                keep = entries_of(c) >= floor
                yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], ["h", "c"])

    # at most `frequent_words` words of 16 bytes each
    parts = packed.mapInArrow(frequent, "h binary, c binary").toArrow()
    head, have = (np.frombuffer(b"".join(parts.column(x).to_pylist()), dtype=t) for x, t in (("h", "<u8"), ("c", "<i8")))
    order = np.argsort(head)
    head, have = head[order], have[order]
    shared = texts.sparkSession.sparkContext.broadcast(head)
    parts = _context_sums(grams, layout, shared).toArrow()
    ctx, mass, followers = (np.frombuffer(b"".join(parts.column(x).to_pylist()), dtype=t) for x, t in (("h", "<u8"), ("m", "<f8"), ("f", "<i8")))
    at = np.searchsorted(head, ctx)
    sums, numbers = np.zeros(len(head)), np.zeros(len(head), dtype=np.int64)
    sums[at], numbers[at] = mass, followers
    shared.destroy()
    return Model(counts, layout, head, _narrow(have), sums, _narrow(numbers), floor == 0, tokens, vocabulary, discount), grams, segments


def in_part(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the crc32 of an id's text has the given remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def score(docs: DataFrame, bits: float = 12.0, max_filter_bytes: int = 128 << 20, frequent_words: int = 1 << 20) -> DataFrame:
    """Score every row's whole text under a model of the rows that are not held out.

    Held out is a tenth of the ids (crc32 of the id's text, remainder 0 by 10).
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (exact
    smoothed unigrams) and score (log10 probability under the pair model).

    Null and empty texts are one end token.  Repeated rows are scored one by
    one and count as often as they come; a null doc_id is held out.  Other
    columns are dropped, whatever their names.  A text of any length is read
    whole.  Without training rows every word is unknown; an empty table gives
    an empty result.

    Counts and context sums of the `frequent_words` most frequent words travel
    with the model; those of all rarer words are joined by hash to the tokens
    that need them.  Neither this bound nor `max_filter_bytes` changes a score.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), in_part(F.col("doc_id"), 10, 0).alias("held_out"))
    model, grams, segments = train(rows.where(~F.col("held_out")), bits, max_filter_bytes, frequent_words)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double"
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "score"]

    def scored(piece, m, levels):
        """Rows of a piece without the terms of tokens that wait for an answer, and those tokens."""
        stream, sizes = token_stream(piece.column("text"))
        found = m.look_up(stream, levels)
        no_count, no_sums = found["count"] < 0, found["mass"] < 0
        wait = no_count | no_sums
        begin = np.cumsum(sizes) - sizes
        count = np.maximum(found["count"], 0)
        base = np.where(no_count, 0.0, np.log10(m.unigram(count)))
        value = np.where(wait, 0.0, np.log10(m.probability(found["level"], found["mass"], found["followers"], count)))
        sums = [np.add.reduceat(x, begin) for x in ((count > 0).astype(np.int64), base, value)]
        rows = pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(sizes, pa.int64()), *map(pa.array, sums)], names)
        at = np.flatnonzero(wait)
        return rows, len(stream), {"row": np.repeat(np.arange(len(sizes)), sizes)[at], "token": stream[at], "no_count": no_count[at], "no_sums": no_sums[at], **{x: found[x][at] for x in ("count", "context", "mass", "followers", "level")}}

    def run(batches):
        m = shared.value
        for piece, levels in _pieces(batches, m):
            yield scored(piece, m, levels)[0]

    def ask(batches):
        m, held, size, name = shared.value, [], 0, TaskContext.get().partitionId() << 32
        for piece, levels in _pieces(batches, m):
            rows, n, waiting = scored(piece, m, levels)
            held.append((rows, waiting))
            size += n
            if size >= SCORE_TOKENS:
                yield from _asked(held, name, m.layout)
                held, size, name = [], 0, name + 1
        if held:
            yield from _asked(held, name, m.layout)

    asked = rows.select("doc_id", "text", "held_out")
    asked = asked if segments is None else _routed(asked, segments, model.layout)
    if model.complete:
        done = asked.mapInArrow(releasing(run), schema)
    else:
        done = _answered(asked.mapInArrow(releasing(ask), _ASKED), grams, replace(model, counts=None, words=model.words[:0], word_counts=model.word_counts[:0], mass=model.mass[:0], followers=model.followers[:0]), schema)
    return done.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")


_ITEMS = (("row", "<u4"), ("token", "<i4"), ("context", "<i4"), ("count", "<i8"), ("mass", "<f8"), ("followers", "<i8"), ("level", "<u1"))
_ASKED = "target int, share bigint, n int, keys binary, rows binary, items array<binary>"


def _asked(held: list[tuple], name: int, layout: Layout) -> Iterator[pa.RecordBatch]:
    """One share of the texts: its rows with the tokens that wait, and the distinct words it asks of each group.

    Waiting tokens know their words by place among all words asked, which are
    ordered by hash and so by group.
    """
    first = np.cumsum([0, *(rows.num_rows for rows, _ in held)])
    items = {x: np.concatenate([w[x] for _, w in held]) for x in held[0][1]}
    items["row"] = np.concatenate([w["row"] + f for f, (_, w) in zip(first, held, strict=False)])
    keys = np.unique(np.concatenate([items["token"][items["no_count"]], items["context"][items["no_sums"]]]))
    for column, missing in (("token", "no_count"), ("context", "no_sums")):
        items[column] = np.where(items[missing], np.searchsorted(keys, items[column]), -1)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0][0].schema) as out:
        for rows, _ in held:
            out.write_batch(rows)
    edges = np.searchsorted(_slot(keys, layout.groups), np.arange(layout.groups + 1))
    used = np.flatnonzero(edges[1:] > edges[:-1])
    packed = [_pack(items[x], t) for x, t in _ITEMS]
    none = [None] * len(used)
    yield pa.RecordBatch.from_arrays(
        [pa.array([*used, layout.groups + name % layout.groups], pa.int32()), pa.array([name] * (len(used) + 1), pa.int64()), pa.array([*(edges[used + 1] - edges[used]), len(items["row"])], pa.int32()), pa.array([*(keys[edges[g] : edges[g + 1]].tobytes() for g in used), None], pa.binary()), pa.array([*none, sink.getvalue().to_pybytes()], pa.binary()), pa.array([*none, packed], pa.list_(pa.binary()))],
        ["target", "share", "n", "keys", "rows", "items"],
    )


def _answered(asked: DataFrame, grams: DataFrame, model: Model, schema: str) -> DataFrame:
    """The rows with the terms of their waiting tokens added."""
    layout = model.layout
    word = F.col("bucket") < layout.words
    group = F.floor(F.when(word, F.col("bucket")).otherwise(F.col("bucket") - layout.words) / layout.parts).cast("int")
    known = grams.select(group.alias("target"), "n", F.when(word, F.col("hashes")).alias("hashes"), F.when(word, F.col("counts")).alias("counts"), "m", "ctx", "mass", "followers")

    def answer(questions: pa.Table, known: pa.Table) -> pa.Table:
        """Of each share's words, in order, count, sum and followers; the shares' rows pass through."""
        rows = known.to_pylist()
        words = [(np.frombuffer(r["hashes"], dtype="<u8"), _unpack(r["counts"], r["n"], "<i8")) for r in rows if r["hashes"] is not None]
        sums = [_contexts(r) for r in rows if r["ctx"] is not None]
        words = [np.concatenate(x) for x in zip(*words, strict=True)] if words else [np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)]
        sums = [np.concatenate(x) for x in zip(*sums, strict=True)] if sums else [np.empty(0, dtype=np.uint64), np.empty(0), np.empty(0, dtype=np.int64)]
        # a word has one count, and a sum in every part of its group
        order = np.argsort(words[0])
        words = [x[order] for x in words]
        names, at = np.unique(sums[0], return_inverse=True)
        mass, followers = np.bincount(at, weights=sums[1], minlength=len(names)), np.bincount(at, weights=sums[2], minlength=len(names)).astype(np.int64)
        out = []
        for share, n, keys, body, items in zip(*(questions.column(c).to_pylist() for c in ("share", "n", "keys", "rows", "items")), strict=True):
            if keys is None:
                out.append({"share": share, "target": -1, "n": n, "rows": body, "items": items})
                continue
            keys = np.frombuffer(keys, dtype="<u8")
            parts = [np.where(_have(words[0], keys), _take(words[1], words[0], keys), 0), np.where(_have(names, keys), _take(mass, names, keys), 0.0), np.where(_have(names, keys), _take(followers, names, keys), 0)]
            out.append({"share": share, "target": int(_slot(keys[:1], layout.groups)[0]), "n": n, "rows": None, "items": [_pack(x, t) for x, t in zip(parts, ("<i8", "<f8", "<i8"), strict=True)]})
        return pa.Table.from_pylist(out, schema=pa.schema([("share", pa.int64()), ("target", pa.int32()), ("n", pa.int32()), ("rows", pa.binary()), ("items", pa.list_(pa.binary()))]))

    def finish(share: pa.Table) -> pa.Table:
        parts = sorted(share.to_pylist(), key=lambda r: r["target"])
        own, parts = parts[0], parts[1:]
        rows = pa.ipc.open_stream(own["rows"]).read_all()
        items = {x: _unpack(body, own["n"], t) for body, (x, t) in zip(own["items"], _ITEMS, strict=True)}
        count, mass, followers = (np.concatenate([np.empty(0, dtype=t), *(_unpack(r["items"][k], r["n"], t) for r in parts)]) for k, t in enumerate(("<i8", "<f8", "<i8")))
        pick = lambda answers, places, have: np.where(places >= 0, answers[np.maximum(places, 0)], have) if len(answers) else have
        asked_count = items["token"] >= 0
        c = pick(count, items["token"], items["count"])
        value = np.log10(model.probability(items["level"].astype(np.int64), pick(mass, items["context"], items["mass"]), pick(followers, items["context"], items["followers"]), c))
        base = np.where(asked_count, np.log10(model.unigram(c)), 0.0)
        more = [np.bincount(items["row"], weights=x, minlength=rows.num_rows) for x in ((asked_count & (c > 0)).astype(float), base, value)]
        new = [pa.array(rows.column(x).to_numpy() + y.astype(t)) for x, y, t in zip(("known", "base", "score"), more, (np.int64, float, float), strict=True)]
        return pa.table([rows.column("doc_id"), rows.column("held_out"), rows.column("n_tokens"), *new], names=rows.column_names)

    replies = asked.groupBy("target").cogroup(known.groupBy("target")).applyInArrow(released_pair(answer), "share bigint, target int, n int, rows binary, items array<binary>")
    return replies.groupBy("share").applyInArrow(released(finish), schema)


def _have(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return names[np.minimum(np.searchsorted(names, keys), len(names) - 1)] == keys if len(names) else np.zeros(len(keys), dtype=bool)


def _take(values: np.ndarray, names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return values[np.minimum(np.searchsorted(names, keys), len(names) - 1)] if len(names) else np.zeros(len(keys))
