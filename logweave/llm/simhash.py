"""SimHash near-duplicates, with candidates found by pigeonring filtering.

A fingerprint is cut into `SEGMENTS` segments that stand in a ring.  If two
fingerprints differ in at most `budget` bits, then some segment begins a chain
such that for every length k the first k segments of the chain differ in at
most k * budget / SEGMENTS bits.  As long as that bound is below one the
segments must be equal, so the equal head of the chain is a hash key; the rest
of the chain prunes the pairs that share a key before the full Hamming check.

Copies share a fingerprint and count as one class, so only distinct
fingerprints are compared.  Keys are dealt by hash to buckets that grow in
number with the input; a key with very many fingerprints is handed on and cut in
blocks, each two of which meet in a task of their own.  A key's matches leave the
task as a forest, never as all its pairs.

`similar_groups` finds texts whose shingle sets have a given Jaccard similarity.
Few bits of a fingerprint cannot say that (at 0.8 and five words half of the
pairs differ in nine bits of 64 or more, and no ring of segments is selective
for so many), so there min-hash bands find further candidates, and each
candidate pair is checked on its whole shingle sets.  Texts with equal sets
count as one.  The checks are of all shingles, by 32 bits of their hashes: two
shingles of a pair of texts are taken for one with a probability of 2**-32.  All
members of a band are first compared with its two ends; the
pairs that are left are those of members which no link joins yet, and they are
compared in blocks, whose links leave the task as a forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bucket_count, checkpoint, released, releasing, small_batches
from .components import connected, connected_local
from .textnum import chunks, find_words, mix64, windows, within_texts

SEGMENTS = 9
BLOCK = 2048
CROWD = 32_768  # fingerprints of one key that one task compares
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    stops = np.cumsum(sizes) - 1
    k = min(shingle, len(words))
    starts = (stops - sizes + 1)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, stops[k - 1 :].tolist(), strict=True)])
    n, total = len(starts), np.zeros(64, dtype=np.int64)
    bits = np.frombuffer(raw, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        total += np.unpackbits(bits[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and signed 64-bit `fp` of every row."""

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), "doc_id bigint, fp bigint")


def _ring(segments: int, budget: int) -> tuple[list[int], int]:
    """Bit borders of the segments, and how many segments a chain's equal head has."""
    borders = [64 * i // segments for i in range(segments + 1)]
    return borders, -(-segments // budget) - 1 if budget else segments


def _segment_bits(fp: np.ndarray, borders: list[int]) -> list[np.ndarray]:
    return [(fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(borders, borders[1:], strict=False)]


def _head(fp: np.ndarray, start: int, borders: list[int], head: int) -> np.ndarray:
    """The equal head of the chain that begins at segment `start`, as one masked integer."""
    segments = len(borders) - 1
    mask = 0
    for k in range(head):
        s = (start + k) % segments
        mask |= ((1 << (borders[s + 1] - borders[s])) - 1) << borders[s]
    return fp & np.uint64(mask)


def chain_holds(diff: np.ndarray, start: int, borders: list[int], budget: int) -> np.ndarray:
    """Whether every prefix of the chain from `start` stays within its proportional budget."""
    segments = len(borders) - 1
    held, total = np.ones(diff.shape, dtype=bool), np.zeros(diff.shape, dtype=np.int16)
    for k in range(segments):
        s = (start + k) % segments
        part = (diff >> np.uint64(borders[s])) & np.uint64((1 << (borders[s + 1] - borders[s])) - 1)
        total += np.bitwise_count(part)
        held &= total * segments <= (k + 1) * budget
    return held


def _links_of_key(fp: np.ndarray, start: int, borders: list[int], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (indices) among fingerprints of one key, thinned to a forest of their components."""
    n, label = len(fp), np.arange(len(fp))
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            diff = fp[a : a + BLOCK, None] ^ fp[None, b : b + BLOCK]
            near = np.bitwise_count(diff) <= budget
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            good = chain_holds(diff[i, j], start, borders, budget)
            i, j = i[good] + a, j[good] + b
            fresh = label[i] != label[j]
            if fresh.any():
                label = connected_local(n, np.concatenate([np.arange(n), i[fresh]]), np.concatenate([label, j[fresh]]))
    joined = np.flatnonzero(label != np.arange(n))
    return joined, label[joined]


def links(classes: DataFrame, budget: int = 2, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of `rep` whose components are those of all links between the distinct `fp` of the classes."""
    borders, head = _ring(segments, budget)
    buckets = bucket_count(classes)

    def deal(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            rep = batch.column("rep")
            for start in range(segments):
                key = mix64(_head(fp, start, borders, head) + np.uint64(start + 1))
                yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(buckets)).astype(np.int32)), pa.array(np.full(len(fp), start, dtype=np.int32)), batch.column("fp"), rep], ["bucket", "start", "fp", "rep"])

    def compare(table: pa.Table) -> pa.Table:
        """Links (a, b), and (fingerprint, rep, start, own block, number of blocks) of the keys that are handed on."""
        start = table.column("start").to_numpy()
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        rep = table.column("rep").to_numpy()
        left, right, late = [], [], []
        for s in range(segments):
            mine = np.flatnonzero(start == s)
            key = _head(fp[mine], s, borders, head)
            order = np.argsort(key, kind="stable")
            mine, key = mine[order], key[order]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
            size = np.diff(np.append(begin, len(key)))
            small = size <= 16
            for step in range(1, int(size[small].max(initial=1))):
                run = np.repeat(size, size)
                ok = np.flatnonzero((key[step:] == key[:-step]) & (run[:-step] <= 16))
                diff = fp[mine[ok]] ^ fp[mine[ok + step]]
                ok = ok[(np.bitwise_count(diff) <= budget) & chain_holds(diff, s, borders, budget)]
                left.append(rep[mine[ok]])
                right.append(rep[mine[ok + step]])
            for at, n in zip(begin[~small], size[~small], strict=True):
                own = mine[at : at + n]
                if n > crowd:
                    blocks = -(-2 * n // crowd)
                    late.append((fp[own].view(np.int64), rep[own], np.full(n, s), np.arange(n) * blocks // n, np.full(n, blocks)))
                    continue
                i, j = _links_of_key(fp[own], s, borders, budget)
                left.append(rep[own[i]])
                right.append(rep[own[j]])
        a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (left, right))
        handed = [np.concatenate(x) for x in zip(*late, strict=True)] if late else [np.empty(0, dtype=np.int64)] * 5
        none = np.full(len(a), -1)
        columns = [np.concatenate(x) for x in zip((np.minimum(a, b), np.maximum(a, b), none, none, none), handed, strict=True)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "b", "start", "own", "blocks"), columns, strict=True)})

    def meet(table: pa.Table) -> pa.Table:
        """Links between two blocks of one key, or inside one."""
        fp, rep = table.column("a").to_numpy().astype(np.int64).view(np.uint64), table.column("b").to_numpy()
        i, j = _links_of_key(fp, table.column("start")[0].as_py(), borders, budget)
        a, b = rep[i], rep[j]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    dealt = classes.select("fp", "rep").mapInArrow(deal, "bucket int, start int, fp bigint, rep bigint")
    found = checkpoint(dealt.groupBy("bucket").applyInArrow(released(compare), "a bigint, b bigint, start bigint, own bigint, blocks bigint"))
    done = found.where("start < 0").select("a", "b")
    late = found.where("start >= 0")
    if late.isEmpty():
        return done
    mask = F.lit(0).cast("bigint")
    for s in range(segments):
        value = int(_head(np.array([2**64 - 1], dtype=np.uint64), s, borders, head).view(np.int64)[0])
        mask = F.when(F.col("start") == s, F.lit(value).cast("bigint")).otherwise(mask)
    pairs = late.withColumn("key", F.col("a").bitwiseAND(mask)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    pairs = pairs.select("start", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "a", "b")
    return done.unionAll(pairs.groupBy("start", "key", "x", "y").applyInArrow(released(meet), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id linked to it, directly or not).

    Fingerprints with at most `budget` differing bits are linked.  Texts with
    fewer words than a shingle use their whole word sequence; texts without
    words, null ones included, have fingerprint zero.  Rows with a null doc_id
    keep their fingerprint but link nothing and have a null component.  Repeated
    rows are returned as often as they come; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    marked = checkpoint(fingerprints(docs, shingle, seed))
    classes = marked.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = connected(links(classes, budget))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    joined = marked.join(named, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


BANDS, BAND_ROWS = 28, 6  # pairs of similarity 0.8 share a band with probability 0.9998
SET_BLOCK, BLOCK_SHINGLES = 512, 1 << 20  # texts of a block, and their shingles


def _shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, side by side, and how many each text has.

    A text with fewer words than a shingle has its whole word sequence as its
    only one, and a text without words has a fixed one.
    """
    words = find_words(texts)
    hashes = words.hashes(lower=True)
    at, owner = within_texts(words, shingle)
    values = windows(hashes, shingle)[at]
    short = np.flatnonzero(words.counts < shingle)
    whole = np.zeros(len(short), dtype=np.uint64)
    for k, row in enumerate(short):
        for h in hashes[words.first[row] : words.first[row + 1]]:
            whole[k] = mix64(whole[k : k + 1] * np.uint64(31) + h + np.uint64(1))[0]
    owner, values = np.concatenate([owner, short]), np.concatenate([values, whole])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.bincount(owner[fresh], minlength=len(words.first) - 1)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fingerprint, two hashes of the shingle set, its size and min-hash bands of every row."""
    factors = mix64(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for piece in chunks(batch, "text"):
                values, sizes = _shingle_sets(piece.column("text"), shingle)
                begin = np.cumsum(sizes) - sizes
                bands = np.zeros((len(sizes), BANDS), dtype=np.uint64)
                for k, factor in enumerate(factors):
                    least = np.minimum.reduceat(values * factor, begin)
                    bands[:, k // BAND_ROWS] = mix64(bands[:, k // BAND_ROWS] * np.uint64(0x9E3779B97F4A7C15) + least)
                fp = np.array([fingerprint(t, shingle) for t in piece.column("text").to_pylist()], dtype=np.uint64)
                edges = pa.array(np.arange(0, BANDS * len(sizes) + 1, BANDS, dtype=np.int32))
                lists = pa.ListArray.from_arrays(edges, pa.array(bands.ravel().view(np.int64)))
                whole = [pa.array(np.add.reduceat(mix64(values ^ np.uint64(salt)), begin).view(np.int64)) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fp.view(np.int64)), *whole, pa.array(sizes, pa.int64()), lists], ["doc_id", "fp", "s1", "s2", "size", "bands"])

    return docs.mapInArrow(releasing(run), "doc_id bigint, fp bigint, s1 bigint, s2 bigint, size bigint, bands array<bigint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id and shingle set (halves of the hashes, ascending) of every row."""

    def sets(batches):
        for batch in batches:
            for piece in chunks(batch, "text"):
                values, sizes = _shingle_sets(piece.column("text"), shingle)
                # the values of a text are sorted, and so are their upper halves
                low = (values >> np.uint64(32)).astype("<u4")
                edges = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([low[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)], pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(releasing(sets), "id bigint, shingles binary")


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets, of 32-bit hashes, have at least the similarity."""

    def check(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            good = np.zeros(len(a), dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = (np.unique(np.frombuffer(v.as_py(), dtype="<u4")) for v in (x, y))
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[k] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(a[good], pa.int64()), pa.array(b[good], pa.int64())], ["a", "b"])

    made = _sets(docs, shingle)
    one = made.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    two = made.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "set_a", "set_b").mapInArrow(releasing(check), "a bigint, b bigint")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    code = np.cumsum(fresh) - 1
    held = np.bincount(code)[code]
    both = np.zeros(n * n, dtype=np.float32)
    few = (held > 1) & (held <= 8)
    code_few, owner_few = code[few], owner[few]
    for step in range(1, 8):
        k = np.flatnonzero(code_few[step:] == code_few[:-step])
        if len(k):
            both += np.bincount(owner_few[k] * n + owner_few[k + step], minlength=n * n).astype(np.float32)
    both = both.reshape(n, n)
    both += both.T
    many = held > 8
    code_many, owner_many = np.cumsum(fresh & many)[many] - 1, owner[many]
    for at in range(0, int(code_many[-1]) + 1 if len(code_many) else 0, 4096):
        a, b = np.searchsorted(code_many, [at, at + 4096])
        table = np.zeros((n, 4096), dtype=np.float32)
        table[owner_many[a:b], code_many[a:b] - at] = 1
        both += table @ table.T
    return both


def _crossing(members: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between members (band, key, id, comp, size) of a key that are in different components.

    Their components are those of all links of at least the similarity.  The
    members of a key's largest component are compared with the others only.
    """
    key = ["band", "key"]
    by_comp = members.groupBy(*key, "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sums = by_comp.groupBy(*key).agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("comps > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / SET_BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1))
    plan = sums.select(*key, F.col("main.comp").alias("main"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("rest"), blocks(F.col("main.n"), F.col("main.size")).alias("mains"))
    salt = lambda n: F.pmod(F.xxhash64("id"), n)
    own = F.when(F.col("comp") == F.col("main"), F.col("rest") + salt(F.col("mains"))).otherwise(salt(F.col("rest")))
    last = F.when(F.col("comp") == F.col("main"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1
    placed = members.join(plan, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    placed = placed.select(*key, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "comp")

    def compare(table: pa.Table) -> pa.Table:
        ids, comp, own = (table.column(c).to_numpy() for c in ("id", "comp", "own"))
        sets = [np.unique(np.frombuffer(v.as_py(), dtype="<u4")) for v in table.column("shingles")]
        alone = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        if (comp == comp[0]).all() or (not alone and (own == own[0]).all()):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        size = np.array([len(x) for x in sets], dtype=np.float64)
        both = _common(sets)
        near = (both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9) & (comp[:, None] != comp[None, :])
        if not alone:
            near &= own[:, None] != own[None, :]
        i, j = np.nonzero(np.triu(near, 1))
        label = connected_local(len(ids), i, j)
        joined = np.flatnonzero(label != np.arange(len(ids)))
        a, b = ids[joined], ids[label[joined]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return placed.join(_sets(docs, shingle), "id").groupBy(*key, "x", "y").applyInArrow(released(compare), "a bigint, b bigint")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int = 2) -> DataFrame:
    """doc_id and component_id (smallest doc_id linked to it, directly or not) of every row with an id.

    Two texts are linked if the sets of their word shingles (A-Z lower-cased)
    have at least the Jaccard similarity and they share a fingerprint or a band,
    or their fingerprints are linked.  No pair of a band is left out: members
    that the links with its smallest and largest id do not join are compared
    with one another.
    Texts shorter than a shingle compare by their whole word sequence; texts
    without words, null ones included, are copies of each other.  Rows with a
    null doc_id are left out; rows that share one are one text, any of them.
    """
    small_batches(docs.sparkSession)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = checkpoint(_sketches(texts, shingle))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    alike = marked.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    copies = marked.select("doc_id", "s1", "s2").join(alike, ["s1", "s2"]).where("id < doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()
    firsts = marked.join(alike.withColumnRenamed("id", "doc_id"), ["s1", "s2", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "size", F.posexplode("bands").alias("band", "key"))
    prints = marked.select("s1", "s2", "size", "fp").join(alike, ["s1", "s2"]).select("id", "size", F.lit(BANDS).alias("band"), F.col("fp").alias("key"))
    keys = firsts.unionAll(prints)
    least = keys.groupBy("band", "key").agg(F.min("id").alias("low"), F.max("id").alias("top"), F.count("*").alias("n")).where("low < top")
    crowd = checkpoint(keys.join(least, ["band", "key"]))
    ends = crowd.select("id", F.explode(F.array("low", "top")).alias("end"))
    pairs = ends.where("end <> id").select(F.least("end", "id").alias("a"), F.greatest("end", "id").alias("b"))
    pairs = checkpoint(pairs.unionAll(links(classes, budget)).where("a < b").distinct())
    found = checkpoint(connected(_verified(pairs, texts, shingle, similarity).unionAll(copies)))
    # with three members every pair has an end
    middle = crowd.where("n > 3 AND id <> low AND id <> top").select("band", "key", "id", "size").distinct()
    middle = middle.join(found.withColumnRenamed("node", "id"), "id", "left").select("band", "key", "id", "size", F.coalesce("component", "id").alias("comp"))
    more = checkpoint(_crossing(middle, texts, shingle, similarity))
    if not more.isEmpty():
        found = connected(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionAll(more))
    named = marked.select("doc_id").distinct().join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return named.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int = 2) -> DataFrame:
    """The row of one document of each group of similar ones, the smallest doc_id; rows without an id all stay.

    Of rows that share an id one stays, that of the smallest text hash.
    """
    groups = similar_groups(docs, shingle, similarity, budget)
    gone = groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionAll(one)
