"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample: each inner node splits by the plane
halfway between two random sample points.  Every row is then indexed: a pass
over the vectors deals each one to its leaf of every tree.  A query walks all
trees at once through one priority queue that holds the most promising branches
first, until its leaves hold enough sample points; the rows of those leaves are
its candidates.  How many are enough is found on the sample: the fewest with
which its own points find the wanted share of their true neighbours.

Rows and queries meet by leaf, not by broadcast, and go there as one byte a
component with the length of what the rounding lost.  That bounds every distance
from both sides; candidates whose lower bound is above the k-th upper bound are
out, and the few that are left are joined with the original vectors and ranked
exactly.  Equal vectors are one point with its smallest `k + 1` ids, which is all
a top-k with ties to the smaller id can use; a leaf with more rows than `block`,
or more queries than `query_block`, is dealt out in blocks.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import checkpoint, released_pair


@dataclass
class Tree:
    """Nodes in parallel arrays; a leaf has no children and its own leaf number."""

    normals: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray  # -1 for inner nodes
    count: np.ndarray  # sample points of each leaf


def fit_tree(points: np.ndarray, leaf_size: int, rng: np.random.Generator) -> Tree:
    normals, offsets, left, right, leaf, count = [], [], [], [], [], []

    def add(ids: np.ndarray, depth: int) -> int:
        me = len(leaf)
        normals.append(np.zeros(points.shape[1], dtype=np.float32))
        offsets.append(0.0)
        left.append(-1)
        right.append(-1)
        leaf.append(-1)
        count.append(len(ids))
        if len(ids) > leaf_size and depth < 48:
            for _ in range(4):
                a, b = points[rng.choice(ids, 2, replace=False)].astype(np.float64)
                normal = a - b
                size = np.sqrt(normal @ normal)
                if size == 0:
                    continue
                normal /= size
                offset = float(normal @ (a + b) / 2)
                side = points[ids] @ normal - offset > 0
                if min(side.sum(), len(ids) - side.sum()) >= 0.05 * len(ids):
                    normals[me], offsets[me] = normal.astype(np.float32), offset
                    left[me], right[me] = add(ids[~side], depth + 1), add(ids[side], depth + 1)
                    return me
        leaf[me] = sum(x >= 0 for x in leaf)
        return me

    add(np.arange(len(points)), 0)
    return Tree(np.stack(normals), np.array(offsets, dtype=np.float32), np.array(left), np.array(right), np.array(leaf), np.array(count))


@dataclass
class Forest:
    trees: list[Tree]
    dimension: int
    sizes: list[np.ndarray] = field(default_factory=list)  # sample points by leaf number

    def __post_init__(self):
        for tree in self.trees:
            size = np.zeros(int(tree.leaf.max()) + 1)
            size[tree.leaf[tree.leaf >= 0]] = tree.count[tree.leaf >= 0]
            self.sizes.append(size)

    @classmethod
    def fit(cls, points: np.ndarray, trees: int, leaf_size: int, seed: int) -> Forest:
        rng = np.random.default_rng(seed)
        return cls([fit_tree(points, leaf_size, rng) for _ in range(trees)], points.shape[1])

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """Leaf number of each point in each tree, points by trees."""
        out = np.empty((len(points), len(self.trees)), dtype=np.int32)
        for t, tree in enumerate(self.trees):
            at = np.zeros(len(points), dtype=np.int64)
            while True:
                inner = np.flatnonzero(tree.left[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                right = np.einsum("ij,ij->i", points[inner], tree.normals[node]) - tree.offsets[node] > 0
                at[inner] = np.where(right, tree.right[node], tree.left[node])
            out[:, t] = tree.leaf[at]
        return out

    def search(self, point: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs, most promising first, until they hold `enough` sample points."""
        margins = [tree.normals @ point - tree.offsets for tree in self.trees]
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < enough:
            cost, t, node = heapq.heappop(queue)
            tree = self.trees[t]
            while tree.left[node] >= 0:
                m = float(margins[t][node])
                near, far = (tree.right[node], tree.left[node]) if m > 0 else (tree.left[node], tree.right[node])
                heapq.heappush(queue, (max(cost, abs(m)), t, int(far)))
                node = near
            found.append((t, int(tree.leaf[node])))
            held += int(tree.count[node])
        return found


def enough_for(forest: Forest, points: np.ndarray, k: int, target: float, queries: int, seed: int) -> float:
    """Sample points that a query's leaves must hold, so that sample points find the target share of their k nearest others."""
    if len(points) <= k + 1:
        return math.inf
    rng = np.random.default_rng(seed)
    chosen = rng.choice(len(points), min(queries, len(points)), replace=False)
    leaf = forest.leaves(points)
    needed = []
    for q in chosen:
        far = ((points - points[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        near = np.argpartition(far, k - 1)[:k]
        before = [np.zeros(int(t.leaf.max()) + 1) for t in forest.trees]
        held = 0
        for t, x in forest.search(points[q], math.inf):
            before[t][x] = held
            held += forest.sizes[t][x]
        needed.append(np.min([before[t][leaf[near, t]] for t in range(len(forest.trees))], axis=0))
    return float(np.quantile(np.concatenate(needed), target, method="higher")) + 1


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte a component, the scale of each vector, and at least the length of what is lost."""
    scale = np.maximum(np.abs(vectors).max(axis=1), 1e-300) / 127
    code = np.rint(vectors / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((vectors - code * scale[:, None]) ** 2).sum(axis=1))
    return code, scale, lost * (1 + 1e-9) + 1e-12 * np.abs(vectors).max(axis=1)


def _usable(vectors: DataFrame) -> DataFrame:
    """id and float-array vector of the rows that take part."""
    v = F.col("vector")
    return vectors.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array, dimension: int, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(-1, dimension)


def nearest(
    embeddings: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 10,
    every: int = 100,
    trees: int = 16,
    leaf_size: int = 64,
    target_recall: float = 0.96,
    sample_rows: int = 20_000,
    sample_queries: int = 128,
    block: int = 200_000,
    query_block: int = 100_000,
    seed: int = 7,
) -> DataFrame:
    """The `k` nearest other rows found for each row whose id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id and score, the Euclidean distance in
    double precision on the original vectors; nearest first, ties to the smaller
    vec_id.  Rows whose vector is null, empty, zero or holds null or non-finite
    components, and rows without an id, take no part, nor do vectors of another
    length than most of the sample.  Rows that repeat an id and its vector count
    once; an id with several vectors keeps each of them, nearest first.  Other
    columns are not used.  Fewer than k + 1 rows give all others; an empty table
    gives an empty result.

    The forest is fitted on at most `sample_rows` rows, the ones with the
    smallest id hashes; all rows are indexed and searched.  A query visits leaves
    until they hold as many sample points as `sample_queries` of the sample's own
    points need, to find `target_recall` of their k nearest in the sample; a
    point counts once for each tree that finds it.
    """
    empty = "query_id long, rank int, vec_id long, score double"
    # vectors travel in the width they came in; distances are taken in double precision
    kind = "float" if embeddings.schema[vector_column].dataType.elementType.simpleString() == "float" else "double"
    spark = embeddings.sparkSession
    rows = _usable(embeddings.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast(f"array<{kind}>").alias("vector")))
    sample = rows.select("vector").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()["vector"].to_list()
    if not sample:
        return spark.createDataFrame([], empty)
    sizes, counts = np.unique([len(v) for v in sample], return_counts=True)
    dimension = int(sizes[np.argmax(counts)])
    fitted = np.unique(np.array([v for v in sample if len(v) == dimension], dtype=np.float32), axis=0)
    forest = Forest.fit(fitted, trees, leaf_size, seed)
    enough = enough_for(forest, fitted, k, target_recall, sample_queries, seed)
    shared = spark.sparkContext.broadcast(forest)
    rows = rows.where(F.size("vector") == dimension)
    first = Window.partitionBy("vector").orderBy("id")
    points = rows.select("id", "vector").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    points = checkpoint(points.select(F.monotonically_increasing_id().alias("row"), "id", "vector"))
    queries = checkpoint(rows.where(F.col("id") % every == 0).distinct().select(F.monotonically_increasing_id().alias("row"), "id", "vector"))

    def placed(batches, leaves_of):
        """A row of (tree, leaf, row, id, code, scale, lost) for each leaf that `leaves_of` says."""
        for batch in batches:
            vectors = _matrix(batch.column("vector"), dimension)
            code, scale, lost = coded(vectors)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dimension), len(code), [None, pa.py_buffer(np.ascontiguousarray(code).tobytes())]).cast(pa.binary())
            whole = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), packed, pa.array(scale), pa.array(lost)], ["row", "id", "code", "scale", "lost"])
            for at, tree, leaf in leaves_of(shared.value, vectors.astype(np.float32)):
                taken = whole if at is None else whole.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), *taken.columns], ["tree", "leaf", *taken.schema.names])

    def all_trees(model, vectors):
        leaves = model.leaves(vectors)
        for t in range(leaves.shape[1]):
            yield None, np.full(len(leaves), t), leaves[:, t]

    def visited(model, vectors):
        for begin in range(0, len(vectors), 256):
            found = [model.search(q, enough) for q in vectors[begin : begin + 256]]
            pairs = np.array([p for f in found for p in f]).reshape(-1, 2)
            yield begin + np.repeat(np.arange(len(found)), [len(f) for f in found]), pairs[:, 0], pairs[:, 1]

    schema = "tree int, leaf int, row bigint, id bigint, code binary, scale double, lost double"
    indexed = points.mapInArrow(lambda batches: placed(batches, all_trees), schema)
    asked = queries.mapInArrow(lambda batches: placed(batches, visited), schema)
    # at most a leaf for every few sample points, so this table is bounded by the sample
    size = lambda df, n: df.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / n).cast("int").alias("n"))
    plan = size(points.mapInArrow(lambda batches: placed(batches, all_trees), schema), block).withColumnRenamed("n", "blocks").join(size(asked, query_block).withColumnRenamed("n", "query_blocks"), ["tree", "leaf"])
    plan = F.broadcast(checkpoint(plan.where("blocks > 1 OR query_blocks > 1")))
    salt = lambda n: F.pmod(F.xxhash64("row"), F.coalesce(n, F.lit(1))).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    indexed = indexed.join(plan, ["tree", "leaf"], "left").withColumn("part", salt(F.col("blocks"))).withColumn("query_part", every_one(F.col("query_blocks")))
    asked = asked.join(plan, ["tree", "leaf"], "left").withColumn("query_part", salt(F.col("query_blocks"))).withColumn("part", every_one(F.col("blocks")))

    def decoded(rows: pa.Table) -> tuple[np.ndarray, ...]:
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), dtype=np.int8).reshape(-1, dimension)
        scale, lost = rows.column("scale").to_numpy(), rows.column("lost").to_numpy()
        return rows.column("row").to_numpy(), rows.column("id").to_numpy(), code * scale[:, None], lost

    def bound(mine: pa.Table, asking: pa.Table) -> pa.Table:
        """Pairs of a leaf that may be among a query's k nearest there, with both bounds of their distance."""
        out = ([], [], [], [])
        if len(mine) and len(asking):
            row, own, body, lost = decoded(mine)
            query, asker, wanted, query_lost = decoded(asking)
            squares = (body**2).sum(axis=1)
            step = max(1, 4_000_000 // len(body))
            for at in range(0, len(query), step):
                part = wanted[at : at + step]
                far = np.sqrt(np.maximum((part**2).sum(axis=1)[:, None] + squares[None, :] - 2 * part @ body.T, 0))
                slack = query_lost[at : at + step, None] + lost[None, :] + 1e-7 * (np.sqrt((part**2).sum(axis=1))[:, None] + np.sqrt(squares)[None, :])
                upper = far + slack
                upper[asker[at : at + step, None] == own[None, :]] = np.inf
                kth = np.partition(upper, min(k, len(body)) - 1, axis=1)[:, min(k, len(body)) - 1]
                i, j = np.nonzero((far - slack <= kth[:, None]) & (upper < np.inf))
                out[0].append(query[at + i])
                out[1].append(row[j])
                out[2].append((far - slack)[i, j])
                out[3].append(upper[i, j])
        kinds = (np.int64, np.int64, np.float64, np.float64)
        return pa.table(dict(zip(("query", "row", "lower", "upper"), (np.concatenate(x) if x else np.empty(0, dtype=t) for x, t in zip(out, kinds, strict=True)), strict=True)))

    keys = ["tree", "leaf", "part", "query_part"]
    names = [*keys, "row", "id", "code", "scale", "lost"]
    pairs = indexed.select(names).groupBy(*keys).cogroup(asked.select(names).groupBy(*keys)).applyInArrow(released_pair(bound), "query bigint, row bigint, lower double, upper double")
    pairs = pairs.groupBy("query", "row").agg(F.min("lower").alias("lower"), F.max("upper").alias("upper"))
    nearest_first = Window.partitionBy("query").orderBy("upper", "row")
    kth = F.max(F.when(F.col("n") <= k, F.col("upper"))).over(Window.partitionBy("query"))
    pairs = pairs.withColumn("n", F.row_number().over(nearest_first)).withColumn("kth", kth).where(F.col("lower") <= F.col("kth")).select("query", "row")
    pairs = pairs.join(points.select("row", F.col("id").alias("vec_id"), F.col("vector").alias("own")), "row").join(queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"), "vector"), "query")
    square = F.aggregate(F.zip_with("own", "vector", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda total, x: total + x)
    scored = pairs.select("query_id", "vec_id", F.sqrt(square).alias("score")).distinct()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
