"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source).  A token budget goes down the tree by
weights.  A node can use at most the tokens below it times `max_epochs`; what a
child cannot use is shared among its siblings by their weights first, and only
what a whole subtree cannot use is shared one level further up.

Each leaf's tokens form a stream of seeded epochs: every epoch is another
pseudo-random order of all its texts.  The leaf takes the prefix of its stream
that its budget pays for: whole epochs, then some whole texts of the next one,
then the first tokens of one more text.  The place of that last text is found
from token sums of hash ranges, of ranges inside the range that holds it, and one
window over what is left there, so no leaf is ever sorted in one task however
large it is.  Rows that are equal in id and text follow one another in the order
they are stored in, and are counted by input split before any of them is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import checkpoint, free_names, steady

RANGE_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
MISSING = ""


def share_out(budget: int, weights: Sequence[float], capacities: Sequence[int]) -> list[int]:
    """Whole tokens for each child by weight, none above its capacity; what some cannot use goes to the others.

    Spends min(budget, sum of capacities).  Fractions go to the largest
    remainders, earlier children first.  Children of weight zero only get what
    the others cannot use, in proportion to their capacities.
    """
    amounts = [0] * len(weights)
    budget = min(budget, sum(capacities))
    exact = [Fraction(w) for w in weights]
    while True:
        left = budget - sum(amounts)
        open_ = [i for i, c in enumerate(capacities) if amounts[i] < c]
        if not left or not open_:
            return amounts
        if not any(exact[i] > 0 for i in open_):
            exact = [Fraction(c) for c in capacities]
        total = sum(exact[i] for i in open_)
        wanted = {i: left * exact[i] / total for i in open_}
        full = [i for i in open_ if wanted[i] >= capacities[i] - amounts[i]]
        if full:
            for i in full:
                amounts[i] = capacities[i]
            continue
        floors = {i: int(wanted[i]) for i in open_}
        rest = left - sum(floors.values())
        extra = set(sorted(open_, key=lambda i: (floors[i] - wanted[i], i))[:rest])
        for i in open_:
            amounts[i] += floors[i] + (i in extra)
        return amounts


@dataclass(frozen=True)
class Weights:
    """Target weights of names on each level; a name that is not listed gets `default`."""

    domains: Mapping[str, float]
    languages: Mapping[str, float]
    sources: Mapping[str, float]
    default: float = 1.0

    def of(self, level: int, name: str) -> float:
        return (self.domains, self.languages, self.sources)[level].get(name, self.default)


def allocate(tokens: Mapping[tuple, int], weights: Weights, budget: int, max_epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf path of equal length, from the tokens each leaf holds."""

    def go(leaves: list[tuple], level: int, amount: int) -> dict[tuple, int]:
        if len(leaves) == 1 and level == len(leaves[0]):
            return {leaves[0]: amount}
        groups: dict[str, list[tuple]] = {}
        for leaf in leaves:
            groups.setdefault(leaf[level], []).append(leaf)
        caps = [sum(tokens[x] for x in g) * max_epochs for g in groups.values()]
        amounts = share_out(amount, [weights.of(level, n) for n in groups], caps)
        out = {}
        for g, a in zip(groups.values(), amounts, strict=True):
            out |= go(g, level + 1, a)
        return out

    leaves = sorted(tokens)
    return go(leaves, 0, min(budget, max_epochs * sum(tokens.values()))) if leaves else {}


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(seed: int, epoch: Column, doc_id: Column, body: Column) -> Column:
    """Place of a text in an epoch's order."""
    return F.xxhash64(F.lit(seed), epoch.cast("int"), doc_id, body)


def _range(key: Column, level: int) -> Column:
    """Number of the range of a level that a key lies in; the ranges of all levels ascend with the key."""
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(2**63))), 64 - RANGE_BITS * level)


def _edge(sums: DataFrame, leaf: list[str], order: list[str]) -> DataFrame:
    """Of each leaf's parts (n tokens each), in order, the one in which `rest` tokens more than `before` are reached."""
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("upto", upto).where("upto >= rest AND upto - n < rest").withColumn("before", F.col("upto") - F.col("n")).drop("upto")


def _cuts(keyed: DataFrame, leaf: list[str]) -> DataFrame:
    """Where each leaf's last epoch ends: key, id, body and row of its last text, and the tokens taken of that.

    `keyed` has one row for each text: leaf, rest, id, body, n, row, key.
    """
    part = keyed.withColumn("before", F.lit(0).cast("bigint"))
    for level in (1, 2):
        ranged = part.withColumn("range", _range(F.col("key"), level))
        edge = _edge(ranged.groupBy(*leaf, "rest", "before", "range").agg(F.sum("n").alias("n")), leaf, ["range"])
        # one row a leaf
        part = ranged.drop("before").join(F.broadcast(edge.select(*leaf, "range", "before")), [*leaf, "range"]).drop("range")
        part = checkpoint(part)
    same = ["key", "id", "body"]
    edge = _edge(part.groupBy(*leaf, "rest", "before", *same).agg(F.sum("n").alias("n"), F.count("*").alias("m"), F.min("row").alias("row")), leaf, same)
    edge = checkpoint(edge.withColumn("each", (F.col("n") / F.col("m")).cast("bigint")).withColumn("rest", F.col("rest") - F.col("before")).drop("n", "before"))
    one = edge.where("m = 1").select(*leaf, *same, "row", F.col("rest").alias("take"))
    # equal rows: first the input split in which the last one lies, then its place there
    equal = part.select(*leaf, *same, "row", "n").join(F.broadcast(edge.where("m > 1").select(*leaf, *same, "rest")), [*leaf, *same])
    equal = equal.withColumn("split", F.shiftright("row", 33))
    splits = equal.groupBy(*leaf, *same, "rest", "split").agg(F.sum("n").alias("n")).withColumn("before", F.lit(0).cast("bigint"))
    split = _edge(splits, leaf, ["split"]).select(*leaf, "split", "before")
    rows = equal.join(F.broadcast(split), [*leaf, "split"])
    many = _edge(rows, leaf, ["row"]).select(*leaf, *same, "row", (F.col("rest") - F.col("before")).alias("take"))
    return one.unionAll(many)


def mix(docs: DataFrame, weights: Weights, domain: Column, share: float | None = None, budget: int | None = None, max_epochs: int = 4, seed: int = 13, text: str = "text", max_leaves: int = 200_000) -> DataFrame:
    """Choose texts so that leaves get the tokens their weights ask for.

    The budget is `budget` tokens, or `share` of all tokens of the input.  Needs
    columns doc_id, lang, source and `text`; `domain` is an expression over the
    input.  All columns pass through, whatever their names, and one row comes out
    for each text and epoch that the leaf's prefix reaches, with `domain`, `epoch`
    (from 0), `n_tokens` and `take_tokens` (less than n_tokens only for the last
    text of a leaf), replacing columns of those names.  The tokens taken of each
    leaf are exactly its budget.

    Tokens are words.  Null domains, languages and sources are a name of their
    own, the empty one.  Null and empty texts have no tokens; they come with
    every full epoch and with the part of the last one before its end.  Rows
    that share a doc_id are texts of their own, and so are rows without one;
    rows that are equal in both follow one another in an epoch's order.  An
    empty table gives an empty result.  The number of leaves must not pass
    `max_leaves`; the driver holds one number a leaf.
    """
    names = ("domain", "epoch", "n_tokens", "take_tokens")
    docs = steady(docs)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    leaf = ["x0", "x1", "x2"]
    about = [
        *(F.coalesce(x.cast("string"), F.lit(MISSING)).alias(c) for x, c in zip((domain, F.col("lang"), F.col("source")), leaf, strict=True)),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(F.col(f"`{text}`")).alias("body"),
        token_count(F.col(f"`{text}`")).alias("n"),
        F.monotonically_increasing_id().alias("row"),
    ]
    slim = checkpoint(docs.select(*about))
    rows = slim.groupBy(*leaf).agg(F.sum("n").alias("n")).limit(max_leaves + 1).collect()
    if len(rows) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    held = {tuple(r[c] for c in leaf): int(r.n) for r in rows}
    if budget is None:
        budget = int(Fraction(str(share if share is not None else 1)) * sum(held.values()))
    given = allocate(held, weights, budget, max_epochs)
    plan = [(*path, *(divmod(given[path], n) if n else (max_epochs, 0))) for path, n in held.items()]
    spark = docs.sparkSession
    schema = "x0 string, x1 string, x2 string, full bigint, rest bigint"
    table = spark.createDataFrame(plan, schema)
    keyed = slim.join(F.broadcast(table.where("rest > 0")), leaf).select(*leaf, "rest", "id", "body", "n", "row", _key(seed, F.col("full"), F.col("id"), F.col("body")).alias("key"))
    ends = {tuple(r[c] for c in leaf): tuple(r[c] for c in ("key", "id", "body", "row", "take")) for r in _cuts(keyed, leaf).collect()}
    table = spark.createDataFrame([(*p, ends.get(p[:3])) for p in plan], schema + ", cut struct<key:bigint,id:bigint,body:bigint,row:bigint,take:bigint>")
    # helper columns stand in one struct, whose name no column of the rows has
    (me,) = free_names(docs, "mixing_helper")
    x = lambda name: F.col(f"{me}.{name}")
    own = docs.select(*keep, F.struct(*about).alias(me))
    table = table.select(F.struct("*").alias(me + "_plan"))
    p = lambda name: F.col(f"{me}_plan.{name}")
    placed = own.join(F.broadcast(table), (x("x0") == p("x0")) & (x("x1") == p("x1")) & (x("x2") == p("x2")))
    here = F.struct(_key(seed, p("full"), x("id"), x("body")).alias("key"), x("id").alias("id"), x("body").alias("body"), x("row").alias("row"))
    end = F.struct(*(p(f"cut.{c}").alias(c) for c in ("key", "id", "body", "row")))
    part = F.when(p("cut").isNotNull(), F.when(here < end, x("n")).when(here == end, p("cut.take")))
    placed = placed.select(*keep, F.struct(x("x0").alias("domain"), x("n").alias("n"), p("full").alias("full"), part.alias("part")).alias(me))
    copies = x("full") + F.when(x("part").isNotNull(), 1).otherwise(0)
    out = placed.where(copies > 0).select(*keep, F.col(me), F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)).alias(me + "_epoch"))
    epoch = F.col(me + "_epoch")
    return out.select(*keep, x("domain").alias("domain"), epoch.cast("int").alias("epoch"), x("n").alias("n_tokens"), F.when(epoch < x("full"), x("n")).otherwise(x("part")).alias("take_tokens"))


def first_tokens(text: Column, n: Column) -> Column:
    """The first n words of a text, joined by one space."""
    return F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), n.cast("int")))
