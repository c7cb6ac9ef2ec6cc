"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source's documents get a seeded random order and fall into blocks of it: a hash places a document in a
   cell, cells are counted, and a cell's offset plus its rank in the cell is the document's place in the source's
   permutation. A hot source spreads over as many cells as its size asks for, so no task holds a whole source.
2. Quotas: the largest mix without repetition that has the target weights, in whole documents per source (largest
   remainders first), is drawn as the head of each permutation.
3. The exact quotas are split among the output shards by a binary tree: at each node, how much of each source goes
   left is one multivariate-hypergeometric draw (a random dealing of all remaining documents), so that every leaf
   holds whole numbers that add up to the quotas. The tree holds counts alone: sources times shards. The driver
   splits down to at most ``CELLS`` counts; where there are more shards, tasks split on, each below its own node.
4. A leaf's counts cut each source's permutation into disjoint blocks; a shard reads its blocks and shuffles them
   locally. A partition is one shard (below a node of the driver's tree: its shards).

Weights: given ones, else the sources' own sizes, which the corpus meets in full: every document is drawn, and no
source, however small, sets how much of another one survives. Given weights are kept exactly, so there the source that is
shortest for its weight sets the size of the mix; ``drawn_of`` reports how many documents of each source are drawn.
With ``repeat`` weights are kept exactly as well, but nothing is left out for them: the source that is largest for its
weight is drawn once, and the others are repeated, whole permutations after each other (every document is drawn before
one is drawn again), the last of them as far as the quota goes. Weights may be a function of the sources' sizes, such as
``tempered``.

Defined results: documents whose source is null form a source of their own (weights may name it by None); a source
without a weight, or with weight 0, is left out. Null and empty texts, null and repeated ids and repeated rows are
documents like any others; rows that are alike in id and text tie, and their order among each other is arbitrary,
which leaves the result the same. An empty table gives an empty mix. Extra columns are kept; ``shard`` and
``place`` of the input are replaced by ``mixed`` and kept by ``draw``. Sources are counted on the driver: they may be
many thousands, not as many as documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.llm.common import arrow, cut, shielded, small, table

SEED = 1729
#: Documents of a shard and of a cell of the permutation, at which their numbers are chosen.
SHARD_ROWS = 20_000
CELL_ROWS = 5_000
#: Counts that the driver's part of the tree holds at most (24 bytes each in what is broadcast of it).
CELLS = 1_000_000
#: Target weights that grow with a source's size to this power: small sources count for more than their share.
POWER = 0.7


def tempered(counts: dict) -> dict:
    return {s: n**POWER for s, n in counts.items()}


def quotas(counts: dict, weights: dict | Callable | None = None, repeat: bool = False) -> dict:
    """Documents to draw of each source: the largest mix with these weights that no source is too small for; with
    ``repeat`` the smallest one that holds every document of each source with a weight.

    Fractions are rounded down and the rest goes to the largest remainders; so the mix is within one document of
    its weights everywhere.
    """
    order = sorted(counts, key=lambda s: (s is None, s or ""))
    if weights is None:
        return {s: counts[s] for s in order if counts[s]}
    if callable(weights):
        weights = weights(counts)
    live = [s for s in order if counts[s] and weights.get(s, 0) > 0]
    if not live:
        return {}
    total = sum(weights[s] for s in live)
    bound = max if repeat else min
    size = bound(counts[s] * total / weights[s] for s in live)
    exact = {s: bound(counts[s], size * weights[s] / total) for s in live}
    out = {s: int(exact[s] + 1e-9) for s in live}
    rest = int(sum(exact.values()) + 1e-9) - sum(out.values())
    for s in sorted(live, key=lambda s: (out[s] - exact[s], order.index(s)))[:rest]:
        out[s] += 1
    return {s: bound(n, counts[s]) for s, n in out.items()}


def drawn_of(docs: DataFrame, weights: dict | Callable | None = None, source_col: str = "source", repeat: bool = False) -> DataFrame:
    """One row per source: its documents (available) and how many of them the mix holds (drawn)."""
    counts = _counts(docs.select(docs[source_col].cast("string").alias("__source")))
    quota = quotas(counts, _named(weights), repeat)
    return docs.sparkSession.createDataFrame([(s, n, quota.get(s, 0)) for s, n in counts.items()], "source string, available long, drawn long")


def _counts(light: DataFrame) -> dict:
    return {r[0]: r[1] for r in light.groupBy("__source").count().collect()}


def _named(weights: dict | Callable | None) -> dict | Callable | None:
    return weights if callable(weights) else weights and {None if k is None else str(k): w for k, w in weights.items()}


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n documents drawn from good + bad are good, for any size: inverts the distribution function.

    Probabilities follow from the ratio of neighbouring ones, outwards from the mode; what is 13 standard deviations
    away has a probability below what a double holds beside 1.
    """
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    deviation = (n * good * bad * (total - n)) ** 0.5 / total / max(1, total - 1) ** 0.5
    reach = int(13 * deviation) + 20
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up) / (up + 1) * ((n - up) / (bad - n + up + 1)))
    below = np.cumprod(down / (good - down + 1) * ((bad - n + down) / (n - down + 1)))
    weight = np.concatenate([below[::-1], [1.0], above])
    reached = np.cumsum(weight)
    return mode - len(below) + int(np.searchsorted(reached, rng.random() * reached[-1], side="right"))


def _deal(rng: np.random.Generator, pool: list[int], n: int) -> list[int]:
    """Multivariate-hypergeometric draw by conditional draws."""
    out, left = [], sum(pool)
    for k in pool:
        left -= k
        out.append(_hypergeometric(rng, k, left, n))
        n -= out[-1]
    return out


def split(pool: list[int], lo: int, hi: int, total: int, shards: int, seed: int = SEED, depth: int = 64) -> Iterator[tuple[int, int, list[int]]]:
    """Nodes (first shard, last + 1, counts) of the tree below [lo, hi): its leaves, or what it has at this depth."""
    if hi - lo == 1 or depth == 0:
        yield lo, hi, pool
        return
    mid = (lo + hi) // 2
    rng = np.random.default_rng([seed, lo, hi])  # each node has its own stream
    left = _deal(rng, pool, (mid - lo) * (total // shards) + max(0, min(mid, total % shards) - lo))  # the first shards hold one more
    yield from split(left, lo, mid, total, shards, seed, depth - 1)
    yield from split([a - b for a, b in zip(pool, left)], mid, hi, total, shards, seed, depth - 1)


def splitting_tree(quota: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Counts [shard, source]; the shards' sizes differ by one at most and the columns add up to the quotas."""
    return np.array([pool for _, _, pool in split(quota, 0, shards, sum(quota), shards, seed)], np.int64).reshape(shards, len(quota))


def _search(n: int, before: Callable[[Column], Column]) -> Column:
    """How many of n ascending ends lie before a row: a binary search, as a fold over bits. ``before``: whether the end
    at this index does (null beyond the last)."""
    bits = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(bits, F.lit(0), lambda at, bit: F.when(before(at + bit - 1), at + bit).otherwise(at))


def _below(total: int, shards: int, seed: int):
    """(node, lo, hi, pool) to (node, ends): per source, the ends of its blocks in the node's shards."""

    def run(batches):
        for batch in batches:
            ends = []
            for lo, hi, pool in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "pool"))):
                leaves = np.array([p for _, _, p in split(pool, lo, hi, total, shards, seed)], np.int64)
                ends.append(np.cumsum(leaves, axis=0).T.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.list_(pa.int64())))], ["node", "lo", "ends"])

    return run


def _mixed(docs: DataFrame, weights: dict | Callable | None, id_col: str, text_col: str, source_col: str, shard_rows: int, seed: int, cells: int, repeat: bool) -> DataFrame:
    """The drawn documents, their columns named c0, c1, ..., with ``shard`` and ``place``.

    Ranks are taken on 8-byte hashes alone. What comes of them is one pair (hash, rank among equal hashes) per
    block, so the documents themselves find their node by a binary search and are shuffled once, to it.
    """
    spark = docs.sparkSession
    plain, new = shielded(docs)
    names = [F.col(c) for c in plain.columns]
    at = F.xxhash64(F.lit(seed), new[id_col])
    source = F.col(new[source_col]).cast("string")
    counts = _counts(plain.select(source.alias("__source")))
    quota = quotas(counts, _named(weights), repeat)
    times = {s: -(-q // counts[s]) for s, q in quota.items()}  # how often the quota goes through the source
    bits = (max(times.values(), default=1) - 1).bit_length()
    if bits:  # a repetition is a document like any other; its number leads its hash, so that repetitions follow each other
        epochs = spark.createDataFrame(list(times.items()), "e_s string, __times int")
        plain = plain.join(small(epochs, len(times), 64), source.eqNullSafe(F.col("e_s"))).withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
        at = F.shiftrightunsigned(F.xxhash64(F.col("__epoch") + seed, new[id_col]), bits).bitwiseOR(F.shiftleft(F.col("__epoch").cast("long"), 64 - bits)).bitwiseXOR(F.lit(-(1 << 63)))
    light = plain.select(source.alias("__source"), at.alias("__at"))
    sources = [s for s in quota if quota[s]]
    if not sources:
        return plain.limit(0).select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("place"))
    total = sum(quota.values())
    shards = max(1, round(total / shard_rows))
    depth = 64 if shards * len(sources) <= cells else max(0, (cells // len(sources)).bit_length() - 1)
    nodes = list(split([quota[s] for s in sources], 0, shards, total, shards, seed, depth))
    ends = np.cumsum([pool for _, _, pool in nodes], axis=0)

    # rank of each hash in its source's permutation: rank in its cell and the sizes of the cells before it
    named = spark.createDataFrame([(s, max(1, round(counts[s] * times[s] / CELL_ROWS))) for s in sources], "s string, n_cells int")
    cell = F.expr("least(n_cells - 1, int(floor((__at / 18446744073709551616D + 0.5D) * n_cells)))")
    celled = cut(light.join(small(named, len(sources), 64), F.col("__source").eqNullSafe(F.col("s"))).select("s", "__at", cell.alias("cell")), "mix-hashes")
    running = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = celled.groupBy("s", "cell").count().select(F.col("s").alias("b_s"), F.col("cell").alias("b_cell"), F.coalesce(F.sum("count").over(running), F.lit(0)).alias("before"))
    in_cell = Window.partitionBy("s", "cell").orderBy("__at")
    ranked = celled.withColumn("r", F.row_number().over(in_cell)).withColumn("__tie", F.row_number().over(Window.partitionBy("s", "cell", "__at").orderBy("__at")) - 1)
    ranked = ranked.join(before, F.col("s").eqNullSafe(F.col("b_s")) & (F.col("cell") == F.col("b_cell"))).withColumn("rank", F.col("before") + F.col("r"))
    wanted = spark.createDataFrame([(s, int(e)) for i, s in enumerate(sources) for e in np.unique(ends[:, i]) if e], "w_s string, w_rank long")
    found = ranked.join(small(wanted, ends.size, 24), F.col("s").eqNullSafe(F.col("w_s")) & (F.col("rank") == F.col("w_rank"))).select("s", "rank", "__at", "__tie").collect()
    last = {(r[0], r[1]): (r[2], r[3]) for r in found}  # a block's end each: CELLS at most
    first = (-(1 << 63), -1)  # the end of blocks that are empty so far
    plan = spark.createDataFrame([(s, i, [last[s, int(e)] if e else first for e in ends[:, i]]) for i, s in enumerate(sources)], "s string, __i int, ends array<struct<__at: long, __tie: int>>")

    base = plain.select(*names, source.alias("__source"), at.alias("__at"))
    ties = cut(celled.groupBy("s", "__at").count().filter("count > 1").select(F.col("s").alias("t_s"), F.col("__at").alias("t_at")), "mix-ties")
    n_ties = ties.count()
    if n_ties:  # rows whose ids are alike (repeated or null): they alone are ranked among each other
        same = F.col("__source").eqNullSafe(F.col("t_s")) & (F.col("__at") == F.col("t_at"))
        ties = small(ties, n_ties, 40)
        again = base.join(ties, same, "left_semi").withColumn("__tie", F.row_number().over(Window.partitionBy("__source", "__at").orderBy(new[text_col])) - 1)
        base = base.join(ties, same, "left_anti").withColumn("__tie", F.lit(0)).union(again)
    else:
        base = base.withColumn("__tie", F.lit(0))
    node = _search(len(nodes), lambda i: F.get("ends", i) < F.struct("__at", "__tie"))
    placed = base.join(small(plan, ends.size, 24), F.col("__source").eqNullSafe(F.col("s"))).withColumn("node", node).filter(f"node < {len(nodes)}").drop("ends", "s", "__source")
    shuffled = F.xxhash64(F.lit(seed + 1), "__at", "__tie")
    if depth == 64:  # nodes are shards, and so are partitions: a row's number in its partition is its place
        own = placed.withColumn("__order", shuffled).repartitionById(shards, "node").sortWithinPartitions("__order", "__at", "__tie")
        return own.select(*names, F.col("node").cast("int").alias("shard"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    top = spark.createDataFrame([(i, lo, hi, pool) for i, (lo, hi, pool) in enumerate(nodes)], "node int, lo int, hi int, pool array<long>")
    tree = top.repartition(min(len(nodes), 1000), "node").transform(arrow, _below(total, shards, seed), "node int, lo int, ends array<array<long>>")
    deep = placed.join(tree.hint("merge"), "node").withColumn("r", F.row_number().over(Window.partitionBy("node", "__i").orderBy("__at", "__tie")))
    deep = deep.withColumn("own", F.get("ends", F.col("__i"))).withColumn("shard", F.col("lo") + _search(max(hi - lo for lo, hi, _ in nodes), lambda i: F.get("own", i) < F.col("r"))).drop("ends", "own")
    place = F.row_number().over(Window.partitionBy("node", "shard").orderBy(shuffled, "__at", "__tie")) - 1
    return deep.select(*names, F.col("shard").cast("int").alias("shard"), place.cast("long").alias("place"))


def mixed(
    docs: DataFrame, weights: dict | Callable | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_rows: int = SHARD_ROWS, seed: int = SEED, cells: int = CELLS, repeat: bool = False
) -> DataFrame:
    """The drawn documents with ``shard`` and ``place`` (0, 1, ... in the shard's shuffled order)."""
    out = _mixed(docs, weights, id_col, text_col, source_col, shard_rows, seed, cells, repeat)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("shard", "place")], "shard", "place")


def draw(
    docs: DataFrame, weights: dict | Callable | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_rows: int = SHARD_ROWS, seed: int = SEED, cells: int = CELLS, repeat: bool = False
) -> DataFrame:
    """The mix in its shards' order, with the columns of the input."""
    return _mixed(docs, weights, id_col, text_col, source_col, shard_rows, seed, cells, repeat).drop("shard", "place").toDF(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
