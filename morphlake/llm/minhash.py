"""MinHash near-duplicates by a containment ensemble.

A document counts as a near-duplicate of a *dominating* one (more shingles, or as many and a lower id) if at
least ``threshold`` of its own distinct word shingles occur in that one, and that one has at most ``max_ratio``
times its shingles (a short excerpt of a long text is the business of substring dedup, not of this operator).

1. One Arrow pass gives each document its shingle-set size, a 128-bit set fingerprint, banded MinHash keys and a
   sketch of one byte per hash function.
2. Equal sets collapse to their lowest id, so exact copies never meet in a bucket.
3. Documents are partitioned by size in half octaves. For a pair of partitions, the containment threshold turns
   into a Jaccard threshold at their worst size ratio, and ``tune`` picks the bands and rows for that threshold
   alone. Partitions share their band keys, so every document is emitted once.
4. Round A is linear: every member of a bucket meets the bucket's leader and its own predecessor in dominance
   order. The best of them by sketch is checked exactly on the texts. Nearly all copies are settled here.
5. Round B looks at the buckets that hold members of several groups so far. All documents of different groups that
   meet there are compared by their sketches, settled or not, block by block, so that no bucket is one task; pairs that
   are four standard deviations short of their own Jaccard threshold are refused, and no others are written. Of each pair of groups the most alike candidates are checked exactly
   first; groups that turn out to be linked are one from then on, and the rest of their candidates can't change
   anything. This goes on, with more candidates each time, until none between different groups is left unchecked.
6. The verified pairs are edges; of each connected group the lowest id stays. So copies of one original that differ
   too much from each other still leave one document.

Defined results: null, empty or word-less texts have no shingles and are never duplicates. Texts of fewer words
than a shingle are one shingle. Rows with a null id can't be named: they are ignored by ``near_duplicates`` and
kept by ``keep_one``. Repeated ids count as one document (the one with most shingles, then the lowest set
fingerprint), and ``keep_one`` keeps one of these rows. An empty table gives an
empty result. Extra columns are ignored, and kept by ``keep_one``. Ids are whole numbers (cast to long; others are null).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.llm.common import arrow, components, cut, cut_at, drop_tables, pick, shielded, small, table
from morphlake.llm.textkit import PUNCT, U, Words, mix, slices, utf8

SHINGLE = 5  # words
THRESHOLD = 0.6
MAX_RATIO = 2.0
#: Candidates of a pair of groups that are checked in the first round, and how many times as many in each further one.
FIRST_CHECKED, MORE_CHECKED = 2, 8
HASHES = 243
RECALL = 0.9  # of a pair exactly at the worst Jaccard threshold of its partitions
SEED = 20240607
#: Rows of a bucket that are compared with each other at once; larger buckets are compared block by block.
BLOCK = 2048

PAIR = "doc_id long, keeper_id long, containment double"


def tune(jaccard: float, hashes: int = HASHES, recall: float = RECALL) -> tuple[int, int]:
    """Most selective banding (rows, bands) that still finds a pair of this similarity with this probability."""
    best = (1, hashes)
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - min(jaccard, 1 - 1e-9) ** rows))
        if rows * bands <= hashes:
            best = (rows, bands)
    return best


def ensemble(threshold: float = THRESHOLD, max_ratio: float = MAX_RATIO, hashes: int = HASHES) -> list[tuple[float, int, int]]:
    """Per distance of two size partitions (half octaves): Jaccard threshold, rows, bands."""
    out = []
    for d in range(math.ceil(2 * math.log2(max_ratio)) + 1):
        worst = min(max_ratio, 2 ** ((d + 1) / 2))
        jaccard = threshold / (1 + worst - threshold)
        out.append((jaccard, *tune(jaccard, hashes)))
    return out


def shingle_sets(column: pa.Array, k: int = SHINGLE):
    """Yield the sorted distinct 64-bit shingle hashes of every text, in order."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        words = Words(part, offsets[a : b + 1] - offsets[a], PUNCT, fold=True)
        h, valid = words.windows(k)
        for i in range(b - a):
            f, t = words.first[i], words.first[i + 1]
            if t - f >= k:
                own = np.sort(h[f : t - k + 1])
                yield own[np.r_[True, own[1:] != own[:-1]]]
            elif t > f:
                own = np.array([t - f], U)
                for x in words.h[f:t]:
                    own = mix(own ^ x) * U(3)
                yield own
            else:
                yield np.empty(0, U)


def _signatures(k: int, hashes: int, layouts: list[tuple[int, int]]):
    """Arrow function: (doc_id, text) to (doc_id, size, set_a, set_b, sketch, keys)."""
    keys_type = pa.list_(pa.int64())
    names = ["doc_id", "size", "set_a", "set_b", "sketch", "keys"]

    def run(batches):
        rng = np.random.default_rng(SEED)
        mul = (rng.integers(0, 1 << 32, hashes, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        add = rng.integers(0, 1 << 32, hashes, np.uint64).astype(np.uint32)[:, None]
        for batch in batches:
            size, set_a, set_b, sketch, keys = [], [], [], [], []
            for own in shingle_sets(batch.column(1), k):
                size.append(len(own))
                mixed = mix(own + U(SEED))
                set_a.append(int(own.sum(dtype=U)) & ((1 << 63) - 1))
                set_b.append(int(mixed.sum(dtype=U)) & ((1 << 63) - 1))
                least = np.full(hashes, 0xFFFFFFFF, np.uint32)
                short = (mixed >> U(32)).astype(np.uint32)
                for at in range(0, len(short), 2048):
                    x = mul * short[at : at + 2048]
                    x += add
                    np.minimum(least, x.min(axis=1), out=least)
                sketch.append((mix(least.astype(U)) & U(0xFF)).astype(np.uint8).tobytes())
                wide = mix(least.astype(U) + (np.arange(hashes, dtype=U) << U(32)))
                own_keys = []
                for rows, bands in layouts:
                    g = wide[: rows * bands].reshape(bands, rows)
                    own_keys.append(mix(g.sum(axis=1, dtype=U) + U(rows)))
                keys.append(np.concatenate(own_keys).view(np.int64) if len(own) else np.empty(0, np.int64))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int32()),
                    pa.array(set_a, pa.int64()),
                    pa.array(set_b, pa.int64()),
                    pa.array(sketch, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(keys_type),
                ],
                names,
            )

    return run


def _likeness(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sketches: whether these leave the pair's own Jaccard threshold possible, and the estimated containment."""
    est = np.clip(((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256), 0, 1)
    need = threshold * size_a / (size_a + size_b - threshold * size_a)
    return est >= need - 4 * np.sqrt(need * (1 - need) / a.shape[1]), est / (1 + est) * (size_a + size_b) / size_a


def _estimated(threshold: float):
    """Arrow function: keep the pairs whose sketches leave their own Jaccard threshold possible; adds ``est``."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in ("sketch_a", "sketch_b"))
            size_a, size_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("size_a", "size_b"))
            ok, contained = _likeness(a, b, size_a, size_b, threshold)
            kept = batch.select(["doc_id", "cand_id"]).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(contained[ok])], ["doc_id", "cand_id", "est"])

    return run


def _met(threshold: float, max_ratio: float, allowed: list[tuple[int, int]]):
    """Rows of blocks of buckets, those of a pair of blocks in a row, to the likely pairs of documents of different groups.

    ``allowed``: per distance of two size partitions, the bands [from, to) that count for it.
    """
    names = ["doc_id", "cand_id", "est"]

    def pairs_of(t: pa.Table):
        ids, size, g, block = (t.column(c).to_numpy() for c in ("doc_id", "size", "g", "block"))
        if len(np.unique(g)) < 2:
            return
        band = int(t.column("band")[0].as_py())
        far = max((d for d, (lo, hi) in enumerate(allowed) if lo <= band < hi), default=-1)
        near = min((d for d, (lo, hi) in enumerate(allowed) if lo <= band < hi), default=0)
        level = np.floor(2 * np.log2(size)).astype(np.int64)
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        both = block.min() != block.max()
        order = np.lexsort((ids, -size))  # dominating ones first
        ids, size, g, block, level, sketch = (x[order] for x in (ids, size, g, block, level, sketch))
        for i in range(1, len(ids)):
            to = np.searchsorted(-size[:i], -max_ratio * size[i])  # from here on, at most so many times as large
            ok = g[to:i] != g[i]
            apart = level[to:i] - level[i]
            ok &= (apart >= near) & (apart <= far)
            if both:
                ok &= block[to:i] != block[i]  # pairs within a block meet where that block is alone
            at = np.flatnonzero(ok) + to
            for lo in range(0, len(at), 4096):
                own = at[lo : lo + 4096]
                likely, est = _likeness(sketch[i : i + 1], sketch[own], size[i].astype(float), size[own].astype(float), threshold)
                if likely.any():
                    yield np.full(int(likely.sum()), ids[i]), ids[own[likely]], est[likely]

    def run(batches):
        kept: list[pa.RecordBatch] = []
        out, n = [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)

        def whole(batches):
            """Tables of one pair of blocks each."""
            now = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                key, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                edges = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
                for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                    this = (key[a], pair[a])
                    if this != now and kept:
                        yield pa.Table.from_batches(kept)
                        kept.clear()
                    now = this
                    kept.append(batch.slice(a, b - a))
            if kept:
                yield pa.Table.from_batches(kept)

        for t in whole(batches):
            for got in pairs_of(t):
                out.append(got)
                n += len(got[0])
                if n > 20_000:
                    yield done()
                    out, n = [], 0
        if out:
            yield done()

    return run


def _contained(k: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [
                    len(np.intersect1d(a, b, assume_unique=True)) / max(1, len(a))
                    for a, b in zip(shingle_sets(part.column("text_a"), k), shingle_sets(part.column("text_b"), k))
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("cand_id"), pa.array(got, pa.float64())], ["doc_id", "cand_id", "containment"])

    return run


def _exact(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Containment of doc_id in cand_id, from the texts; ``pairs`` is a written table."""
    n = pairs.count()
    ids = pairs.select("doc_id").union(pairs.select("cand_id")).distinct()
    texts = docs.join(small(ids.withColumnRenamed("doc_id", "id"), 2 * n, 24), F.col("doc_id") == F.col("id"), "left_semi")
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("doc_id", "cand_id").join(a, F.col("doc_id") == F.col("a")).join(b, F.col("cand_id") == F.col("b"))
    got = both.select("doc_id", "cand_id", "text_a", "text_b").transform(arrow, _contained(k), "doc_id long, cand_id long, containment double")
    return got.groupBy("doc_id", "cand_id").agg(F.max("containment").alias("containment"))  # ids may repeat


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_ratio: float = MAX_RATIO, k: int = SHINGLE, hashes: int = HASHES
) -> DataFrame:
    """One row per document that goes: its id, the id that stays in its group, and the greatest containment of a
    verified pair that it is part of (1.0 for an equal shingle set)."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.expr("try_cast(doc_id AS long)")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    bands = ensemble(threshold, max_ratio, hashes)
    layouts = sorted({(r, max(b for _, r2, b in bands if r2 == r)) for _, r, _ in bands})
    starts = {r: sum(b for _, b in layouts[:i]) for i, (r, _) in enumerate(layouts)}

    signed = docs.transform(arrow, _signatures(k, hashes, layouts), "doc_id long, size int, set_a long, set_b long, sketch binary, keys array<long>")
    signed = cut(signed.filter("size > 0"), "minhash-sets")
    light = signed.select("doc_id", "size", "set_a", "set_b").groupBy("doc_id").agg(F.max(F.struct("size", F.negative("set_a").alias("na"), F.negative("set_b").alias("nb"))).alias("s"))
    light = light.select("doc_id", "s.size", F.negative("s.na").alias("set_a"), F.negative("s.nb").alias("set_b"))
    light = cut(light.withColumn("rep", F.min("doc_id").over(Window.partitionBy("set_a", "set_b", "size"))), "minhash-reps")
    equal = light.filter("doc_id <> rep").select("doc_id", F.col("rep").alias("keeper_id"), F.lit(1.0).alias("containment"))
    reps = signed.join(light.filter("doc_id = rep").select("doc_id", "set_a", "set_b", "size"), ["doc_id", "set_a", "set_b", "size"], "left_semi")
    reps = reps.dropDuplicates(["doc_id"])

    by = Window.partitionBy("key")
    ordered = by.orderBy(F.desc("size"), "doc_id")
    who = F.struct("doc_id", "size")
    rows = reps.select("doc_id", "size", F.posexplode("keys").alias("band", "key"))
    buckets = rows.select("key", "band", "doc_id", "size", F.count("*").over(by).alias("n"), F.first(who).over(ordered).alias("lead"), F.lag(who).over(ordered).alias("prev"))
    buckets = cut(buckets.filter("n > 1").drop("n"), "minhash-buckets")

    # which bands count for two sizes: by the distance of their partitions
    apart = "(int(floor(2 * log2(size_b))) - int(floor(2 * log2(size_a))))"
    allowed = " OR ".join(f"({apart} = {d} AND band >= {starts[r]} AND band < {starts[r] + b})" for d, (_, r, b) in enumerate(bands))
    fits = f"size_b >= size_a AND size_b <= {float(max_ratio)} * size_a AND ({allowed})"
    sketches = reps.select("doc_id", "sketch")

    def sketched(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("doc_id").alias("ia"), F.col("sketch").alias("sketch_a"))
        b = sketches.select(F.col("doc_id").alias("ib"), F.col("sketch").alias("sketch_b"))
        both = pairs.join(a, F.col("doc_id") == F.col("ia")).join(b, F.col("cand_id") == F.col("ib"))
        both = both.select("doc_id", "cand_id", "size_a", "size_b", "sketch_a", "sketch_b")
        return both.transform(arrow, _estimated(threshold), "doc_id long, cand_id long, est double")

    met = [buckets.select("band", F.col("doc_id"), F.col("size").alias("size_a"), F.col(f"{c}.doc_id").alias("cand_id"), F.col(f"{c}.size").alias("size_b")) for c in ("lead", "prev")]
    first = met[0].union(met[1]).filter(f"cand_id IS NOT NULL AND doc_id <> cand_id AND {fits}")
    first = first.groupBy("doc_id", "cand_id", "size_a", "size_b").agg(F.count("*").alias("hits"))
    likely = first.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), F.desc("size_b"), "cand_id"))).filter("r <= 4")
    chosen = sketched(likely).groupBy("doc_id").agg(F.max(F.struct("est", F.negative("cand_id").alias("c"))).alias("m")).select("doc_id", F.negative("m.c").alias("cand_id"))
    tested = cut(_exact(docs, cut(chosen, "minhash-first"), k), "minhash-tested")
    settled = tested.filter(F.col("containment") >= threshold).select("doc_id", F.col("cand_id").alias("keeper_id"), "containment")

    # round B: candidates between different groups, the likeliest of each pair of groups first
    named = lambda df, c, g: df.join(groups.select(F.col("doc_id").alias("m"), F.col("label").alias(g)), F.col(c) == F.col("m"), "left").withColumn(g, F.coalesce(g, c)).drop("m")
    groups = components(settled)
    placed = named(buckets.select("key", "band", "doc_id", "size"), "doc_id", "g")
    several = placed.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 <> g1").select("key")
    placed = cut(placed.join(several, "key", "left_semi"), "minhash-mixed")
    # buckets fall into blocks; every pair of blocks of a bucket is a small group of its own, whatever the bucket's size
    by_key = Window.partitionBy("key")
    blocks = placed.withColumn("block", F.expr(f"int((row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1) div {BLOCK})"))
    blocks = blocks.withColumn("n", F.max("block").over(by_key) + 1).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    paired = blocks.withColumn("pair", F.least("block", "other").cast("long") * F.col("n") + F.greatest("block", "other"))
    paired = paired.join(sketches.withColumnRenamed("doc_id", "s_id"), F.col("doc_id") == F.col("s_id")).select("key", "pair", "band", "block", "doc_id", F.col("size").cast("long").alias("size"), "g", "sketch")
    second = paired.repartition("key", "pair").sortWithinPartitions("key", "pair").transform(arrow, _met(threshold, max_ratio, [(starts[r], starts[r] + n) for _, r, n in bands]), "doc_id long, cand_id long, est double")
    second = second.groupBy("doc_id", "cand_id").agg(F.max("est").alias("est"))
    second = second.join(tested.select("doc_id", "cand_id"), ["doc_id", "cand_id"], "left_anti")
    left, old = cut_at(second, "minhash-second")
    links, many = settled, FIRST_CHECKED
    while True:
        between = named(named(left, "doc_id", "g_a"), "cand_id", "g_b").filter("g_a <> g_b")
        likeliest = Window.partitionBy(F.least("g_a", "g_b"), F.greatest("g_a", "g_b")).orderBy(F.desc("est"), "doc_id", "cand_id")
        ranked, path = cut_at(between.withColumn("r", F.row_number().over(likeliest)).select("doc_id", "cand_id", "est", "r"), "minhash-ranked")
        drop_tables(docs.sparkSession, old)
        old = path
        now = ranked.filter(f"r <= {many}")
        if now.isEmpty():
            break
        checked = cut(_exact(docs, now, k).filter(F.col("containment") >= threshold), "minhash-checked")
        links = links.union(checked.select("doc_id", F.col("cand_id").alias("keeper_id"), "containment"))
        left, many = ranked.filter(f"r > {many}").drop("r"), many * MORE_CHECKED
        if not checked.isEmpty():
            groups = components(links)
    links = cut(links, "minhash-links")

    closest = links.select("doc_id", "containment").union(links.select("keeper_id", "containment")).groupBy("doc_id").agg(F.max("containment").alias("containment"))
    labels = groups
    near = labels.filter("doc_id <> label").join(closest, "doc_id").select("doc_id", F.col("label").alias("keeper_id"), "containment")
    top = labels.select(F.col("doc_id").alias("u"), F.col("label"))
    equal = equal.join(top, equal.keeper_id == top.u, "left").select("doc_id", F.coalesce("label", "keeper_id").alias("keeper_id"), "containment")
    return near.union(equal)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The documents without those that ``near_duplicates`` names, and with one row of each repeated id."""
    gone = cut(near_duplicates(docs, id_col, text_col, **parameters).select(F.col("doc_id").alias("__gone")), "minhash-gone")
    plain, new = shielded(docs)
    key, text = F.expr(f"try_cast({new[id_col]} AS long)"), F.col(new[text_col])
    kept = plain.join(small(gone, gone.count(), 16), key == F.col("__gone"), "left_anti")
    again = cut(kept.select(key.alias("__again")).filter("__again IS NOT NULL").groupBy("__again").count().filter("count > 1").drop("count"), "minhash-again")
    n = again.count()
    if n == 0:
        return kept.toDF(*docs.columns)
    single = kept.join(small(again, n, 16), key == F.col("__again"), "left_anti")
    several = kept.join(small(again, n, 16), key == F.col("__again"), "left_semi")
    order = Window.partitionBy(key).orderBy(F.desc(F.length(text)), text)
    return single.union(several.withColumn("__row", F.row_number().over(order)).filter("__row = 1").drop("__row")).toDF(*docs.columns)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
