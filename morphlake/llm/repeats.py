"""Maximal repeats of the corpus by a common-prefix interval tree.

A maximal repeat is a run of at least ``MIN_WORDS`` words that occurs at two or more places and can be extended
neither left nor right without losing one. They are the nodes of the interval tree over an enhanced suffix array
(suffixes in order, lengths of common prefixes of neighbours) whose suffixes have different words in front.

The suffix array is never built whole. All suffixes that share their first MIN_WORDS words form one interval, so
it falls apart by a hash of these words, and only intervals that can hold a result are sorted:

1. Anchors: hashes of half windows, thinned by winnowing (any MIN_WORDS equal words share one), are counted.
   Positions without a repeated anchor near them begin no repeat.
2. For the remaining positions the hash of the next MIN_WORDS words is grouped. Groups of one suffix, and groups
   whose suffixes all have the same word in front (no left extension differs), are dropped.
3. What is left is brought together with its text up to the end of the run of candidate positions. Starts that share
   an anchor, the least hash of a half window in their first MIN_WORDS words, share one copy of that text; equal first
   words have equal anchors, so the anchor's group holds all that belongs together. In it the suffixes are put in an
   order that keeps equal beginnings together and scanned with a stack of open intervals. A closed interval of at
   least MIN_WORDS common words with differing words in front is a repeat.

The result is that tree itself. An occurrence has one row, at the longest repeat that begins there; ``parent_id``
names the repeat that encloses it, with fewer words and more occurrences. The occurrences of a repeat are its own
rows and those of all repeats below it, so nothing is written once per pair of copies; ``occurrences`` writes them
out. A repeat whose occurrences all begin longer ones has a row at one of them. ``n_occurrences`` counts them all.

Equal texts are worked on once, under their lowest id: they are occurrences of the repeat that is the whole text, which
has a row for each of them, and count as often as they are in every repeat inside.

The beginning of a text counts as a word in front that equals no other; so does its end. Occurrences may overlap, as
they do in a periodic passage. Words are what white space separates; places are given in code points, end exclusive.

Defined results: null and empty texts, and texts shorter than MIN_WORDS words, have no repeats. Rows with a null id
are ignored. Rows alike in id and text count once; different texts under one id are all searched. An empty table
gives an empty result. Extra columns are ignored. Ids are whole numbers (cast to long; others become null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.llm.common import arrow, cut, pick, small, table
from morphlake.llm.textkit import BASE, U, Words, mix, powers, slices, utf8, winnow

MIN_WORDS = 50
TREE = "repeat_id long, parent_id long, n_words int, n_occurrences long, doc_id long, begin int, end int, k long, whole boolean"
RESULT = ["repeat_id", "parent_id", "n_words", "n_occurrences", "doc_id", "begin", "end"]
#: Groups are scanned together in lots of about so many bytes of text.
LOT = 4 << 20


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def anchors_of(w: Words, i: int, h: np.ndarray, gram: int, width: int) -> np.ndarray:
    """Word positions (from the slice's start) of the winnowed grams of row i."""
    f, t = w.first[i], w.first[i + 1]
    return f + winnow(h[f : t - gram + 1], width) if t - f >= gram else np.empty(0, np.int64)


def _anchors(min_words: int):
    gram = min_words // 2
    width = min_words - gram + 1

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h, _ = w.windows(gram)
                at = [anchors_of(w, i, h, gram, width) for i in range(b - a)]
                row = np.repeat(np.arange(a, b), [len(x) for x in at])
                at = np.concatenate(at)
                pos = (at - w.first[row - a]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), _i64(h[at]), pa.array(pos)], ["k", "h", "pos"])

    return run


def _starts(min_words: int):
    """(k, text, anchors) to candidate starts: hash of the window, hash of the word in front, position, run end."""
    gram = min_words // 2

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            anchors = batch.column(2)
            keys = batch.column(0).to_numpy()
            for a, b in slices(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h, valid = w.windows(min_words)
                out = [[], [], [], [], []]
                for i in range(a, b):
                    f, t = int(w.first[i - a]), int(w.first[i - a + 1])
                    n = t - f - min_words + 1
                    if n <= 0:
                        continue
                    cover = np.zeros(n + 1, np.int32)
                    q = anchors[i].values.to_numpy().astype(np.int64)
                    np.add.at(cover, np.clip(q - (min_words - gram), 0, n), 1)
                    np.add.at(cover, np.clip(q + 1, 0, n), -1)
                    at = np.flatnonzero(np.cumsum(cover[:n]) > 0)
                    if not len(at):
                        continue
                    stop = np.flatnonzero(np.diff(at, append=n + 2) > 1)
                    end = at[stop[np.searchsorted(stop, np.arange(len(at)))]] + min_words
                    front = np.where(at > 0, w.h[f + np.maximum(at, 1) - 1], mix(np.full(len(at), keys[i]).astype(np.int64).view(U)))
                    for x, y in zip(out, (np.full(len(at), keys[i]), h[f + at], front, at, end)):
                        x.append(y)
                if out[0]:
                    k, win, front, at, end = map(np.concatenate, out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k), _i64(win), _i64(front), pa.array(at.astype(np.int32)), pa.array(end.astype(np.int32))], ["k", "win", "front", "pos", "stop"]
                    )

    return run


SLICE_ROW = "anchor long, k long, one long, n long, begin int, body binary, whole boolean, at array<int>, front array<long>, first boolean"


def _slices(min_words: int):
    """(k, one, n, text, starts) to one row per anchor: its hash, the text's key, lowest id and number of ids, what precedes
    in code points, the text from the first start at this anchor up to the run's end, whether the text ends there, the
    starts in it with the words in front of them, and whether the first of them begins the text."""
    gram = min_words // 2
    width = min_words - gram + 1
    names = [x.split()[0] for x in SLICE_ROW.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_()]

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for r in range(batch.num_rows):
                k, one, n = (batch.column(c)[r].as_py() for c in ("k", "one", "n"))
                starts = batch.column("starts")[r].values
                pos, stop, front = (starts.field(c).to_numpy() for c in ("pos", "stop", "front"))
                order = np.argsort(pos)
                pos, stop, front = pos[order].astype(np.int64), stop[order], front[order]
                data, offsets = utf8(batch.column("text").slice(r, 1))
                w = Words(data, offsets)
                raw = data.tobytes()
                heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                h, _ = w.windows(gram)
                seen = np.lib.stride_tricks.sliding_window_view(h, width)[pos]
                anchor = h[pos + width - 1 - np.argmin(seen[:, ::-1], axis=1)].view(np.int64)
                edges = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1  # a periodic passage has one anchor all along
                for i, j in zip([0, *edges], [*edges, len(pos)]):
                    p, end = int(pos[i]), min(int(stop[i:j].max()), len(w.h))
                    body = raw[w.start[p] : w.end[end - 1]]
                    rows.append((int(anchor[i]), k, one, n, int(heads[w.start[p]]), body, end == len(w.h), pos[i:j] - p, front[i:j], p == 0))
                    size += len(body)
                    if size > LOT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


class _Lot:
    """Slices of whole anchor groups as one sequence of word hashes; each slice ends with a word that equals no other."""

    def __init__(self, bodies: list[bytes]):
        data = np.frombuffer(b"".join(bodies), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
        w = Words(data, offsets)
        n = np.diff(w.first)
        self.w, self.offsets = w, offsets
        self.base = w.first[:-1] + np.arange(len(bodies))  # where a slice begins in the sequence
        self.stop = self.base + n  # where its last word, which equals no other, stands
        self.seq = np.empty(len(w.h) + len(bodies), U)
        self.seq[np.arange(len(w.h)) + np.repeat(np.arange(len(bodies)), n)] = w.h
        self.seq[self.stop] = mix(np.arange(len(bodies), dtype=U) + U(BASE))
        self.up, self.down = powers(len(self.seq) + 1)
        self.total = np.zeros(len(self.seq) + 1, U)
        np.cumsum(self.seq * self.up[: len(self.seq)], out=self.total[1:])
        self.heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

    def common(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j have in common, at most ``most``: a binary search over hashes."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (self.total[i + mid] - self.total[i]) * self.up[j] == (self.total[j + mid] - self.total[j]) * self.up[i]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def ordered(self, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the suffixes at ``at`` in which equal beginnings stand together, and the words that each has in
        common with the next. In each round every group is compared with one of its members: by how much they share
        with it and by the word that follows, it falls into smaller ones."""
        n = len(at)
        order = np.arange(n)
        group = np.zeros(n, np.int64)
        live = np.arange(n)  # places in the order whose group has several members
        rng = np.random.default_rng(n)
        while len(live):
            own = order[live]
            first = np.flatnonzero(np.diff(group[live], prepend=-1))
            size = np.diff(first, append=len(live))
            chosen = own[first + (rng.random(len(first)) * size).astype(np.int64)]
            against = np.repeat(chosen, size)
            shared = self.common(at[own], at[against], np.minimum(room[own], room[against]))
            shared[own == against] = np.iinfo(np.int64).max
            follows = self.seq[np.minimum(at[own] + np.minimum(shared, room[own]), len(self.seq) - 1)]
            by = np.lexsort((follows, -shared, group[live]))
            g, s, f = group[live][by], shared[by], follows[by]
            order[live] = own[by]
            new = np.ones(len(by), bool)
            new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (f[1:] != f[:-1])
            # group numbers rise along the order: a place's number is where its group begins
            begins = live[np.flatnonzero(new)]
            number = np.repeat(begins, np.diff(np.flatnonzero(new), append=len(by)))
            group[live] = number
            sizes = np.diff(np.flatnonzero(new), append=len(by))
            live = live[np.repeat(sizes > 1, sizes)]
        a, b = order[:-1], order[1:]
        return order, np.append(self.common(at[a], at[b], np.minimum(room[a], room[b])), 0)


def intervals(shared: list[int], fronts: list[int], least: int, alone: list[int]) -> list[tuple[int, int, int]]:
    """Stack scan of ordered suffixes: (words, from, to) of each left-diverse interval.

    ``alone``: words of the suffixes that stand for several whole texts, a repeat by themselves; else 0.
    """
    out = []
    stack: list[list] = []  # words in common, first suffix, word in front if it is always the same, whether it differs
    before = 0
    for j, (n, front, whole) in enumerate(zip(shared, fronts, alone), 1):
        first, diverse = j - 1, whole > 0
        if whole >= least and whole > n and whole > before:
            out.append((whole, j - 1, j))
        before = n
        while stack and stack[-1][0] > n:
            words, lo, f, d = stack.pop()
            d = d or diverse or f != front
            if d:
                out.append((words, lo, j))
            first, diverse, front = lo, d, f
        if stack and stack[-1][0] == n:
            stack[-1][3] = stack[-1][3] or diverse or stack[-1][2] != front
        elif n >= least:
            stack.append([n, first, front, diverse])
    return out


def _scanned(rows: list[tuple], least: int) -> list[np.ndarray] | None:
    """Columns of TREE for whole anchor groups."""
    _, k, one, n, begin, bodies, whole, starts, fronts, first = zip(*rows)
    lot = _Lot(list(bodies))
    per = [len(x) for x in starts]
    row = np.repeat(np.arange(len(rows)), per)
    word = np.concatenate([x.values.to_numpy() for x in starts]).astype(np.int64)
    front = np.concatenate([x.values.to_numpy() for x in fronts])
    k, one, n, begin = (np.array(x, np.int64) for x in (k, one, n, begin))
    at = lot.base[row] + word
    room = lot.stop[row] - at
    alone = (word == 0) & np.array(first)[row] & (n[row] > 1)
    order, shared = lot.ordered(at, room)
    found = intervals(shared.tolist(), front[order].tolist(), least, np.where(alone, room, 0)[order].tolist())
    if not found:
        return None
    found.sort()  # from few words to many: an interval comes after those that enclose it
    words, lo, hi = (np.array(x, np.int64) for x in zip(*found))
    deepest, parent = np.full(len(order), -1, np.int64), np.empty(len(found), np.int64)
    for i, (_, a, b) in enumerate(found):
        parent[i] = deepest[a]
        deepest[a:b] = i
    weight = np.concatenate([[0], np.cumsum(n[row[order]])])
    p = at[order[lo]]
    content = mix((lot.total[p + words] - lot.total[p]) * lot.down[p] + mix(words.astype(U))).view(np.int64)
    has = np.zeros(len(found), bool)
    has[deepest[deepest >= 0]] = True
    held = np.concatenate([np.flatnonzero(deepest >= 0), lo[~has]])
    node = np.concatenate([deepest[deepest >= 0], np.flatnonzero(~has)])
    s = order[held]
    r, i = row[s], lot.w.first[row[s]] + word[s]
    head = lambda byte: begin[r] + lot.heads[byte] - lot.heads[lot.offsets[r]]
    above = np.ma.masked_array(content[parent[node]], parent[node] < 0)
    return [
        content[node], above, words[node].astype(np.int32), (weight[hi] - weight[lo])[node], one[r], head(lot.w.start[i]).astype(np.int32),
        head(lot.w.end[i + words[node] - 1]).astype(np.int32), k[r], alone[s] & (words[node] == room[s]),
    ]


def _tree(least: int):
    """Groups arrive in order of their anchor; one that a batch cuts off waits for the next batch."""
    names = [x.split()[0] for x in TREE.split(", ")]

    def lots(batches) -> Iterator[list[tuple]]:
        kept: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [c.to_pylist() if i not in (7, 8) else c for i, c in enumerate(batch.columns)]
            for row in zip(*columns):
                if size > LOT and row[0] != kept[-1][0]:
                    yield kept
                    kept, size = [], 0
                kept.append(row)
                size += len(row[5])
        if kept:
            yield kept

    def run(batches):
        for rows in lots(batches):
            got = _scanned(rows, least)
            if got:
                arrays = [pa.array(c.data, mask=c.mask) if isinstance(c, np.ma.MaskedArray) else pa.array(c) for c in got]
                whole = pa.RecordBatch.from_arrays(arrays, names)
                for i in range(0, whole.num_rows, 50_000):
                    yield whole.slice(i, 50_000)

    return run


def text_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a hash ``k`` of the text that no two different texts of the table share, and the owners (k, doc_id)."""
    for seed in count(42):
        keyed = docs.withColumn("k", F.xxhash64(F.lit(seed), "text"))
        owners = cut(keyed.select("k", "doc_id", F.length("text").alias("n"), F.xxhash64(F.lit(seed + 1), "text").alias("h")).distinct(), "owners")
        if owners.groupBy("k").agg(F.min(F.struct("n", "h")).alias("a"), F.max(F.struct("n", "h")).alias("b")).filter("a <> b").isEmpty():
            return keyed, owners.select("k", "doc_id")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The tree, one row per occurrence: repeat_id (hash of its words), parent_id, n_words, n_occurrences, doc_id, begin, end."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.expr("try_cast(doc_id AS long)")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    # equal texts are worked on once, under their lowest id
    docs, owners = text_keys(docs)
    several = cut(owners.groupBy("k").agg(F.min("doc_id").alias("one"), F.count("*").alias("n")).filter("n > 1").withColumnRenamed("k", "k2"), "several")
    n = several.count()
    several = small(several, n, 32)
    unique = docs.join(several, F.col("k") == F.col("k2"), "left").filter("one IS NULL OR one = doc_id")
    unique = unique.select("k", "text", F.coalesce("one", "doc_id").alias("one"), F.coalesce("n", F.lit(1)).alias("n"))
    anchors = unique.select("k", "text").transform(arrow, _anchors(min_words), "k long, h long, pos int")
    anchors = anchors.join(several.select("k2"), F.col("k") == F.col("k2"), "left")
    weighted = anchors.select("k", "h", "pos", F.when(F.col("k2").isNull(), 1).otherwise(2).alias("m"))
    shared = weighted.withColumn("n", F.sum("m").over(Window.partitionBy("h"))).filter("n > 1")
    shared = cut(shared.groupBy("k").agg(F.collect_set("pos").alias("anchors")), "anchors")
    n = shared.count()
    texts = unique.join(small(shared.select(F.col("k").alias("s")), n, 24), F.col("k") == F.col("s"), "left_semi").dropDuplicates(["k"])
    texts = cut(texts, "shared-texts")
    starts = texts.join(shared, "k").select("k", "text", "anchors").transform(arrow, _starts(min_words), "k long, win long, front long, pos int, stop int")
    by = Window.partitionBy("win")
    counted = starts.select("front", "k", "pos", "stop", F.min("front").over(by).alias("f0"), F.max("front").over(by).alias("f1"))
    diverse = counted.filter("f0 <> f1 OR pos = 0").select("k", "front", "pos", "stop")
    diverse = diverse.groupBy("k").agg(F.collect_list(F.struct("front", "pos", "stop")).alias("starts"))
    suffixes = texts.join(diverse, "k").select("k", "one", "n", "text", "starts").transform(arrow, _slices(min_words), SLICE_ROW)
    grouped = suffixes.repartition("anchor").sortWithinPartitions("anchor")
    tree = cut(grouped.transform(arrow, _tree(min_words), TREE), "repeat-tree")
    # the other owners of a text that is a repeat by itself
    others = tree.filter("whole").withColumnRenamed("doc_id", "first_id").join(owners.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2")).filter("doc_id <> first_id")
    return tree.select(*RESULT).union(others.select(*RESULT))


def occurrences(tree: DataFrame) -> DataFrame:
    """(repeat_id, doc_id, begin): every occurrence of every repeat, from the rows of the tree. Equal texts give theirs
    under each of their ids in the repeat that is the whole text, and under the lowest in those inside."""
    nodes = cut(tree.select("repeat_id", "parent_id").distinct(), "repeat-nodes")
    up = nodes.select(F.col("repeat_id").alias("r"), F.col("parent_id").alias("up"))
    now = cut(tree.select("repeat_id", "doc_id", "begin").distinct(), "repeat-rows")
    out = now
    while not now.isEmpty():
        now = cut(now.join(up, F.col("repeat_id") == F.col("r")).filter("up IS NOT NULL").select(F.col("up").alias("repeat_id"), "doc_id", "begin").distinct(), "repeat-rows")
        out = out.union(now)
    return out.distinct()


def op6_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats(table(spark, sf_dir, "documents"))
