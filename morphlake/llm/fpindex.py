"""Incremental substring dedup over a log-structured fingerprint index.

Documents arrive in batches. A batch's window hashes (half windows of ``MIN_WORDS`` words, thinned by winnowing, so
that any MIN_WORDS words in common share one) are written as a sorted, bucketed, immutable run. The run is
merge-joined, bucket by bucket and without a shuffle of either side, with the sorted runs of history; a hash that
history lacks is looked for in the batch itself. The index holds each hash once, with its first occurrence, so a
window meets one place however often a passage was seen. What was new in the batch becomes the next run of history;
``FAN`` runs of a level are compacted to one of the next, so a hash is rewritten a logarithmic number of times.

The first occurrence of a half window may stand in other surroundings than a later one. Each fingerprint therefore
carries a hash of its context, all words of the windows of MIN_WORDS words that chose it. Where this differs from
the context of the first occurrence, these whole windows are looked for as well, in a second index of the same kind
that holds such windows alone, each once with its first occurrence. A whole window seen before is thus always met:
its occurrence is the first of its half window, or the second index has it.

The index is a folder: its runs, and a manifest of them that is written anew after every load (``Runs.save``). A later
session opens the last whole manifest and goes on (``index`` of ``repeated_spans``); runs that a manifest doesn't name
are leftovers of a load that didn't end. Texts are not in it: who goes on gives the earlier documents as ``history``.

Matches are verified on the texts: from each matched window the two places are extended word by word to both sides
while they agree, and spans of at least MIN_WORDS equal words are reported.

Reported are the later documents: (doc_id, begin, end) repeats (source_id, source_begin, source_end), code points,
end exclusive. Order of arrival is the id; a batch is a range of ids.

Defined results: null and empty texts and texts of fewer words have no spans. Rows with a null id are ignored. Of
repeated ids the longest text counts, of these the least. A passage repeated within one document is reported as
its own source where the places don't overlap. An empty table gives an empty result. Extra columns are ignored. Ids
are whole numbers (cast to long; others are null).
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.llm.common import arrow, cut, drop_tables, new_path, parallel, pick, small, table
from morphlake.llm.repeats import _i64
from morphlake.llm.textkit import U, Words, mix, powers, slices, utf8

MIN_WORDS = 50
BATCHES = 4
#: Bytes of texts whose words a task remembers while it verifies.
REMEMBERED = 1 << 20
FAN = 3
SPAN = "doc_id long, begin int, end int, n_words int, source_id long, source_begin int, source_end int"


def _chosen(w: Words, i: int, h: np.ndarray, gram: int, min_words: int) -> np.ndarray:
    """Word positions (in row i) of the half window that each window of ``min_words`` words of the row chooses."""
    f, t = w.first[i], w.first[i + 1]
    if t - f < min_words:
        return np.empty(0, np.int64)
    width = min_words - gram + 1
    seen = np.lib.stride_tricks.sliding_window_view(h[f : t - gram + 1], width)
    return np.arange(len(seen)) + width - 1 - np.argmin(seen[:, ::-1], axis=1)


def _fingerprints(min_words: int):
    """(doc_id, text) to the fingerprints: hash, hash of the context, document, position. Shorter texts have none."""
    gram = min_words // 2

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h, _ = w.windows(gram)
                up, down = powers(len(w.h) + 1)
                total = np.zeros(len(w.h) + 1, U)
                np.cumsum(w.h * up[:-1], out=total[1:])
                found = [np.unique(_chosen(w, i, h, gram, min_words), return_index=True, return_counts=True) for i in range(b - a)]
                row = np.repeat(np.arange(a, b), [len(x[0]) for x in found])
                pos, low, n = (np.concatenate(x).astype(np.int64) for x in zip(*found))
                at, lo = pos + w.first[row - a], low + w.first[row - a]
                context = mix((total[lo + n - 1 + min_words] - total[lo]) * down[lo] + mix(((pos - low) * min_words + n).astype(U)))
                yield pa.RecordBatch.from_arrays([_i64(h[at]), _i64(context), batch.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32))], ["h", "c", "doc_id", "pos"])

    return run


def _whole(min_words: int):
    """(doc_id, text, at) to the windows of ``min_words`` words that chose one of the fingerprints ``at``."""
    gram = min_words // 2

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h, _ = w.windows(gram)
                whole, _ = w.windows(min_words)
                found = [np.flatnonzero(np.isin(_chosen(w, i - a, h, gram, min_words), batch.column(2)[i].values.to_numpy())) for i in range(a, b)]
                row = np.repeat(np.arange(a, b), [len(x) for x in found])
                pos = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [_i64(whole[pos + w.first[row - a]]), batch.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32))], ["h", "doc_id", "pos"]
                )

    return run


class Runs:
    """The index: levels of immutable runs, each a table bucketed and sorted by hash in the index's folder."""

    def __init__(self, spark: SparkSession, buckets: int, fan: int = FAN, path: str | None = None):
        self.spark, self.buckets, self.fan = spark, buckets, fan
        self.path = path or new_path(spark, "index")
        self.levels: list[list[str]] = []
        self.wider: Runs | None = None  # whole windows of later occurrences in other surroundings
        self.saved = 0
        self.name = "fp_" + uuid.uuid4().hex[:10]

    def _table(self, run: str) -> str:
        return f"{self.name}_{run}"

    def write(self, rows: DataFrame, what: str) -> str:
        """An immutable run; its name is part of its path."""
        run = f"{what}_{uuid.uuid4().hex[:12]}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{run}").saveAsTable(self._table(run))
        return run

    def table(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    def history(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, rows: DataFrame) -> None:
        run, level = self.write(rows, "run"), 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan:
                return
            merged = self.table(self.levels[level][0])
            for other in self.levels[level][1:]:
                merged = merged.unionByName(self.table(other))
            # hashes of different runs differ: compaction is a merge, nothing to reconcile
            run = self.write(merged.repartition(self.buckets, "h"), "compacted")
            self.levels[level] = []
            level += 1

    def drop(self, run: str) -> None:
        """Remove a run that no later plan reads."""
        self.spark.sql(f"DROP TABLE {self._table(run)}")
        drop_tables(self.spark, f"{self.path}/{run}")

    def forget(self) -> None:
        """Drop the session's names; the files stay."""
        if self.wider:
            self.wider.forget()
        for t in self.spark.catalog.listTables():
            if t.name.startswith(self.name):
                self.spark.sql(f"DROP TABLE {t.name}")

    def _described(self) -> dict:
        return {"path": self.path, "levels": self.levels, "schemas": {r: self.table(r).schema.simpleString()[7:-1] for r in self.history()}, "wider": self.wider and self.wider._described()}

    def save(self) -> None:
        """Write the manifest under the next number: a load either is in it or didn't happen."""
        self.saved += 1
        whole = json.dumps(self._described() | {"buckets": self.buckets, "fan": self.fan})
        self.spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.saved:09d}")

    def _take(self, found: dict) -> Runs:
        self.levels = found["levels"]
        for run, schema in found["schemas"].items():
            columns = ", ".join(c.replace(":", " ", 1) for c in schema.split(","))
            self.spark.sql(f"CREATE TABLE {self._table(run)} ({columns}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        if found["wider"]:
            self.wider = Runs(self.spark, self.buckets, self.fan, found["wider"]["path"])._take(found["wider"])
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int, fan: int = FAN) -> Runs:
        """The index in a folder as its last manifest has it; a new one if it has none."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        whole = sorted(x.getPath().getName() for x in fs.listStatus(at) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))) if fs.exists(at) else []
        if not whole:
            return cls(spark, buckets, fan, path)
        found = json.loads(spark.read.text(f"{path}/manifest/{whole[-1]}").first()[0])
        runs = cls(spark, found["buckets"], found["fan"], path)
        runs.saved = int(whole[-1])
        return runs._take(found)


def _aligned(min_words: int):
    """(doc_id, text, source_id, source_text, places) to verified maximal spans."""

    def words_of(known: dict, key: int, text: str):
        """A text's words, bytes and code points; of some texts they are remembered, as sources come again and again."""
        got = known.pop(key, None)
        if got is None:
            data, offsets = utf8(pa.array([text]))
            got = Words(data, offsets), data.tobytes(), np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            while known and len(got[1]) + sum(len(x[1]) for x in known.values()) > REMEMBERED:
                known.pop(next(iter(known)))
        known[key] = got
        return got

    def run(batches):
        known: dict[int, tuple] = {}
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, text, src, src_text, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "source_id", "source_text", "places"))):
                w, raw, cp = words_of(known, doc, text)
                v, raw2, cp2 = (w, raw, cp) if src == doc else words_of(known, src, src_text)
                done: dict[int, int] = {}  # per diagonal: first word not yet covered
                for p, q in sorted((x["pos"], x["source_pos"]) for x in places):
                    d = p - q
                    if p < done.get(d, 0) or p >= len(w.h) or q >= len(v.h):
                        continue
                    n = min(len(w.h) - p, len(v.h) - q)
                    right = w.h[p : p + n] != v.h[q : q + n]
                    hi = int(right.argmax()) if right.any() else n
                    n = min(p, q)
                    left = (w.h[p - n : p] != v.h[q - n : q])[::-1]
                    lo = int(left.argmax()) if left.any() else n
                    done[d] = p + hi
                    a, b, a2, b2 = p - lo, p + hi, q - lo, q + hi
                    if src == doc and b2 > a:  # a periodic passage: no further than its own source reaches
                        b, b2 = b - (b2 - a), a
                    if b - a < min_words or raw[w.start[a] : w.end[b - 1]].split() != raw2[v.start[a2] : v.end[b2 - 1]].split():
                        continue
                    for col, x in zip(out, (doc, cp[w.start[a]], cp[w.end[b - 1]], b - a, src, cp2[v.start[a2]], cp2[v.end[b2 - 1]])):
                        col.append(int(x))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [x.split()[0] for x in SPAN.split(", ")])

    return run


def _matched(runs: Runs, prints: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """``prints`` (h, doc_id, pos, extra) with their first occurrence in the batch (self) and in history (old); the batch's table."""
    batch = runs.write(prints.repartition(runs.buckets, "h"), "batch")
    place = F.struct("doc_id", "pos", *extra)
    found = runs.table(batch).withColumn("self", F.first(place).over(Window.partitionBy("h").orderBy("doc_id", "pos")))
    sources = []
    for i, run in enumerate(runs.history()):
        old = runs.table(run).select(F.col("h").alias(f"h{i}"), place.alias(f"s{i}"))
        found = found.join(old.hint("merge"), F.col("h") == F.col(f"h{i}"), "left")
        sources.append(F.col(f"s{i}"))
    known = F.coalesce(*sources) if sources else F.lit(None).cast(found.schema["self"].dataType)
    found = found.select("h", "doc_id", "pos", *extra, "self", known.alias("old"))
    return found.withColumn("source", F.coalesce("old", "self")), batch


REPEATED = "(source.doc_id <> doc_id OR source.pos <> pos)"
HIT = ("doc_id", "pos", "source.doc_id AS source_id", "source.pos AS source_pos")


def ingest(runs: Runs, batch: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Match one batch (doc_id, text) with history and itself, then make it history.

    Returns matched windows: doc_id, pos, source_id, source_pos."""
    prints = batch.transform(arrow, _fingerprints(min_words), "h long, c long, doc_id long, pos int")
    found, name = _matched(runs, prints, ("c",))
    hits = cut(found.filter(REPEATED).selectExpr(*HIT, "source.c <> c AS other"), "fp-hits")
    runs.add(found.filter(f"old IS NULL AND NOT {REPEATED}").select("h", "c", "doc_id", "pos"))
    runs.drop(name)
    # other surroundings than at the first occurrence: the whole windows may have been seen elsewhere
    other = cut(hits.filter("other").groupBy("doc_id").agg(F.collect_list("pos").alias("at")).withColumnRenamed("doc_id", "d"), "fp-other")
    hits = hits.drop("other")
    n, places = other.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    if not n:
        return hits
    if runs.wider is None:
        runs.wider = Runs(runs.spark, runs.buckets, runs.fan, f"{runs.path}/wider")
    texts = batch.join(small(other, 24 * n + 4 * places, 1), F.col("doc_id") == F.col("d")).select("doc_id", "text", "at")
    found, name = _matched(runs.wider, texts.transform(arrow, _whole(min_words), "h long, doc_id long, pos int"))
    more = cut(found.filter(REPEATED).selectExpr(*HIT), "fp-hits")
    runs.wider.add(found.filter(f"old IS NULL AND NOT {REPEATED}").select("h", "doc_id", "pos"))
    runs.wider.drop(name)
    return hits.union(more)


def _single(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text): of repeated ids the longest text, of these the least."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.expr("try_cast(doc_id AS long)")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    again = cut(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again")), "fp-again")
    n = again.count()
    if not n:
        return docs
    same = F.col("doc_id") == F.col("again")
    one = docs.join(small(again, n, 16), same, "left_semi").groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), F.negative(F.xxhash64("text")).alias("x"), "text")).alias("m"))
    return docs.join(small(again, n, 16), same, "left_anti").union(one.select("doc_id", "m.text"))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, batches: int = BATCHES, fan: int = FAN, index: str | None = None, history: DataFrame | None = None
) -> DataFrame:
    """Spans of later documents that repeat an earlier one, over all batches.

    ``index``: a folder to keep the index in and to go on from; ``history``: the documents that are in it already, which
    come before all of ``docs`` (their ids are others).
    """
    spark = docs.sparkSession
    docs = _single(docs, id_col, text_col)
    ends = docs.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.001) if batches > 1 else []
    runs = Runs.open(spark, index, parallel(docs), fan) if index else Runs(spark, parallel(docs), fan)
    hits = None
    lows = [None, *sorted(set(ends))]
    for lo, hi in zip(lows, [*lows[1:], None]):
        part = docs
        if lo is not None:
            part = part.filter(F.col("doc_id") > lo)
        if hi is not None:
            part = part.filter(F.col("doc_id") <= hi)
        got = ingest(runs, part, min_words)
        hits = got if hits is None else hits.union(got)
    if index:
        runs.save()
    runs.forget()
    if history is not None:
        docs = docs.union(_single(history, id_col, text_col))
    # one row per pair of documents; a window is kept only where its diagonal begins or goes on after a gap
    by = Window.partitionBy("doc_id", "source_id", F.col("pos") - F.col("source_pos")).orderBy("pos")
    gap = F.col("pos") - F.coalesce(F.lag("pos").over(by), F.lit(-(1 << 30)))
    pairs = hits.withColumn("gap", gap).filter(f"gap > {min_words // 2}").groupBy("doc_id", "source_id").agg(F.collect_list(F.struct("pos", "source_pos")).alias("places"))
    pairs = cut(pairs, "fp-pairs")
    n = pairs.count()
    ids = pairs.select(F.col("doc_id").alias("i")).union(pairs.select("source_id")).distinct()
    texts = docs.join(small(ids, 2 * n, 16), F.col("doc_id") == F.col("i"), "left_semi")
    a = texts.select(F.col("doc_id").alias("a"), "text")
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("source_text"))
    both = pairs.join(a, F.col("doc_id") == F.col("a")).join(b, F.col("source_id") == F.col("b"))
    return both.select("doc_id", "text", "source_id", "source_text", "places").transform(arrow, _aligned(min_words), SPAN).distinct()


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
