"""Capture index of web pages: locally sorted runs and their k-way loser-tree merge.

Every input partition is a capture run. Its records get a URL key (SURT form: host reversed, scheme, fragment,
default port and leading ``www`` dropped, query arguments sorted), a 14-digit timestamp, a digest and a length, and
are sorted by (key, timestamp, id) on their own. Range bounds over these triples, taken from an even sample of them,
cut all runs alike; a merge task gets its range of every run, about ``RANGE_ROWS`` index rows, and merges the k sorted
slices with a loser tree, which costs one comparison per level and record. Ranges are in order, and so are the records
in each: with the ranges' sizes every record has its global rank, and every capture its place in its URL's history. A
history may go over several ranges; what a range begins with goes on from where the one before it ended.

A payload never moves: only index rows are shuffled.

Pages without a time of capture get one from their id (2024 plus ``id * 7919`` seconds, within the year).

Defined results: a null or empty URL has the key ``-`` and is indexed under it; a null payload has length 0 and the
digest of the empty payload; null ids and times sort first. Repeated rows are captures of their own; full ties are
alike in all columns. An empty table gives an empty index. Extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.common import arrow, cut, pick, small, table

#: Index rows per merge task, and sampled keys per bound.
RANGE_ROWS = 50_000
PER_BOUND = 32
URL = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)([?][^#]*)?"
HISTORY = "url_key string, capture_ts string, page_id long, digest string, length long, capture_no long, changed boolean"


def url_key(url: Column) -> Column:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), "^[^@]*@", ""), "(:80|:443)$", "")
    host = F.regexp_replace(host, "^www[0-9]*[.]", "")
    path = F.lower(part(2))
    query = F.lower(F.substr(part(3), F.lit(2)))
    key = F.concat(
        F.array_join(F.reverse(F.split(host, "[.]")), ","),
        F.lit(")"),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))),
    )
    return F.when(F.coalesce(url, F.lit("")) == "", "-").when(F.regexp_extract(url, URL, 1) == "", F.lower(url)).otherwise(key)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts_col: str | None = None) -> DataFrame:
    """Index rows: url_key, capture_ts, page_id, digest, length."""
    names = {"page_id": id_col, "url": url_col, "html": html_col} | ({"ts": ts_col} if ts_col else {})
    p = pick(pages, **names)
    ts = F.col("ts") if ts_col else F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(31536000)))
    payload = F.coalesce("html", F.lit(""))
    return p.select(
        url_key(F.col("url")).alias("url_key"),
        (ts if ts_col else F.date_format(ts, "yyyyMMddHHmmss")).cast("string").alias("capture_ts"),
        F.col("page_id").cast("long").alias("page_id"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("length"),
    )


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k
        for r in range(len(runs)):
            self._play(r)

    def _less(self, a: int, b: int) -> bool:
        ra, rb = self.runs[a], self.runs[b]
        ia, ib = self.at[a], self.at[b]
        if ia >= len(ra) or ib >= len(rb):
            return ia < len(ra)
        return (ra[ia], a) < (rb[ib], b)

    def _play(self, r: int) -> None:
        node = (r + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # first arrival waits here for its opponent
                self.tree[node] = r
                return
            if self._less(other, r):
                self.tree[node], r = r, other
            node //= 2
        self.tree[0] = r

    def __iter__(self):
        if not self.runs:
            return
        while True:
            r = self.tree[0]
            if self.at[r] >= len(self.runs[r]):
                return
            yield r, self.at[r]
            self.at[r] += 1
            node = (r + self.k) // 2
            while node > 0:
                if self._less(self.tree[node], r):
                    self.tree[node], r = r, self.tree[node]
                node //= 2
            self.tree[0] = r


def _merge(batches):
    """Arrow function over one range: (run, seq, index columns) to histories in order, with ``pos`` from 0."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    runs: dict[int, list] = {}
    order = t.column("seq").to_numpy()
    for i, run in enumerate(t.column("run").to_pylist()):
        runs.setdefault(run, []).append(i)
    key, ts, page = (t.column(c).to_pylist() for c in ("url_key", "capture_ts", "page_id"))
    rows, keys = [], []
    for run in sorted(runs):
        own = runs[run]
        own.sort(key=order.__getitem__)  # slices of a run arrive in order; this costs one pass then
        rows.append(own)
        keys.append([(key[i], ts[i] is not None, ts[i] or "", page[i] is not None, page[i] or 0) for i in own])
    merged = [rows[r][i] for r, i in LoserTree(keys)]
    digest = t.column("digest").to_pylist()
    number, changed = [], []
    for j, i in enumerate(merged):
        again = j > 0 and key[merged[j - 1]] == key[i]
        number.append(number[-1] + 1 if again else 1)
        changed.append(not again or digest[merged[j - 1]] != digest[i])
    out = t.take(pa.array(merged)).select(["url_key", "capture_ts", "page_id", "digest", "length", "rng"])
    out = out.append_column("capture_no", pa.array(number, pa.int64())).append_column("changed", pa.array(changed)).append_column("pos", pa.array(range(len(merged)), pa.int64()))
    yield from out.combine_chunks().to_batches(max_chunksize=50_000)


def histories(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Global capture histories: the index rows with ``capture_no`` in the URL's history, ``changed`` (payload differs
    from the capture before it) and ``global_rank``."""
    spark = index.sparkSession
    order = ["url_key", "capture_ts", "page_id"]
    runs = index.withColumn("run", F.spark_partition_id()).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    runs = cut(runs, "warc-runs")
    n = runs.count()
    ranges = max(1, -(-n // range_rows))
    # bounds are whole keys with their times, so the history of a hot URL spreads over ranges, too
    some = F.pmod(F.xxhash64(*order), F.lit(max(1, n // (ranges * PER_BOUND)))) == 0
    found = runs.filter(some).select(*order).distinct().collect() if ranges > 1 else []
    sample = sorted(found, key=lambda r: [(x is not None, x or type(y)()) for x, y in zip(r, ("", "", 0))])
    bounds = list(dict.fromkeys(tuple(sample[len(sample) * i // ranges]) for i in range(1, ranges))) if sample else []
    ranges = len(bounds) + 1
    if bounds:
        ends = spark.createDataFrame([(0, bounds)], "one int, ends array<struct<url_key: string, capture_ts: string, page_id: long>>")
        bits = F.array(*[F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))])
        step = lambda at, bit: F.when(F.get("ends", at + bit - 1) <= F.struct(*order), at + bit).otherwise(at)
        runs = runs.withColumn("one", F.lit(0)).join(small(ends, len(bounds), 200), "one").withColumn("rng", F.aggregate(bits, F.lit(0), step)).drop("ends", "one")
    else:
        runs = runs.withColumn("rng", F.lit(0))
    schema = "url_key string, capture_ts string, page_id long, digest string, length long, rng int, capture_no long, changed boolean, pos long"
    merged = cut(runs.repartitionById(ranges, F.col("rng")).transform(arrow, _merge, schema), "warc-merged")
    # one row for each range: how many captures it has, and what its first and last ones are
    edge = F.struct("pos", "url_key", "digest", "capture_no")
    edges = {r.rng: r for r in merged.groupBy("rng").agg(F.count("*").alias("n"), F.min(edge).alias("first"), F.max(edge).alias("last")).collect()}
    starts, total, last = [], 0, None  # last: URL, digest and number of the capture before the range
    for r in range(ranges):
        e = edges.get(r)
        if e is None:
            continue
        goes_on = last is not None and last[0] == e.first.url_key
        starts.append((r, total, e.first.url_key if goes_on else None, last[2] if goes_on else 0, last[1] if goes_on else None))
        total += e.n
        last = (e.last.url_key, e.last.digest, e.last.capture_no + (last[2] if goes_on and e.last.url_key == e.first.url_key else 0))
    offs = small(spark.createDataFrame(starts, "o int, start long, same string, earlier long, before string"), len(starts), 200)
    out = merged.join(offs, F.col("rng") == F.col("o"))
    here = F.coalesce(F.col("same") == F.col("url_key"), F.lit(False))
    number = F.col("capture_no") + F.when(here, F.col("earlier")).otherwise(0)
    changed = F.when(here & (F.col("pos") == 0), ~F.col("digest").eqNullSafe(F.col("before"))).otherwise(F.col("changed"))
    return out.select("url_key", "capture_ts", "page_id", "digest", "length", number.alias("capture_no"), changed.alias("changed"), (F.col("start") + F.col("pos") + 1).alias("global_rank"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histories(captures(table(spark, sf_dir, "pages")))


HISTORY_SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(url, '{URL}', 1) AS g1, lower(regexp_extract(url, '{URL}', 2)) AS path,
         lower(substr(regexp_extract(url, '{URL}', 3), 2)) AS query FROM pages),
h AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(g1), '^[^@]*@', ''), '(:80|:443)$', ''), '^www[0-9]*[.]', '') AS host FROM p),
k AS (
  SELECT CASE WHEN coalesce(url, '') = '' THEN '-' WHEN g1 = '' THEN lower(url) ELSE
      array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END ||
      CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END AS url_key,
    strftime(TIMESTAMP '2024-01-01' + to_seconds((page_id * 7919) % 31536000), '%Y%m%d%H%M%S') AS capture_ts,
    page_id, sha256(html) AS digest, CAST(strlen(html) AS BIGINT) AS length FROM h)
SELECT url_key, capture_ts, page_id, digest, length,
  row_number() OVER (PARTITION BY url_key ORDER BY capture_ts, page_id) AS capture_no,
  coalesce(digest <> lag(digest) OVER (PARTITION BY url_key ORDER BY capture_ts, page_id), true) AS changed,
  row_number() OVER (ORDER BY url_key, capture_ts, page_id) AS global_rank
FROM k
"""
