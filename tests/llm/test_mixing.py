from collections import Counter

import numpy as np

from morphlake.llm import mixing
from tests.llm.fixtures import DOCS, awkward, clashing, empty


def table(spark, sizes):
    rows = [(1000 * i + j, f"text {j}", "en", s, 6) for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    return spark.createDataFrame(rows, DOCS)


def test_quotas_are_the_largest_mix():
    assert mixing.quotas({"a": 100, "b": 50}, {"a": 1, "b": 1}) == {"a": 50, "b": 50}
    assert mixing.quotas({"a": 100, "b": 50}, {"a": 3, "b": 1}) == {"a": 100, "b": 33}
    assert mixing.quotas({"a": 5, None: 7}, {"a": 1}) == {"a": 5}
    assert mixing.quotas({}, None) == {}


def test_tree_adds_up_and_is_hypergeometric():
    quota = [700, 200, 100]
    t = mixing.splitting_tree(quota, 7)
    assert t.sum(axis=0).tolist() == quota and t.sum(axis=1).max() - t.sum(axis=1).min() <= 1
    left = np.array([mixing.splitting_tree([60, 40], 2, seed=s)[0, 0] for s in range(2000)])
    variance = 50 * 0.6 * 0.4 * (100 - 50) / 99
    assert abs(left.mean() - 30) < 4 * (variance / 2000) ** 0.5 and abs(left.var() / variance - 1) < 0.2


def test_exact_counts_disjoint_blocks_and_places(spark):
    docs = table(spark, {"a": 400, "b": 100, "c": 37})
    w = {"a": 2, "b": 1, "c": 0}
    got = mixing.mixed(docs, w, shard_rows=50).collect()
    assert Counter(r.source for r in got) == {"a": 200, "b": 100}
    assert len({r.doc_id for r in got}) == 300
    shards = Counter(r.shard for r in got)
    assert len(shards) == 6 and set(shards.values()) == {50}
    for s in shards:
        assert sorted(r.place for r in got if r.shard == s) == list(range(50))
    want = mixing.splitting_tree([200, 100], 6)
    have = Counter((r.shard, r.source) for r in got)
    assert [[have[i, "a"], have[i, "b"]] for i in range(6)] == want.tolist()
    again = mixing.mixed(docs.repartition(7), w, shard_rows=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_draws_beyond_the_generators_range():
    """Same distribution as the generator's where that works, exact bounds and moments where it doesn't."""
    few = mixing._hypergeometric
    rng, scale = np.random.default_rng(1), 10**9
    small = np.array([few(rng, 3, scale, scale // 2) for _ in range(3000)])  # 3 good ones, half drawn: binomial
    assert abs(small.mean() - 1.5) < 0.08 and np.allclose(np.bincount(small, minlength=4) / 3000, [1 / 8, 3 / 8, 3 / 8, 1 / 8], atol=0.035)
    good, bad, n = 7 * 10**9, 5 * 10**9, 10**7
    x = np.array([few(rng, good, bad, n) for _ in range(300)])
    p, variance = 7 / 12, n * 7 / 12 * 5 / 12 * (12 * 10**9 - n) / (12 * 10**9 - 1)
    assert abs(x.mean() - n * p) < 5 * (variance / 300) ** 0.5 and 0.7 < x.var() / variance < 1.35
    assert few(rng, 10**10, 5, 10**10 + 2) >= 10**10 - 3 and few(rng, 10**10, 0, 17) == 17 and few(rng, 0, 10**10, 17) == 0
    nodes = list(mixing.split([4 * 10**9, 10**9 + 1, 3], 0, 5, 5 * 10**9 + 4, 5))
    assert np.sum([x for _, _, x in nodes], axis=0).tolist() == [4 * 10**9, 10**9 + 1, 3]
    assert [sum(x) for _, _, x in nodes] == [10**9 + 1] * 4 + [10**9]


def test_tasks_split_on_where_the_driver_stops(spark):
    docs = table(spark, {"a": 400, "b": 100, None: 37})
    whole = sorted(map(str, mixing.mixed(docs, shard_rows=20).collect()))
    for cells in (3, 14, 40):
        assert sorted(map(str, mixing.mixed(docs, shard_rows=20, cells=cells).collect())) == whole


def test_columns_of_the_input_stay(spark):
    docs = table(spark, {"a": 30, "b": 10}).selectExpr("*", "concat('mine', doc_id) AS shard", "doc_id AS place", "'x' AS c0", "1 AS node")
    assert sorted(map(str, mixing.draw(docs, shard_rows=10).collect())) == sorted(map(str, docs.collect()))
    got = mixing.mixed(docs, shard_rows=10)
    assert got.columns == [c for c in docs.columns if c not in ("shard", "place")] + ["shard", "place"]
    assert {r.c0 for r in got.collect()} == {"x"} and {r.shard for r in got.collect()} == {0, 1, 2, 3}


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "shard", "rank", "s", "cell", "__at")
    got = mixing.mixed(docs, {"web": 1, "books": 1, None: 1}).collect()
    assert Counter(r.source for r in got) == {"web": 2, "books": 2, None: 2}
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.draw(empty(spark)).columns == empty(spark).columns
    assert mixing.mixed(docs, {"nowhere": 1}).count() == 0


def test_repeated_rows_are_documents(spark):
    docs = spark.createDataFrame([(1, "same", "en", "web", 4)] * 300, DOCS)
    got = mixing.mixed(docs, {"web": 1}, shard_rows=100).collect()
    assert Counter(r.shard for r in got) == {0: 100, 1: 100, 2: 100}


def test_a_tiny_source_costs_no_other_document(spark):
    docs = table(spark, {"a": 400, "b": 100, None: 1})
    assert Counter(r.source for r in mixing.mixed(docs, shard_rows=50).collect()) == {"a": 400, "b": 100, None: 1}
    assert {tuple(r) for r in mixing.drawn_of(docs).collect()} == {("a", 400, 400), ("b", 100, 100), (None, 1, 1)}
    assert {tuple(r) for r in mixing.drawn_of(docs, {"a": 1, "b": 1}).collect()} == {("a", 400, 100), ("b", 100, 100), (None, 1, 0)}


def test_repetition_meets_weights_and_leaves_nothing_out(spark):
    sizes = {"a": 400, "b": 90, "c": 7, None: 1}
    docs = table(spark, sizes)
    quota = mixing.quotas(sizes, mixing.tempered, True)
    assert quota["a"] == 400 and all(abs(quota[s] - 400 * (n / 400) ** 0.7) < 1 and quota[s] >= n for s, n in sizes.items())
    assert mixing.quotas({"a": 100, "b": 50, "c": 5}, {"a": 1, "b": 1}, True) == {"a": 100, "b": 100}
    got = mixing.mixed(docs, mixing.tempered, shard_rows=60, repeat=True).collect()
    assert Counter(r.source for r in got) == quota
    for s, n in sizes.items():  # each document as often as the others of its source, or once more
        times = Counter(r.doc_id for r in got if r.source == s)
        assert len(times) == n and set(times.values()) <= {quota[s] // n, -(-quota[s] // n)}
    shards = Counter(r.shard for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1 and all(sorted(r.place for r in got if r.shard == i) == list(range(n)) for i, n in shards.items())
    whole = sorted(map(str, got))
    assert sorted(map(str, mixing.mixed(docs.repartition(5), mixing.tempered, shard_rows=60, repeat=True).collect())) == whole
    assert sorted(map(str, mixing.mixed(docs, mixing.tempered, shard_rows=60, repeat=True, cells=8).collect())) == whole
    assert {r.source: r.drawn for r in mixing.drawn_of(docs, mixing.tempered, repeat=True).collect()} == quota
    assert mixing.mixed(docs.limit(0), mixing.tempered, repeat=True).count() == 0
