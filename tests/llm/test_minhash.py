import re
from itertools import combinations

from morphlake.llm import minhash
from tests.llm.fixtures import DOCS, awkward, clashing, empty, prose, rows


def brute(docs: dict[int, str], threshold=minhash.THRESHOLD, ratio=minhash.MAX_RATIO, k=minhash.SHINGLE) -> dict[int, int]:
    """Document that goes to the one that stays, by all pairs."""
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs.items()}
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for i, w in words.items() if w}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        small, large = sorted((sets[a], sets[b]), key=len)
        if len(large) <= ratio * len(small) and len(small & large) >= threshold * len(small):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in sets if top(i) != i}


def edited(text: str, every: int, mark: str) -> str:
    w = text.split(" ")
    return " ".join(f"{mark}{i}" if i % every == every - 1 else x for i, x in enumerate(w))


def test_groups_match_brute_force(spark):
    base = [prose(i, 200) for i in range(6)]
    texts = [*base, base[0], edited(base[1], 25, "x"), edited(base[1], 25, "y"), edited(base[1], 30, "z"), base[2] + " " + prose(99, 20), base[3].upper(), base[4][: len(base[4]) // 4], edited(base[5], 4, "q")]
    docs = spark.createDataFrame(rows(*texts), DOCS)
    got = {r.doc_id: r.keeper_id for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(dict(enumerate(texts)))


def window(words: list[str], at: int, n: int = 100) -> str:
    return " ".join(words[at : at + n])


def test_chains_of_revisions_are_one_group(spark):
    """Settled documents of different groups are compared as well."""
    w = prose(21, 400).split()
    for starts in ((0, 75, 20, 55), (0, 38, 76, 114, 152), (114, 0, 76, 38, 152, 190)):
        texts = [window(w, s) for s in starts]
        got = {r.doc_id: r.keeper_id for r in minhash.near_duplicates(spark.createDataFrame(rows(*texts), DOCS)).collect()}
        assert got == brute(dict(enumerate(texts))), starts


def test_contained_in_a_longer_text(spark):
    """Original and the same with other text behind it, up to the ratio of sizes."""
    base = [prose(30 + i, 200) for i in range(4)]
    texts = [*base, *[f"{b} {prose(60 + i, n)}" for i, (b, n) in enumerate(zip(base, (60, 120, 180, 260)))]]
    got = {r.doc_id: r.keeper_id for r in minhash.near_duplicates(spark.createDataFrame(rows(*texts), DOCS)).collect()}
    assert got == {4: 0, 5: 1, 6: 2} == brute(dict(enumerate(texts)))


def test_hot_bucket(spark):
    """A third of all rows share a template; some of these are near-duplicates, others aren't."""
    head = prose(70, 90)
    texts = [f"{head} {prose(100 + i // 3, 100)} {prose(500 + i, 8)}" for i in range(60)] + [prose(200 + i, 150) for i in range(60)]
    docs = spark.createDataFrame(rows(*texts), DOCS)
    got = {r.doc_id: r.keeper_id for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(dict(enumerate(texts))) and len(got) == 40


def test_text_ids(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate([prose(1, 80), prose(1, 80), prose(2, 80)])] + [("x", prose(1, 80))], "doc_id string, text string")
    assert [tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "keeper_id").collect()] == [(1, 0)]
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == ["0", "2", "x"]


def test_recall_on_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    got = {r.doc_id: r.keeper_id for r in minhash.near_duplicates(docs).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.9 * len(want)


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "size", "keys", "k", "keeper_id", "__gone", "__row")
    got = {r.doc_id: r.keeper_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {6: 1}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]


def test_many_copies_leave_one(spark):
    base = prose(5, 120)
    docs = spark.createDataFrame(rows(*[base] * 50, *[edited(base, 40, f"m{i}v") for i in range(50)], prose(6, 120)), DOCS)
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == [0, 100]


def test_empty_table(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.keep_one(empty(spark)).count() == 0


def test_banding_finds_its_threshold():
    for jaccard, r, b in minhash.ensemble():
        assert r * b <= minhash.HASHES
        assert 1 - (1 - jaccard**r) ** b >= minhash.RECALL
