from collections import defaultdict

import pytest

from morphlake.llm import repeats
from tests.llm.fixtures import DOCS, awkward, clashing, empty, prose, rows


def brute(texts: dict[int, str], least: int) -> set[tuple]:
    """Maximal repeats by growing groups of equal windows word by word: (words, frozenset of (doc, first word))."""
    words = {i: (t or "").split() for i, t in texts.items()}
    places = defaultdict(list)
    for d, w in words.items():
        for p in range(len(w) - least + 1):
            places[tuple(w[p : p + least])].append((d, p))
    out = set()
    todo = [(at, least) for at in places.values() if len(at) > 1]
    while todo:
        at, n = todo.pop()
        after = defaultdict(list)
        for d, p in at:
            after[words[d][p + n] if p + n < len(words[d]) else (d, "end")].append((d, p))
        if len(after) > 1 and len({words[d][p - 1] if p else (d, "begin") for d, p in at}) > 1:
            out.add((n, frozenset(at)))
        todo += [(x, n + 1) for x in after.values() if len(x) > 1]
    return out


def found(df, texts):
    """The repeats of a tree with all their occurrences, those of equal texts under each id."""
    starts, same = {}, defaultdict(list)
    for d, t in texts.items():
        at, n = {}, 0
        for w in (t or "").split():
            n = t.index(w, n)
            at[n] = len(at)
            n += len(w)
        starts[d] = at
        same[t].append(d)
    words, total = {}, {}
    for r in df.collect():
        assert texts[r.doc_id][r.begin : r.end].split() and len(texts[r.doc_id][r.begin : r.end].split()) == r.n_words
        assert words.setdefault(r.repeat_id, r.n_words) == r.n_words and total.setdefault(r.repeat_id, r.n_occurrences) == r.n_occurrences
    groups = defaultdict(set)
    for r in repeats.occurrences(df).collect():
        groups[r.repeat_id] |= {(d, starts[r.doc_id][r.begin]) for d in same[texts[r.doc_id]]}
    assert set(groups) == set(words)
    assert {i: len(x) for i, x in groups.items()} == total
    return {(words[i], frozenset(x)) for i, x in groups.items()}


def test_matches_brute_force(spark):
    p, q = prose(1, 30), prose(2, 14)
    texts = dict(enumerate([f"{prose(3, 9)} {p} {prose(4, 8)}", f"é  {p}\n{q} tail", f"{q}\t{p} {q}", p, p, f"{p} {prose(9, 5)}", f"zz {p}", prose(8, 40), f"aa {p[: len(p) // 2]} bb"]))
    docs = spark.createDataFrame(rows(*texts.values()), DOCS)
    want = brute(texts, 10)
    assert len(want) == 4 and found(repeats.maximal_repeats(docs, min_words=10), texts) == want


def test_edited_copies_match_brute_force(spark):
    base = prose(11, 260).split()
    texts = [" ".join(f"e{c}" if (i * 7 + c * 31) % (40 + c) == 0 else x for i, x in enumerate(base)) for c in range(12)]
    texts = dict(enumerate([*texts, texts[3], texts[3], " ".join(base), " ".join(base[20:200])]))
    docs = spark.createDataFrame(rows(*texts.values()), DOCS)
    for least in (12, 50):
        want = brute(texts, least)
        assert want and found(repeats.maximal_repeats(docs, min_words=least), texts) == want


def test_only_exact_copies(spark):
    p = prose(1, 60)
    docs = spark.createDataFrame(rows(p, p, p, prose(2, 60)), DOCS)
    got = repeats.maximal_repeats(docs).collect()
    assert {(r.n_words, r.n_occurrences) for r in got} == {(60, 3)} and sorted(r.doc_id for r in got) == [0, 1, 2]


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "k", "pos", "anchors", "win", "n", "one", "whole")
    assert {(r.doc_id, r.n_words, r.n_occurrences) for r in repeats.maximal_repeats(docs).collect()} == {(1, 80, 2), (6, 80, 2)}
    text = docs.selectExpr("CAST(doc_id AS string) AS doc_id", "text")
    assert repeats.maximal_repeats(text).count() == 2


@pytest.mark.parametrize("texts", [["a b " * 30], ["a b " * 29, "x " + "a b " * 31 + "y"], ["a " * 60 + prose(5, 60), "b " + "a " * 56 + prose(5, 60)], [(prose(7, 13) + " ") * 9, prose(8, 5) + " " + (prose(7, 13) + " ") * 7]])
def test_periodic_texts_match_brute_force(spark, texts):
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame(rows(*texts.values()), DOCS)
    want = brute(texts, 50)
    assert want and found(repeats.maximal_repeats(docs), texts) == want


def test_long_periodic_text_and_empty_table(spark):
    got = repeats.maximal_repeats(spark.createDataFrame(rows("a b " * 10_000), DOCS)).collect()
    assert max(r.n_words for r in got) == 19_998 and max(r.n_occurrences for r in got) == 9_976
    assert repeats.maximal_repeats(empty(spark)).count() == 0


def test_the_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = brute(texts, repeats.MIN_WORDS)
    assert want and found(repeats.maximal_repeats(docs), texts) == want
