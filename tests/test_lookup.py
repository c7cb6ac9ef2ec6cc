"""What looks for words and runs along whole documents."""

import random

import numpy as np
import pytest

from morphlake.functions.categories import MASK, Categories
from morphlake.operators import chars as C
from morphlake.operators import lexicon as X


@pytest.mark.parametrize("filtered", [True, False])
def test_prefixes_with_and_without_hashes(spark, monkeypatch, filtered):
    r = random.Random(4)
    if not filtered:
        monkeypatch.setattr(X, "FILTER_ROWS", 0)
    alphabet = "abé漢\U0002000b "
    texts = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(1, 120)))) for i in range(60)]
    long = texts[0][1][:2] + "x" * 40
    texts += [(60, None), (61, ""), (62, "a" + long + long), (63, long[:-1])]
    heads = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, 4))) for _ in range(60)} | {long, long + "y", t[:35] if len(t := texts[1][1]) > 35 else "zz"})
    lex = spark.createDataFrame([(i, h) for i, h in enumerate([*heads, None, heads[0]])], "word_id int, headword string")
    docs = spark.createDataFrame(texts, "id long, text string")
    got = sorted((x.id, x.begin, x.end, x.word_id) for x in X.prefix_lookup(docs, "id", "text", lex).collect())
    want = sorted((i, b, b + len(h), w) for i, t in texts for w, h in enumerate([*heads, heads[0]], 0) for b in range(len(t or "")) if t.startswith(h, b))
    want = [(i, b, e, w if w < len(heads) else w + 1) for i, b, e, w in want]
    assert got == sorted(want)


def test_few_probes_are_joined(spark):
    """Of a text in which words are rare, what is joined is what has a word's hash, not a row for every start and length."""
    r = random.Random(5)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)) + " abcdefghij"
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    lex = spark.createDataFrame([("abcdefghij",), ("bacdefghijk",), ("hgfedcbaabc",)], "headword string")
    assert X.probed(docs, "id", "text", lex).count() == 1
    assert X.probed(docs, "id", "text", lex.limit(0)).count() == 0


def test_sums_are_those_of_all_characters(spark):
    r = random.Random(6)
    ranges = [(97, 113, MASK["KANJI"]), (104, 123, MASK["ALPHA"]), (101, 102, MASK["NUMERIC"])]
    texts = [(i, None if i == 3 else "".join(r.choice("abchkpqz e漢") for _ in range(r.randint(0, 40)))) for i in range(80)]
    texts.append((0, "repeated id"))
    cats = Categories(ranges)
    want = []
    for i, t in texts:
        if t:
            m = cats.masks(t)
            bow = C.word_starts(m)
            runs, at = 0, 0
            while at < len(m):
                both, runs = m[at], runs + 1
                while at < len(m) and both & m[at]:
                    both, at = both & m[at], at + 1
            want.append((i, int(bow.sum()), int(C.candidate_lengths(bow).sum()), runs))
    docs = spark.createDataFrame(texts, "id long, text string")
    assert sorted(map(tuple, C.summed(docs, "id", ranges=ranges).collect())) == sorted(want)
    assert C.runs_of(np.empty(0, np.int32)).tolist() == []
