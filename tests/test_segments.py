"""Batches of texts, segment by segment, against one text at a time."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest

from morphlake.functions.categories import DEFAULT_RANGES, MASK
from morphlake.functions.normalize import DefaultRewriter, MarkCollapser, normalized, rewrite
from morphlake.operators import lattice as L
from morphlake.operators.lexicon import INHIBITED
from morphlake.operators.oov import SimpleOov
from morphlake.operators.segments import Segmenter, rewritten, slices
from morphlake.plans import sql


def rows(d, texts, mode):
    s = Segmenter(d, mode, L._NAMES, L._TYPES)
    out = [[] for _ in texts]
    for first, part in slices(pa.array(texts, pa.string()), 40):
        at, columns = s.rows(part)
        columns = [c.to_pylist() for c in columns]
        for k, i in enumerate(at.tolist()):
            out[first + i].append(tuple(c[k] for c in columns))
    return out


def dictionary(r: random.Random, alphabet: str, n: int, **settings):
    words = []
    for i in range(n):
        head = "".join(r.choice(alphabet) for _ in range(r.randint(1, 7)))
        pos = ("p", str(r.randint(0, 2)), "*", "*", "*", "*")
        words.append(L.Word(r.choice([0, 0, 1, 2]), i, head, r.randint(0, 4), r.randint(0, 4), r.randint(-500, 500), head, pos, head.upper(), head, head[::-1]))
    for k, w in enumerate(list(words)):
        if len(w.headword) > 2:
            words[k] = L.replace(w, a_unit_split=(words[0].packed, words[-1].packed), b_unit_split=(words[0].packed,))
    edges = {(a, b): INHIBITED if r.random() < 0.15 else r.randint(-300, 300) for a in range(6) for b in range(6)}
    return L.Dictionary(words, edges if n % 2 else L.Connection(*zip(*[(a, b, c) for (a, b), c in edges.items()])), **settings)


@pytest.mark.parametrize("seed", range(30))
def test_as_one_text_at_a_time(seed):
    r = random.Random(seed)
    alphabet = ["ab ", "abあア漢 ", "aÉß①-ー㈱か゛ \U0002000b", "xyα1٠"][seed % 4]
    rewriters = [[], [DefaultRewriter(), MarkCollapser()], [DefaultRewriter(set(), {"a": "", "b ": "xy"})]][seed % 3]
    ranges = [*DEFAULT_RANGES, (ord("y"), ord("y") + 1, MASK["NOOOVBOW"])]
    d = dictionary(r, alphabet, r.choice([0, 1, 8, 40]), rewriters=rewriters, ranges=ranges, providers=[SimpleOov(1, 2, 300)])
    texts = [None, "", *("".join(r.choice(alphabet) for _ in range(r.randint(1, 30))) for _ in range(80))]
    for mode in "ABC" if d.words else "C":
        assert rows(d, texts, mode) == [L.morphemes(t, d, mode) for t in texts]


def test_long_texts_are_fast():
    """A million characters of words that are mostly unknown: arrays, not a step for each candidate."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(20_000)]
    d = L.Dictionary([L.Word(0, i, w, 1, 1, 100, w, ("p",) * 6, w, w, w) for i, w in enumerate([" ", *words[:50]])])
    texts = [" ".join(r.choice(words) for _ in range(1000)) for _ in range(160)]
    began = time.process_time()
    got = sum(len(Segmenter(d, "C", ["begin"], [pa.int32()]).rows(part)[0]) for _, part in slices(pa.array(texts)))
    took = time.process_time() - began
    print(f"{sum(map(len, texts)) / took:.0f} characters a second")
    assert got == 160 * 1999 and sum(map(len, texts)) / took > 1_000_000


def test_columns_and_repeated_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["b a", None, "a", "b a", "", "a"])], "id long, text string")
    d = L.Dictionary([L.Word(0, 0, "a", 1, 1, 5, "a", ("p",) * 6, "A", "a", "")])
    got = L.tokenized(df, d, "id", columns=["surface", "is_oov"])
    assert got.columns == ["id", "surface", "is_oov"]
    whole = [(0, "b", True), (0, " ", True), (0, "a", False), (2, "a", False), (3, "b", True), (3, " ", True), (3, "a", False), (5, "a", False)]
    assert sorted(map(tuple, got.collect())) == sorted(whole)
    lines = [r.value for r in L.printed_texts(df.coalesce(1), d).collect()]
    assert lines.count("EOS") == 6 and len(lines) == 14
    assert L.lattice_dump(df, d, "id").count() == 8


def test_offsets_of_texts_together():
    """Null, empty, plain, moved and vanishing texts in one slice."""
    for chain in ([], [DefaultRewriter(), MarkCollapser()], [DefaultRewriter(set(), {"a": ""})]):
        texts = ["", None, "Ab--c　½", "plain É", "a", None, "か゛x", "--", "aa", ""]
        for part in (texts, texts[1:2], texts[:1], texts[2:4], []):
            got = rewritten(pa.array(["dropped", *part], pa.string()).slice(1), chain).to_pylist()
            want = [(None, None, None) if t is None else (t, *rewrite(t, chain)) for t in part]
            assert [tuple(x.values()) for x in got] == want


def test_offsets_in_bounded_memory(spark):
    """Offsets of long texts as numbers in arrays: no object for each character."""
    tracemalloc.start()
    texts = pa.array(["Some plain text of a document. " * 500] * 100)
    for _, part in slices(texts):
        assert len(rewritten(part, [DefaultRewriter(), MarkCollapser()])) == len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 512 * 1024
    df = spark.createDataFrame([(1, "Ab--c", None), (2, None, 3)], "id long, text string, norm int")
    got = normalized(df).orderBy("id").collect()
    assert [(r.id, r.text, tuple(r.norm)) for r in got] == [(1, "Ab--c", ("Ab--c", "abーc", [0, 1, 2, 4, 5])), (2, None, (None, None, None))]


def test_table_function_over_repeated_texts(spark, monkeypatch):
    """A small table's rows go over all cores, and texts that come again have their morphemes again."""
    texts = [(i, ["b a", "a", None, "a" * 150, ""][i % 5]) for i in range(400)]
    df = sql.spread(spark.createDataFrame(texts, "id long, text string").coalesce(1))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    d = L.Dictionary([L.Word(0, 0, "a", 1, 1, 5, "a", ("p",) * 6, "A", "a", "")])
    sql.register(spark, d, "repeated_morphemes")
    df.createOrReplaceTempView("repeated_texts")
    got = spark.sql("SELECT id, t.* FROM repeated_texts r, LATERAL repeated_morphemes(r.text, 'C') t")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, L.tokenized(df, d, "id").collect()), key=repr)
