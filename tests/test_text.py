"""Published values of the text layer, and errors of malformed definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morphlake.functions import categories as K
from morphlake.functions import normalize as N
from morphlake.operators import chars as C
from morphlake.operators import lexicon as X
from morphlake.operators.lattice import View
from morphlake.operators.oov import GroupedOov
from morphlake.sources import definitions as D

TEXT = "âｂC1あ234漢字𡈽アｺﾞ"


def byte_starts(text):
    out = [0]
    for c in text:
        out.append(out[-1] + len(c.encode()))
    return out


def test_categories_runs_and_word_starts():
    v = View(TEXT, K.Categories())
    at = {b: i for i, b in enumerate(byte_starts(TEXT))}
    names = {0: "ALPHA", 2: "ALPHA", 5: "ALPHA", 6: "NUMERIC", 10: "NUMERIC", 7: "HIRAGANA", 13: "KANJI", 23: "KATAKANA", 26: "KATAKANA"}
    for byte, name in names.items():
        assert v.mask[at[byte]] & K.MASK[name], (byte, name)
    assert v.mask[at[19]] == K.MASK["DEFAULT"]
    starts = {b: v.can_bow[at[b]] for b in (0, 2, 5, 6, 7, 19, 23)}
    assert starts == {0: True, 2: False, 5: False, 6: True, 7: True, 19: True, 23: True}
    assert [v.run_length[at[b]] for b in (0, 2, 5, 6, 7, 10, 19, 23)] == [3, 2, 1, 1, 1, 3, 1, 3]
    assert v.candidate_length[at[0]] == 3 and v.candidate_length[at[6]] == 1


def test_default_rewrite_golden():
    text, offsets = N.rewrite("ÂＢΓД㈱ｶﾞウ゛⼼Ⅲ", [N.DefaultRewriter()])
    assert text == "âbγд(株)ガヴ⼼ⅲ"
    assert len(text.encode()) == 24
    of_byte = [o for c, o in zip(text, offsets) for _ in c.encode()]
    assert [of_byte[b] for b in (3, 7, 11, 15, 17)] == [2, 4, 4, 7, 7]


@pytest.mark.parametrize("raw,want", [("ゴーール", "ゴール"), ("スーパーー", "スーパー"), ("エーービーーーシーーーー", "エービーシー"), ("エーービ〜〜〜シ〰〰〰〰", "エービーシー")])
def test_mark_collapse(spark, raw, want):
    assert N.rewrite(raw, [N.MarkCollapser()])[0] == want
    assert spark.range(1).select(N.collapsed(F.lit(raw)).alias("x")).first().x == want


def test_replacement_offsets():
    text, offsets = TEXT, list(range(len(TEXT) + 1))
    for new, size, index in (("ああ", 32, None), ("あ", 29, None), ("あああ", 35, None)):
        got, off = N.replaced(text, offsets, 8, 10, new)
        assert len(got.encode()) == size and off[8 : 8 + len(new)] == [8] * len(new) and len(off) == len(got) + 1
    for bad in ((99, 100), (3, 3), (5, 4)):
        with pytest.raises(ValueError):
            N.replaced(text, offsets, *bad, "x")


def test_chain_composes_offsets():
    text, offsets = N.rewrite("㈱ーーA", N.default_chain())
    assert text == "(株)ーa" and offsets == [0, 0, 0, 1, 3, 4]


@pytest.mark.parametrize(
    "parse,text,message",
    [
        (K.parse_ranges, "0x0030..", "invalid format at line 0"),
        (K.parse_ranges, "0x0030..0x0029 NUMERIC", "invalid range at line 0"),
        (K.parse_ranges, "0x0030..0x0039 FOO", "FOO is invalid type at line 0"),
        (K.parse_ranges, "0x0030..0x0039", "invalid format at line 0"),
        (N.parse_rewrite, "\n12", "12 is not character at line 1"),
        (N.parse_rewrite, "#c\na b c", "invalid format at line 1"),
        (N.parse_rewrite, "x\n12 31\n12 31", "12 is already defined at line 2"),
        (D.parse_properties, "KANJI 0 0", "invalid format at line 1"),
        (D.parse_properties, "KANJI 0 0 2\nKANJI 0 0 2", "KANJI is already defined at line 2"),
        (D.parse_templates, "KANJI,1,1", "invalid format at line 1"),
        (D.parse_templates, "FOO,1,1,1,a,b,c,d,e,f", "FOO is invalid type at line 1"),
    ],
)
def test_definition_errors(parse, text, message):
    with pytest.raises(K.DefinitionError, match=message):
        parse(text)


def test_overlapping_ranges(spark):
    raw = K.parse_ranges("0x0030..0x0039 NUMERIC\n0x0032 KANJI # two\n")
    assert K.compile_ranges(raw) == [(0x30, 0x32, 16), (0x32, 0x33, 20), (0x33, 0x3A, 16)]
    assert sorted(map(tuple, K.compiled(K.ranges_table(spark, raw)).collect())) == K.compile_ranges(raw)
    cats = K.Categories(raw)
    assert cats.mask("2") == 20 and cats.mask("3") == 16 and cats.mask("a") == 1


def slow_runs(masks):
    """Remaining characters of the greedy run at each position, character by character."""
    out, i = [0] * len(masks), 0
    while i < len(masks):
        both, j = masks[i], i + 1
        while j < len(masks) and both & masks[j]:
            both &= masks[j]
            j += 1
        out[i:j] = range(j - i, 0, -1)
        i = j
    return out


def slow_longest(masks):
    out = []
    for i in range(len(masks)):
        both, j = masks[i], i + 1
        while j < len(masks) and both & masks[j]:
            both &= masks[j]
            j += 1
        out.append(j - i)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=40))
def test_runs_by_brute_force(masks):
    m = np.array(masks, np.int32)
    assert C.runs_of(m).tolist() == slow_runs(masks)
    assert C.longest_runs(m).tolist() == slow_longest(masks)


def test_plan_agrees_with_worker_code(spark):
    texts = [TEXT, "", "Ｈello ΑΒΓ где 12,3", None, "ーァア々", "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.pos): tuple(r)[2:] for r in C.profiled(df, "id").collect()}
    want = {}
    for i, t in enumerate(texts):
        v = View(t or "", K.Categories())
        at = byte_starts(t or "")
        longest = slow_longest(v.mask) if i < 5 else list(range(len(t), 0, -1))
        want |= {(i, p): (t[p], v.mask[p], v.can_bow[p], v.candidate_length[p], v.run_length[p], longest[p], at[p]) for p in range(len(t or ""))}
    assert got == want
    assert v.run_length == list(range(300_000, 0, -1))


def test_shared_categories_of_spans(spark):
    masks = [4, 4 | 64, 64, 64 | 16, 16, 1]
    df = spark.createDataFrame([(masks,)], "m array<int>")

    def slow(a, b):
        out = masks[a]
        for x in masks[a:b]:
            out &= x
        return 1 if b - a > slow_runs(masks)[a] else out

    spans = [(a, b) for a in range(6) for b in range(a + 1, 7)]
    row = df.select(*[C.shared_categories("m", F.lit(a), F.lit(b)).alias(f"{a}_{b}") for a, b in spans]).first()
    assert list(row) == [slow(a, b) for a, b in spans]


def test_default_tables():
    """Values of the default categories and rules, typed in."""
    cats = K.Categories()
    want = {"　": 8, "！": 8, "：": 8, "［": 8, "｛": 8, "￥": 8, "⁰": 16, "Ⅳ": 16, "々": 32780, "〇": 268, "㈱": 8, "㍻": 8, "︰": 8, "﹫": 8, "゛": 192, "⑀": 1, "⦀": 1, "─": 1, "━": 8, "\U0001f600": 1}
    assert {c: cats.mask(c) for c in want} == want
    assert cats.masks("a\U0010ffff").tolist() == [32, 1] and cats.masks("").tolist() == []
    rules, keep = N.default_rules(), N.default_ignored()
    assert len(rules) == 182 and len(keep) == 835
    assert {k: rules.get(k) for k in ("か\u3099", "か゛", "かﾞ", "ｶﾞ", "ｶ゛", "は\u309a", "ワ\u3099", "ゝ゛", "ウ\u3099")} == {"か\u3099": "が", "か゛": "が", "かﾞ": "が", "ｶﾞ": "ガ", "ｶ゛": None, "は\u309a": "ぱ", "ワ\u3099": None, "ゝ゛": None, "ウ\u3099": "ヴ"}
    assert "ↀ" not in keep and "ⅿ" in keep


ANY = st.text(alphabet=st.one_of(st.sampled_from("aB-ーか\u3099ゝﾞ゛ⅢİßſΣς ¼²\u00a0…“"), st.characters(max_codepoint=0x30FF, exclude_categories=["Cs"])), max_size=25)


@settings(max_examples=500, deadline=None)
@given(ANY)
def test_short_ways_of_rewriting_agree(text):
    """The text alone, and the way for plain Latin, against pieces put together."""
    for r in (N.DefaultRewriter(), N.MarkCollapser()):
        pieces = list(r.pieces(text))
        assert r.apply(text) == "".join(x[2] for x in pieces)
        plain = r.steady(text)
        assert plain is None or [(i, i + 1) for i in range(len(text))] == [x[:2] for x in pieces] and plain == r.apply(text) and len(plain) == len(text)


def test_modified_in_the_jvm_agrees(spark):
    texts = ["Plain ASCII -- text", "ÄÖÜ Straße ªº²³¹µ ¼", "\u00a0nbsp", None, "", "か\u3099ーー", "“quotes” – dash‑", "ΑΣ Σ", "İstanbul", "ŁÓDŹ ſ", "㈱ -－-", "\U0001f600 smile"]
    texts += ["x" + chr(c) + "Y" for c in [*range(1, 0x250), *range(0x2010, 0x2070), *range(0x20A0, 0x20C1)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.modified for r in N.modified(df).collect()}
    assert got == {i: None if t is None else N.rewrite(t, N.default_chain())[0] for i, t in enumerate(texts)}


def test_substring_bounds(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    assert df.select(C.substring_of(F.col("t"), F.lit(1), F.lit(3)).alias("x")).first().x == "bc"
    for a, b in ((2, 4), (-1, 2), (2, 1)):
        with pytest.raises(Exception, match="bounds"):
            df.select(C.substring_of(F.col("t"), F.lit(a), F.lit(b))).collect()


def test_prefix_lookup_by_brute_force(spark):
    long = "ab" * 30
    words = ["a", "ab", "b", "ba", long, long + "c", "漢字", "𡈽"]
    lex = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [(None, 99)], "headword string, word_id int")
    texts = [None, "", "ab漢字𡈽a", long + "c" + long[:50], "ba" * 400]
    got = {tuple(r) for r in X.prefix_lookup(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", lex).select("id", "begin", "end", "word_id").collect()}
    assert got == {(i, p, p + len(w), k) for i, t in enumerate(texts) for p in range(len(t or "")) for k, w in enumerate(words) if t.startswith(w, p)}


@pytest.mark.parametrize("props,without,with_words", [((0, 0, 0), 0, 0), ((1, 0, 0), 0, 0), ((0, 1, 0), 1, 0), ((1, 1, 0), 1, 1), ((0, 0, 2), 2, 0), ((0, 1, 2), 3, 0), ((1, 1, 2), 3, 3)])
def test_grouped_provider_truth_table(props, without, with_words):
    v = View("あいうAB", K.Categories([(ord("あ"), ord("う") + 1, K.MASK["KANJI"])]))
    p = GroupedOov({"KANJI": props}, {"KANJI": [(1, 2, 3, ("a",) * 6)]})
    assert (len(p.candidates(0, False, v)), len(p.candidates(0, True, v))) == (without, with_words)
    if props == (0, 1, 2):
        assert [x[0] for x in p.candidates(0, False, v)] == [3, 1, 2]


def test_unescape(spark):
    texts = ["a,c", "a\\u{002c}c", "a\\u{20b9f}c", "\\u0041\\u0042", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.unescaped(F.col("t"))).collect()] == ["a,c", "a,c", "a𠮟c", "AB", None]
