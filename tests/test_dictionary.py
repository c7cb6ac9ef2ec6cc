"""Dictionary build, lattice, splits, user dictionaries, streams, SQL function and command line."""

from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from morphlake import __main__ as cli
from morphlake.functions.categories import DefinitionError
from morphlake.operators import lattice as L
from morphlake.operators.lexicon import INHIBITED
from morphlake.plans import dictionary as etl
from morphlake.plans import sql
from morphlake.sources import definitions as D
from morphlake.streaming.tokenize import stream, to_parquet

NOUN = "名詞,固有名詞,地名,一般,*,*"
CSV = f"""東京都,0,0,0,東京都,{NOUN},ヒガシキョウト,東京都,*,B,"東京,{NOUN},ヒガシ/2",*,1/2
東京,-1,-1,0,東京,{NOUN},ヒガシ,東京,*,A,*,*,*
都,0,0,100,都,名詞,普通名詞,一般,*,*,*,ト,,1,A,*,*,*
"""
MATRIX = "1 1\n# comment\n0 0 200\n\n"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("dic")
    (d / "lex.csv").write_text(CSV, encoding="utf-8")
    (d / "matrix.def").write_text(MATRIX, encoding="utf-8")
    etl.build(spark, str(d / "lex.csv"), str(d / "matrix.def"), str(d / "out"), description="test")
    return d


def test_build(spark, built):
    lex = {r.word_id: r for r in spark.read.parquet(f"{built}/out/lexicon").collect()}
    assert sorted(lex) == [0, 1, 2]
    assert lex[0].surface == "東京都" and lex[0].reading_form == "ヒガシキョウト" and lex[0].dictionary_form_word_id == -1
    assert lex[0].a_unit_split == [1, 2] and lex[0].b_unit_split == [] and lex[0].word_structure == [1, 2]
    assert etl.parts_of_speech(spark, f"{built}/out") == [tuple(NOUN.split(",")), ("名詞", "普通名詞", "一般", "*", "*", "*")]
    assert lex[1].headword is None and lex[0].head_word_length == 9
    assert lex[2].normalized_form == "都" and lex[2].dictionary_form == "東京"
    assert [r.pos_id for r in spark.read.parquet(f"{built}/out/pos").orderBy("pos_id").collect()] == [0, 1]
    assert [tuple(r) for r in spark.read.parquet(f"{built}/out/connection").collect()] == [(0, 0, 200)]
    assert spark.read.parquet(f"{built}/out/meta").first().description == "test"


def row(**changes):
    base = dict(zip(D.CSV_COLUMNS, ["a", "1", "1", "1", "a", *"******", "a", "a", "*", "A", "*", "*", "*"])) | {"row_id": 0}
    return base | changes


@pytest.mark.parametrize(
    "changes,error",
    [({"headword": ""}, "headword is empty"), ({"headword": "x" * 32768}, "headword is too long"), ({"a_split": "/".join("1" * 128)}, "a_split has too many parts"), ({"cost": "x"}, "cost is not a number"), ({}, None)],
)
def test_row_validation(spark, changes, error):
    schema = ", ".join(f"{c} string" for c in D.CSV_COLUMNS) + ", row_id long"
    df = spark.createDataFrame([row(**changes)], schema)
    assert etl.validated(df).first().error == error


def test_unresolved_split_fails(spark):
    schema = ", ".join(f"{c} string" for c in D.CSV_COLUMNS) + ", row_id long"
    with pytest.raises(Exception, match="invalid word id"):
        etl.built(spark.createDataFrame([row(a_split="b,x,*,*,*,*,*,b")], schema))[0].collect()


def test_numbers_of_split_references_are_checked(spark):
    schema = ", ".join(f"{c} string" for c in D.CSV_COLUMNS) + ", row_id long"
    rows = spark.createDataFrame([row(a_split="0/1")], schema)
    with pytest.raises(Exception, match="invalid word id"):
        etl.built(rows)[0].collect()
    with pytest.raises(Exception, match="invalid word id"):
        etl.built(spark.createDataFrame([row(a_split="U0/U1")], schema), 1)[0].collect()
    assert etl.built(spark.createDataFrame([row(a_split="U0/7")], schema), 1)[0].first().a_unit_split == [1 << 28, 7]


USER = f"""東京京都,0,0,-32768,東京京都,{NOUN},ヒガシキョウト,東京都,*,B,"東京,{NOUN},ヒガシ/京,{NOUN},キョウ/2",U1/U0,U1/2
京,0,0,5,京,{NOUN},キョウ,京,*,A,*,*,*
"""


@pytest.fixture(scope="module")
def user(spark, built):
    (built / "user.csv").write_text(USER, encoding="utf-8")
    etl.build(spark, str(built / "user.csv"), None, str(built / "user"), user=True, system=str(built / "out"))
    return built


def test_user_words_split_into_system_and_own_words(spark, user):
    own = lambda d, w: d << 28 | w
    for users, number in ((("user",), 1), (("user", "user"), 2)):
        d = etl.load(spark, f"{user}/out", tuple(f"{user}/{u}" for u in users), rewriters=[])
        word = d.by_id[own(number, 0)]
        assert word.a_unit_split == (1, own(number, 1), 2) and word.b_unit_split == (own(number, 1), own(number, 0))
    assert [w.surface for w in d.units(word, "A")] == ["東京", "京", "都"]
    df = spark.createDataFrame([(1, "東京京都")], "id long, text string")
    assert [(r.surface, r.dictionary_id) for r in L.tokenized(df, d, "id", mode="A").orderBy("idx").collect()] == [("東京", 0), ("京", 1), ("都", 0)]
    assert d.parts == [tuple(NOUN.split(",")), ("名詞", "普通名詞", "一般", "*", "*", "*")]


def test_costs_are_set_at_load(spark, user):
    d = etl.load(spark, f"{user}/out", (f"{user}/user",), rewriters=[])
    # three unknown words, then 都: 100 - 6000, less 20 for each of four
    assert d.by_id[1 << 28].cost == -5980 and d.by_id[(1 << 28) + 1].cost == 5


def test_kinds_and_headers_are_checked(spark, user):
    for target, users in ((f"{user}/user", ()), (f"{user}/out", (f"{user}/out",))):
        with pytest.raises(ValueError, match="invalid dictionary"):
            etl.load(spark, target, users)
    with pytest.raises(ValueError, match="256"):
        etl.header(spark, False, "x" * 257)
    with pytest.raises(ValueError, match="at most 16"):
        etl.load(spark, f"{user}/out", (f"{user}/user",) * 16)


def test_large_tables_are_refused():
    with pytest.raises(ValueError, match="bytes"):
        L.Connection([40_000], [40_000], [1])
    c = L.Connection([0, 2, 1], [0, 1, 2], [0, -100, 200])
    assert [c.get(x) for x in ((2, 1), (1, 2), (0, 0), (9, 9), (2, 2))] == [-100, 200, 0, 0, 0]


def test_settings_name_files_and_classes(spark, built, tmp_path, capsys, monkeypatch):
    import io
    import json

    (tmp_path / "rules").write_text("x\ty\n")
    (tmp_path / "s.json").write_text(json.dumps({"systemDict": f"{built}/out", "rewriteDefinitionFile": "rules", "inputTextPlugin": [{"class": "p.DefaultInputTextPlugin"}]}))
    d = etl.configured(spark, str(tmp_path / "s.json"))
    assert d.rewriters[0].apply("xXⅢ") == "yxiii" and len(d.words) == 3
    monkeypatch.setattr("sys.stdin", io.StringIO("東京都\n\nab\n"))
    assert cli.main(["-r", str(tmp_path / "s.json"), "-m", "A"]) == 0
    assert [x.split("\t")[0] for x in capsys.readouterr().out.splitlines()] == ["東京", "都", "EOS", "EOS", "ab", "EOS"]
    for bad in ({"inputTextPlugin": [{"class": "p.Other"}]}, {"oovProviderPlugin": [{}]}, {"oovProviderPlugin": [{"class": "Other"}]}):
        with pytest.raises(DefinitionError):
            D.parts_of(D.DEFAULTS | {"folder": ""} | bad)


def test_command_line_builds_user_dictionaries(spark, built, capsys):
    (built / "u2.csv").write_text(USER, encoding="utf-8")
    assert cli.main(["ubuild", "-o", f"{built}/u2", "-s", f"{built}/out", f"{built}/u2.csv"]) == 0
    (built / "in2.txt").write_text("東京京都\n", encoding="utf-8")
    assert cli.main(["-d", f"{built}/out", "-u", f"{built}/u2", "-a", "-m", "A", f"{built}/in2.txt"]) == 0
    assert [(x.split("\t")[0], x.split("\t")[-1]) for x in capsys.readouterr().out.splitlines()] == [("東京", "0"), ("京", "1"), ("都", "0"), ("EOS", "EOS")]


def test_documents_path_by_brute_force(spark):
    """Long texts of several scripts: no position may be lost, and costs equal those of all segmentations of each piece."""
    d = L.Dictionary([word(i, w, 1 + i % 3, 1 + i % 2, 100 * i) for i, w in enumerate(["ab", "a", "b", "漢", "漢字", " ", "字か"])], {(1, 2): 50, (2, 1): 900, (0, 3): 7})
    text = "ab 漢字かa b漢" * 3
    path, want = L.solve(text, d), brute(text, d)
    assert path[-1].total + d.connection.get((path[-1].right_id, 0), 0) == want[0]
    long = text * 2000
    rows = L.morphemes(long, d)
    assert "".join(r[3] for r in rows) == long and [r[1] for r in rows[1:]] == [r[2] for r in rows[:-1]]


def test_tokenize_split_and_print(spark, built):
    d = etl.load(spark, f"{built}/out", rewriters=[])
    df = spark.createDataFrame([(1, "東京都に"), (2, ""), (3, None)], "id long, text string")
    c = L.tokenized(df, d, "id").orderBy("id", "idx").collect()
    assert [(r.surface, r.begin, r.end, r.is_oov, r.dictionary_id) for r in c] == [("東京都", 0, 3, False, 0), ("に", 3, 4, True, None)]
    a = L.tokenized(df, d, "id", mode="A").orderBy("idx").collect()
    assert [r.surface for r in a] == ["東京", "都", "に"] and [r.end for r in a] == [2, 3, 4]
    assert [r.surface for r in L.tokenized(df, d, "id", mode="B").orderBy("idx").collect()] == ["東京都", "に"]
    line = L.printed(L.tokenized(df, d, "id"), "id", True).orderBy("idx").collect()[1].line
    assert line.split("\t") == ["に", "名詞,普通名詞,一般,*,*,*", "に", "に", "", "-1", "(OOV)"]


def word(i, headword, left, right, cost, **more):
    return L.Word(more.pop("dict_id", 0), i, headword, left, right, cost, headword, ("p",), headword, headword, headword, **more)


def brute(text, d):
    """Best path by trying all segmentations."""
    n, best = len(text), None
    view = L.View(text, d.categories)
    edges = {}
    for i in range(n):
        if view.can_bow[i]:
            own = [(e, w.left_id, w.right_id, w.cost, w.packed) for e, w in d.lookup(text, i) if e == n or view.can_bow[e]]
            edges[i] = own or [(i + x[0], x[1], x[2], x[3], None) for x in d.providers[0].candidates(i, False, view)]

    def walk(at, right, total, path):
        nonlocal best
        if at == n:
            c = d.connection.get((right, 0), 0)
            if c != INHIBITED and (best is None or total + c < best[0]):
                best = (total + c, path)
            return
        for e, l, r, cost, wid in edges.get(at, ()):
            c = d.connection.get((right, l), 0)
            if c != INHIBITED:
                walk(e, r, total + c + cost, [*path, (at, e, wid)])

    walk(0, 0, 0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="漢字かな1a", min_size=1, max_size=8), st.integers(0, 10_000))
def test_path_cost_equals_brute_force(text, seed):
    import random

    r = random.Random(seed)
    pieces = ["漢", "字", "漢字", "か", "かな", "な", "1", "字か", "かな1", "a"]
    words = [word(i, p, r.randint(1, 3), r.randint(1, 3), r.randint(-500, 3000)) for i, p in enumerate(pieces) if r.random() < 0.7]
    conn = {(a, b): INHIBITED if r.random() < 0.15 else r.randint(-300, 900) for a, b in product(range(4), range(4))}
    d = L.Dictionary(words, conn, rewriters=[])
    path, want = L.solve(text, d), brute(text, d)
    if want is None:
        assert path == []
    else:
        last = path[-1]
        assert last.total + conn.get((last.right_id, 0), 0) == want[0]
        assert "".join(text[x.begin : x.end] for x in path) == text


def test_first_of_equal_predecessors_wins():
    d = L.Dictionary([word(0, "漢", 1, 1, 10), word(1, "漢", 1, 1, 10), word(2, "漢字", 1, 1, 20), word(3, "字", 1, 1, 10)], rewriters=[])
    assert [x.word.word_id for x in L.solve("漢字", d)] == [2]
    assert L.solve("漢", d)[0].word.word_id == 0


def test_user_dictionaries_come_first_and_no_words_fails():
    d = L.Dictionary([word(0, "漢", 1, 1, 10), word(0, "漢", 1, 1, 10, dict_id=1)], rewriters=[], providers=[])
    assert L.solve("漢", d)[0].word.dict_id == 1
    with pytest.raises(L.NoMorpheme, match="at 1"):
        L.solve("漢字", d)


def test_expanded_character_keeps_coordinates():
    rows = L.morphemes("㈱あ", L.Dictionary())
    assert "".join(r[3] for r in rows) == "㈱あ" and rows[-1][1:3] == (1, 2)
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_stream_equals_batch(spark, built, tmp_path):
    d = etl.load(spark, f"{built}/out", rewriters=[])
    df = spark.createDataFrame([(i, "東京都に都") for i in range(20)], "id long, text string")
    df.write.parquet(f"{tmp_path}/in")
    s = stream(spark, f"{tmp_path}/in", "id long, text string", d, "id")
    assert s.isStreaming
    to_parquet(s, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, L.tokenized(df, d, "id").collect()))


def test_sql_function(spark, built):
    sql.register(spark, etl.load(spark, f"{built}/out", rewriters=[]))
    got = spark.sql("SELECT t.surface FROM VALUES ('東京都に') AS x(text), LATERAL tokenize(x.text, 'A') t ORDER BY idx").collect()
    assert [r.surface for r in got] == ["東京", "都", "に"]


def test_command_line(spark, built, capsys):
    (built / "in.txt").write_text("東京都\nab に\n", encoding="utf-8")
    assert cli.main(["tokenize", "-d", f"{built}/out", f"{built}/in.txt"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("東京都\t") and out.count("EOS") == 2


def test_definition_files(spark, tmp_path):
    (tmp_path / "c.def").write_text("0x0030..0x0039 NUMERIC\nNUMERIC 1 1 0\n# x\n")
    (tmp_path / "m.def").write_text("2 3\n0 0 5\n1 2 -7 # no\n1 1 -7\n1\n")
    (tmp_path / "s.json").write_text('{"leftId": 1}')
    assert D.ranges_file(str(tmp_path / "c.def")) == [(0x30, 0x3A, 16)]
    assert D.parse_properties(D.read_text(str(tmp_path / "c.def"))) == {"NUMERIC": (1, 1, 0)}
    assert sorted(tuple(r) for r in D.connection_text(spark, str(tmp_path / "m.def")).collect()) == [(0, 0, 5), (1, 1, -7)]
    assert D.settings(str(tmp_path / "s.json"))["leftId"] == 1 and D.settings()["oovProviderPlugin"][0]["cost"] == 6000
    assert D.parse_templates("ALPHA,1,2,3,a,b,c,d,e,f\n") == {"ALPHA": [(1, 2, 3, ("a", "b", "c", "d", "e", "f"))]}
