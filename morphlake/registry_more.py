"""Queries of sources, sinks, dictionaries, settings and the finer points of texts, with their SQL.

What SQL can't derive from the tables is typed in: definition files and texts, and what must come of them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.categories import MASK, DefinitionError, compile_ranges, hex_value, parse_ranges, ranges_table
from morphlake.functions.normalize import DefaultRewriter, normalized, parse_rewrite, replaced
from morphlake.operators import chars as C
from morphlake.operators import lattice as L
from morphlake.operators import lexicon as X
from morphlake.operators.oov import GroupedOov, SimpleOov
from morphlake.plans import demo, sql
from morphlake.plans import dictionary as etl
from morphlake.plans.catalog import ORACLES, query, values
from morphlake.sources import definitions as D
from morphlake.sources.shared import folder, write_lines
from morphlake.streaming.tokenize import stream_lines, to_text

LEX = f"WITH {demo.LEXICON_SQL}"
NAMED = f"WITH RECURSIVE {demo.nodes_sql('SELECT p_partkey AS id, p_name AS text FROM part')}"
PATH_COLUMNS = ["p_partkey", "idx", "begin", "end", "surface", "word_id", "is_oov", "cost"]
_LINES = ORACLES["morpheme_print_all"].replace("SELECT p.id AS p_partkey, CAST(p.idx AS INTEGER) AS idx, ", "SELECT ", 1)


# sources and sinks of texts


@query("SELECT p_name AS text FROM part")
def line_source(spark, sf_dir):
    """Names written as lines and read again, one text per line."""
    at = folder(spark, "lines")
    demo.names(spark, sf_dir).select("p_name").write.text(at)
    return D.lines(spark, at).select("text")


@query("SELECT CAST(p_partkey % 2 AS INTEGER) AS file, count(*) AS n, count(DISTINCT p_name) AS n_texts FROM part GROUP BY 1")
def input_files(spark, sf_dir):
    """Several input files at once."""
    paths = [folder(spark, "file") for _ in range(2)]
    for i, at in enumerate(paths):
        demo.names(spark, sf_dir).filter(F.col("p_partkey") % 2 == i).select(F.concat(F.lit(f"{i} "), "p_name")).coalesce(1).write.text(at)
    got = D.lines(spark, paths).select(F.substring("text", 1, 1).cast("int").alias("file"), "text")
    return got.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_texts"))


@query(f"SELECT line AS value, count(*) AS n FROM (({_LINES}) UNION ALL SELECT 'EOS' FROM part) GROUP BY 1")
def morpheme_sink(spark, sf_dir):
    """Output lines of all texts as text files, EOS after each text."""
    at = folder(spark, "out")
    L.printed_texts(demo.names(spark, sf_dir), demo.dictionary(spark, sf_dir), "p_name", print_all=True).write.text(at)
    return spark.read.text(at).groupBy("value").agg(F.count("*").alias("n"))


@query(ORACLES["morpheme_sink"])
def stream_text_lines(spark, sf_dir):
    """Text files as a stream of lines, through the same plan to text files."""
    source, at = folder(spark, "lines"), folder(spark, "stream")
    demo.names(spark, sf_dir).select("p_name").write.text(source)
    to_text(stream_lines(spark, source, demo.dictionary(spark, sf_dir), print_all=True), f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.text(f"{at}/out").groupBy("value").agg(F.count("*").alias("n"))


# definition files


def _tried(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


RANGES_DEF = ["# comment", "0x0030..0x0039 NUMERIC # digits", "0x0032 KANJI", "", "NUMERIC 1 1 0", "0x3041..0x3043 HIRAGANA KATAKANA"]


@query(values("low, high, mask", (48, 58, 16), (50, 51, 4), (12353, 12356, 192)))
def char_ranges_source(spark, sf_dir):
    return ranges_table(spark, parse_ranges(D.read_text(write_lines(spark, folder(spark, "def"), RANGES_DEF))))


PROPERTIES_DEF = ["# comment", "DEFAULT 0 1 0 # all others", "0x0030 NUMERIC", "KANJI 0 0 2", "", "KATAKANA 1 1 2"]


@query(values("category, invoke, grp, length", ("DEFAULT", 0, 1, 0), ("KANJI", 0, 0, 2), ("KATAKANA", 1, 1, 2)))
def char_properties_source(spark, sf_dir):
    got = D.parse_properties(D.read_text(write_lines(spark, folder(spark, "def"), PROPERTIES_DEF)))
    return _tried(spark, "category string, invoke int, grp int, length int", *[(k, *v) for k, v in got.items()])


TEMPLATES_DEF = ["KANJI,4,5,600,noun,a,b,*,*,*", "KANJI,6,7,-20,verb,*,*,*,*,*", "DEFAULT,1,1,9,x,*,*,*,*,*"]


@query(values("category, ord, left_id, right_id, cost, pos", ("KANJI", 0, 4, 5, 600, "noun,a,b,*,*,*"), ("KANJI", 1, 6, 7, -20, "verb,*,*,*,*,*"), ("DEFAULT", 0, 1, 1, 9, "x,*,*,*,*,*")))
def oov_templates_source(spark, sf_dir):
    got = D.parse_templates(D.read_text(write_lines(spark, folder(spark, "def"), TEMPLATES_DEF)))
    rows = [(k, i, a, b, c, ",".join(p)) for k, v in got.items() for i, (a, b, c, p) in enumerate(v)]
    return _tried(spark, "category string, ord int, left_id int, right_id int, cost int, pos string", *rows)


REWRITE_DEF = ["# kept", "Ⅲ", "⼼", "", "# replaced", "ab\t1", "か゛ が"]


@query(values("kind, before, after", ("keep", "Ⅲ", None), ("keep", "⼼", None), ("rule", "ab", "1"), ("rule", "か゛", "が")))
def rewrite_source(spark, sf_dir):
    keep, rules = parse_rewrite(D.read_text(write_lines(spark, folder(spark, "def"), REWRITE_DEF)))
    return _tried(spark, "kind string, before string, after string", *[("keep", c, None) for c in keep], *[("rule", *x) for x in rules.items()])


BROKEN = [
    ("ranges", "0x0030..0x0039", "invalid format at line 0"), ("ranges", "0x0030..0x0029 NUMERIC", "invalid range at line 0"), ("ranges", "\n0x0030 FOO", "FOO is invalid type at line 1"),
    ("properties", "KANJI 0 0", "invalid format at line 1"), ("properties", "KANJI 0 0 2\nKANJI 0 0 2", "KANJI is already defined at line 2"), ("properties", "FOO 0 0 2", "FOO is invalid type at line 1"),
    ("templates", "KANJI,1,1", "invalid format at line 1"), ("templates", "\nFOO,1,1,1,a,b,c,d,e,f", "FOO is invalid type at line 2"),
    ("rewrite", "\n12", "12 is not character at line 1"), ("rewrite", "a b c", "invalid format at line 0"), ("rewrite", "ab x\nab y", "ab is already defined at line 1"),
]


@query(values("kind, text, message", *BROKEN))
def definition_errors(spark, sf_dir):
    """Malformed definitions and what is said about them."""
    parse = {"ranges": parse_ranges, "properties": D.parse_properties, "templates": D.parse_templates, "rewrite": parse_rewrite}
    rows = []
    for kind, text, _ in BROKEN:
        try:
            parse[kind](text)
            rows.append((kind, text, None))
        except DefinitionError as e:
            rows.append((kind, text, str(e)))
    return _tried(spark, "kind string, text string, message string", *rows)


@query("SELECT p_partkey, CAST(p_partkey AS BIGINT) AS value FROM part")
def hex_numbers(spark, sf_dir):
    """Numbers written as 0x..., read back."""
    return demo.names(spark, sf_dir).select("p_partkey", hex_value(F.concat(F.lit("0x"), F.lower(F.hex("p_partkey")))).alias("value"))


# texts


SCRIPTS = [
    (1, "âｂC1あ234漢字𡈽アｺﾞ", [32, 32, 32, 16, 64, 16, 16, 16, 4, 4, 1, 128, 128, 128]),
    (2, "々〇一ー・゛ァ　", [32780, 268, 260, 32896, 32768, 192, 32896, 8]),
    (3, "¼²€Ⅲ①㈱（５～", [8, 8, 8, 16, 8, 8, 8, 16, 8]),
    (4, "Ωяß\t\n x", [512, 1024, 32, 2, 2, 2, 32]),
    (5, "⑟⦀⟰─━︰ﾞ￠\U0002000b", [1, 1, 8, 1, 8, 8, 128, 8, 1]),
]


@query(values("id, pos, mask", *[(i, p, m) for i, _, masks in SCRIPTS for p, m in enumerate(masks)]))
def char_category_scripts(spark, sf_dir):
    """Default categories of characters of many scripts, by the generated expression."""
    texts = _tried(spark, "id int, text string", *[(i, t) for i, t, _ in SCRIPTS])
    return C.classified(C.exploded(texts, "id")).select("id", "pos", "mask")


PROFILES = [
    # the published text: runs, word starts, candidate lengths, bytes
    (1, "âｂC1あ234漢字𡈽アｺﾞ", [3, 2, 1, 1, 1, 3, 2, 1, 2, 1, 1, 3, 2, 1], "10011111111111", [3, 2, 1] + [1] * 11, [0, 2, 5, 6, 7, 10, 11, 12, 13, 16, 19, 23, 26, 29]),
    (2, "aЖbαβ漢々〇一", [1, 1, 1, 2, 1, 4, 3, 2, 1], "111101111", [1, 1, 1, 2, 1, 1, 1, 1, 1], [0, 1, 3, 4, 6, 8, 11, 14, 17]),
]


@query(values("id, pos, run_length, can_bow, candidate_length, byte_pos", *[(i, p, r[p], w[p] == "1", c[p], b[p]) for i, t, r, w, c, b in PROFILES for p in range(len(t))]))
def text_profile_scripts(spark, sf_dir):
    texts = _tried(spark, "id int, text string", *[(x[0], x[1]) for x in PROFILES])
    return C.profiled(texts, "id", columns=("run_length", "can_bow", "candidate_length", "byte_pos")).drop("ch")


# letters a to p of category KANJI, h to z of HIRAGANA, e of NUMERIC as well; the space of none
MIXED = compile_ranges([(97, 113, MASK["KANJI"]), (104, 123, MASK["HIRAGANA"]), (101, 102, MASK["NUMERIC"])])
MIXED_SQL = """x AS (SELECT p_partkey, CAST(unnest(range(length(p_name))) AS INTEGER) AS pos, unnest(string_split(p_name, '')) AS ch FROM part WHERE length(p_name) > 0),
m AS (SELECT *, CASE WHEN ch = ' ' THEN 1 ELSE CASE WHEN ch <= 'p' THEN 4 ELSE 0 END | CASE WHEN ch >= 'h' THEN 64 ELSE 0 END | CASE WHEN ch = 'e' THEN 16 ELSE 0 END END AS mask FROM x)"""


@query(
    f"""WITH RECURSIVE {MIXED_SQL}, r AS (
SELECT p_partkey, pos, mask AS both, pos AS run FROM m WHERE pos = 0 UNION ALL
SELECT m.p_partkey, m.pos, CASE WHEN (r.both & m.mask) <> 0 THEN r.both & m.mask ELSE m.mask END, CASE WHEN (r.both & m.mask) <> 0 THEN r.run ELSE m.pos END
FROM r JOIN m ON m.p_partkey = r.p_partkey AND m.pos = r.pos + 1)
SELECT p_partkey, pos, CAST(max(pos) OVER (PARTITION BY p_partkey, run) - pos + 1 AS INTEGER) AS run_length FROM r"""
)
def category_runs_mixed(spark, sf_dir):
    """Greedy runs where characters have several categories."""
    return C.profiled(demo.names(spark, sf_dir), "p_partkey", "p_name", ("run_length",), MIXED).drop("ch")


@query(
    f"""WITH {MIXED_SQL}, w AS (SELECT a.p_partkey, a.pos, b.pos AS last, bit_and(c.mask) AS common FROM m a JOIN m b ON b.p_partkey = a.p_partkey AND b.pos >= a.pos
JOIN m c ON c.p_partkey = a.p_partkey AND c.pos BETWEEN a.pos AND b.pos GROUP BY ALL)
SELECT p_partkey, pos, CAST(max(last) - pos + 1 AS INTEGER) AS longest_run FROM w WHERE common <> 0 GROUP BY p_partkey, pos"""
)
def longest_category_run(spark, sf_dir):
    """From each position: how far some category goes on."""
    return C.profiled(demo.names(spark, sf_dir), "p_partkey", "p_name", ("longest_run",), MIXED).drop("ch")


@query(
    f"""WITH {MIXED_SQL} SELECT p_partkey, CAST(CASE WHEN bit_and(mask) = 0 THEN 1 ELSE bit_and(mask) END AS INTEGER) AS mask FROM m WHERE pos < 3 GROUP BY p_partkey HAVING count(*) = 3"""
)
def span_categories(spark, sf_dir):
    """Categories that the first three characters share; DEFAULT if they are no run."""
    masks = C.profiled(demo.names(spark, sf_dir), "p_partkey", "p_name", ("mask",), MIXED)
    own = masks.groupBy("p_partkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mask"))), lambda x: x["mask"]).alias("masks"))
    return own.filter("size(masks) >= 3").select("p_partkey", C.shared_categories("masks", F.lit(0), F.lit(3)).alias("mask"))


_ACCENTED = "replace(replace(p_name, 'a', 'é'), 'o', '漢')"


@query(
    f"""WITH t AS (SELECT p_partkey, {_ACCENTED} AS t FROM part), p AS (SELECT *, CAST(unnest(range(length(t))) AS INTEGER) AS pos FROM t)
SELECT p_partkey, pos, CAST(strlen(substr(t, pos + 1, 3)) AS INTEGER) AS n_bytes FROM p"""
)
def bytes_of_next_characters(spark, sf_dir):
    """Bytes of the three characters from each position on, or of as many as there are."""
    t = demo.names(spark, sf_dir).select("p_partkey", F.expr(_ACCENTED).alias("t")).filter("length(t) > 0")
    return t.select("p_partkey", "t", F.explode(F.sequence(F.lit(0), F.length("t") - 1)).alias("pos")).select("p_partkey", "pos", C.next_bytes(F.col("t"), F.col("pos"), 3).alias("n_bytes"))


@query("SELECT p_partkey, substr(p_name, 2, least(4, length(p_name) - 1)) AS part FROM part WHERE length(p_name) > 1")
def substrings(spark, sf_dir):
    """Characters 1 to 4 (bounds are checked)."""
    return demo.names(spark, sf_dir).filter("length(p_name) > 1").select("p_partkey", C.substring_of(F.col("p_name"), F.lit(1), F.least(F.lit(5), F.length("p_name"))).alias("part"))


GOLDEN = [
    (1, "ÂＢΓД㈱ｶﾞウ゛⼼Ⅲ", "âbγд(株)ガヴ⼼ⅲ", [0, 1, 2, 3, 4, 4, 4, 5, 7, 9, 10, 11]),
    (2, "がきﾞパ", "がぎパ", [0, 2, 4, 6]),
    (3, "ワﾞゝ゛ｶ゛", "ヷゝ゛カ゛", [0, 1, 2, 3, 4, 5, 6]),
    (4, "ゴーール－〰", "ゴールー", [0, 1, 3, 4, 6]),
    (5, "Ab--c　½", "abーc 1⁄2", [0, 1, 2, 4, 5, 6, 6, 6, 7]),
    (6, "", "", [0]),
]


@query(values("id, modified, offsets", *[(i, m, ",".join(map(str, o))) for i, _, m, o in GOLDEN]))
def normalize_scripts(spark, sf_dir):
    """The default chain over texts of several scripts, with the origin of every character and of the end."""
    got = normalized(_tried(spark, "id int, text string", *[(i, t) for i, t, _, _ in GOLDEN]))
    return got.select("id", "norm.modified", F.array_join(F.transform("norm.offsets", lambda x: x.cast("string")), ",").alias("offsets"))


@query(
    """WITH t AS (SELECT p_partkey, list_transform(regexp_extract_all(p_name, 'ing|in|an|ar|n|.'), lambda x: CASE x WHEN 'ing' THEN '1' WHEN 'in' THEN '22' WHEN 'an' THEN '' WHEN 'ar' THEN 'R' WHEN 'n' THEN 'ñ' ELSE x END) AS parts FROM part)
SELECT p_partkey, array_to_string(parts, '') AS modified FROM t"""
)
def longest_rule_first(spark, sf_dir):
    """Replacement rules over the names: the longest that matches wins, what comes of one isn't looked at again."""
    chain = [DefaultRewriter(set(), {"n": "ñ", "in": "22", "ing": "1", "ar": "R", "an": ""})]
    return normalized(demo.names(spark, sf_dir), "p_name", chain=chain).select("p_partkey", "norm.modified")


REPLACED = [(1, 8, 10, "ああ", 32), (2, 8, 10, "あ", 29), (3, 8, 10, "あああ", 35), (4, 0, 99, "x", 1), (5, 13, 14, "", 29)]


@query(values("id, n_bytes, offsets", (1, 32, "0,1,2,3,4,5,6,7,8,8,10,11,12,13,14"), (2, 29, "0,1,2,3,4,5,6,7,8,10,11,12,13,14"), (3, 35, "0,1,2,3,4,5,6,7,8,8,8,10,11,12,13,14"), (4, 1, "0,14"), (5, 29, "0,1,2,3,4,5,6,7,8,9,10,11,12,14")))
def replace_with_offsets(spark, sf_dir):
    """Single replacements in the published text."""
    text = PROFILES[0][1]
    rows = []
    for i, begin, end, new, _ in REPLACED:
        got, offsets = replaced(text, list(range(len(text) + 1)), begin, end, new)
        rows.append((i, len(got.encode()), ",".join(map(str, offsets))))
    return _tried(spark, "id int, n_bytes int, offsets string", *rows)


@query("SELECT substr(headword, 1, 1) AS first, CAST(max(length(headword)) AS INTEGER) AS most FROM lex GROUP BY 1".join([f"{LEX} ", ""]))
def longest_per_first_character(spark, sf_dir):
    return X.longest(demo.lexicon(spark, sf_dir).select("headword"), "headword")


@query(
    """WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ȶ]+|(?s:.)') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_starts, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x) * (length(x) + 1) // 2)), 0) AS BIGINT) AS candidate_chars,
CAST(len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ȶ]+|[0-9]+|[ \\t\\n\\v\\r]+|[!-/:-@\\[-`{-~¡-¿×÷]+|[^A-Za-zÀ-ÖØ-öø-ȶ0-9 \\t\\n\\v\\r!-/:-@\\[-`{-~¡-¿×÷]+')) AS BIGINT) AS n_runs FROM t WHERE length(text) > 0"""
)
def document_profile(spark, sf_dir):
    """Word starts, candidate lengths and runs of whole documents, summed up for each."""
    return C.summed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


# dictionaries


_made: dict[tuple, str] = {}


def _once(make):
    """What it makes is made once for a session and its tables."""

    def get(spark: SparkSession, sf_dir: str) -> str:
        key = (make.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _made:
            _made[key] = make(spark, sf_dir)
        return _made[key]

    return get


@_once
def _built(spark: SparkSession, sf_dir: str) -> str:
    """The demonstration lexicon and its connection costs as files, built into a system dictionary."""
    at = folder(spark, "dic")
    csv = demo.written_csv(demo.system_rows(spark, sf_dir), f"{at}/csv")
    cells = demo.connection(spark).select(F.concat_ws(" ", "left", "right", "cost").alias("value"))
    header = spark.createDataFrame([(f"{demo.N_IDS} {demo.N_IDS}",), ("# costs",), ("",)], "value string")
    header.union(cells).coalesce(1).write.text(f"{at}/matrix")
    etl.build(spark, csv, f"{at}/matrix", f"{at}/system", description="names of parts")
    return at


@_once
def _with_users(spark: SparkSession, sf_dir: str) -> str:
    at = _built(spark, sf_dir)
    for i in (1, 2):
        csv = demo.written_csv(demo.user_rows(spark, sf_dir, i), f"{at}/csv{i}")
        etl.build(spark, csv, None, f"{at}/user{i}", user=True, description=f"user {i}", system=f"{at}/system")
    return at


@query(f"{LEX} SELECT headword, CAST(left_id AS VARCHAR) AS left_id, CAST(cost AS VARCHAR) AS cost, pos, reverse(headword) AS reading, upper(headword) AS normalized FROM lex")
def lexicon_csv_source(spark, sf_dir):
    csv = demo.written_csv(demo.system_rows(spark, sf_dir), folder(spark, "csv"))
    pos = F.concat_ws(",", *[f"pos{i}" for i in range(1, 7)])
    return D.lexicon_csv(spark, csv).select("headword", "left_id", "cost", pos.alias("pos"), "reading", "normalized")


@query(f'{LEX} SELECT l AS "left", r AS "right", cost FROM conn')
def connection_text_source(spark, sf_dir):
    return spark.read.parquet(f"{_built(spark, sf_dir)}/system/connection")


@query(
    f"""{LEX}, f AS (SELECT pos, min(word_id) AS first FROM lex GROUP BY pos), p AS (SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS pos_id, pos FROM f)
SELECT lex.word_id, lex.headword, lex.left_id, lex.right_id, lex.cost, p.pos_id, CAST(strlen(lex.headword) AS INTEGER) AS head_word_length, upper(lex.headword) AS normalized_form,
coalesce(d.headword, lex.headword) AS dictionary_form, reverse(lex.headword) AS reading_form, array_to_string(lex.a_split, ',') AS a_split, array_to_string(lex.b_split, ',') AS b_split
FROM lex JOIN p USING (pos) LEFT JOIN lex d ON d.word_id = lex.dictionary_form_word_id"""
)
def system_dictionary_tables(spark, sf_dir):
    """What building from files leaves in the lexicon table."""
    lex = spark.read.parquet(f"{_built(spark, sf_dir)}/system/lexicon")
    columns = ["word_id", "headword", "left_id", "right_id", "cost", "pos_id", "head_word_length", "normalized_form", "dictionary_form", "reading_form"]
    return lex.select(*columns, F.array_join("a_unit_split", ",").alias("a_split"), F.array_join("b_unit_split", ",").alias("b_split"))


@query(values("version, kind, description, recent", (1, "system", "names of parts", True), (1, "user", "user 1", True), (1, "user", "user 2", True)))
def dictionary_headers(spark, sf_dir):
    at = _with_users(spark, sf_dir)
    meta = spark.read.parquet(f"{at}/system/meta", f"{at}/user1/meta", f"{at}/user2/meta")
    return meta.select("version", "kind", "description", F.col("created").between(F.unix_timestamp() - 3600, F.unix_timestamp()).alias("recent"))


@query(values("opened_as, target, accepted", ("system", "system", True), ("system", "user1", False), ("user", "user1", True), ("user", "system", False)))
def dictionary_kinds_checked(spark, sf_dir):
    """A dictionary is opened only as what its header says it is."""
    at, rows = _with_users(spark, sf_dir), []
    for kind, target in (("system", "system"), ("system", "user1"), ("user", "user1"), ("user", "system")):
        try:
            etl.checked_header(spark, f"{at}/{target}", kind == "user")
            rows.append((kind, target, True))
        except ValueError:
            rows.append((kind, target, False))
    return _tried(spark, "opened_as string, target string, accepted boolean", *rows)


@query(f"{LEX}, f AS (SELECT pos, min(word_id) AS first FROM lex GROUP BY pos) SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS pos_id, pos FROM f UNION ALL SELECT 4, 'user,1,*,*,*,*' UNION ALL SELECT 5, 'user,2,*,*,*,*'")
def parts_of_speech(spark, sf_dir):
    """Parts of speech of a system and two user dictionaries: the later ones are appended."""
    at = _with_users(spark, sf_dir)
    d = etl.load(spark, f"{at}/system", (f"{at}/user1", f"{at}/user2"))
    return _tried(spark, "pos_id int, pos string", *[(i, ",".join(p)) for i, p in enumerate(d.parts)])


@query(ORACLES["best_path"])
def built_dictionary_best_path(spark, sf_dir):
    """From lexicon and matrix files to morphemes."""
    d = etl.load(spark, f"{_built(spark, sf_dir)}/system")
    return L.tokenized(demo.names(spark, sf_dir), d, "p_partkey", "p_name", columns=PATH_COLUMNS).select(*PATH_COLUMNS)


# names through the system and user dictionary 1; then, the second one's costs known, through all three
_AUTO = demo.nodes_sql("SELECT w AS id, headword AS text FROM usr WHERE d = 2", "lex1", "_u", demo.LEXICON_SQL + demo.USERS_SQL + ",")
_COSTS = """usr2 AS (SELECT id AS w, greatest(-32768, least(32767, arg_max(cost, idx) - arg_min(cost, idx) - 20 * count(*))) AS cost FROM path_u GROUP BY id),
lex2 AS (SELECT * FROM lex1 UNION ALL SELECT word_id, headword, left_id, right_id, cost, 2, a_split FROM users JOIN usr2 ON d = 2 AND usr2.w = word_id - 536870912),"""
_USERS = f"WITH RECURSIVE {_AUTO}, {demo.nodes_sql('SELECT p_partkey AS id, p_name AS text FROM part', 'lex2', '', _COSTS)}"


def _user_dictionary(spark: SparkSession, sf_dir: str) -> L.Dictionary:
    at = _with_users(spark, sf_dir)
    return etl.load(spark, f"{at}/system", (f"{at}/user1", f"{at}/user2"))


@query(
    f"""{_USERS} SELECT id AS p_partkey, CAST(idx AS INTEGER) AS idx, surface, CAST(coalesce(word_id, 0) AS BIGINT) AS word_id, CAST(coalesce(word_id, 0) // 268435456 AS INTEGER) AS dictionary_id, CAST(cost AS INTEGER) AS cost FROM path WHERE word_id IS NOT NULL"""
)
def user_tokenize_auto_cost(spark, sf_dir):
    """Two user dictionaries; the words of the second get their costs from paths through the first and the system's."""
    columns = ["idx", "surface", "word_id", "dictionary_id", "cost"]
    tokens = L.tokenized(demo.names(spark, sf_dir), _user_dictionary(spark, sf_dir), "p_partkey", "p_name", columns=[*columns, "is_oov"])
    return tokens.filter("NOT is_oov").select("p_partkey", *columns)


@query(
    f"""{_USERS}, w AS (SELECT p.id, p.idx, p.surface, p.word_id, CASE WHEN len(l.a_split) > 1 THEN l.a_split ELSE [NULL] END AS units FROM path p LEFT JOIN lex2 l ON l.word_id = p.word_id),
e AS (SELECT id, idx, surface, word_id, unnest(units) AS unit, unnest(range(len(units))) AS k FROM w), f AS (SELECT e.*, coalesce(l.headword, e.surface) AS s, coalesce(l.word_id, e.word_id, 0) AS wid FROM e LEFT JOIN lex2 l ON l.word_id = e.unit)
SELECT id AS p_partkey, CAST(row_number() OVER (PARTITION BY id ORDER BY idx, k) - 1 AS INTEGER) AS idx, s AS surface, CAST(wid AS BIGINT) AS word_id FROM f"""
)
def user_split_a(spark, sf_dir):
    """User words split into words of the system dictionary."""
    columns = ["idx", "surface", "word_id"]
    return L.tokenized(demo.names(spark, sf_dir), _user_dictionary(spark, sf_dir), "p_partkey", "p_name", "A", columns=columns).select("p_partkey", *columns)


@query("WITH odd AS (SELECT DISTINCT p_name AS h FROM part WHERE length(p_name) % 2 = 1), u AS (SELECT h, 1 + CAST(h >= 'i' AS INTEGER) AS d, row_number() OVER (PARTITION BY h >= 'i' ORDER BY h) - 1 AS w FROM odd) SELECT h AS surface, concat(d * 268435456 + w, ',', d * 268435456 + w) AS b_split, CASE d WHEN 1 THEN CAST(268435456 + w AS VARCHAR) ELSE '' END AS structure FROM u")
def user_references_rebased(spark, sf_dir):
    """References of user words to their own dictionary, under the number that it is loaded with."""
    at = _with_users(spark, sf_dir)
    both = etl.user_lexicon(spark, f"{at}/user1", 1).union(etl.user_lexicon(spark, f"{at}/user2", 2))
    return both.select("surface", F.array_join("b_unit_split", ",").alias("b_split"), F.array_join("word_structure", ",").alias("structure"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'headword is empty' WHEN 1 THEN 'headword is too long' WHEN 2 THEN 'a_split has too many parts' WHEN 3 THEN 'cost is not a number' END AS error FROM part"""
)
def lexicon_rows_validated(spark, sf_dir):
    """Rows with faults by their number; good and bad ones are told apart."""
    n = F.col("p_partkey") % 6
    head = F.when(n == 0, "").when(n == 1, F.repeat(F.lit("x"), 32768)).otherwise("ab")
    plain = {c: F.lit("*") for c in D.CSV_COLUMNS} | {"headword": head, "left_id": F.lit("1"), "right_id": F.lit("1"), "cost": F.when(n == 3, "1x").otherwise("-7")}
    plain["a_split"] = F.when(n == 2, F.repeat(F.lit("1/"), 127)).otherwise("*")
    rows = demo.names(spark, sf_dir).select("p_partkey", *[v.alias(k) for k, v in plain.items()])
    good, bad = etl.quarantined(rows)
    return good.select("p_partkey", F.lit(None).cast("string").alias("error")).union(bad.select("p_partkey", "error"))


# tokenizing


_POS = "p AS (SELECT pos, CAST(row_number() OVER (ORDER BY min(word_id)) - 1 AS INTEGER) AS pos_id FROM lex GROUP BY pos)"


@query(f"{NAMED}, {_POS} SELECT a.id AS p_partkey, CAST(a.idx AS INTEGER) AS idx, p.pos_id FROM path a LEFT JOIN lex USING (word_id) LEFT JOIN p USING (pos)")
def part_of_speech_ids(spark, sf_dir):
    """Null for unknown words: their part of speech is none of the dictionary's."""
    return L.tokenized(demo.names(spark, sf_dir), demo.dictionary(spark, sf_dir), "p_partkey", "p_name", columns=["idx", "pos_id"]).select("p_partkey", "idx", "pos_id")


@query("SELECT p_partkey, CAST(unnest(range(length(p_name))) AS INTEGER) AS idx, unnest(string_split(p_name, '')) AS surface, CAST(CASE unnest(string_split(p_name, '')) WHEN 'o' THEN 6000 ELSE 10 END AS INTEGER) AS cost FROM part WHERE length(p_name) > 0")
def barred_and_last_resort(spark, sf_dir):
    """Where providers are barred (o) the last one is asked all the same; elsewhere the first has an answer."""
    d = L.Dictionary(ranges=[(ord("o"), ord("o") + 1, MASK["NOOOVBOW"])], rewriters=[], providers=[GroupedOov({"DEFAULT": (1, 0, 1)}, {"DEFAULT": [(0, 0, 10, ("x",) * 6)]}), SimpleOov(0, 0)])
    columns = ["idx", "surface", "cost"]
    return L.tokenized(demo.names(spark, sf_dir), d, "p_partkey", "p_name", columns=columns).select("p_partkey", *columns)


@query("SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, ' ', '')) AS BIGINT) * 2 + 1 AS n FROM part WHERE p_partkey % 3 = 0 AND length(p_name) > 0")
def empty_texts(spark, sf_dir):
    """Null and empty texts have no morphemes."""
    texts = demo.names(spark, sf_dir).withColumn("p_name", F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '' END"))
    return L.tokenized(texts, L.Dictionary(), "p_partkey", "p_name", columns=["idx"]).groupBy("p_partkey").agg(F.count("*").alias("n"))


@query(ORACLES["best_path"])
def sql_tokenize(spark, sf_dir):
    """The table function in SQL."""
    sql.register(spark, demo.dictionary(spark, sf_dir), "name_morphemes")
    sql.spread(demo.names(spark, sf_dir)).createOrReplaceTempView("names_to_tokenize")
    return spark.sql("SELECT p_partkey, t.* FROM names_to_tokenize n, LATERAL name_morphemes(n.p_name, 'C') t").select(*PATH_COLUMNS)


@query(ORACLES["split_a"])
def split_a_by_join(spark, sf_dir):
    """Mode A with the lexicon as a table of any size."""
    rules = L.Dictionary(connection=demo.dictionary(spark, sf_dir).connection)
    lex = demo.lexicon(spark, sf_dir).withColumn("pos", F.split("pos", ","))
    return L.tokenized_by_join(demo.names(spark, sf_dir), lex, rules, "p_partkey", "p_name", "A").select("p_partkey", "idx", "surface", "word_id", "begin")


@query("SELECT p_partkey, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part WHERE length(p_name) > 0 AND NOT contains(p_name, 'z')) GROUP BY 1")
def texts_without_morpheme_skipped(spark, sf_dir):
    """Without a provider for z, texts that hold one are skipped."""
    d = L.Dictionary(ranges=[(ord("z"), ord("z") + 1, MASK["USER1"])], rewriters=[], providers=[GroupedOov({"DEFAULT": (1, 0, 1)}, {"DEFAULT": [(0, 0, 10, ("x",) * 6)]})])
    return L.tokenized(demo.names(spark, sf_dir), d, "p_partkey", "p_name", errors="skip", columns=["idx"]).groupBy("p_partkey").agg(F.count("*").alias("n"))


# settings: a grouped provider, then a simple one, own ranges, rewriters by name

SETTINGS = {
    "characterDefinitionFile": "chars", "inputTextPlugin": [{"class": "any.package.DefaultInputTextPlugin"}, {"class": "ProlongedSoundMarkInputTextPlugin", "prolongedSoundMarks": ["o"], "replacementSymbol": "a"}],
    "oovProviderPlugin": [{"class": "any.package.MeCabOovProviderPlugin", "charDef": "chars", "unkDef": "unk"}, {"class": "SimpleOovProviderPlugin", "oovPOS": list("uvwxyz"), "leftId": 5, "rightId": 6, "cost": 77}],
}
CHARS_DEF = ["DEFAULT 0 1 0", "KANJI 0 0 2", "HIRAGANA 0 1 2", "0x0061..0x006D KANJI", "0x006E..0x007A HIRAGANA"]
UNK_DEF = ["KANJI,1,2,300,k,*,*,*,*,*", "HIRAGANA,2,1,200,h,*,*,*,*,*", "HIRAGANA,3,3,250,i,*,*,*,*,*"]


def _settings(spark: SparkSession) -> str:
    at = folder(spark, "settings")
    write_lines(spark, f"{at}/chars", CHARS_DEF)
    write_lines(spark, f"{at}/unk", UNK_DEF)
    return write_lines(spark, f"{at}/settings.json", [json.dumps(SETTINGS)])


@query(
    values(
        "name, value",
        ("ranges", "97-110:4 110-123:64"), ("rewriters", "DefaultRewriter MarkCollapser"), ("marks", "xaxaa"), ("providers", "GroupedOov SimpleOov"), ("properties", "DEFAULT:0,1,0 HIRAGANA:0,1,2 KANJI:0,0,2"),
        ("templates", "HIRAGANA:2 KANJI:1"), ("simple", "5,6,77,uvwxyz"),
    )
)
def settings_source(spark, sf_dir):
    """What a settings file with its definition files makes of a dictionary."""
    d = etl.configured(spark, _settings(spark))
    grouped, simple = d.providers
    rows = {
        "ranges": " ".join(f"{a}-{b}:{m}" for a, b, m in d.ranges), "rewriters": " ".join(type(r).__name__ for r in d.rewriters), "marks": L.rewrite_text("XaXooooa", d.rewriters),
        "providers": " ".join(type(p).__name__ for p in d.providers), "properties": " ".join(f"{k}:{','.join(map(str, v))}" for k, v in sorted(grouped.properties.items())),
        "templates": " ".join(f"{k}:{len(v)}" for k, v in sorted(grouped.templates.items())), "simple": f"{simple.left_id},{simple.right_id},{simple.cost},{''.join(simple.pos)}",
    }
    return _tried(spark, "name string, value string", *rows.items())


def _grouped_sql(longest: int = 16) -> str:
    """Least total of each name: nodes by the rules of the settings above, then one step for each position."""
    steps = ["t0 AS MATERIALIZED (SELECT DISTINCT id, 0 AS at, 0 AS r, 0 AS total FROM ch)"]
    for p in range(longest):
        seen = " UNION ALL ".join(f"SELECT * FROM t{q}" for q in range(p + 1))
        steps.append(
            f't{p + 1} AS MATERIALIZED (SELECT n.id, n."end" AS at, n.r, min(t.total + c.cost + n.cost) AS total FROM nodes n JOIN ({seen}) t ON t.id = n.id AND t.at = {p} AND n.begin = {p} '
            "JOIN conn c ON c.l = t.r AND c.r = n.l WHERE c.cost <> 32767 GROUP BY ALL)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM t{q}" for q in range(longest + 1))
    return f"""WITH conn AS {demo.LEXICON_SQL.split('conn AS', 1)[1]},
tx AS (SELECT p_partkey AS id, regexp_replace(p_name, 'oo+', 'a', 'g') AS text FROM part WHERE length(p_name) > 0),
ch AS (SELECT id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS c FROM tx),
k AS (SELECT *, CASE WHEN c = ' ' THEN 'D' WHEN c <= 'm' THEN 'K' ELSE 'H' END AS cat FROM ch),
f AS (SELECT *, CASE WHEN lag(cat) OVER (PARTITION BY id ORDER BY pos) = cat THEN 0 ELSE 1 END AS fresh FROM k),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY pos) AS run FROM f),
r AS (SELECT *, max(pos) OVER (PARTITION BY id, run) - pos + 1 AS n FROM g),
s AS (SELECT id, pos, cat, unnest(CASE cat WHEN 'K' THEN range(1, least(2, n) + 1) WHEN 'H' THEN list_append(range(1, least(2, n - 1) + 1), n) ELSE [1] END) AS n FROM r),
nodes AS (SELECT id, pos AS begin, pos + s.n AS "end", l, r, cost FROM s JOIN (VALUES ('K', 1, 2, 300), ('H', 2, 1, 200), ('H', 3, 3, 250), ('D', 5, 6, 77)) AS q(c, l, r, cost) ON q.c = s.cat),
{", ".join(steps)}
SELECT tx.id AS p_partkey, CAST(min(e.total + c.cost) AS BIGINT) AS total FROM ({every}) e JOIN tx ON tx.id = e.id AND e.at = length(tx.text) JOIN conn c ON c.l = e.r AND c.r = 0 WHERE c.cost <> 32767 GROUP BY 1"""


@query(_grouped_sql())
def best_path_grouped(spark, sf_dir):
    """Best paths with the providers, ranges and rewriters of a settings file: their total costs."""
    d = etl.configured(spark, _settings(spark))
    d.connection = etl.connections(demo.connection(spark))
    dump = L.lattice_dump(demo.names(spark, sf_dir), d, "p_partkey", "p_name").filter("on_path")
    last = dump.groupBy("p_partkey").agg(F.max(F.struct("end", "right_id", "total")).alias("x")).select("p_partkey", F.col("x.right_id").alias("left"), F.col("x.total").alias("t"))
    return last.join(F.broadcast(demo.connection(spark).filter("right = 0").select("left", "cost")), "left").select("p_partkey", (F.col("t") + F.col("cost")).alias("total"))


# whole documents


@query(
    f"""{LEX}, w AS (SELECT word_id, headword FROM lex WHERE kind = 1 AND variant = 0), d AS (SELECT lower(text) AS text FROM documents)
SELECT word_id, CAST(sum(len(string_split(text, headword)) - 1) AS BIGINT) AS n FROM d, w WHERE contains(text, headword) GROUP BY 1"""
)
def lexicon_prefix_documents(spark, sf_dir):
    """How often each simple word begins somewhere in the documents (none of them can overlap itself)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    words = demo.lexicon(spark, sf_dir).filter("pos = 'word,0,*,*,*,*'").select("headword", "word_id")
    return X.prefix_lookup(docs, "doc_id", "text", words).groupBy("word_id").agg(F.count("*").alias("n"))


@query()
def best_path_documents(spark, sf_dir):
    """Morphemes of whole documents with the demonstration lexicon."""
    return L.tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"), demo.dictionary(spark, sf_dir), "doc_id", columns=PATH_COLUMNS).select("doc_id", *PATH_COLUMNS[1:])


@query()
def normalize_offsets_documents(spark, sf_dir):
    """Of whole documents, as an array each."""
    return normalized(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "norm.modified", "norm.offsets")
