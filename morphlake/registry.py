"""Every registered query of the library and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.functions.categories import DEFAULT_RANGES, MASK, RUN_SCRIPTS, code_point, compile_ranges, compiled, names_of, ranges_table, values_sql
from morphlake.functions.normalize import collapsed, modified, normalized
from morphlake.operators import chars as C
from morphlake.operators import lattice as L
from morphlake.operators import lexicon as X
from morphlake.operators.oov import grouped_candidates, simple_tokens
from morphlake.plans import demo
from morphlake.plans.catalog import ORACLES, QUERIES, query
from morphlake.sources.shared import folder
from morphlake.streaming.tokenize import stream, to_parquet

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def name_profile(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return C.profiled(demo.names(spark, sf_dir), "p_partkey", "p_name", columns)


# SQL over the part names: (p_partkey, pos, ch, mask)
R = values_sql()  # of what any character may be; ``char_category_scripts`` holds the table against values that are typed in
NAME_CHARS = f"""x AS (SELECT p_partkey, CAST(unnest(range(length(p_name))) AS INTEGER) AS pos, unnest(string_split(p_name, '')) AS ch FROM part WHERE length(p_name) > 0),
m AS (SELECT x.*, coalesce(r.mask, 1) AS mask FROM x LEFT JOIN {R} ON unicode(x.ch) >= r.low AND unicode(x.ch) < r.high)"""
STARTS = f"""{NAME_CHARS}, s AS (SELECT *, coalesce(NOT ((mask & {RUN_SCRIPTS}) <> 0 AND (mask & lag(mask) OVER w) <> 0), true) AS can_bow FROM m WINDOW w AS (PARTITION BY p_partkey ORDER BY pos))"""


@query("SELECT p_partkey, CAST(unnest(range(length(p_name))) AS INTEGER) AS pos, unnest(string_split(p_name, '')) AS ch, unicode(unnest(string_split(p_name, ''))) AS cp FROM part WHERE length(p_name) > 0")
def char_explode(spark, sf_dir):
    return C.exploded(demo.names(spark, sf_dir), "p_partkey", "p_name")


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n_code_points, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents")
def char_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length("text").alias("n_code_points"), F.octet_length("text").alias("n_bytes"))


@query(f"WITH {NAME_CHARS} SELECT p_partkey, pos, ch, CAST(coalesce(sum(strlen(ch)) OVER (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_pos FROM x")
def byte_lengths(spark, sf_dir):
    return name_profile(spark, sf_dir, "byte_pos").select("p_partkey", "pos", "ch", F.col("byte_pos").cast("long").alias("byte_pos"))


@query(f"WITH {NAME_CHARS} SELECT p_partkey, pos, ch, mask FROM m")
def char_category(spark, sf_dir):
    c = C.exploded(demo.names(spark, sf_dir), "p_partkey", "p_name")
    return C.categories_of(c, ranges_table(spark)).select("p_partkey", "pos", "ch", "mask")


@query(
    f"""WITH x AS (SELECT unicode(unnest(string_split(text, ''))) AS cp FROM documents), c AS (SELECT cp, count(*) AS n FROM x GROUP BY cp),
m AS (SELECT c.*, coalesce(r.mask, 1) AS mask FROM c LEFT JOIN {R} ON cp >= r.low AND cp < r.high WHERE cp > 0),
b AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {b})" for n, b in MASK.items())}) AS t(category, bit))
SELECT category, CAST(sum(n) AS BIGINT) AS n FROM m JOIN b ON (mask & bit) <> 0 GROUP BY category"""
)
def category_histogram(spark, sf_dir):
    """Characters are counted first, so code points and categories are looked up once for each."""
    counts = documents(spark, sf_dir).select(F.explode(F.split("text", "", -1)).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    named = C.classified(counts.withColumn("cp", code_point(F.col("ch")))).select(F.explode(F.split(names_of(F.col("mask")), r"\|")).alias("category"), "n")
    return named.groupBy("category").agg(F.sum("n").alias("n"))


_OVERLAPPING = [(48, 58, MASK["NUMERIC"]), (50, 51, MASK["KANJI"]), (40, 52, MASK["SYMBOL"]), (58, 60, MASK["NUMERIC"]), (100, 120, MASK["ALPHA"]), (110, 130, MASK["GREEK"])]


@query(
    f"""WITH r AS (SELECT * FROM {values_sql(_OVERLAPPING)}), e AS (SELECT low AS p FROM r UNION SELECT high FROM r),
s AS (SELECT p AS a, lead(p) OVER (ORDER BY p) AS b FROM e), c AS (SELECT a, b, bit_or(mask) AS mask FROM s JOIN r ON low <= a AND high >= b GROUP BY a, b),
i AS (SELECT *, CASE WHEN lag(b) OVER (ORDER BY a) = a AND lag(mask) OVER (ORDER BY a) = mask THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT *, sum(fresh) OVER (ORDER BY a) AS island FROM i) SELECT min(a) AS low, max(b) AS high, min(mask) AS mask FROM g GROUP BY island"""
)
def category_compile(spark, sf_dir):
    return compiled(ranges_table(spark, _OVERLAPPING))


@query(f"WITH {STARTS} SELECT p_partkey, pos, can_bow FROM s")
def word_start_flags(spark, sf_dir):
    return name_profile(spark, sf_dir, "can_bow").drop("ch")


@query(
    f"""WITH {STARTS} SELECT p_partkey, pos, CAST(coalesce(min(CASE WHEN can_bow THEN pos END) OVER (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
max(pos) OVER (PARTITION BY p_partkey) + 1) - pos AS INTEGER) AS candidate_length FROM s"""
)
def candidate_length(spark, sf_dir):
    return name_profile(spark, sf_dir, "candidate_length").drop("ch")


@query(
    f"""WITH {NAME_CHARS}, b AS (SELECT *, CASE WHEN (mask & lag(mask) OVER (PARTITION BY p_partkey ORDER BY pos)) <> 0 THEN 0 ELSE 1 END AS fresh FROM m),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY p_partkey ORDER BY pos) AS run FROM b)
SELECT p_partkey, pos, CAST(max(pos) OVER (PARTITION BY p_partkey, run) - pos + 1 AS INTEGER) AS run_length FROM g"""
)
def category_runs(spark, sf_dir):
    """One category per character in these texts, so the SQL may compare neighbours."""
    return name_profile(spark, sf_dir, "run_length").drop("ch")


_PLAIN = "[A-Za-zÀ-ÖØ-öø-ȶḀ-ỹＡ-Ｚａ-ｚ]+|[ʹ-ϻ]+|[Ѐ-ӹԀ-ԏ]+|(?s:.)"


@query(
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_PLAIN}') AS tokens FROM documents)
SELECT doc_id, CAST(unnest(range(len(tokens))) AS INTEGER) AS idx, unnest(tokens) AS surface FROM t"""
)
def simple_oov_tokens(spark, sf_dir):
    """With no lexicon: the pass over each text is one native expression."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(simple_tokens(F.col("text"))).alias("idx", "surface"))


@query(f"SELECT surface, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_PLAIN}')) AS surface FROM documents) GROUP BY surface")
def oov_histogram(spark, sf_dir):
    return documents(spark, sf_dir).select(F.explode(simple_tokens(F.col("text"))).alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))


_COLLAPSE = "[ー\\-⁓〜〰]{2,}"


@query(f"SELECT doc_id, regexp_replace(nfkc, '{_COLLAPSE}', 'ー', 'g') AS normalized FROM (SELECT doc_id, translate(lower(text), chr(160), ' ') AS nfkc FROM documents)")
def normalize_text(spark, sf_dir):
    return modified(documents(spark, sf_dir), "text", "normalized").select("doc_id", "normalized")


@query(
    """WITH t AS (SELECT p_partkey, replace(p_name, ' ', '--') AS text FROM part), c AS (SELECT p_partkey, text, CAST(unnest(range(length(text))) AS INTEGER) AS o, unnest(string_split(text, '')) AS ch FROM t),
k AS (SELECT *, lag(ch) OVER (PARTITION BY p_partkey ORDER BY o) AS before FROM c), f AS (SELECT * FROM k WHERE NOT (ch = '-' AND coalesce(before, '') = '-'))
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY o) - 1 AS INTEGER) AS pos, o AS original_pos FROM f
UNION ALL SELECT p_partkey, CAST(count(*) AS INTEGER), CAST(max(length(text)) AS INTEGER) FROM f GROUP BY p_partkey"""
)
def normalize_offsets(spark, sf_dir):
    """Original position of every normalized character, and of the end."""
    texts = demo.names(spark, sf_dir).select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("--")).alias("text"))
    return normalized(texts).select("p_partkey", F.posexplode("norm.offsets").alias("pos", "original_pos"))


@query(f"SELECT doc_id, regexp_replace(text, '{_COLLAPSE}', 'ー', 'g') AS text FROM documents")
def mark_collapse(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", collapsed(F.col("text")).alias("text"))


LEX = f"WITH {demo.LEXICON_SQL}"


@query(f"{LEX} SELECT headword, string_agg(CAST(word_id AS VARCHAR), ',' ORDER BY word_id) AS word_ids FROM lex GROUP BY headword")
def headword_index(spark, sf_dir):
    return X.headword_index(demo.lexicon(spark, sf_dir)).select("headword", F.array_join("word_ids", ",").alias("word_ids"))


@query(f"{LEX}, f AS (SELECT pos, min(word_id) AS first FROM lex GROUP BY pos) SELECT CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS pos_id, pos FROM f")
def pos_table(spark, sf_dir):
    return X.pos_table(demo.lexicon(spark, sf_dir), F.col("pos"), F.col("word_id"))


@query(f"{LEX} SELECT l.word_id, coalesce(d.headword, l.headword) AS dictionary_form FROM lex l LEFT JOIN lex d ON d.word_id = l.dictionary_form_word_id")
def dictionary_form_lookup(spark, sf_dir):
    return X.with_dictionary_forms(demo.lexicon(spark, sf_dir)).select("word_id", "dictionary_form")


@query(f"{LEX} SELECT word_id, headword AS text FROM lex")
def unescape(spark, sf_dir):
    """Every headword, written as escapes and read back."""
    escaped = F.concat_ws("", F.transform(C.characters(F.col("headword")), lambda c: F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))))
    return demo.lexicon(spark, sf_dir).select("word_id", X.unescaped(escaped).alias("text"))


@query(f"{LEX} SELECT word_id, array_to_string(a_split, ',') AS ids FROM lex")
def split_ref_resolution(spark, sf_dir):
    """Splits of compounds written as inline references, resolved by surface, part of speech and reading."""
    lex = demo.lexicon(spark, sf_dir)
    ref = lambda w, pos: F.concat_ws(",", w, F.lit(pos), F.reverse(w))
    first, last = F.split("headword", " ")[0], F.split("headword", " ")[1]
    whole = F.concat_ws("/", ref(first, "word,0,*,*,*,*"), ref(F.lit(" "), "space,*,*,*,*,*"), ref(last, "word,0,*,*,*,*"))
    words = lex.select("word_id", F.when(F.size("a_unit_split") == 0, "*").otherwise(whole).alias("refs"))
    return X.split_references(words, "word_id", "refs", lex.select("word_id", "surface", "pos", "reading_form")).select("word_id", F.array_join("ids", ",").alias("ids"))


_PREFIX = (
    "SELECT p_partkey, CAST(b.pos AS INTEGER) AS begin, CAST(b.pos + length(l.headword) AS INTEGER) AS \"end\", l.word_id FROM "
    "(SELECT p_partkey, p_name, unnest(range(length(p_name))) AS pos FROM part WHERE length(p_name) > 0) b "
    "JOIN {lex} l ON substr(b.p_name, CAST(b.pos + 1 AS BIGINT), length(l.headword)) = l.headword"
)


@query(f"{LEX} {_PREFIX.format(lex='lex')}")
def lexicon_prefix_lookup(spark, sf_dir):
    return X.prefix_lookup(demo.names(spark, sf_dir), "p_partkey", "p_name", demo.lexicon(spark, sf_dir)).select("p_partkey", "begin", "end", "word_id")


@query(f'{LEX}, p AS ({_PREFIX.format(lex="lex")}) SELECT p_partkey, begin, "end", count(*) AS n_words FROM p GROUP BY ALL')
def homograph_expand(spark, sf_dir):
    return lexicon_prefix_lookup(spark, sf_dir).groupBy("p_partkey", "begin", "end").agg(F.count("*").alias("n_words"))


@query(f"{LEX} SELECT a.word_id AS left_word, b.word_id AS right_word, c.cost FROM lex a JOIN conn c ON c.l = a.right_id JOIN lex b ON b.left_id = c.r WHERE c.cost <> 32767")
def connection_edges(spark, sf_dir):
    """All pairs of words that may stand next to each other, with the cost of it."""
    lex = demo.lexicon(spark, sf_dir)
    a = lex.select(F.col("word_id").alias("left_word"), F.col("right_id").alias("left"))
    b = lex.select(F.col("word_id").alias("right_word"), F.col("left_id").alias("right"))
    return a.join(F.broadcast(demo.connection(spark)), "left").join(F.broadcast(b), "right").filter(F.col("cost") != X.INHIBITED).select("left_word", "right_word", "cost")


_PROPS = [(MASK["ALPHA"], True, True, 2), (MASK["SPACE"], False, True, 1), (MASK["NUMERIC"], False, False, 2)]
_TEMPLATES = [(MASK["ALPHA"], 0, 5, 5, 4000, 1), (MASK["ALPHA"], 1, 6, 6, 4500, 2), (MASK["SPACE"], 0, 1, 1, 100, 3)]


@query(
    f"""WITH {NAME_CHARS}, b AS (SELECT *, CASE WHEN (mask & lag(mask) OVER (PARTITION BY p_partkey ORDER BY pos)) <> 0 THEN 0 ELSE 1 END AS fresh FROM m),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY p_partkey ORDER BY pos) AS run FROM b), r AS (SELECT *, max(pos) OVER (PARTITION BY p_partkey, run) - pos + 1 AS n FROM g),
p AS (SELECT * FROM (VALUES {", ".join(map(str, _PROPS)).replace("True", "true").replace("False", "false")}) AS t(category, invoke, grp, most)),
q AS (SELECT * FROM (VALUES {", ".join(map(str, _TEMPLATES))}) AS t(category, ord, left_id, right_id, cost, pos_id)),
j AS (SELECT r.p_partkey, r.pos AS begin, r.n, p.* FROM r JOIN p ON (r.mask & p.category) <> 0 WHERE invoke OR r.pos % 3 <> 0),
s AS (SELECT p_partkey, begin, category, n AS n_chars FROM j WHERE grp UNION ALL
      SELECT p_partkey, begin, category, k FROM j, range(1, 3) AS x(k) WHERE k <= most AND k <= n - CASE WHEN grp THEN 1 ELSE 0 END)
SELECT s.p_partkey, begin, category, CAST(n_chars AS INTEGER) AS n_chars, ord, left_id, right_id, cost, pos_id FROM s JOIN q USING (category)"""
)
def grouped_oov_candidates(spark, sf_dir):
    """Grouped candidates where every third position counts as having words."""
    c = name_profile(spark, sf_dir, "mask", "run_length").withColumn("has_words", F.col("pos") % 3 == 0)
    props = spark.createDataFrame(_PROPS, "mask int, invoke boolean, grp boolean, length int")
    templates = spark.createDataFrame(_TEMPLATES, "mask int, ord int, left_id int, right_id int, cost int, pos_id int")
    return grouped_candidates(c, "p_partkey", props, templates)


def _named(text: str = "SELECT p_partkey AS id, p_name AS text FROM part") -> str:
    return f"WITH RECURSIVE {demo.nodes_sql(text)}"


_PATH = f'{_named()} SELECT id AS p_partkey, CAST(idx AS INTEGER) AS idx, CAST(begin AS INTEGER) AS begin, CAST("end" AS INTEGER) AS "end", surface, coalesce(word_id, 0) AS word_id, word_id IS NULL AS is_oov, cost FROM path'
_COLUMNS = ["p_partkey", "idx", "begin", "end", "surface", "word_id", "is_oov", "cost"]


@query(_PATH.replace("coalesce(word_id, 0) AS word_id", "CAST(coalesce(word_id, 0) AS BIGINT) AS word_id"))
def best_path(spark, sf_dir):
    return L.tokenized(demo.names(spark, sf_dir), demo.dictionary(spark, sf_dir), "p_partkey", "p_name", columns=_COLUMNS).select(*_COLUMNS)


@query(ORACLES["best_path"])
def best_path_by_join(spark, sf_dir):
    """The same with the lexicon as a table of any size."""
    rules = L.Dictionary(connection=demo.dictionary(spark, sf_dir).connection)
    lex = demo.lexicon(spark, sf_dir).withColumn("pos", F.split("pos", ","))
    return L.tokenized_by_join(demo.names(spark, sf_dir), lex, rules, "p_partkey", "p_name").select(*_COLUMNS)


@query(f"{_named()} SELECT id AS p_partkey, CAST(total AS BIGINT) AS total FROM best WHERE rk = 1")
def best_path_cost(spark, sf_dir):
    """Total cost of each best path, with the edge to the end."""
    dump = L.lattice_dump(demo.names(spark, sf_dir), demo.dictionary(spark, sf_dir), "p_partkey", "p_name").filter("on_path")
    last = dump.groupBy("p_partkey").agg(F.max(F.struct("end", "right_id", "total")).alias("x")).select("p_partkey", F.col("x.right_id").alias("left"), F.col("x.total").alias("t"))
    end = demo.connection(spark).filter("right = 0").select("left", "cost")
    return last.join(F.broadcast(end), "left").select("p_partkey", (F.col("t") + F.col("cost")).alias("total"))


@query(
    f"""{_named()}, reached AS (SELECT id, seqs[len(seqs)] AS seq, min(total) AS total FROM paths WHERE len(seqs) > 0 GROUP BY ALL)
SELECT n.id AS p_partkey, CAST(n.seq AS INTEGER) AS seq, CAST(n.begin AS INTEGER) AS begin, CAST(n."end" AS INTEGER) AS "end", n.left_id, n.right_id, n.cost, CAST(r.total AS BIGINT) AS total,
n.word_id IS NULL AS is_oov, s.seq IS NOT NULL AS on_path FROM nodes n LEFT JOIN reached r ON r.id = n.id AND r.seq = n.seq LEFT JOIN steps s ON s.id = n.id AND s.seq = n.seq"""
)
def lattice_dump(spark, sf_dir):
    return L.lattice_dump(demo.names(spark, sf_dir), demo.dictionary(spark, sf_dir), "p_partkey", "p_name")


def _split_sql(column: str) -> str:
    return f"""{_named()}, w AS (SELECT p.id, p.idx, p.begin, p.surface, p.word_id, CASE WHEN len(l.{column}) > 1 THEN l.{column} ELSE [NULL] END AS units FROM path p LEFT JOIN lex l ON l.word_id = p.word_id),
e AS (SELECT id, idx, begin, surface, word_id, unnest(units) AS unit, unnest(range(len(units))) AS k FROM w), f AS (SELECT e.*, coalesce(l.headword, e.surface) AS s, coalesce(l.word_id, e.word_id, 0) AS wid FROM e LEFT JOIN lex l ON l.word_id = e.unit)
SELECT id AS p_partkey, CAST(row_number() OVER (PARTITION BY id ORDER BY idx, k) - 1 AS INTEGER) AS idx, s AS surface, CAST(wid AS BIGINT) AS word_id,
CAST(coalesce(sum(length(s)) OVER (PARTITION BY id ORDER BY idx, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS begin FROM f"""


def _split(spark, sf_dir, mode):
    columns = ["idx", "surface", "word_id", "begin"]
    return L.tokenized(demo.names(spark, sf_dir), demo.dictionary(spark, sf_dir), "p_partkey", "p_name", mode, columns=columns).select("p_partkey", *columns)


@query(_split_sql("a_split"))
def split_a(spark, sf_dir):
    return _split(spark, sf_dir, "A")


@query(_split_sql("b_split"))
def split_b(spark, sf_dir):
    return _split(spark, sf_dir, "B")


@query(f"{_named()} SELECT id AS p_partkey, CAST(idx AS INTEGER) AS idx, surface, CAST(coalesce(word_id, 0) AS BIGINT) AS word_id, CAST(begin AS INTEGER) AS begin FROM path")
def split_c(spark, sf_dir):
    return _split(spark, sf_dir, "C")


@query(
    f"""{_named()} SELECT p.id AS p_partkey, CAST(p.idx AS INTEGER) AS idx, p.surface || chr(9) || coalesce(l.pos, '名詞,普通名詞,一般,*,*,*') || chr(9) || CASE WHEN l.word_id IS NULL THEN p.surface ELSE upper(p.surface) END
|| chr(9) || p.surface || chr(9) || CASE WHEN l.word_id IS NULL THEN '' ELSE reverse(p.surface) END || chr(9) || CASE WHEN l.word_id IS NULL THEN '-1' || chr(9) || '(OOV)' ELSE '0' END AS line
FROM path p LEFT JOIN lex l ON l.word_id = p.word_id"""
)
def morpheme_print_all(spark, sf_dir):
    return L.printed(L.tokenized(demo.names(spark, sf_dir), demo.dictionary(spark, sf_dir), "p_partkey", "p_name"), "p_partkey", True)


@query(f"{_named()} SELECT id AS p_partkey, CAST(arg_max(cost, idx) - arg_min(cost, idx) AS INTEGER) AS internal_cost, count(*) AS n_morphemes FROM path GROUP BY id")
def internal_cost(spark, sf_dir):
    return L.internal_cost(L.tokenized(demo.names(spark, sf_dir), demo.dictionary(spark, sf_dir), "p_partkey", "p_name", columns=["idx", "cost"]), "p_partkey")


def _user(spark, sf_dir) -> DataFrame:
    """A user dictionary: the names of odd length."""
    odd = demo.names(spark, sf_dir).filter("length(p_name) % 2 = 1").select(F.col("p_name").alias("headword")).distinct()
    return odd.select(F.lit(1).alias("dict_id"), (F.row_number().over(Window.orderBy("headword")) - 1).alias("word_id"), "headword")


_USER = ", usr AS (SELECT 1 AS dict_id, row_number() OVER (ORDER BY headword) - 1 AS word_id, headword FROM (SELECT DISTINCT p_name AS headword FROM part WHERE length(p_name) % 2 = 1))"


@query(
    f"""{LEX}{_USER}, u AS (SELECT dict_id * 268435456 + word_id AS word_id, headword, dict_id FROM usr UNION ALL SELECT word_id, headword, 0 FROM lex), p AS ({_PREFIX.format(lex="u")}),
s AS (SELECT p.*, CASE WHEN word_id >= 268435456 THEN 1 ELSE 16 END AS pr FROM p)
SELECT p_partkey, begin, CAST(row_number() OVER (PARTITION BY p_partkey, begin ORDER BY pr, "end", word_id) - 1 AS INTEGER) AS ord, "end", CAST(word_id AS BIGINT) AS word FROM s"""
)
def user_dictionary_priority(spark, sf_dir):
    """Candidates of system and user dictionary together, in insertion order, by packed id."""
    both = X.united(demo.lexicon(spark, sf_dir).select("dict_id", "word_id", "headword"), _user(spark, sf_dir))
    found = X.prefix_lookup(demo.names(spark, sf_dir), "p_partkey", "p_name", both)
    order = Window.partitionBy("p_partkey", "begin").orderBy("priority", "end", "word_id")
    return found.select("p_partkey", "begin", (F.row_number().over(order) - 1).alias("ord"), "end", X.packed(F.col("dict_id"), F.col("word_id")).alias("word"))


@query(
    f"""{_named("SELECT row_number() OVER (ORDER BY p_name) - 1 AS id, p_name AS text FROM (SELECT DISTINCT p_name FROM part WHERE length(p_name) % 2 = 1)")}
SELECT CAST(id AS INTEGER) AS word_id, CAST(greatest(-32768, least(32767, arg_max(cost, idx) - arg_min(cost, idx) - 20 * count(*))) AS INTEGER) AS cost FROM path GROUP BY id"""
)
def user_auto_cost(spark, sf_dir):
    return L.auto_costs(_user(spark, sf_dir), demo.dictionary(spark, sf_dir), "word_id", "headword")


@query(ORACLES["best_path"])
def stream_tokenize(spark, sf_dir):
    """The table as a stream, through the same plan; all that is there, then the result."""
    source = spark.read.parquet(f"{sf_dir}/part.parquet")
    at = folder(spark, "stream")
    tokens = stream(spark, f"{sf_dir}/part.parquet*", source.schema.simpleString()[7:-1].replace(":", " "), demo.dictionary(spark, sf_dir), "p_partkey", "p_name", columns=_COLUMNS)
    to_parquet(tokens, f"{at}/out", f"{at}/log").awaitTermination()
    return spark.read.parquet(f"{at}/out").select(*_COLUMNS)


assert compile_ranges(DEFAULT_RANGES) == DEFAULT_RANGES

from morphlake import registry_more  # noqa: E402, F401
