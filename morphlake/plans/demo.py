"""A lexicon and connection costs that follow from the table ``part``, so that SQL can derive the same ones.

Words of the part names (not those that begin with g: they stay unknown), second readings of words of odd length,
names of even length as compounds, and the space.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.operators.lattice import Dictionary
from morphlake.operators.lexicon import INHIBITED
from morphlake.plans.dictionary import snapshot

N_IDS = 9


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = names(spark, sf_dir).filter("p_name IS NOT NULL").select("p_name").distinct()
    words = parts.select(F.explode(F.split("p_name", " ")).alias("headword")).filter("headword <> '' AND headword NOT LIKE 'g%'").distinct()
    words = words.select(F.lit(1).alias("kind"), "headword", F.explode(F.expr("IF(length(headword) % 2 = 1, array(0, 1), array(0))")).alias("variant"))
    compounds = parts.filter("length(p_name) % 2 = 0").select(F.lit(2), "p_name", F.lit(0))
    space = spark.createDataFrame([(0, " ", 0)], "kind int, headword string, variant int")
    rows = space.union(words).union(compounds)
    rows = rows.withColumn("word_id", F.row_number().over(Window.orderBy("kind", "headword", "variant")) - 1)  # a lexicon: driver-sized
    cost = F.expr("CASE kind WHEN 0 THEN 500 WHEN 1 THEN 3000 - 400 * length(headword) + 150 * variant ELSE 3000 - 350 * length(headword) END")
    rows = rows.withColumns(
        {
            "dict_id": F.lit(0), "left_id": F.expr("word_id * 7 % 5 + 1"), "right_id": F.expr("word_id * 3 % 5 + 1"), "cost": cost.cast("int"), "surface": F.col("headword"),
            "pos": F.expr("CASE kind WHEN 0 THEN 'space,*,*,*,*,*' WHEN 2 THEN 'compound,*,*,*,*,*' ELSE concat('word,', variant, ',*,*,*,*') END"),
            "normalized_form": F.upper("headword"), "dictionary_form_word_id": F.expr("IF(variant = 1, word_id - 1, -1)"), "reading_form": F.reverse("headword"),
        }
    )
    rows = rows.withColumn("dictionary_form", F.col("surface"))
    units = rows.filter("kind < 2 AND variant = 0").select(F.col("headword").alias("u"), F.col("word_id").alias("u_id"))
    pieces = rows.filter("kind = 2").select("word_id", F.posexplode(F.expr("array(split(headword, ' ')[0], ' ', split(headword, ' ')[1])")).alias("ord", "u"))
    found = pieces.join(F.broadcast(units), "u").groupBy("word_id").agg(F.expr("transform(array_sort(collect_list(struct(ord, u_id))), x -> x.u_id)").alias("ids")).filter("size(ids) = 3")
    rows = rows.join(found, "word_id", "left")
    none = F.array().cast("array<int>")
    return rows.withColumns({"a_unit_split": F.coalesce("ids", none), "b_unit_split": F.expr("IF(length(headword) % 4 = 0, coalesce(ids, array()), cast(array() AS array<int>))")}).drop("ids", "kind")


def connection(spark: SparkSession) -> DataFrame:
    pairs = spark.range(0, N_IDS, 1, 1).select(F.col("id").cast("int").alias("left")).crossJoin(spark.range(0, N_IDS, 1, 1).select(F.col("id").cast("int").alias("right")))
    return pairs.withColumn("cost", F.expr(f"CAST(IF(left = 4 AND right = 3, {INHIBITED}, (left * 7 + right * 13) % 11 * 100) AS int)"))


def dictionary(spark: SparkSession, sf_dir: str) -> Dictionary:
    return snapshot(lexicon(spark, sf_dir), connection(spark))


LEXICON_SQL = """
parts AS (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL),
ws AS (SELECT DISTINCT headword FROM (SELECT unnest(string_split(p_name, ' ')) AS headword FROM parts) WHERE headword <> '' AND headword NOT LIKE 'g%'),
raw AS (
  SELECT 0 AS kind, ' ' AS headword, 0 AS variant
  UNION ALL SELECT 1, headword, v FROM ws, (VALUES (0), (1)) AS vs(v) WHERE v = 0 OR length(headword) % 2 = 1
  UNION ALL SELECT 2, p_name, 0 FROM parts WHERE length(p_name) % 2 = 0),
ids AS (SELECT *, CAST(row_number() OVER (ORDER BY kind, headword, variant) - 1 AS INTEGER) AS word_id FROM raw),
lex0 AS (
  SELECT *, word_id * 7 % 5 + 1 AS left_id, word_id * 3 % 5 + 1 AS right_id,
    CAST(CASE kind WHEN 0 THEN 500 WHEN 1 THEN 3000 - 400 * length(headword) + 150 * variant ELSE 3000 - 350 * length(headword) END AS INTEGER) AS cost,
    CASE kind WHEN 0 THEN 'space,*,*,*,*,*' WHEN 2 THEN 'compound,*,*,*,*,*' ELSE 'word,' || variant || ',*,*,*,*' END AS pos,
    CASE WHEN variant = 1 THEN word_id - 1 ELSE -1 END AS dictionary_form_word_id FROM ids),
units AS (SELECT headword AS u, word_id AS u_id FROM lex0 WHERE kind < 2 AND variant = 0),
sp AS (
  SELECT l.word_id, [a.u_id, s.u_id, b.u_id] AS ids FROM lex0 l JOIN units a ON a.u = string_split(l.headword, ' ')[1]
  JOIN units b ON b.u = string_split(l.headword, ' ')[2] JOIN units s ON s.u = ' ' WHERE l.kind = 2),
lex AS (
  SELECT lex0.*, coalesce(sp.ids, []) AS a_split, CASE WHEN length(headword) % 4 = 0 THEN coalesce(sp.ids, []) ELSE [] END AS b_split
  FROM lex0 LEFT JOIN sp USING (word_id)),
conn AS (
  SELECT CAST(l AS INTEGER) AS l, CAST(r AS INTEGER) AS r, CASE WHEN l = 4 AND r = 3 THEN 32767 ELSE (l * 7 + r * 13) % 11 * 100 END AS cost
  FROM range(9) a(l), range(9) b(r))
"""


def user_rows(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """CSV columns (and ``ord``) of the two user dictionaries: names of odd length, the first those of early letters with a
    cost, the second the rest without one. Each word splits into system words by inline references; of the first
    dictionary, a word's structure is itself."""
    odd = names(spark, sf_dir).filter("length(p_name) % 2 = 1").select("p_name").distinct()
    odd = odd.filter("p_name < 'i'" if number == 1 else "p_name >= 'i'").withColumn("ord", F.row_number().over(Window.orderBy("p_name")) - 1)
    known = lexicon(spark, sf_dir).filter("pos = 'word,0,*,*,*,*'").select("headword")
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    both = odd.join(F.broadcast(known.withColumnRenamed("headword", "h1")), first == F.col("h1"), "left").join(F.broadcast(known.withColumnRenamed("headword", "h2")), last == F.col("h2"), "left")
    ref = lambda w, pos: F.concat_ws(",", w, F.lit(pos), F.reverse(w))
    refs = F.concat_ws("/", ref(first, "word,0,*,*,*,*"), ref(F.lit(" "), "space,*,*,*,*,*"), ref(last, "word,0,*,*,*,*"))
    cost = "-1000" if number == 1 else "-32768"
    own = F.concat(F.lit("U"), F.col("ord"))
    return both.select(
        "ord", F.col("p_name").alias("headword"), F.lit("2").alias("left_id"), F.lit("3").alias("right_id"), F.lit(cost).alias("cost"), F.col("p_name").alias("surface"),
        F.lit("user").alias("pos1"), F.lit(str(number)).alias("pos2"), *[F.lit("*").alias(f"pos{i}") for i in range(3, 7)], F.reverse("p_name").alias("reading"), F.upper("p_name").alias("normalized"),
        F.lit("*").alias("dict_form"), F.lit("A").alias("split_type"), F.when(F.col("h1").isNotNull() & F.col("h2").isNotNull(), refs).otherwise("*").alias("a_split"),
        F.concat_ws("/", own, own).alias("b_split"), (own if number == 1 else F.lit("*")).alias("structure"),
    )


def system_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV columns (and ``ord``) of the lexicon."""
    plain = lambda c: F.when(F.size(c) == 0, "*").otherwise(F.concat_ws("/", F.transform(c, lambda x: x.cast("string"))))
    pos = [F.split("pos", ",")[i].alias(f"pos{i + 1}") for i in range(6)]
    form = F.when(F.col("dictionary_form_word_id") < 0, "*").otherwise(F.col("dictionary_form_word_id").cast("string"))
    return lexicon(spark, sf_dir).select(
        F.col("word_id").alias("ord"), "headword", *[F.col(c).cast("string").alias(c) for c in ("left_id", "right_id", "cost")], "surface", *pos,
        F.col("reading_form").alias("reading"), F.col("normalized_form").alias("normalized"), form.alias("dict_form"), F.lit("A").alias("split_type"),
        plain("a_unit_split").alias("a_split"), plain("b_unit_split").alias("b_split"), F.lit("*").alias("structure"),
    )


def written_csv(rows: DataFrame, path: str) -> str:
    """The rows as one lexicon file, in order."""
    rows.coalesce(1).sortWithinPartitions("ord").drop("ord").write.csv(path, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


#: The system lexicon and user dictionary 1 as ``lex1``; the words of user dictionary 2 that lack a cost as ``usr2``.
USERS_SQL = """,
odd AS (SELECT DISTINCT p_name AS headword FROM part WHERE length(p_name) % 2 = 1),
usr AS (SELECT headword, 1 AS d, row_number() OVER (ORDER BY headword) - 1 AS w FROM odd WHERE headword < 'i'
  UNION ALL SELECT headword, 2, row_number() OVER (ORDER BY headword) - 1 FROM odd WHERE headword >= 'i'),
usplit AS (SELECT usr.d, usr.w, [a.u_id, s.u_id, b.u_id] AS ids FROM usr JOIN units a ON a.u = string_split(headword, ' ')[1]
  JOIN units b ON b.u = string_split(headword, ' ')[2] JOIN units s ON s.u = ' '),
users AS (SELECT usr.d * 268435456 + usr.w AS word_id, headword, 2 AS left_id, 3 AS right_id, d, coalesce(x.ids, []) AS a_split FROM usr LEFT JOIN usplit x USING (d, w)),
lex1 AS (SELECT word_id, headword, left_id, right_id, cost, 16 AS pr, a_split FROM lex
  UNION ALL SELECT word_id, headword, left_id, right_id, -1000, 1, a_split FROM users WHERE d = 1)
"""


def nodes_sql(texts: str, lex: str = "lex", tag: str = "", before: str | None = None) -> str:
    """CTEs from a query for (id, text): characters, lattice nodes and the best path of each text. ``lex``: table of the
    words, with ``pr`` (dictionaries in order) unless it is the system's; ``tag``: ends the names of the CTEs;
    ``before``: CTEs in place of the lexicon's own."""
    sql = (
        (LEXICON_SQL + "," if before is None else before)
        + f"texts AS ({texts}),"
        + """
chars AS (
  SELECT id, pos, ch, lag(ch) OVER (PARTITION BY id ORDER BY pos) AS before
  FROM (SELECT id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS ch FROM texts WHERE length(text) > 0)),
bow AS (SELECT id, pos FROM chars WHERE before IS NULL OR NOT (regexp_matches(ch, '[a-zA-Z]') AND regexp_matches(before, '[a-zA-Z]'))
  UNION ALL SELECT id, length(text) FROM texts WHERE length(text) > 0),
hits AS (
  SELECT b.id, b.pos AS begin, CAST(b.pos + length(l.headword) AS BIGINT) AS "end", l.left_id, l.right_id, l.cost, l.word_id, l.headword AS surface, PRIORITY AS pr
  FROM bow b JOIN texts t ON t.id = b.id JOIN LEXICON l ON substr(t.text, CAST(b.pos + 1 AS BIGINT), length(l.headword)) = l.headword
  JOIN bow e ON e.id = b.id AND e.pos = b.pos + length(l.headword)),
nexts AS (SELECT id, pos, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS nx FROM bow),
oov AS (
  SELECT n.id, n.pos, n.nx, 8 AS left_id, 8 AS right_id, 6000 AS cost, NULL AS word_id, substr(t.text, CAST(n.pos + 1 AS BIGINT), CAST(n.nx - n.pos AS BIGINT)) AS surface, 99 AS pr
  FROM nexts n JOIN texts t ON t.id = n.id WHERE n.nx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.id = n.id AND h.begin = n.pos)),
nodes AS (
  SELECT * EXCLUDE (pr), row_number() OVER (PARTITION BY id ORDER BY begin, word_id IS NULL, pr, "end", word_id) - 1 AS seq FROM (SELECT * FROM hits UNION ALL SELECT * FROM oov)),
paths AS (
  SELECT id, CAST(0 AS BIGINT) AS at, 0 AS right_id, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS seqs FROM texts WHERE length(text) > 0
  UNION ALL
  SELECT p.id, n."end", n.right_id, p.total + c.cost + n.cost, list_append(p.seqs, n.seq)
  FROM paths p JOIN nodes n ON n.id = p.id AND n.begin = p.at JOIN conn c ON c.l = p.right_id AND c.r = n.left_id WHERE c.cost <> 32767),
best AS (
  SELECT p.id, p.seqs, p.total + c.cost AS total,
    row_number() OVER (PARTITION BY p.id ORDER BY p.total + c.cost, list_reverse(p.seqs)) AS rk
  FROM paths p JOIN texts t ON t.id = p.id AND p.at = length(t.text) JOIN conn c ON c.l = p.right_id AND c.r = 0 WHERE c.cost <> 32767),
steps AS (SELECT id, unnest(range(len(seqs))) AS idx, unnest(seqs) AS seq FROM best WHERE rk = 1),
path AS (SELECT s.id, s.idx, n.* EXCLUDE (id, seq) FROM steps s JOIN nodes n ON n.id = s.id AND n.seq = s.seq)
""".replace("LEXICON", lex).replace("PRIORITY", "1" if lex == "lex" else "l.pr")
    )
    names = "texts chars bow hits nexts oov nodes paths best steps path".split()
    return re.sub(rf"\b({'|'.join(names)})\b", lambda m: m[0] + tag, sql) if tag else sql
