"""Dictionary ETL: lexicon CSV to Parquet tables, and a loaded dictionary for the tokenizer."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.operators.lattice import BROADCAST_BYTES, BROADCAST_ROWS, CARRIED, MATRIX_BYTES, Connection, Dictionary, Word, auto_costs
from morphlake.operators.lexicon import MAX_CHARS, MAX_DICTIONARIES, MAX_PARTS, USER_SHIFT, pos_table, rebased_split, split_references, unescaped, with_dictionary_forms
from morphlake.sources.definitions import beside, connection_text, lexicon_csv, parts_of
from morphlake.sources.definitions import settings as settings_file

VERSION = 1
#: The cost of a word that is to get one when it is loaded.
NO_COST = -32768
TEXTS = ["headword", "surface", "reading", "normalized"]


def validated(rows: DataFrame) -> DataFrame:
    """Add ``error``: null for a good row, else what is wrong with it."""
    parts = lambda c: F.size(F.split(c, "/"))
    first = F.lit(None).cast("string")
    checks = [(F.length(c) > MAX_CHARS, f"{c} is too long") for c in TEXTS]
    checks += [(F.coalesce(F.length("headword"), F.lit(0)) == 0, "headword is empty")]
    checks += [(parts(c) > MAX_PARTS, f"{c} has too many parts") for c in ("a_split", "b_split", "structure")]
    checks += [(F.expr(f"try_cast({c} AS smallint)").isNull(), f"{c} is not a number") for c in ("left_id", "right_id", "cost")]
    for bad, message in reversed(checks):
        first = F.when(bad, message).otherwise(first)
    return rows.withColumn("error", first)


def quarantined(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their ``error``: for loads that go on without what is malformed."""
    checked = validated(rows)
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL")


def built(rows: DataFrame, dict_id: int = 0, system: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lexicon, pos) of parsed CSV rows (columns of ``lexicon_csv``).

    Word ids follow row order, parts of speech the order of first appearance. Split references are resolved among the
    rows themselves and, for a user dictionary, then in ``system`` (a lexicon table). In a user dictionary an id with U
    in front is one of its own words, a plain one the system's; its own are packed with its dictionary's number.

    Word ids and part of speech ids are numbered over the whole lexicon in one task; a lexicon is small beside texts.
    """
    checked = validated(rows)
    fail = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("lexicon row "), F.col("row_id"), F.lit(": "), F.col("error"))))
    good = checked.withColumns({c: F.coalesce(fail.cast("string"), unescaped(F.col(c))) for c in TEXTS})
    joined = F.concat_ws(",", *[f"pos{i}" for i in range(1, 7)])
    numbered = good.withColumn("word_id", (F.row_number().over(Window.orderBy("row_id")) - 1).cast("int")).withColumn("pos", joined)
    pos = pos_table(numbered, F.col("pos"), F.col("word_id"))
    words = numbered.join(pos, "pos")
    base = words.select(
        F.lit(dict_id).alias("dict_id"), "word_id", F.when(F.col("left_id") != "-1", F.col("headword")).alias("headword"), F.col("left_id").cast("int").alias("left_id"),
        F.col("right_id").cast("int").alias("right_id"), F.col("cost").cast("int").alias("cost"), "surface", F.octet_length("headword").alias("head_word_length"), "pos_id", "pos",
        F.coalesce(F.expr("nullif(normalized, '')"), "surface").alias("normalized_form"), F.coalesce(F.expr("try_cast(nullif(dict_form, '*') AS int)"), F.lit(-1)).alias("dictionary_form_word_id"),
        F.coalesce(F.expr("nullif(reading, '')"), "surface").alias("reading_form"), "a_split", "b_split", "structure",
    )
    shift = dict_id << USER_SHIFT
    known = base.select((F.col("word_id") + shift).alias("word_id"), "surface", "pos", "reading_form")
    if system is not None:
        text = F.concat_ws(",", "pos") if dict(system.dtypes)["pos"].startswith("array") else F.col("pos")
        both = known.withColumn("rank", F.lit(0)).union(system.select("word_id", "surface", text.alias("pos"), "reading_form", F.lit(1).alias("rank")))
        best = Window.partitionBy("surface", "pos", "reading_form").orderBy("rank", "word_id")
        known = both.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r", "rank")
    own, others = rows.count(), None if system is None else system.count()
    low, high = F.lit((1 << USER_SHIFT) - 1), lambda x: F.shiftright(x, USER_SHIFT)
    beyond = lambda x: (high(x) == dict_id) & (x.bitwiseAND(low) >= own)
    alien = lambda x: (F.lit(dict_id) > 0) & (high(x) == 0) & (x >= others) if others is not None else F.lit(False)
    out = base
    for source, target in (("a_split", "a_unit_split"), ("b_split", "b_unit_split"), ("structure", "word_structure")):
        refs = split_references(base, "word_id", source, known, shift)
        bad = F.exists("ids", lambda x: (x < 0) | beyond(x) | alien(x))
        refs = refs.select("word_id", F.when(bad, F.raise_error(F.lit("invalid word id"))).otherwise(F.col("ids")).alias(target))
        out = out.join(refs, "word_id")
    lexicon = with_dictionary_forms(out).drop("a_split", "b_split", "structure")
    return lexicon, pos


def header(spark: SparkSession, user: bool, description: str = "") -> DataFrame:
    """One row: version, kind (system or user), when it was made (seconds), description (256 bytes at most)."""
    if len(description.encode()) > 256:
        raise ValueError("the description is longer than 256 bytes")
    kind = "user" if user else "system"
    return spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(kind).alias("kind"), F.unix_timestamp().alias("created"), F.lit(description).alias("description"))


def checked_header(spark: SparkSession, target: str, user: bool) -> None:
    """Fail unless the folder holds a dictionary of this version and kind."""
    meta = spark.read.parquet(f"{target}/meta").first()
    if meta is None or meta.version != VERSION or meta.kind != ("user" if user else "system"):
        raise ValueError(f"invalid dictionary: {target} is not a {'user' if user else 'system'} dictionary of version {VERSION}")


def build(spark: SparkSession, csv_paths, matrix_path: str | None, target: str, user: bool = False, description: str = "", system: str | None = None) -> None:
    """Build a dictionary into Parquet tables under ``target``. A user dictionary has no connection costs of its own; its
    split references may name words of ``system``, the folder of the system dictionary."""
    if system:
        checked_header(spark, system, False)
    meta = header(spark, user, description)
    lexicon, pos = built(lexicon_csv(spark, csv_paths), int(user), spark.read.parquet(f"{system}/lexicon") if system else None)
    lexicon.write.mode("overwrite").parquet(f"{target}/lexicon")
    pos.write.mode("overwrite").parquet(f"{target}/pos")
    matrix = connection_text(spark, matrix_path) if matrix_path else spark.createDataFrame([], "left int, right int, cost int")
    matrix.write.mode("overwrite").parquet(f"{target}/connection")
    meta.write.mode("overwrite").parquet(f"{target}/meta")


def words_of(lexicon: DataFrame) -> list[Word]:
    """A lexicon's rows for workers, in order; their number and the bytes of their texts are checked before."""
    columns = [*CARRIED, "a_unit_split", "b_unit_split"]
    texts = [c for c, t in lexicon.select(*CARRIED).dtypes if t == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0))
    n, total = lexicon.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n > BROADCAST_ROWS or total > BROADCAST_BYTES:
        raise ValueError(f"the lexicon has over {BROADCAST_ROWS} rows or {BROADCAST_BYTES} bytes, more than workers hold: use tokenized_by_join")
    words = []
    for r in sorted(lexicon.select(*columns).collect(), key=lambda r: (r["dict_id"], r["word_id"])):
        row = r.asDict()
        row["pos"] = tuple(row["pos"].split(",")) if isinstance(row["pos"], str) else tuple(row["pos"] or ())
        words.append(Word(**row | {k: tuple(row[k] or ()) for k in ("a_unit_split", "b_unit_split")}))
    return words


def connections(table: DataFrame) -> Connection:
    """Connection costs for workers: two bytes a cell, checked against a bound before they are collected."""
    left, right, n = table.agg(F.coalesce(F.max("left"), F.lit(-1)), F.coalesce(F.max("right"), F.lit(-1)), F.count("*")).first()
    if 2 * (left + 1) * (right + 1) > MATRIX_BYTES:
        raise ValueError(f"a connection table of {left + 1} x {right + 1} takes more than {MATRIX_BYTES} bytes")
    got = table.select("left", "right", "cost").toArrow()
    return Connection(*(got.column(c).to_numpy() for c in ("left", "right", "cost")))


def snapshot(lexicon: DataFrame, connection: DataFrame, **settings) -> Dictionary:
    """A dictionary for workers, from tables whose size is checked. ``lexicon`` has CARRIED and the unit splits."""
    return Dictionary(words_of(lexicon), connections(connection), **settings)


def parts_of_speech(spark: SparkSession, target: str) -> list[tuple]:
    return [tuple(r.pos.split(",")) for r in spark.read.parquet(f"{target}/pos").orderBy("pos_id").collect()]


def user_lexicon(spark: SparkSession, target: str, dict_id: int) -> DataFrame:
    """A user dictionary's lexicon under the number that it gets here: its own units go along, the system's stay."""
    lexicon = spark.read.parquet(f"{target}/lexicon").withColumn("dict_id", F.lit(dict_id))
    return lexicon.withColumns({c: rebased_split(F.col(c), F.lit(dict_id)) for c in ("a_unit_split", "b_unit_split", "word_structure")})


def with_user(spark: SparkSession, d: Dictionary, lexicon: DataFrame, parts: list[tuple]) -> Dictionary:
    """The dictionary with a user lexicon. Words without a cost get one from the path of their surface through what is
    there so far. Parts of speech are joined by name: those that are new get the next ids."""
    words = words_of(lexicon)
    blank = [(w.packed, w.surface) for w in words if w.cost == NO_COST]
    if blank:
        costs = dict(map(tuple, auto_costs(spark.createDataFrame(blank, "id long, surface string"), d, "id").select("id", "cost").collect()))
        words = [replace(w, cost=costs.get(w.packed, w.cost)) if w.cost == NO_COST else w for w in words]
    new = [p for p in parts if p not in d.pos_ids]
    return d.with_words(words, new)


def load(spark: SparkSession, target: str, users: tuple[str, ...] = (), **settings) -> Dictionary:
    """A system dictionary and user dictionaries, in order."""
    if len(users) + 1 > MAX_DICTIONARIES:
        raise ValueError(f"at most {MAX_DICTIONARIES} dictionaries")
    checked_header(spark, target, False)
    d = snapshot(spark.read.parquet(f"{target}/lexicon"), spark.read.parquet(f"{target}/connection"), parts=parts_of_speech(spark, target), **settings)
    for i, u in enumerate(users, 1):
        checked_header(spark, u, True)
        d = with_user(spark, d, user_lexicon(spark, u, i), parts_of_speech(spark, u))
    lost = sorted({u for w in d.words for u in (*w.a_unit_split, *w.b_unit_split) if u not in d.by_id})
    if lost:
        raise ValueError(f"invalid word id {lost[0]}")
    return d


def configured(spark: SparkSession, path: str | None = None, target: str | None = None, users: tuple[str, ...] = ()) -> Dictionary:
    """The dictionary that a settings file describes; ``target`` and ``users`` go before what it names. Without any
    dictionary all words are unknown."""
    config = settings_file(path)
    target = target or beside(config, config["systemDict"])
    users = users or tuple(beside(config, u) for u in config["userDict"])
    parts = parts_of(config)
    return load(spark, target, users, **parts) if target else Dictionary(**parts)
