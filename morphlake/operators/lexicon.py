"""Dictionary tables: lexicon rows, parts of speech, connections, headword index, split references.

A lexicon row is named by (dict_id, word_id) and has its headword (null if it isn't indexed) with its length in bytes,
the connection ids and the cost, what is shown of it (surface, reading, normalized and dictionary forms), its part of
speech, and the ids of its units for modes A and B and of its structure.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS, MAX_PARTS, MAX_DICTIONARIES = 32767, 127, 16
USER_SHIFT = 28
INHIBITED = 0x7FFF


def unescaped(text: Column) -> Column:
    r"""``\uXXXX`` and ``\u{X...}`` to characters: escapes are cut out, decoded from UTF-32 and put back in between."""
    pattern = r"\\u([0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})"
    codes = F.regexp_extract_all(text, F.lit(pattern), 1)
    between = F.split(text, pattern, -1)
    one = lambda c: F.decode(F.unhex(F.lpad(F.regexp_replace(c, "[{}]", ""), 8, "0")), "UTF-32")
    parts = F.transform(between, lambda s, i: F.concat(s, F.when(i < F.size(codes), one(F.get(codes, i))).otherwise("")))
    return F.when(text.contains("\\u"), F.array_join(parts, "")).otherwise(text)


def pos_table(rows: DataFrame, pos: Column, order: Column) -> DataFrame:
    """(pos_id, pos): distinct parts of speech, numbered in order of first appearance."""
    first = rows.groupBy(pos.alias("pos")).agg(F.min(order).alias("first"))
    return first.select((F.row_number().over(Window.orderBy("first")) - 1).alias("pos_id"), "pos")


def headword_index(lexicon: DataFrame) -> DataFrame:
    """(headword, word_ids): homographs in order of id; headwords in byte order."""
    indexed = lexicon.filter("headword IS NOT NULL")
    return indexed.groupBy("headword").agg(F.sort_array(F.collect_list("word_id")).alias("word_ids")).orderBy("headword")


def with_dictionary_forms(lexicon: DataFrame) -> DataFrame:
    """``dictionary_form`` of each word: the surface of the word it refers to, its own for a negative reference."""
    forms = lexicon.select(F.col("dict_id").alias("fd"), F.col("word_id").alias("fw"), F.col("surface").alias("form"))
    on = (F.col("dict_id") == F.col("fd")) & (F.col("dictionary_form_word_id") == F.col("fw"))
    return lexicon.join(forms, on, "left").withColumn("dictionary_form", F.coalesce("form", "surface")).drop("fd", "fw", "form")


def split_references(words: DataFrame, key_col: str, refs_col: str, lexicon: DataFrame, user_base: int = 0) -> DataFrame:
    """(key, ids) for ``*`` or ``/``-joined references: a word id, ``U`` and a user word id, or an inline
    ``headword,pos x 6,reading`` that is looked up by (surface, pos, reading), the lowest id first.

    ``lexicon``: (word_id, surface, pos, reading_form), pos being the joined six. An unresolved reference is -1.
    """
    refs = words.filter(F.col(refs_col) != "*").select(key_col, F.posexplode(F.split(refs_col, "/")).alias("ord", "ref"))
    numeric = F.regexp_extract("ref", "^U?([0-9]+)$", 1)
    cells = F.split("ref", ",")
    refs = refs.withColumns(
        {
            "direct": F.when(numeric != "", numeric.cast("int") + F.when(F.col("ref").startswith("U"), user_base).otherwise(0)),
            "r_surface": F.when(numeric == "", unescaped(F.get(cells, 0))),
            "r_pos": F.when(numeric == "", F.array_join(F.slice(cells, 2, 6), ",")),
            "r_reading": F.when(numeric == "", F.get(cells, 7)),
        }
    )
    known = lexicon.groupBy("surface", "pos", "reading_form").agg(F.min("word_id").alias("found"))
    on = (F.col("r_surface") == F.col("surface")) & (F.col("r_pos") == F.col("pos")) & (F.col("r_reading") == F.col("reading_form"))
    found = refs.join(known, on, "left").withColumn("id", F.coalesce("direct", "found", F.lit(-1)))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"])
    return words.select(key_col).join(found.groupBy(key_col).agg(ids.alias("ids")), key_col, "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def packed(dict_id: Column, word_id: Column) -> Column:
    return F.shiftleft(dict_id.cast("long"), USER_SHIFT) + word_id


def rebased_split(ids: Column, dict_id: Column) -> Column:
    """Split ids of a user dictionary, as longs: packed ones belong to the dictionary at hand, plain ones to the system's."""
    base = F.shiftleft(dict_id.cast("long"), USER_SHIFT)
    low = (1 << USER_SHIFT) - 1
    return F.transform(ids, lambda x: F.when(x.cast("long") > low, base + x.cast("long").bitwiseAND(low)).otherwise(x.cast("long")))


def united(*lexicons: DataFrame) -> DataFrame:
    """System and user lexicons as one; ``priority`` puts user dictionaries first, in order, the system last."""
    if len(lexicons) > MAX_DICTIONARIES:
        raise ValueError(f"at most {MAX_DICTIONARIES} dictionaries")
    out = lexicons[0]
    for other in lexicons[1:]:
        out = out.unionByName(other)
    return out.withColumn("priority", F.when(F.col("dict_id") == 0, MAX_DICTIONARIES).otherwise(F.col("dict_id")))


def longest(keys: DataFrame, column: str) -> DataFrame:
    """(first, most): the greatest length of the keys that begin with each character."""
    return keys.groupBy(F.substring(column, 1, 1).alias("first")).agg(F.max(F.length(column)).alias("most"))


#: Characters of the windows that are cut from a text at every position; longer headwords are compared with it afterwards.
WINDOW = 32


#: So many different beginnings of headwords go to the workers as hashes (8 bytes each), which leave out what meets none.
FILTER_ROWS = 4_000_000
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (_BASE, _INVERSE))


class Hashes:
    """A rolling hash of the characters of many texts: of any span in constant time."""

    def __init__(self, cp: np.ndarray):
        v = cp.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(29)
        power, self.back = _powers(1 << max(16, len(cp).bit_length()))
        v *= power[: len(cp)]
        self.sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(v, out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.back[begin]


def _beginnings(lexicon: DataFrame) -> tuple[dict[int, list[int]], dict[int, np.ndarray] | None]:
    """First characters (code points) with the lengths of headwords, up to WINDOW, that have them; by length the hashes of
    their first WINDOW characters, unless these are too many."""
    heads = lexicon.filter("headword <> ''").select(F.substring("headword", 1, WINDOW).alias("probe"))
    first = heads.groupBy(F.substring("probe", 1, 1).alias("first")).agg(F.collect_set(F.length("probe")).alias("lens"))
    lens = {ord(r.first): sorted(r.lens) for r in first.collect()}
    if heads.count() > FILTER_ROWS and heads.distinct().count() > FILTER_ROWS:
        return lens, None

    def run(batches):
        from morphlake.operators.segments import Rewritten

        for batch in batches:
            if batch.num_rows:
                t = Rewritten(batch.column(0).cast(pa.string()), [])
                got = Hashes(t.cp).of(t.starts[:-1], t.starts[1:])
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(t.starts).astype(np.int32)), pa.array(got.view(np.int64))], ["n", "h"])

    got = heads.mapInArrow(run, "n int, h long").distinct().toArrow()
    n, h = got.column("n").to_numpy(), got.column("h").to_numpy().view(np.uint64)
    return lens, {k: np.sort(h[n == k]) for k in np.unique(n).tolist()}


def probed(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """(id, begin, n, probe): every start and every length that some headword with this first character has, up to WINDOW
    characters. Where hashes of the headwords fit, only what has the hash of one: nearly nothing else is left to join."""
    from morphlake.operators.segments import Rewritten, cut_out, slices
    from morphlake.sources.shared import small_batches

    small_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(_beginnings(lexicon))
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        lens, hashes = shared.value
        bits = np.zeros(max(lens, default=0) + 2, np.uint32)  # the last entry is that of all other characters
        for first, own in lens.items():
            for n in own:
                bits[first] |= np.uint32(1 << (n - 1))
        every = sorted({n for own in lens.values() for n in own})
        for batch in batches:
            for at, part in slices(batch.column(1)):
                some = np.flatnonzero(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False) > 0)
                if not len(some) or not every:
                    continue
                t = Rewritten(part.cast(pa.string()).take(pa.array(some)), [])
                own, rolling = bits[np.minimum(t.cp, len(bits) - 1)], Hashes(t.cp)
                open_ = np.flatnonzero(own)
                of_text = np.searchsorted(t.starts, open_, "right") - 1
                own, last = own[open_], t.starts[of_text + 1]
                key = batch.column(0).slice(at, len(part))
                for n in every:
                    k = np.flatnonzero((own >> np.uint32(n - 1) & np.uint32(1)).astype(bool) & (open_ + n <= last))
                    if hashes is not None:
                        known, h = hashes[n], rolling.of(open_[k], open_[k] + n)
                        k = k[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
                    begin, text = open_[k], of_text[k]
                    columns = [key.take(pa.array(some[text])), pa.array((begin - t.starts[text]).astype(np.int32)), pa.array(np.full(len(k), n, np.int32)), cut_out(t.data, t.byte_at[begin], t.byte_at[begin + n])]
                    for i in range(0, len(k), 100_000):
                        yield pa.RecordBatch.from_arrays([c.slice(i, 100_000) for c in columns], [id_col, "begin", "n", "probe"])

    return texts.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"{id_col} {kind}, begin int, n int, probe string")


def prefix_lookup(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """Common-prefix search as an equi-join: every start and every length that some headword with this first character
    has, against the headword. Returns (id, begin, end, headword and the lexicon's columns).

    Lengths are bounded per first character, from the lexicon, and hashes sort out nearly all that is no headword before
    anything is joined. Headwords beyond WINDOW characters meet on their first WINDOW; the few matches are then compared
    with the text.
    """
    lex = lexicon.filter("headword IS NOT NULL")
    probes = probed(texts, id_col, text_col, lex)
    met = probes.join(lex.withColumn("probe", F.substring("headword", 1, WINDOW)), "probe").withColumn("end", F.col("begin") + F.length("headword"))
    plain = met.filter(F.length("headword") == F.col("n"))
    longer = met.filter(F.length("headword") > F.col("n")).filter(F.col("n") == WINDOW)
    text = texts.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"))
    longer = longer.join(text, F.col(id_col) == F.col("__id")).filter(F.expr("substring(__t, begin + 1, length(headword)) = headword"))
    columns = ["headword", id_col, "begin", "end", *[c for c in lexicon.columns if c != "headword"]]
    if not lex.agg(F.coalesce(F.max(F.length("headword")), F.lit(0))).first()[0] > WINDOW:
        return plain.select(*columns)
    return plain.select(*columns).union(longer.select(*columns))
