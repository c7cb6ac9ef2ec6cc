"""Minimum-cost segmentation over a lattice of lexicon and out-of-vocabulary candidates.

One text is one lattice, solved in one left-to-right pass: candidates are generated, connected to their best
predecessor, and never looked at again. The earliest inserted of equally good predecessors wins. Insertion order is
position, then lexicon (user dictionaries first, shorter words first, lower ids first), then the providers in order.

The pass runs inside ``mapInArrow``: no shuffle, no state between rows, so the same plan serves batch and streams.
A lexicon whose checked size allows it is broadcast (``tokenized``); beyond that size the candidates come from an
equi-join and are brought together per text (``tokenized_by_join``).

A null or empty text has no rows. A text whose end can't be reached (all edges inhibited) has none either.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.functions.categories import DEFAULT_RANGES, MASK, Categories
from morphlake.functions.normalize import default_chain, rewrite, rewrite_text
from morphlake.operators.chars import candidate_lengths, runs_of, word_starts
from morphlake.operators.lexicon import INHIBITED, MAX_DICTIONARIES, USER_SHIFT, packed, prefix_lookup
from morphlake.operators.oov import SimpleOov
from morphlake.operators.segments import Headwords, Segmenter, applies, slices

#: A lexicon is broadcast up to so many rows (about 400 bytes each in a worker) and bytes of its texts.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 512 << 20
#: Connection costs take two bytes a cell, of as many cells as the greatest ids make.
MATRIX_BYTES = 1 << 30

MORPHEME = (
    "idx int, begin int, end int, surface string, pos array<string>, pos_id int, normalized_form string, dictionary_form string, reading_form string, "
    "word_id long, dictionary_id int, is_oov boolean, cost int"
)


class NoMorpheme(ValueError):
    """No candidate begins at a reachable position."""


@dataclass(frozen=True)
class Word:
    """A lexicon row as a worker sees it. ``units``: the words themselves that it splits into, where they come with it."""

    dict_id: int
    word_id: int
    headword: str
    left_id: int
    right_id: int
    cost: int
    surface: str
    pos: tuple
    normalized_form: str
    dictionary_form: str
    reading_form: str
    a_unit_split: tuple = ()
    b_unit_split: tuple = ()
    units: tuple = ()

    @property
    def packed(self) -> int:
        return (self.dict_id << USER_SHIFT) | self.word_id

    @property
    def priority(self) -> int:
        return self.dict_id or MAX_DICTIONARIES


@dataclass
class Node:
    begin: int
    end: int
    left_id: int
    right_id: int
    cost: int
    word: Word | None = None
    pos: tuple | None = None
    total: int | None = None  # None: no predecessor


class View:
    """What candidates need to know about a (rewritten) text."""

    def __init__(self, text: str, categories: Categories):
        mask = categories.masks(text)
        can_bow = word_starts(mask)
        self.text = text
        self.mask = mask.tolist()
        self.can_bow = can_bow.tolist()
        self.run_length = runs_of(mask).tolist()
        self.candidate_length = candidate_lengths(can_bow).tolist()


class Connection:
    """Connection costs as a table of 16-bit numbers by (left, right); absent is 0."""

    def __init__(self, left=(), right=(), cost=()):
        left, right, cost = (np.asarray(x, np.int64) for x in (left, right, cost))
        shape = (int(left.max(initial=-1)) + 1, int(right.max(initial=-1)) + 1)
        if 2 * shape[0] * shape[1] > MATRIX_BYTES:
            raise ValueError(f"a connection table of {shape[0]} x {shape[1]} takes more than {MATRIX_BYTES} bytes")
        self.table = np.zeros(shape, np.int16)
        self.table[left, right] = cost

    def get(self, pair: tuple[int, int], default: int = 0) -> int:
        left, right = pair
        return int(self.table[left, right]) if 0 <= left < self.table.shape[0] and 0 <= right < self.table.shape[1] else default


@dataclass
class Dictionary:
    """Words, connection costs (absent: 0), the configured text rewriters and providers, and parts of speech by id."""

    words: list[Word] = field(default_factory=list)
    connection: dict[tuple[int, int], int] | Connection = field(default_factory=dict)
    ranges: list = field(default_factory=lambda: DEFAULT_RANGES)
    rewriters: list = field(default_factory=default_chain)
    providers: list = field(default_factory=lambda: [SimpleOov()])
    parts: list[tuple] = field(default_factory=list)

    def with_words(self, words: list[Word], parts: list[tuple]) -> Dictionary:
        """With another dictionary's words and parts of speech; the caches are made anew."""
        return replace(self, words=[*self.words, *words], parts=[*self.parts, *parts])

    @cached_property
    def categories(self) -> Categories:
        return Categories(self.ranges)

    @cached_property
    def index(self) -> dict[str, list[Word]]:
        out: dict[str, list[Word]] = {}
        for w in self.words:
            if w.headword is not None:
                out.setdefault(w.headword, []).append(w)
        return out

    @cached_property
    def lengths(self) -> dict[str, list[int]]:
        out: dict[str, set[int]] = {}
        for h in self.index:
            out.setdefault(h[0], set()).add(len(h))
        return {c: sorted(n) for c, n in out.items()}

    @cached_property
    def by_id(self) -> dict[int, Word]:
        return {w.packed: w for w in self.words}

    @cached_property
    def headwords(self) -> Headwords:
        return Headwords(self)

    @cached_property
    def pos_ids(self) -> dict[tuple, int]:
        """The first id of each part of speech."""
        known = self.parts or list(dict.fromkeys(w.pos for w in sorted(self.words, key=lambda w: w.packed)))
        out: dict[tuple, int] = {}
        for i, pos in enumerate(known):
            out.setdefault(tuple(pos), i)
        return out

    @cached_property
    def edges(self) -> dict[tuple[int, int], int]:
        """Connection costs looked up so far."""
        return {}

    def lookup(self, text: str, at: int) -> list[tuple[int, Word]]:
        """(end, word) of every word that begins here, in insertion order."""
        lengths = self.lengths.get(text[at])
        if not lengths:
            return []
        index, last = self.index, len(text) - at
        found = [(at + n, w) for n in lengths if n <= last for w in index.get(text[at : at + n], ())]
        return sorted(found, key=lambda x: (x[1].priority, x[0], x[1].word_id)) if len(found) > 1 else found

    def units(self, word: Word, mode: str) -> list[Word]:
        """Words of mode A or B, if there are several."""
        if word.units:
            return list(word.units)
        ids = word.a_unit_split if mode == "A" else word.b_unit_split
        return [self.by_id[u] for u in ids] if len(ids) > 1 else []


def solve(text: str, d: Dictionary, lookup=None, log: list | None = None, before: int = 0, behind: int = 0) -> list[Node]:
    """Best path of one rewritten text. ``log`` gets all nodes in insertion order (the lattice dump). ``before`` and
    ``behind``: right id of what stands before it, left id of what stands behind it.

    Nodes are numbers into parallel lists. Candidates at one position with the same left id have the same best
    predecessor, which is looked for once.
    """
    view = View(text, d.categories)
    n = len(text)
    lookup = lookup or d.lookup
    edges, connection = d.edges, d.connection
    nodes: list[tuple] = []  # begin, end, left id, right id, cost, word, pos, total, predecessor
    ends: list[list | None] = [None] * (n + 1)  # connected nodes that end here: (total, right id, number); None: no node at all
    ends[0] = [(0, before, -1)]
    mask, can_bow = view.mask, view.can_bow
    barred = MASK["NOOOVBOW"]

    def best(before: list, left_id: int) -> tuple:
        least, at = None, -1
        for total, right_id, number in before:
            edge = edges.get((right_id, left_id))
            if edge is None:
                edge = edges[right_id, left_id] = connection.get((right_id, left_id), 0)
            if edge != INHIBITED and (least is None or total + edge < least):
                least, at = total + edge, number
        return least, at

    for i in range(n):
        own_before = ends[i]
        if own_before is None or not can_bow[i]:
            continue
        known: dict[int, tuple] = {}

        def insert(end: int, left_id: int, right_id: int, cost: int, word, pos, i=i, before=own_before, known=known) -> None:
            got = known.get(left_id)
            if got is None:
                got = known[left_id] = best(before, left_id)
            total = None if got[0] is None else got[0] + cost
            own = ends[end]
            if own is None:
                own = ends[end] = []
            if total is not None:
                own.append((total, right_id, len(nodes)))
            nodes.append((i, end, left_id, right_id, cost, word, pos, total, got[1]))

        some = False
        for end, w in lookup(text, i):
            if end < n and not can_bow[end]:
                continue
            insert(end, w.left_id, w.right_id, w.cost, w, w.pos)
            some = True
        if not mask[i] & barred:
            for p in d.providers:
                for length, left, right, cost, pos in p.candidates(i, some, view):
                    insert(i + length, left, right, cost, None, pos)
                    some = True
        if not some and d.providers:
            for length, left, right, cost, pos in d.providers[-1].candidates(i, False, view):
                insert(i + length, left, right, cost, None, pos)
                some = True
        if not some:
            raise NoMorpheme(f"there is no morpheme at {i}")
    at = best(ends[n] or [], behind)[1] if n else -1
    path: list[int] = []
    while at >= 0:
        path.append(at)
        at = nodes[at][8]
    if log is not None:
        made = [Node(*x[:8]) for x in nodes]
        log += made
        return [made[k] for k in path[::-1]]
    return [Node(*nodes[k][:8]) for k in path[::-1]]


def split(path: list[Node], d: Dictionary, mode: str) -> list[Node]:
    """Modes A and B: a word of several units gives way to them; C leaves the path as it is."""
    if mode == "C":
        return path
    out: list[Node] = []
    for node in path:
        units = [] if node.word is None else d.units(node.word, mode)
        if not units:
            out.append(node)
            continue
        at = node.begin
        for w in units:
            end = min(at + len(w.headword or w.surface), node.end)  # units don't reach beyond their word
            out.append(Node(at, end, 0, 0, 0, w, w.pos))
            at = end
    return out


def morphemes(text: str | None, d: Dictionary, mode: str = "C", lookup=None) -> list[tuple]:
    """Rows of MORPHEME for one text."""
    if not text:
        return []
    modified, offsets = rewrite(text, d.rewriters)
    out = []
    for i, node in enumerate(split(solve(modified, d, lookup), d, mode)):
        a, b = offsets[node.begin], offsets[node.end]
        w, seen = node.word, modified[node.begin : node.end]
        fields = (seen, seen, "") if w is None else (w.normalized_form, w.dictionary_form, w.reading_form)
        pos = list(node.pos) if node.pos else None
        out.append((i, a, b, text[a:b], pos, pos and d.pos_ids.get(tuple(pos)), *fields, 0 if w is None else w.packed, None if w is None else w.dict_id, w is None, node.cost))
    return out


_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32()]
_NAMES = [x.split()[0] for x in MORPHEME.split(", ")]


def _batch(key: pa.Array, key_name: str, per_row: list[list[tuple]], names: list[str] = _NAMES, types: list = _TYPES, at: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of the texts as a batch. ``at``: the list of each row of the key, if rows share them."""
    columns = [pa.array([r[j] for rows in per_row for r in rows], t) for j, t in enumerate(types)]
    counts = np.array([len(rows) for rows in per_row], np.int64)
    if at is None:
        return pa.RecordBatch.from_arrays([key.take(pa.array(np.repeat(np.arange(len(per_row)), counts))), *columns], [key_name, *names])
    own = counts[at]
    of = np.repeat(np.arange(len(at)), own)
    where = pa.array(np.arange(len(of)) - np.repeat(np.cumsum(own) - own, own) + (np.cumsum(counts) - counts)[at][of])
    return pa.RecordBatch.from_arrays([key.take(pa.array(of)), *(c.take(where) for c in columns)], [key_name, *names])


def _different(texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """The different texts, and which of them each row has: equal texts are solved once."""
    coded = texts.dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _shared(df: DataFrame, dictionary: Dictionary):
    if len(dictionary.words) > BROADCAST_ROWS:
        raise ValueError(f"the lexicon has over {BROADCAST_ROWS} rows: use tokenized_by_join")
    return df.sparkSession.sparkContext.broadcast(dictionary)


def tokenized(df: DataFrame, dictionary: Dictionary, id_col: str, text_col: str = "text", mode: str = "C", errors: str = "raise", columns: list[str] | None = None) -> DataFrame:
    """(id, MORPHEME...) of every text, in one narrow pass. ``errors``: "raise", or "skip" texts without a morpheme;
    ``columns``: those of MORPHEME that are wanted, in its order (all)."""
    shared = _shared(df, dictionary)
    wanted = [j for j, name in enumerate(_NAMES) if columns is None or name in columns]
    names, types = [_NAMES[j] for j in wanted], [_TYPES[j] for j in wanted]

    def run(batches):
        d = shared.value
        segmenter = Segmenter(d, mode, names, types) if applies(d) else None
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                key = batch.column(0).slice(first, len(texts))
                if segmenter:
                    at, made = segmenter.rows(texts)
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(at)), *made], [id_col, *names])
                    continue
                different, at = _different(texts)
                per_text = [[tuple(m[j] for j in wanted) for m in _guarded(t, d, mode, errors)] for t in different]
                yield _batch(key, id_col, per_text, names, types, at)

    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join(x for j, x in enumerate(MORPHEME.split(", ")) if j in wanted)
    return df.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"{id_col} {kind}, {schema}")


def _guarded(text, d: Dictionary, mode: str, errors: str, lookup=None) -> list[tuple]:
    try:
        return morphemes(text, d, mode, lookup)
    except NoMorpheme:
        if errors == "raise":
            raise
        return []


def line_of(m: tuple, print_all: bool) -> str:
    """The tab-separated line of a morpheme (a row of MORPHEME)."""
    _, _, _, surface, pos, _, normalized, dictionary, reading, _, dictionary_id, is_oov, _ = m
    cells = [surface, ",".join(pos or ()), normalized]
    if print_all:
        cells += [dictionary, reading, str(-1 if dictionary_id is None else dictionary_id), *(["(OOV)"] if is_oov else [])]
    return "\t".join(cells)


def printed_texts(df: DataFrame, dictionary: Dictionary, text_col: str = "text", mode: str = "C", print_all: bool = False, errors: str = "raise") -> DataFrame:
    """Output lines (value) of the texts in their order, EOS after each: one narrow pass, for batches and streams."""
    shared = _shared(df, dictionary)

    def run(batches):
        d = shared.value
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                different, at = _different(texts)
                lines = [[*((line_of(m, print_all),) for m in _guarded(t, d, mode, errors)), ("EOS",)] for t in different]
                yield _batch(texts, "text", lines, ["value"], [pa.string()], at).select(["value"])

    return df.select(F.col(text_col).alias("__text")).mapInArrow(run, "value string")


#: Columns of a lexicon table that a candidate carries.
CARRIED = ["dict_id", "word_id", "headword", "left_id", "right_id", "cost", "surface", "pos", "normalized_form", "dictionary_form", "reading_form"]


def with_units(lexicon: DataFrame, mode: str) -> DataFrame:
    """Add ``units``: the words that a word splits into in this mode (empty: it stays whole). Joins of the lexicon with
    itself, before any text is seen."""
    column = {"A": "a_unit_split", "B": "b_unit_split"}.get(mode)
    none = F.array().cast(f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in lexicon.select(*CARRIED).schema)}>>")
    if not column:
        return lexicon.withColumn("units", none)
    refs = lexicon.filter(F.size(column) > 1).select(F.col("dict_id").alias("of_dict"), F.col("word_id").alias("of_word"), F.posexplode(column).alias("ord", "unit"))
    words = lexicon.select(packed(F.col("dict_id"), F.col("word_id")).alias("packed"), F.struct(*CARRIED).alias("w"))
    found = refs.join(words, F.col("unit").cast("long") == F.col("packed")).groupBy("of_dict", "of_word").agg(F.array_sort(F.collect_list(F.struct("ord", "w"))).alias("found"))
    on = (F.col("dict_id") == F.col("of_dict")) & (F.col("word_id") == F.col("of_word"))
    return lexicon.join(found, on, "left").withColumn("units", F.coalesce(F.transform("found", lambda x: x["w"]), none)).drop("of_dict", "of_word", "found")


def tokenized_by_join(df: DataFrame, lexicon: DataFrame, dictionary: Dictionary, id_col: str, text_col: str = "text", mode: str = "C", errors: str = "raise") -> DataFrame:
    """``tokenized`` with a lexicon of any size. ``lexicon`` has the columns CARRIED (and, for modes A and B, the unit
    splits); ``dictionary`` all but the words.

    ``id_col`` names the texts: repeated ids would share their candidates, so it must be a key.
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionary)
    kind = df.schema[id_col].dataType.simpleString()

    @F.pandas_udf("string")
    def modified(texts):
        d = shared.value
        return texts.map(lambda t: rewrite_text(t, d.rewriters), na_action="ignore")

    base = df.select(id_col, F.col(text_col).alias("__text"), modified(F.col(text_col)).alias("__modified"))
    carried = [*CARRIED, "units"]
    found = prefix_lookup(base, id_col, "__modified", with_units(lexicon, mode).select(*carried))
    found = found.groupBy(id_col).agg(F.collect_list(F.struct("begin", "end", *carried)).alias("__found"))
    both = base.select(id_col, "__text").join(found, id_col, "left")

    def word(c: dict) -> Word:
        plain = {k: tuple(c[k] or ()) if k == "pos" else c[k] for k in CARRIED}
        return Word(**plain, units=tuple(word(u) for u in c.get("units") or ()))

    def run(batches):
        d = shared.value
        for batch in batches:
            per_row = []
            for text, cands in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at: dict[int, list] = {}
                for c in cands or ():
                    at.setdefault(c["begin"], []).append((c["end"], word(c)))
                for own in at.values():
                    own.sort(key=lambda x: (x[1].priority, x[0], x[1].word_id))
                per_row.append(_guarded(text, d, mode, errors, lambda _, i, at=at: at.get(i, [])))
            yield _batch(batch.column(0), id_col, per_row)

    return both.select(id_col, "__text", "__found").mapInArrow(run, f"{id_col} {kind}, {MORPHEME}")


def lattice_dump(df: DataFrame, dictionary: Dictionary, id_col: str, text_col: str = "text") -> DataFrame:
    """Every node of every lattice: (id, seq, begin, end, left_id, right_id, cost, total, is_oov, on_path)."""
    shared = _shared(df, dictionary)
    names = ["seq", "begin", "end", "left_id", "right_id", "cost", "total", "is_oov", "on_path"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]

    def nodes(text: str | None, d: Dictionary) -> list[tuple]:
        log: list[Node] = []
        best = {id(x) for x in (solve(rewrite_text(text, d.rewriters), d, log=log) if text else [])}
        return [(s, x.begin, x.end, x.left_id, x.right_id, x.cost, x.total, x.word is None, id(x) in best) for s, x in enumerate(log)]

    def run(batches):
        d = shared.value
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                different, at = _different(texts)
                yield _batch(batch.column(0).slice(first, len(texts)), id_col, [nodes(t, d) for t in different], names, types, at)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("__text")).mapInArrow(
        run, f"{id_col} {kind}, seq int, begin int, end int, left_id int, right_id int, cost int, total long, is_oov boolean, on_path boolean"
    )


def internal_cost(tokens: DataFrame, id_col: str) -> DataFrame:
    """Cost of the last morpheme less that of the first, per text."""
    by = F.struct("idx", "cost")
    return tokens.groupBy(id_col).agg((F.max(by)["cost"] - F.min(by)["cost"]).alias("internal_cost"), F.count("*").alias("n_morphemes"))


def auto_costs(words: DataFrame, dictionary: Dictionary, id_col: str, surface_col: str = "surface", per_morpheme: int = -20) -> DataFrame:
    """Costs of user words that come without one: internal cost of the surface's path, less 20 per morpheme, as i16."""
    keyed = words.select(F.col(id_col).alias("__key"), F.col(surface_col).alias("__surface"))  # a morpheme has a word_id, too
    got = internal_cost(tokenized(keyed, dictionary, "__key", "__surface", columns=["idx", "cost"]), "__key")
    cost = F.col("internal_cost") + per_morpheme * F.col("n_morphemes")
    return got.select(F.col("__key").alias(id_col), F.greatest(F.lit(-32768), F.least(F.lit(32767), cost)).cast("int").alias("cost"))


def printed(tokens: DataFrame, id_col: str, print_all: bool = False) -> DataFrame:
    """The tab-separated line of each morpheme."""
    cells = ["surface", F.array_join("pos", ","), "normalized_form"]
    if print_all:
        cells += ["dictionary_form", "reading_form", F.coalesce("dictionary_id", F.lit(-1)).cast("string")]
    line = F.concat_ws("\t", *cells)
    if print_all:
        line = F.concat(line, F.when(F.col("is_oov"), "\t(OOV)").otherwise(""))
    return tokens.select(id_col, "idx", line.alias("line"))
