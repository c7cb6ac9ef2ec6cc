"""Many texts at once: the lattice falls apart into words that nothing competes with, and the stretches between them.

A text's word starts cut it into units (a run of an alphabetic script, or a character). A headword begins and ends at
word starts, and whether one stands inside it depends on its own characters alone, so it matches where its units do. A
unit that no longer match covers and that has one word at most is a single node that every path goes through: its
neighbours decide nothing about it. What is left are stretches of units with a choice; each is solved by ``solve`` from
the right id before it to the left id behind it, once for all its occurrences among the texts. All else is arrays.

This holds where unknown words come from ``SimpleOov`` alone, which proposes a unit. Costs are compared within a stretch,
as all paths share what is outside. An inhibited edge between single nodes leaves the text without a path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from morphlake.functions.normalize import DefaultRewriter, MarkCollapser, rewrite
from morphlake.operators.chars import word_starts
from morphlake.operators.lexicon import INHIBITED
from morphlake.operators.oov import SimpleOov

#: Bytes of text that are worked on at once, unless one text has more.
SLICE_BYTES = 512 << 10
#: Pieces that are remembered between slices.
PIECES = 200_000
_OTHER = np.uint32(0xFFFFFFFF)


def applies(d) -> bool:
    return len(d.providers) == 1 and type(d.providers[0]) is SimpleOov


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, slice) of a column of strings, so that a slice's texts have about so many bytes."""
    if len(column):
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield at, column.slice(at, end - at)
            at = end


def strings(data, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data))


def cut_out(data, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings [begin, end) of UTF-8 bytes."""
    if len(begin) and (begin[1:] == end[:-1]).all():
        return strings(data, np.append(begin, end[-1]))
    size = end - begin
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return strings(np.frombuffer(data, np.uint8)[at].tobytes(), np.concatenate([[0], ends]))


def byte_starts(cp: np.ndarray) -> np.ndarray:
    """Where each character begins in UTF-8, and where the last one ends."""
    out = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=out[1:])
    return out


class Units:
    """Texts, one behind the other, cut at their word starts."""

    def __init__(self, cp: np.ndarray, starts: np.ndarray, categories):
        """``starts``: where each text begins, and where the last one ends."""
        self.text = cp.tobytes().decode("utf-32-le")
        self.data = self.text.encode()
        self.byte_at = byte_starts(cp)
        bow = word_starts(categories.table[np.minimum(cp, len(categories.table) - 1)])
        bow[starts[:-1][starts[:-1] < starts[1:]]] = True
        begin = np.flatnonzero(bow)
        self.begin = np.append(begin, len(cp))
        self.first = np.searchsorted(begin, starts)  # each text's first unit, and the number of units
        self.of_text = np.repeat(np.arange(len(starts) - 1), np.diff(self.first))

    def strings(self) -> pa.Array:
        return strings(self.data, self.byte_at[self.begin])


class Headwords:
    """The headwords of a dictionary as sequences of units."""

    def __init__(self, d):
        heads = [(h, w) for h, w in d.index.items() if h]
        cp = np.frombuffer("".join(h for h, _ in heads).encode("utf-32-le"), np.uint32)
        units = Units(cp, np.concatenate([[0], np.cumsum([len(h) for h, _ in heads], dtype=np.int64)]).astype(np.int64), d.categories)
        coded = units.strings().dictionary_encode()
        self.known, code = coded.dictionary, coded.indices.to_numpy()
        n = len(self.known)
        self.single = np.zeros(n + 1, np.int64)  # words of one unit; the last entry is that of unknown units
        self.begins = np.zeros(n + 1, bool)
        self.only: dict[int, object] = {}
        step: dict[int, int] = {}
        ends = [False]
        for (_, words), a, b in zip(heads, units.first.tolist(), units.first[1:].tolist()):
            own = code[a:b].tolist()
            if len(own) == 1:
                self.single[own[0]] = len(words)
                if len(words) == 1:
                    self.only[own[0]] = words[0]
                continue
            self.begins[own[0]] = True
            node = 0
            for u in own:
                node = step.setdefault(node * n + u, len(ends))
                if node == len(ends):
                    ends.append(False)
            ends[node] = True
        self.ends = np.array(ends)
        self.keys = np.array(sorted(step), np.int64)
        self.nodes = np.array([step[k] for k in sorted(step)], np.int64)
        oov = d.providers[0]
        self.left, self.right = np.full(n + 1, oov.left_id, np.int64), np.full(n + 1, oov.right_id, np.int64)
        for u, w in self.only.items():
            self.left[u], self.right[u] = w.left_id, w.right_id
        self.inhibited = [(int(a), int(b)) for a, b in _inhibited(d.connection)]

    def codes(self, units: Units) -> np.ndarray:
        if not len(self.known):
            return np.full(len(units.begin) - 1, -1)
        return pc.fill_null(pc.index_in(units.strings(), value_set=self.known), -1).to_numpy(zero_copy_only=False)

    def covered(self, code: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Units in a match of several. ``limit``: behind the last unit of each unit's text."""
        at = np.flatnonzero(self.begins[code])
        out = np.zeros(len(code) + 1, np.int64)
        node, depth, n = np.zeros(len(at), np.int64), 0, len(self.known)
        while len(at):
            inside = at + depth < limit[at]
            at, node = at[inside], node[inside]
            unit = code[at + depth]
            key = node * n + unit
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = (unit >= 0) & (self.keys[where] == key)
            at, node, depth = at[there], self.nodes[where[there]], depth + 1
            whole = at[self.ends[node]]
            if depth > 1:
                np.add.at(out, whole, 1)
                np.add.at(out, whole + depth, -1)
        return np.cumsum(out)[:-1] > 0

    def barred(self, right: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Whether the edge between is inhibited."""
        out = np.zeros(len(right), bool)
        if len(self.inhibited) > 8:
            return np.isin(right << 32 | left & 0xFFFFFFFF, np.array([a << 32 | b & 0xFFFFFFFF for a, b in self.inhibited]))
        for a, b in self.inhibited:
            out |= (right == a) & (left == b)
        return out


def _inhibited(connection):
    table = getattr(connection, "table", None)
    return [k for k, c in connection.items() if c == INHIBITED] if table is None else np.argwhere(table == INHIBITED)


class Rewritten:
    """Texts (none of them null or empty) as the rewriters leave them. ``origin`` leads from a text's character (the text's
    number added: each has an entry for its end) to the original one; None: they are the same."""

    def __init__(self, texts: pa.Array, rewriters: list):
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        self.data = bytes(memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]])
        whole = self.data.decode()
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        self.byte_at = byte_starts(cp)
        self.original = self.starts = starts = np.searchsorted(self.byte_at, offsets.astype(np.int64) - offsets[0])
        self.cp, self.origin = cp, None
        moved = np.zeros(len(texts), bool)
        for r in rewriters:
            if type(r) is DefaultRewriter:
                table = r.steady_codes
                self.cp = table[np.minimum(self.cp, len(table) - 1)]
                odd = np.flatnonzero(self.cp == _OTHER)
                self.cp[odd] = 0
            elif type(r) is MarkCollapser:
                mark = np.zeros(len(cp) + 1, bool)
                for m in map(ord, r.marks):
                    mark[:-1] |= self.cp == m
                odd = np.flatnonzero(mark[:-1] & mark[1:])
                odd = odd[~np.isin(odd + 1, starts)]
            else:
                moved[:] = True
                break
            moved[np.searchsorted(starts, odd, "right") - 1] = True
        if not moved.any():
            return
        parts, origins = [], []
        for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
            if moved[i]:
                new, of = rewrite(whole[a:b], rewriters)
                parts.append(np.frombuffer(new.encode("utf-32-le", "surrogatepass"), np.uint32))
                origins.append(np.array(of, np.int64) + a)
            else:
                parts.append(self.cp[a:b])
                origins.append(np.arange(a, b + 1))
        self.cp, self.origin = np.concatenate(parts), np.concatenate(origins)
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def rewritten(texts: pa.Array, rewriters: list) -> pa.Array:
    """Structs of the original text, the modified one and the offsets into the original, of its end as well."""
    texts = texts.cast(pa.string())
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(size > 0)
    null = texts.is_null().to_numpy(zero_copy_only=False)
    if len(some):
        t = Rewritten(texts.take(pa.array(some)), rewriters)
        count = np.diff(t.starts) + 1
        ends = np.cumsum(count)
        if t.origin is None:
            own = np.arange(ends[-1], dtype=np.int64) - np.repeat(ends - count, count)
        else:
            own = t.origin - np.repeat(t.original[:-1], count)
        data = t.cp.tobytes().decode("utf-32-le").encode()
        new = strings(data, byte_starts(t.cp)[t.starts])
    else:
        count, own, new = np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.string())
    # an empty text has the offset of its end alone
    lengths = np.where(null, 0, 1)
    lengths[some] = count
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = np.zeros(at[-1], np.int32)
    flat[np.repeat(size > 0, lengths)] = own
    place = np.full(len(texts), len(new))
    place[some] = np.arange(len(some))
    modified = pc.if_else(pa.array(null), pa.scalar(None, pa.string()), pa.concat_arrays([new, pa.array([""])]).take(pa.array(place)))
    offsets = pa.ListArray.from_arrays(pa.array(at, mask=np.append(null, False)) if null.any() else pa.array(at), pa.array(flat))
    return pa.StructArray.from_arrays([texts, modified, offsets], ["original", "modified", "offsets"])


class Segmenter:
    """Rows of morphemes (``names`` of MORPHEME's columns) of batches of texts."""

    def __init__(self, d, mode: str, names: list[str], types: list[pa.DataType]):
        self.d, self.mode, self.names, self.types, self.words = d, mode, names, types, d.headwords
        self.at = {id(w): i for i, w in enumerate(d.words)}
        self.packed = np.array([w.packed for w in d.words] or [0], np.int64)
        self.dicts = np.array([w.dict_id for w in d.words] or [0], np.int32)
        self.parts: dict = {}
        self.forms: dict[str, pa.Array] = {}
        self.clear()

    def clear(self) -> None:
        self.codes: dict = {}
        self.ends, self.table = [0], np.empty((0, 5), np.int64)
        self.fresh: list[tuple[int, int, int, int, int]] = []
        oov = self.d.providers[0]
        self.add([(0, -1, -1, oov.cost, self.part(oov.pos))])  # ends with its unit
        self.single = np.full(len(self.words.known) + 1, -1, np.int64)
        self.single[-1] = 0
        self.single[self.words.single == 0] = 0

    def part(self, pos) -> int:
        return self.parts.setdefault(tuple(pos) if pos else None, len(self.parts))

    def add(self, pieces: list[tuple[int, int, int, int, int]]) -> int:
        self.fresh += pieces
        self.ends.append(self.ends[-1] + len(pieces))
        return len(self.ends) - 2

    def added(self, nodes: list) -> int:
        from morphlake.operators.lattice import split

        own = split(nodes, self.d, self.mode)
        return self.add([(x.begin, x.end, -1 if x.word is None else self.at[id(x.word)], x.cost, self.part(x.pos)) for x in own])

    def solved(self, text: str, right: int, left: int) -> int:
        """The number of a stretch's pieces; -1: it has no path."""
        from morphlake.operators.lattice import solve

        key = (text, right, left)
        code = self.codes.get(key)
        if code is None:
            path = solve(text, self.d, before=right, behind=left)
            code = self.codes[key] = self.added(path) if path else -1
        return code

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        """The text's row of each morpheme, and the columns."""
        from morphlake.operators.lattice import Node

        some = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0)
        if not len(some):
            return some, [pa.array([], t) for t in self.types]
        t = Rewritten(texts.cast(pa.string()).take(pa.array(some)), self.d.rewriters)
        if self.ends[-1] > PIECES:
            self.clear()
        units, words = Units(t.cp, t.starts, self.d.categories), self.words
        code = words.codes(units)
        last = units.first[units.of_text + 1]
        choice = (words.single[code] > 1) | words.covered(code, last)
        n = len(code)

        # elements: single nodes, and stretches of units with a choice
        opens = np.zeros(n, bool)
        opens[units.first[:-1][units.first[:-1] < units.first[1:]]] = True
        opens[1:] |= ~(choice[1:] & choice[:-1])
        unit = np.flatnonzero(opens)
        begin, end = units.begin[unit], units.begin[np.append(unit[1:], n)]
        of_text, stretch = units.of_text[unit], choice[unit]
        left, right = words.left[code[unit]], words.right[code[unit]]
        first = np.append(True, of_text[1:] != of_text[:-1])[: len(unit)]
        final = np.append(of_text[1:] != of_text[:-1], True)[: len(unit)]
        before = np.where(first, 0, np.append(0, right[:-1])[: len(unit)])
        behind = np.where(final, 0, np.append(left[1:], 0)[: len(unit)])
        dead = np.zeros(len(texts), bool)
        plain = ~stretch
        dead[of_text[plain & ~(~first & np.append(False, stretch[:-1])[: len(unit)]) & words.barred(before, left)]] = True
        dead[of_text[plain & final & words.barred(right, np.zeros_like(left))]] = True

        coded = self.single[code[unit]]
        for u in np.unique(code[unit[plain & (coded < 0)]]).tolist():
            w = words.only[u]
            self.single[u] = self.added([Node(0, len(w.headword), w.left_id, w.right_id, w.cost, w, w.pos)])
        coded = self.single[code[unit]]
        for e in np.flatnonzero(stretch).tolist():
            got = self.solved(units.text[begin[e] : end[e]], int(before[e]), int(behind[e]))
            if got < 0:
                dead[of_text[e]] = True
            coded[e] = got
        if dead.any():
            alive = ~dead[of_text]
            begin, end, of_text, coded, unit = begin[alive], end[alive], of_text[alive], coded[alive], unit[alive]
        return self.columns(t, units, some, begin, end, of_text, coded)

    def columns(self, t: Rewritten, units: Units, some: np.ndarray, begin: np.ndarray, end: np.ndarray, of_text: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        if self.fresh:
            self.table, self.fresh = np.concatenate([self.table, np.array(self.fresh, np.int64)]), []
        ends = np.array(self.ends)
        count = ends[coded + 1] - ends[coded]
        of = np.repeat(np.arange(len(coded)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + ends[coded][of]
        b, e, word, cost, part = self.table[at].T
        a, z, of_text = begin[of] + b, np.where(e < 0, end[of], begin[of] + e), of_text[of]
        unknown = word < 0
        oa, oz = (a, z) if t.origin is None else (t.origin[a + of_text], t.origin[z + of_text])
        starts = t.original[of_text]
        number = np.arange(len(of_text))

        def form(name: str, other) -> pa.Array:
            if name not in self.forms:
                self.forms[name] = pa.array([getattr(w, name) for w in self.d.words] or [None], pa.string())
            return pc.if_else(pa.array(unknown), other, self.forms[name].take(pa.array(np.maximum(word, 0))))

        def seen() -> pa.Array:
            return cut_out(units.data, units.byte_at[a], units.byte_at[z])

        kinds = [list(p) if p else None for p in self.parts]
        make = {
            "idx": lambda: pa.array((number - np.searchsorted(of_text, of_text)).astype(np.int32)),
            "begin": lambda: pa.array((oa - starts).astype(np.int32)),
            "end": lambda: pa.array((oz - starts).astype(np.int32)),
            "surface": lambda: cut_out(t.data, t.byte_at[oa], t.byte_at[oz]),
            "pos": lambda: pa.array(kinds, pa.list_(pa.string())).take(pa.array(part)),
            "pos_id": lambda: pa.array([None if p is None else self.d.pos_ids.get(tuple(p)) for p in kinds], pa.int32()).take(pa.array(part)),
            "normalized_form": lambda: form("normalized_form", seen()),
            "dictionary_form": lambda: form("dictionary_form", seen()),
            "reading_form": lambda: form("reading_form", ""),
            "word_id": lambda: pa.array(np.where(unknown, 0, self.packed[word])),
            "dictionary_id": lambda: pa.array(self.dicts[word], mask=unknown),
            "is_oov": lambda: pa.array(unknown),
            "cost": lambda: pa.array(cost.astype(np.int32)),
        }
        return some[of_text], [make[name]() for name in self.names]
