"""SentencePiece BPE encoding and decoding through a prefix table.

In a merge-type (BPE) vocabulary the encoding of a prefix has exactly one last token, and a token sequence is an
encoding exactly if each adjacent pair is the encoding of its own concatenation. So one left-to-right pass over
an automaton's matches stores, for every prefix, the one matching token that is compatible with the last token of
what stands before it; the ids are then recovered backwards. No merge loop runs over a text.

A piece never has a space mark behind another character, so a text falls into words (a space mark and what follows
it, or several marks in a row and what follows them) that can be encoded on their own; a worker remembers the shorter
ones that it has seen. Merges of equal score go from left to right, which is as good an order as any for the
compatibility of neighbours, so runs of marks, whose pieces tie, need no other way.

Encoding follows the model's own settings: a space mark is put in front, spaces become marks, and a character
without a piece becomes its UTF-8 bytes. Decoding is the inverse; a text that itself holds the mark U+2581 decodes
with a space there, as in the library, and has ``exact`` = false.

Defined results: a null text has null ids, an empty one has none; both are ``exact``. Null or repeated ids of rows
and repeated texts are encoded row by row. An empty table gives an empty result. Extra columns are ignored by
``encode`` and kept by ``with_pieces``; columns ``ids``, ``n_ids`` and ``exact`` of its input are replaced.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.common import arrow, pick, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words, and token pairs, remembered in each of a worker's two generations, and characters of such a word at most, so that
#: memory is bounded (results don't depend on it).
REMEMBERED = 160_000
LONGEST = 48

RESULT = "ids array<int>, n_ids int, exact boolean"


class PieceModel:
    """Tables of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.piece = [m.id_to_piece(i) for i in range(n)]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
        self.byte = {}
        for i in range(n):
            if m.is_byte(i):
                self.byte[int(self.piece[i][3:5], 16)] = i
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = m.unk_id()
        self.special = {i for i in range(n) if special[i]}
        normal = [i for i in range(n) if not special[i] and i not in self.byte_of]
        self.id = {self.piece[i]: i for i in normal}
        self.cost = [-m.get_score(i) for i in range(n)]
        self.single = {p for p in self.id if len(p) == 1}
        self.split: dict[int, tuple[int, int]] = {}
        self.odd: set[int] = set()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1:
                self.automaton.add_word(p, (i, 1))
                continue
            got, last = self._merge(p)
            if got != [p]:
                continue  # never the outcome of merges, so no encoding holds it
            self.automaton.add_word(p, (i, len(p)))
            self.split[i] = (self.id[last[0]], self.id[last[1]])
        for i, parts in self.split.items():
            if any(x in self.split and self.cost[x] >= self.cost[i] for x in parts) or any(x in self.odd for x in parts):
                self.odd.add(i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}  # of words after a space mark
        self.bare: dict[str, list[int]] = {}
        self.words_before: dict[str, list[int]] = {}
        self.bare_before: dict[str, list[int]] = {}
        self.shown = [p.replace(MARK, " ") for p in self.piece]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merge loop itself: best score first, then leftmost; also the last pair merged."""
        s, last = list(text), None
        while True:
            best = None
            for j in range(len(s) - 1):
                i = self.id.get(s[j] + s[j + 1])
                if i is not None and (best is None or self.cost[i] < best[0]):
                    best = (self.cost[i], j)
            if best is None:
                return s, last
            j = best[1]
            last = (s[j], s[j + 1])
            s[j : j + 2] = [s[j] + s[j + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their concatenation.

        The merges that made them are undone from the latest on; a merge across the border that would have
        come before the one just undone rules the pair out.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, ok = left, right, True
        if left in self.odd or right in self.odd:
            ok = self._merge(self.piece[left] + self.piece[right])[0] == [self.piece[left], self.piece[right]]
        else:
            limit, strict = float("inf"), True
            while True:
                across = self.id.get(self.piece[a] + self.piece[b])
                if across is not None and (self.cost[across] < limit or not strict and self.cost[across] == limit):
                    ok = False
                    break
                made_a = self.cost[a] if a in self.split else -1.0
                made_b = self.cost[b] if b in self.split else -1.0
                if made_a < 0 and made_b < 0:
                    break
                if made_a > made_b:
                    limit, strict, a = made_a, True, self.split[a][1]
                else:
                    limit, strict, b = made_b, False, self.split[b][0]
        if len(self.pairs) >= 2 * REMEMBERED:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def _prefix_table(self, text: str) -> list[int]:
        last = [-1] * (len(text) + 1)
        begin = [0] * (len(text) + 1)
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - n
            if start == 0 or last[start] >= 0 and self.compatible(last[start], token):
                last[end], begin[end] = token, start
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at = begin[at]
        return out[::-1]

    def word(self, w: str) -> list[int]:
        out: list[int] = []
        known = ""
        for c in w:
            if c in self.single:
                known += c
            else:
                out += self._prefix_table(known) + self._bytes(c)
                known = ""
        return out + self._prefix_table(known)

    def _bytes(self, c: str) -> list[int]:
        return [self.byte.get(b, self.unknown) for b in c.encode()]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[list[int]] = []
        get = self.words.get
        for line_no, line in enumerate(text.replace(MARK, " ").split("\n")):
            parts = line.split(" ")
            if line_no:  # a line break has no piece, so nothing merges across it
                out.append(self._newline())
                if parts[0]:
                    out.append(self._known("", parts[0]))
            if "" in (parts[1:] if line_no else parts):
                out += [self._known("", g) for g in self._groups(parts, bool(line_no))]
                continue
            rest = parts[1:] if line_no else parts
            ids = [get(p) for p in rest]
            if None in ids:
                ids = [self._known(MARK, p) if x is None else x for p, x in zip(rest, ids)]
            out += ids
        return list(chain.from_iterable(out))

    @staticmethod
    def _groups(parts: list[str], later: bool) -> list[str]:
        """Words of a line with several spaces in a row: marks in a row and what follows them stay together."""
        out, now = [], ""
        for p in parts[1:] if later else parts:
            if now and now[-1] != MARK:
                out.append(now)
                now = ""
            now += MARK + p
        return [*out, now] if now else out

    def _known(self, mark: str, w: str) -> list[int]:
        if len(w) > LONGEST:
            return self.word(mark + w)
        words, before = (self.words, self.words_before) if mark else (self.bare, self.bare_before)
        ids = words.get(w)
        if ids is None:
            if len(words) >= REMEMBERED:  # the older half is forgotten; what is still in use moves up
                before.clear()
                before.update(words)
                words.clear()
            ids = before.get(w)
            words[w] = ids = self.word(mark + w) if ids is None else ids
        return ids

    def _newline(self) -> list[int]:
        return [self.id["\n"]] if "\n" in self.id else self._bytes("\n")

    def decode(self, ids) -> str:
        """Text of the ids: bytes joined as UTF-8 (invalid ones as U+FFFD), the leading mark dropped."""
        shown, byte_of = self.shown, self.byte_of
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            if i not in self.special:
                out.append(shown[i])
            elif i == self.unknown:
                out.append(" ⁇ ")
        if pending:
            out.append(pending.decode(errors="replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def model(path: str = MODEL) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _encoded(path: str):
    def run(batches):
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = part.column(part.num_columns - 1)
                flat, ends, exact, size = [], [0], [], 0
                for t in text.to_pylist():
                    ids = [] if t is None else m.encode(t)
                    flat.append(np.array(ids, np.int32))
                    size += len(ids)
                    ends.append(size)
                    exact.append(t is None or m.decode(ids) == t)
                null = text.is_null()
                values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), values, mask=null)
                n = pa.array(np.diff(ends).astype(np.int32), mask=np.array(null))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, ids, n, pa.array(exact)], [*part.schema.names[:-1], "ids", "n_ids", "exact"])

    return run


def _decoded(path: str):
    def run(batches):
        m = model(path)
        for batch in batches:
            text = [None if x is None else m.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids, and whether decoding the ids gives the text back."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    return docs.transform(arrow, _encoded(path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    encoded = pick(encoded, doc_id=id_col, ids=ids_col)
    return encoded.transform(arrow, _decoded(path), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def with_pieces(docs: DataFrame, text_col: str = "text", path: str = MODEL) -> DataFrame:
    """The rows with ids, n_ids and exact added, in the same pass that reads them."""
    keep = [c for c in docs.columns if c not in ("ids", "n_ids", "exact")]
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", " + RESULT
    out = named.transform(arrow, _encoded(path), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "ids", "n_ids", "exact")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
