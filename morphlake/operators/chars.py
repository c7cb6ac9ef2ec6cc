"""Texts as character tables: categories, runs, word starts, candidate lengths, offsets.

``exploded`` gives one row per character by built-in functions. What looks along a text (``profiled``) is computed for
all its characters at once in one Arrow pass, where they stand together anyway: no exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.functions.categories import DEFAULT_RANGES, MASK, RUN_SCRIPTS, Categories, code_point, mask_column
from morphlake.sources.shared import small_batches

PROFILE = {"mask": "int", "can_bow": "boolean", "candidate_length": "int", "run_length": "int", "longest_run": "int", "byte_pos": "int"}
#: Characters that an output batch of ``profiled`` holds, unless one text has more.
BATCH = 200_000


def characters(text: Column) -> Column:
    """Array of a text's characters, in code points."""
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def exploded(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, pos, ch, cp): one row per character, without a shuffle."""
    out = df.filter(F.length(text_col) > 0).select(id_col, F.posexplode(characters(F.col(text_col))).alias("pos", "ch"))
    return out.withColumn("cp", code_point(F.col("ch")))


def classified(chars: DataFrame, ranges=DEFAULT_RANGES) -> DataFrame:
    """Add ``mask``."""
    return chars.withColumn("mask", mask_column(F.col("cp"), ranges))


def categories_of(chars: DataFrame, ranges: DataFrame) -> DataFrame:
    """``mask`` from a table of ranges: the range join runs over the distinct code points alone."""
    distinct = chars.select("cp").distinct()
    known = distinct.join(F.broadcast(ranges), (F.col("cp") >= F.col("low")) & (F.col("cp") < F.col("high")), "left")
    masks = known.groupBy("cp").agg(F.coalesce(F.bit_or("mask"), F.lit(MASK["DEFAULT"])).alias("mask"))
    return chars.join(F.broadcast(masks), "cp")  # as many rows as there are different characters at most: 1.1 M


def word_starts(mask: np.ndarray) -> np.ndarray:
    """The first character, and any other unless it goes on a run of an alphabetic script."""
    out = np.ones(len(mask), bool)
    out[1:] = ((mask[1:] & RUN_SCRIPTS) == 0) | ((mask[1:] & mask[:-1]) == 0)
    return out


def candidate_lengths(can_bow: np.ndarray) -> np.ndarray:
    """Characters up to the next word start, or to the end of the text."""
    n = len(can_bow)
    begins = np.append(np.flatnonzero(can_bow), n)
    at = np.arange(n)
    return begins[np.searchsorted(begins, at, side="right")] - at


def runs_of(mask: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Greedy runs from the left: a run goes on while some category is shared by all of it. Remaining characters of
    the run at each position. ``starts``: positions where a text begins, if there are several."""
    n = len(mask)
    if not n:
        return np.empty(0, np.int64)
    # what all neighbours share can only break up further; within such stretches of one mask there is nothing to test
    fresh = np.ones(n, bool)
    fresh[1:] = (mask[1:] & mask[:-1]) == 0
    if starts is not None:
        fresh[starts] = True
    stretch = np.cumsum(fresh) - 1
    bounds = np.append(np.flatnonzero(fresh), n)
    out = bounds[stretch + 1] - np.arange(n)
    for k in np.unique(stretch[1:][(mask[1:] != mask[:-1]) & ~fresh[1:]]).tolist():
        a, b = int(bounds[k]), int(bounds[k + 1])
        i, m = 0, mask[a:b].tolist()
        while i < len(m):
            both, j = m[i], i + 1
            while j < len(m) and both & m[j]:
                both &= m[j]
                j += 1
            out[a + i : a + j] = np.arange(j - i, 0, -1)
            i = j
    return out


def longest_runs(mask: np.ndarray) -> np.ndarray:
    """From each position on its own: characters of the longest stretch that shares a category."""
    n = len(mask)
    out = np.empty(n, np.int64)
    reach: dict[int, int] = {}  # per category: where the stretch of it that covers the position ends
    for i in range(n - 1, -1, -1):
        m = int(mask[i])
        reach = {bit: reach.get(bit, i + 1) for bit in range(m.bit_length()) if m >> bit & 1}
        out[i] = max(reach.values(), default=i + 1) - i
    return out


def byte_positions(text: str) -> np.ndarray:
    """Where each character begins in the UTF-8 text, and the text's end."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    return np.concatenate([[0], np.cumsum(size)])


def next_bytes(text: Column, at: Column, n: int) -> Column:
    """Bytes of the next n characters from a position on, or of as many as there are."""
    return F.octet_length(F.substring(text, at + 1, F.lit(n)))


def substring_of(text: Column, begin: Column, end: Column) -> Column:
    """Characters [begin, end) of a text; bounds outside it are an error."""
    fits = (begin >= 0) & (begin <= end) & (end <= F.length(text))
    return F.when(fits | text.isNull(), F.substring(text, begin + 1, end - begin)).otherwise(F.raise_error(F.lit("a substring's bounds are outside its text")))


def profiled(df: DataFrame, id_col: str, text_col: str = "text", columns: tuple[str, ...] = tuple(PROFILE), ranges=DEFAULT_RANGES) -> DataFrame:
    """(id, pos, ch, the ``columns`` of PROFILE): one row per character, in one narrow pass."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        cats = Categories(ranges)
        for batch in batches:
            rows: list[tuple[int, str]] = []
            size = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    rows.append((i, text))
                    size += len(text)
                if rows and (size > BATCH or i == batch.num_rows - 1):
                    yield table(batch.column(0), rows, cats)
                    rows, size = [], 0

    def table(ids: pa.Array, rows: list[tuple[int, str]], cats: Categories) -> pa.RecordBatch:
        out: dict[str, list[np.ndarray]] = {c: [] for c in columns}
        for _, text in rows:
            m = cats.masks(text)
            bow = word_starts(m)
            for c in columns:
                if c == "mask":
                    got = m
                elif c == "can_bow":
                    got = bow
                elif c == "candidate_length":
                    got = candidate_lengths(bow)
                elif c == "run_length":
                    got = runs_of(m)
                elif c == "longest_run":
                    got = longest_runs(m)
                else:
                    got = byte_positions(text)[:-1]
                out[c].append(got)
        lengths = [len(t) for _, t in rows]
        key = ids.take(pa.array(np.repeat([i for i, _ in rows], lengths)))
        pos = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        ch = pa.array([c for _, t in rows for c in t], pa.string())
        made = [pa.array(np.concatenate(out[c]).astype(bool if PROFILE[c] == "boolean" else np.int32)) for c in columns]
        return pa.RecordBatch.from_arrays([key, pa.array(pos), ch, *made], [id_col, "pos", "ch", *columns])

    schema = f"{id_col} {kind}, pos int, ch string, " + ", ".join(f"{c} {PROFILE[c]}" for c in columns)
    return df.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def summed(df: DataFrame, id_col: str, text_col: str = "text", ranges=DEFAULT_RANGES) -> DataFrame:
    """(id, n_starts, candidate_chars, n_runs) of every text that isn't empty: word starts, the sum of candidate lengths, and
    greedy runs. One row per text, many texts at once, no row per character."""
    from morphlake.operators.segments import Rewritten, slices  # these build on this module

    kind = df.schema[id_col].dataType.simpleString()
    small_batches(df.sparkSession)

    def run(batches):
        cats = Categories(ranges)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                some = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0)
                if not len(some):
                    continue
                t = Rewritten(texts.cast(pa.string()).take(pa.array(some)), [])
                starts = t.starts[:-1]
                mask = cats.table[np.minimum(t.cp, len(cats.table) - 1)]
                bow = word_starts(mask)
                bow[starts] = True
                begin = np.flatnonzero(bow)
                length = np.diff(np.append(begin, len(mask)))
                units = np.searchsorted(begin, starts)
                made = [np.add.reduceat(x, at) for x, at in ((np.ones_like(length), units), (length * (length + 1) // 2, units), ((runs_of(mask, starts) == 1).astype(np.int64), starts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)).take(pa.array(some)), *map(pa.array, made)], [id_col, "n_starts", "candidate_chars", "n_runs"])

    return df.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"{id_col} {kind}, n_starts long, candidate_chars long, n_runs long")


def shared_categories(masks: str, begin: Column, end: Column) -> Column:
    """Categories that all characters of a span have; DEFAULT if it goes beyond the run that it begins in. ``masks``: column
    of a text's masks. Runs are greedy from the text's beginning, so what the run shares before the span counts."""

    def step(state: Column, m: Column) -> Column:
        both = state["both"].bitwiseAND(m)
        goes_on = (both != 0) & (state["at"] > 0)
        run = F.when(goes_on, state["run"]).otherwise(state["at"])
        inside = (state["at"] >= begin) & (state["at"] < end)
        return F.struct(
            (state["at"] + 1).alias("at"), F.when(goes_on, both).otherwise(m).alias("both"), run.alias("run"),
            F.when(inside, state["shared"].bitwiseAND(m)).otherwise(state["shared"]).alias("shared"),
            (state["broken"] | (inside & (state["at"] > begin) & ~goes_on)).alias("broken"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("both"), F.lit(0).alias("run"), F.lit(-1).alias("shared"), F.lit(False).alias("broken"))
    return F.aggregate(masks, zero, step, lambda s: F.when(s["broken"], MASK["DEFAULT"]).otherwise(s["shared"]))
