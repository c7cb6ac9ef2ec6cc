"""Character categories: sets of them as bit masks, ranges of code points, and their compilation.

The default ranges follow Unicode's block and script structure for the scripts that Japanese text mixes.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = "DEFAULT SPACE KANJI SYMBOL NUMERIC ALPHA HIRAGANA KATAKANA KANJINUMERIC GREEK CYRILLIC USER1 USER2 USER3 USER4 NOOOVBOW".split()
MASK = {name: 1 << i for i, name in enumerate(NAMES)}
#: A word of these scripts begins only where the script begins.
RUN_SCRIPTS = MASK["ALPHA"] | MASK["GREEK"] | MASK["CYRILLIC"]


class DefinitionError(ValueError):
    """A malformed definition line; the message ends with the line number."""


def mask_of(names: list[str], line: int) -> int:
    out = 0
    for n in names:
        if n not in MASK:
            raise DefinitionError(f"{n} is invalid type at line {line}")
        out |= MASK[n]
    return out


def parse_ranges(text: str) -> list[tuple[int, int, int]]:
    """Lines ``0xLOW[..0xHIGH] CATEGORY... # comment`` to (low, exclusive high, mask); lines are counted from 0."""
    out = []
    for i, raw in enumerate(text.splitlines()):
        parts = raw.split("#", 1)[0].split() if raw.strip().startswith("0x") else []
        if not parts:
            continue
        m = re.fullmatch(r"0x([0-9A-Fa-f]+)(?:\.\.0x([0-9A-Fa-f]+))?", parts[0])
        if len(parts) < 2 or not m:
            raise DefinitionError(f"invalid format at line {i}")
        low = int(m[1], 16)
        high = int(m[2], 16) + 1 if m[2] else low + 1
        if low >= high:
            raise DefinitionError(f"invalid range at line {i}")
        out.append((low, high, mask_of(parts[1:], i)))
    return out


def compile_ranges(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping ranges to disjoint ones with the union of the masks; equal neighbours merge."""
    cuts = sorted({x for low, high, _ in ranges for x in (low, high)})
    out: list[tuple[int, int, int]] = []
    for low, high in zip(cuts, cuts[1:]):
        mask = 0
        for a, b, m in ranges:
            if a <= low and high <= b:
                mask |= m
        if not mask:
            continue
        if out and out[-1][1] == low and out[-1][2] == mask:
            out[-1] = (out[-1][0], high, mask)
        else:
            out.append((low, high, mask))
    return out


def compiled(ranges: DataFrame) -> DataFrame:
    """``compile_ranges`` as a plan over (low, high, mask): elementary segments between end points, the union of the
    masks that cover each, and gaps-and-islands to merge equal neighbours."""
    ends = ranges.select(F.col("low").alias("p")).union(ranges.select("high")).distinct()
    segments = ends.select(F.col("p").alias("a"), F.lead("p").over(Window.orderBy("p")).alias("b")).filter("b IS NOT NULL")
    covered = segments.join(F.broadcast(ranges), (F.col("low") <= F.col("a")) & (F.col("high") >= F.col("b"))).groupBy("a", "b").agg(F.bit_or("mask").alias("mask"))
    w = Window.orderBy("a")
    new = (F.lag("b").over(w) == F.col("a")) & (F.lag("mask").over(w) == F.col("mask"))
    islands = covered.withColumn("island", F.sum(F.when(new, 0).otherwise(1)).over(w))
    return islands.groupBy("island").agg(F.min("a").alias("low"), F.max("b").alias("high"), F.first("mask").alias("mask")).select("low", "high", "mask")


def _default() -> list[tuple[int, int, int]]:
    r: list[tuple[int, int, int]] = []

    def put(name: str, *spans: tuple[int, int] | int) -> None:
        for s in spans:
            low, high = (s, s) if isinstance(s, int) else s
            r.append((low, high + 1, MASK[name]))

    put("SPACE", 0x20, (0x09, 0x0B), 0x0D)
    put("NUMERIC", (0x30, 0x39), (0x2070, 0x209F), (0x2150, 0x218F), (0xFF10, 0xFF19))
    put("ALPHA", (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x236), (0x1E00, 0x1EF9), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))
    put("SYMBOL", (0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E), (0xA1, 0xBF), 0xD7, 0xF7)
    put("SYMBOL", (0x2000, 0x206F), (0x20A0, 0x214F), (0x2190, 0x23FF), (0x2460, 0x24FF), (0x2501, 0x26FE), (0x2700, 0x297F), (0x2A00, 0x2BFF))
    put("SYMBOL", (0x3000, 0x303F), (0x3200, 0x32FE), (0x3300, 0x33FF), (0xFE30, 0xFE6B), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFE0, 0xFFEF))
    put("GREEK", (0x374, 0x3FB))
    put("CYRILLIC", (0x400, 0x4F9), (0x500, 0x50F))
    put("HIRAGANA", (0x3041, 0x309F))
    put("KATAKANA", (0x309B, 0x309C), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F))
    put("NOOOVBOW", *map(ord, "ァィゥェォャュョヮ"), (0x30FB, 0x30FE), 0x3005)
    put("KANJI", (0x2E80, 0x2EF3), (0x2F00, 0x2FD5), 0x3005, 0x3007, (0x3400, 0x4DB5), (0x4E00, 0x9FFF), (0xF900, 0xFA2D), (0xFA30, 0xFA6A))
    put("KANJINUMERIC", *map(ord, "〇一二三四五六七八九十百千万億兆"))
    return compile_ranges(r)


DEFAULT_RANGES = _default()
#: category: (invoke even if there are words, group the whole run, longest length)
DEFAULT_PROPERTIES = {
    "DEFAULT": (0, 1, 0), "SPACE": (0, 1, 0), "KANJI": (0, 0, 2), "SYMBOL": (1, 1, 0), "NUMERIC": (1, 1, 0), "ALPHA": (1, 1, 0),
    "HIRAGANA": (0, 1, 2), "KATAKANA": (1, 1, 2), "KANJINUMERIC": (0, 1, 0), "GREEK": (1, 1, 0), "CYRILLIC": (1, 1, 0),
}


class Categories:
    """Lookup of masks on the driver or in a worker: a table of all code points up to the last range's end."""

    def __init__(self, ranges: list[tuple[int, int, int]] = DEFAULT_RANGES):
        self.ranges = compile_ranges(ranges)
        self.table = np.full(max([0, *(high for _, high, _ in self.ranges)]) + 1, MASK["DEFAULT"], np.int32)
        for low, high, m in self.ranges:
            self.table[low:high] = m

    def mask(self, ch: str) -> int:
        return int(self.table[min(ord(ch), len(self.table) - 1)])

    def masks(self, text: str) -> np.ndarray:
        """Mask of each character; beyond the table's end (its last entry is no range's) DEFAULT."""
        return self.table[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(self.table) - 1)]


def ranges_table(spark: SparkSession, ranges: list[tuple[int, int, int]] = DEFAULT_RANGES) -> DataFrame:
    return spark.createDataFrame(ranges, "low int, high int, mask int")


def code_point(ch: Column) -> Column:
    """Code point of a one-character string, from its UTF-32 bytes."""
    return F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("int")


def hex_value(text: Column) -> Column:
    """Number of a text like 0x1F600; null if it isn't one."""
    return F.when(text.rlike("^0x[0-9A-Fa-f]{1,15}$"), F.conv(F.substring(text, 3, 15), 16, 10).cast("long"))


def mask_column(cp: Column, ranges: list[tuple[int, int, int]] = DEFAULT_RANGES) -> Column:
    """Category mask of a code point as one generated expression: a binary tree of comparisons, no join."""

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            low, high, mask = compiled_[lo]
            return F.when((cp >= low) & (cp < high), mask).otherwise(MASK["DEFAULT"])
        mid = (lo + hi) // 2
        return F.when(cp < compiled_[mid][0], tree(lo, mid)).otherwise(tree(mid, hi))

    compiled_ = compile_ranges(ranges)
    return tree(0, len(compiled_)) if compiled_ else F.lit(MASK["DEFAULT"])


def names_of(mask: Column) -> Column:
    """Names in a mask, in bit order, joined by ``|``."""
    return F.concat_ws("|", *[F.when(mask.bitwiseAND(b) != 0, F.lit(n)) for n, b in MASK.items()])


def values_sql(ranges: list[tuple[int, int, int]] = DEFAULT_RANGES) -> str:
    """The ranges as an inline SQL table."""
    return "(VALUES " + ", ".join(f"({a}, {b}, {m})" for a, b, m in ranges) + ") AS r(low, high, mask)"
