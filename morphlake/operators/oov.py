"""Out-of-vocabulary candidates.

``simple`` proposes, where nothing else does, the span up to the next word start. ``grouped`` proposes per category of
the character: its whole run, and its first 1, 2, ... characters, by templates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.functions.categories import DEFAULT_PROPERTIES, DEFAULT_RANGES, NAMES, RUN_SCRIPTS

NOUN = ("名詞", "普通名詞", "一般", "*", "*", "*")


@dataclass(frozen=True)
class SimpleOov:
    left_id: int = 8
    right_id: int = 8
    cost: int = 6000
    pos: tuple[str, ...] = NOUN

    def candidates(self, i: int, has_words: bool, lat) -> list[tuple[int, int, int, int, tuple]]:
        return [] if has_words else [(lat.candidate_length[i], self.left_id, self.right_id, self.cost, self.pos)]


@dataclass(frozen=True)
class GroupedOov:
    """``properties``: category to (invoke, group, length); ``templates``: category to [(left, right, cost, pos)]."""

    properties: dict = field(default_factory=lambda: dict(DEFAULT_PROPERTIES))
    templates: dict = field(default_factory=dict)

    def candidates(self, i: int, has_words: bool, lat) -> list[tuple[int, int, int, int, tuple]]:
        run = lat.run_length[i]
        out = []
        if not run:
            return out
        for bit, name in enumerate(NAMES):
            if not lat.mask[i] >> bit & 1 or name not in self.properties:
                continue
            invoke, group, length = self.properties[name]
            if not invoke and has_words:
                continue
            templates = self.templates.get(name, [])
            left = run
            if group:
                out += [(run, *t) for t in templates]
                left -= 1  # the whole run is there already
            for n in range(1, min(length, left) + 1):
                out += [(n, *t) for t in templates]
        return out


def _class(mask: int, ranges) -> str:
    spans = ["".join([f"\\x{{{a:X}}}", f"-\\x{{{b - 1:X}}}" if b - a > 1 else ""]) for a, b, m in ranges if m & mask]
    return "[" + "".join(spans) + "]"


def simple_pattern(ranges=DEFAULT_RANGES) -> str:
    """With no lexicon, words are runs of one alphabetic script and any other character on its own."""
    scripts = [_class(1 << bit, ranges) + "+" for bit in range(16) if RUN_SCRIPTS >> bit & 1]
    return "(" + "|".join([*scripts, "(?s:.)"]) + ")"


def simple_tokens(text: Column, ranges=DEFAULT_RANGES) -> Column:
    """Array of the simple tokens: one native expression, no character table."""
    return F.regexp_extract_all(text, F.lit(simple_pattern(ranges)), 1)


def grouped_candidates(chars: DataFrame, id_col: str, properties: DataFrame, templates: DataFrame) -> DataFrame:
    """Candidates as a plan. ``chars``: (id, pos, mask, run_length, has_words); ``properties``: (mask, invoke, grp,
    length); ``templates``: (mask, ord, left_id, right_id, cost, pos_id). Adds (begin, length) rows per template."""
    bits = F.filter(F.array(*[F.lit(1 << b) for b in range(16)]), lambda b: F.col("mask").bitwiseAND(b) != 0)
    per = chars.filter("run_length > 0").withColumn("category", F.explode(bits)).drop("mask")
    per = per.join(F.broadcast(properties.withColumnRenamed("mask", "category")), "category").filter("invoke OR NOT has_words")
    left = F.col("run_length") - F.when(F.col("grp"), 1).otherwise(0)
    most = F.least(F.col("length"), left)
    shorter = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    whole = F.when(F.col("grp"), F.array("run_length")).otherwise(F.array().cast("array<int>"))
    spans = per.withColumn("n", F.explode(F.concat(whole, shorter))).select(id_col, F.col("pos").alias("begin"), "category", F.col("n").alias("n_chars"))
    return spans.join(F.broadcast(templates.withColumnRenamed("mask", "category")), "category")

