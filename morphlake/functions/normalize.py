"""Text rewriting that keeps, for every output character, the original character that it came from.

A rewriter maps a text to pieces (start, end, output): the output of a piece has the start of the piece as its
origin. Rewriters run in order; origins compose. ``steady`` is the shorter way where no character moves.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from morphlake.functions.categories import DefinitionError

MARKS_RUN = "[ー\\-⁓〜〰]{2}"
RESULT_TYPE = StructType().add("original", StringType()).add("modified", StringType()).add("offsets", ArrayType(IntegerType()))


def default_ignored() -> set[str]:
    """Characters whose compatibility form would lose what they are: Roman numerals, spacing voice marks, radicals
    and compatibility ideographs."""
    spans = [(0x2160, 0x217F), (0x309B, 0x309C), (0x2E80, 0x2EF3), (0x2F00, 0x2FD5), (0xF900, 0xFAD9)]
    return {chr(c) for a, b in spans for c in range(a, b + 1) if unicodedata.category(chr(c)) != "Cn"}


def default_rules() -> dict[str, str]:
    """A kana and a voice mark to the composed letter: any of the marks after full-width kana, the half-width ones after
    half-width kana. Letters that are rare (ヷ, ヸ, ヹ, ヺ) and iteration marks are left alone."""
    out = {}
    for half, bases in ((True, range(0xFF66, 0xFF9E)), (False, [*range(0x3041, 0x3097), *range(0x30A1, 0x30F7)])):
        for base in map(chr, bases):
            for marks, combining in (("ﾞ゛\u3099", "\u3099"), ("ﾟ゜\u309a", "\u309a")):
                one = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", base) + combining)
                if len(one) == 1 and one <= "ヴ":
                    out |= {base + m: one for m in (marks[:1] if half else marks)}
    return out


def parse_rewrite(text: str) -> tuple[set[str], dict[str, str]]:
    """Lines of one character (kept as it is) or of two columns (replacement)."""
    keep: set[str] = set()
    rules: dict[str, str] = {}
    for i, raw in enumerate(text.splitlines()):
        parts = raw.split() if raw.strip() and not raw.lstrip().startswith("#") else []
        if len(parts) == 1:
            if len(parts[0]) != 1:
                raise DefinitionError(f"{parts[0]} is not character at line {i}")
            keep.add(parts[0])
        elif len(parts) == 2:
            if parts[0] in rules:
                raise DefinitionError(f"{parts[0]} is already defined at line {i}")
            rules[parts[0]] = parts[1]
        elif parts:
            raise DefinitionError(f"invalid format at line {i}")
    return keep, rules


class DefaultRewriter:
    """The longest rule that matches here, else lower case, else (unless kept) the compatibility form."""

    def __init__(self, keep: set[str] | None = None, rules: dict[str, str] | None = None):
        self.keep = default_ignored() if keep is None else keep
        self.rules = default_rules() if rules is None else rules
        keys = sorted(map(re.escape, self.rules), key=len, reverse=True)
        self.token = re.compile("|".join([*keys, "(?s:.)"]))
        self.known: dict[str, str] = dict(self.rules)
        begins = {k[0] for k in self.rules}
        latin = [c for c in map(chr, range(0x180)) if len(self.one(c)) == 1 and c not in begins]
        self.latin = re.compile("[" + re.escape("".join(latin)) + "]*")
        self.latin_table = str.maketrans({c: self.one(c) for c in latin})
        #: What becomes of the code points of plain Latin characters; of others (the last entry) 0xFFFFFFFF.
        self.steady_codes = np.full(0x181, 0xFFFFFFFF, np.uint32)
        for c in latin:
            self.steady_codes[ord(c)] = ord(self.one(c))

    def one(self, c: str) -> str:
        out = self.known.get(c)
        if out is None:
            low = c.lower()
            out = self.known[c] = low if low in self.keep else unicodedata.normalize("NFKC", low)
        return out

    def steady(self, text: str) -> str | None:
        """The rewritten text, if each character of it stands where its origin stands (plain Latin texts)."""
        return text.translate(self.latin_table) if self.latin.fullmatch(text) else None

    def pieces(self, text: str):
        for m in self.token.finditer(text):
            yield m.start(), m.end(), self.one(m[0])

    def apply(self, text: str) -> str:
        plain = self.steady(text)
        return "".join(map(self.one, self.token.findall(text))) if plain is None else plain


class MarkCollapser:
    """Two or more prolonged-sound marks in a row become one symbol."""

    def __init__(self, marks: str = "ー-⁓〜〰", symbol: str = "ー"):
        if not marks:
            raise DefinitionError("no prolonged sound marks")
        self.run = re.compile(f"[{re.escape(marks)}]{{2,}}")
        self.marks, self.symbol = marks, symbol

    def steady(self, text: str) -> str | None:
        return None if self.run.search(text) else text

    def pieces(self, text: str):
        at = 0
        for m in self.run.finditer(text):
            yield from ((i, i + 1, text[i]) for i in range(at, m.start()))
            yield m.start(), m.end(), self.symbol
            at = m.end()
        yield from ((i, i + 1, text[i]) for i in range(at, len(text)))

    def apply(self, text: str) -> str:
        return self.run.sub(lambda _: self.symbol, text)


def rewrite(text: str, rewriters: list) -> tuple[str, list[int]]:
    """Modified text, and the original index of each of its characters and of its end."""
    offsets = list(range(len(text) + 1))
    for r in rewriters:
        plain = r.steady(text)
        if plain is not None:
            text = plain
            continue
        out, now = [], []
        for start, _, new in r.pieces(text):
            out.append(new)
            now += [offsets[start]] * len(new)
        text, offsets = "".join(out), [*now, offsets[-1]]
    return text, offsets


def rewrite_text(text: str, rewriters: list) -> str:
    """The modified text alone."""
    for r in rewriters:
        text = r.apply(text)
    return text


def replaced(text: str, offsets: list[int], begin: int, end: int, new: str) -> tuple[str, list[int]]:
    """One replacement in a rewriting buffer: the new characters all come from where the range began."""
    if begin > len(text):
        raise ValueError("begin is beyond the text")
    if begin >= end:
        raise ValueError("the range is empty")
    end = min(end, len(text))
    return text[:begin] + new + text[end:], offsets[:begin] + [offsets[begin]] * len(new) + offsets[end:]


def default_chain() -> list:
    return [DefaultRewriter(), MarkCollapser()]


def normalized(df: DataFrame, text_col: str = "text", out_col: str = "norm", chain: list | None = None) -> DataFrame:
    """Add ``out_col``: original, modified, offsets. One Arrow pass, a bounded slice of texts at a time, with offsets as
    arrays of numbers; plain Latin texts are rewritten together."""
    from morphlake.operators.segments import SLICE_BYTES, rewritten, slices  # these build on this module
    from morphlake.sources.shared import small_batches

    chain = default_chain() if chain is None else chain
    others = [c for c in df.columns if c != out_col]
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column(batch.num_columns - 1), SLICE_BYTES):
                rest = batch.slice(first, len(texts)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*rest, rewritten(texts, chain)], [*others, out_col])

    schema = StructType([df.schema[c] for c in others]).add(out_col, RESULT_TYPE)
    return df.select(*[F.col(f"`{c}`") for c in others], F.col(text_col).alias("__text")).mapInArrow(run, schema)


def _plain() -> tuple[str, str, str]:
    """A pattern of what isn't plain, and the plain characters that change beyond their case, with what they become.

    Plain are characters of Latin script and its punctuation that become one other character or stay.
    """
    one = DefaultRewriter().one
    candidates = [c for a, b in ((0, 0x130), (0x131, 0x180), (0x2010, 0x2020), (0x20AC, 0x20AD)) for c in range(a, b)]
    plain = [c for c in candidates if len(one(chr(c))) == 1]
    edges = [i for i, c in enumerate(plain) if i == 0 or plain[i - 1] != c - 1]
    spans = [(plain[i], plain[j - 1]) for i, j in zip(edges, [*edges[1:], len(plain)])]
    changed = [chr(c) for c in plain if one(chr(c)) != chr(c).lower()]
    return "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]", "".join(changed), "".join(map(one, changed))


def modified(df: DataFrame, text_col: str = "text", out_col: str = "modified") -> DataFrame:
    """Add the text as the default chain rewrites it, without offsets: built-in functions for plain texts; only those
    that hold another character go to a worker."""
    pattern, old, new = _plain()
    chain = default_chain()

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: rewrite_text(t, chain), na_action="ignore")

    text = F.col(text_col)
    # a branch doesn't keep a Python function from running, an empty input does
    sent = df.withColumn("__other", F.when(text.rlike(pattern), text)).withColumn("__done", run("__other"))
    low = F.lower(text)
    low = F.when(text.rlike(f"[{old}]"), F.translate(low, old, new)).otherwise(low)
    plain = F.when(F.col("__other").isNull(), F.when(low.rlike(MARKS_RUN), collapsed(low)).otherwise(low))
    return sent.withColumn(out_col, F.coalesce("__done", plain)).drop("__other", "__done")


def collapsed(text: Column, marks: str = "ー-⁓〜〰", symbol: str = "ー") -> Column:
    """Mark collapse as a built-in expression, where no offsets are needed."""
    return F.regexp_replace(text, f"[{re.escape(marks)}]{{2,}}", symbol)
