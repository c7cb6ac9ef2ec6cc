"""Fuzzy search for short licence notices.

A notice may be off by ``errors(notice)`` insertions, deletions and substitutions, an eighth of its length. By the
pigeonhole principle, a notice split into one more piece than that holds at least one piece unharmed: an automaton
over all pieces finds these seeds in one pass over a text, and each seed fixes a window that the whole notice must
lie in. A bit-parallel edit distance over the window leaves the ends of matches and their least errors, so that the
regex library's bounded-error matching, which backtracks, runs only where a match is certain and with no more errors
than it needs; it verifies the edits and gives the span. Of a run of neighbouring ends the one with the fewest
errors, then the first, counts. Where spans overlap, the one with the fewest errors, then the longest, then the
first notice, is reported.

Letters match in either case. Spans are code points, end exclusive.

Defined results: null and empty texts have no notices. Rows with null or repeated ids are searched one by one. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from morphlake.llm.common import arrow, pick, table

NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License as published by the Free Software Foundation, either version 3"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License as published by the Free Software Foundation; either version 2"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose"],
    "EPL-2.0": ["made available under the terms of the Eclipse Public License 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
SPAN = "license string, begin int, end int, errors int, matched string"


def errors(notice: str) -> int:
    return len(notice) // 8


def fold(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _distance(a: str, b: str) -> int:
    """Edits between two short texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Search:
    def __init__(self, notices: dict[str, list[str]] = NOTICES):
        import ahocorasick

        self.notices = [(name, fold(n), errors(n)) for name, ns in notices.items() for n in ns]
        seeds: dict[str, list[tuple[int, int]]] = {}
        self.patterns: dict[tuple[int, int], object] = {}
        self.masks = []
        for k, (_, n, e) in enumerate(self.notices):
            cuts = [len(n) * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(n[a:b], []).append((k, a))
            masks: dict[str, int] = {}
            for i, c in enumerate(n):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks.append(masks)
        self.automaton = ahocorasick.Automaton()
        for s, at in seeds.items():
            self.automaton.add_word(s, (len(s), at))
        self.automaton.make_automaton()

    def windows(self, low: str) -> dict[int, list[list[int]]]:
        """Per notice the merged text windows that one of its pieces points to."""
        out: dict[int, list[list[int]]] = {}
        for last, (n, at) in self.automaton.iter(low):
            for k, a in at:
                e = self.notices[k][2]
                lo = last + 1 - n - a - e
                hi = lo + len(self.notices[k][1]) + 2 * e
                out.setdefault(k, []).append([max(0, lo), min(len(low), hi)])
        for k, w in out.items():
            w.sort()
            merged = [w[0]]
            for lo, hi in w[1:]:
                if lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            out[k] = merged
        return out

    def _pattern(self, k: int, e: int):
        import regex

        if (k, e) not in self.patterns:
            self.patterns[k, e] = regex.compile(f"(?:{regex.escape(self.notices[k][1], special_only=True)}){{e<={e}}}")
        return self.patterns[k, e]

    def ends(self, k: int, low: str, lo: int, hi: int) -> list[tuple[int, int]]:
        """(end, least errors) of each run of ends in a window at which notice k matches within its errors."""
        _, notice, limit = self.notices[k]
        m, masks = len(notice), self.masks[k]
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, errors_now = full, 0, m
        out: list[tuple[int, int]] = []
        last = -2
        for i in range(lo, hi):
            eq = masks.get(low[i], 0)
            x = eq | down
            h = (((eq & up) + up) ^ up) | eq
            plus, minus = down | (full & ~(h | up)), up & h
            if plus & top:
                errors_now += 1
            elif minus & top:
                errors_now -= 1
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up, down = minus | (full & ~(x | plus)), plus & x
            if errors_now <= limit:
                if last == i - 1:
                    if errors_now < out[-1][1]:
                        out[-1] = (i + 1, errors_now)
                else:
                    out.append((i + 1, errors_now))
                last = i
        return out

    def _span(self, k: int, low: str, lo: int, end: int, e: int) -> tuple[int, int]:
        """Span of the match with exactly e errors that ends here: the shortest start from which it does."""
        n = len(self.notices[k][1])
        for start in sorted(range(lo, end), key=lambda i: (abs(end - i - n), i)):
            m = self._pattern(k, e).fullmatch(low, start, end)
            if m:
                return m.span()
        # the library settles for other edits than the distance counts: the start by the distance itself
        want = self.notices[k][1]
        return next(((start, end) for start in sorted(range(lo, end), key=lambda i: (abs(end - i - n), i)) if _distance(low[start:end], want) == e), (lo, end))

    def find(self, text: str | None) -> list[tuple[str, int, int, int, str]]:
        if not text:
            return []
        low = fold(text)
        hits = []
        for k, spans in self.windows(low).items():
            for lo, hi in spans:
                for end, e in self.ends(k, low, lo, hi):
                    m = self._span(k, low, max(lo, end - len(self.notices[k][1]) - e), end, e)
                    hits.append((e, m[0] - m[1], k, *m))
        out: list[tuple[str, int, int, int, str]] = []
        for e, _, k, a, b in sorted(hits):
            if all(b <= x[1] or a >= x[2] for x in out):
                out.append((self.notices[k][0], a, b, e, text[a:b]))
        return sorted(out, key=lambda x: x[1])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """One row per notice found: doc_id, license, begin, end, errors, matched text."""
    docs = pick(docs, doc_id=id_col, text=text_col)

    def run(batches):
        search = Search(notices)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                got = search.find(text)
                rows += got
                at += [i] * len(got)
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], ["doc_id", "license", "begin", "end", "errors", "matched"])

    return docs.transform(arrow, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SPAN}")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
