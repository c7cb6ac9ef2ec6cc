"""Readers of the text formats that dictionaries and settings come in."""

from __future__ import annotations

import csv
import io
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.categories import DEFAULT_PROPERTIES, DEFAULT_RANGES, MASK, DefinitionError, compile_ranges, parse_ranges
from morphlake.functions.normalize import DefaultRewriter, MarkCollapser, parse_rewrite
from morphlake.operators.oov import GroupedOov, SimpleOov

CSV_COLUMNS = [
    "headword", "left_id", "right_id", "cost", "surface", "pos1", "pos2", "pos3", "pos4", "pos5", "pos6",
    "reading", "normalized", "dict_form", "split_type", "a_split", "b_split", "structure",
]


def read_text(path: str) -> str:
    """A small file, as definitions are; one with a scheme, or a folder of one file, is read through the session."""
    if "://" in path or os.path.isdir(path):
        return SparkSession.getActiveSession().read.text(path, wholetext=True).first()[0]
    with open(path, encoding="utf-8") as f:
        return f.read()


def parse_properties(text: str) -> dict[str, tuple[int, int, int]]:
    """Lines ``CATEGORY INVOKE GROUP LENGTH``; range lines and comments are passed over; lines count from 1."""
    out: dict[str, tuple[int, int, int]] = {}
    for i, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        if not line or line.startswith("0x"):
            continue
        parts = line.split()
        if len(parts) < 4 or not all(p.isdigit() for p in parts[1:4]):
            raise DefinitionError(f"invalid format at line {i}")
        if parts[0] not in MASK:
            raise DefinitionError(f"{parts[0]} is invalid type at line {i}")
        if parts[0] in out:
            raise DefinitionError(f"{parts[0]} is already defined at line {i}")
        out[parts[0]] = tuple(map(int, parts[1:4]))
    return out


def parse_templates(text: str, known: dict | None = None) -> dict[str, list[tuple[int, int, int, tuple]]]:
    """Lines ``CATEGORY,left,right,cost,pos x 6`` to provider templates; lines count from 1."""
    out: dict[str, list] = {}
    for i, row in enumerate(csv.reader(io.StringIO(text)), 1):
        if not row:
            continue
        if len(row) < 10:
            raise DefinitionError(f"invalid format at line {i}")
        if row[0] not in (MASK if known is None else known):
            raise DefinitionError(f"{row[0]} is invalid type at line {i}")
        out.setdefault(row[0], []).append((int(row[1]), int(row[2]), int(row[3]), tuple(row[4:10])))
    return out


#: What is configured where the settings say nothing.
SIMPLE = {"class": "SimpleOovProviderPlugin", "oovPOS": ["名詞", "普通名詞", "一般", "*", "*", "*"], "leftId": 8, "rightId": 8, "cost": 6000}
DEFAULTS = {"systemDict": None, "userDict": [], "characterDefinitionFile": None, "rewriteDefinitionFile": None, "inputTextPlugin": [{"class": "DefaultInputTextPlugin"}], "oovProviderPlugin": [SIMPLE]}


def settings(path: str | None = None) -> dict:
    """JSON settings over the defaults; ``folder`` is where relative file names in them begin."""
    given = json.loads(read_text(path)) if path else {}
    if not isinstance(given, dict):
        raise DefinitionError("settings are not an object at line 0")
    folder = "" if not path else path.rpartition("/")[0] if "://" in path else os.path.dirname(os.path.abspath(path))
    return DEFAULTS | given | {"folder": folder}


def beside(config: dict, name: str | None) -> str | None:
    """A file that the settings name, relative to their folder."""
    return name and (name if os.path.isabs(name) or "://" in name else os.path.join(config["folder"], name))


def _class(item) -> str:
    """Short name of a configured class: the last part of a dotted one."""
    if not isinstance(item, dict) or not isinstance(item.get("class"), str):
        raise DefinitionError("a plug-in without a class at line 0")
    return item["class"].rpartition(".")[2]


def rewriters(config: dict) -> list:
    """The configured chain of text rewriters, in order."""
    out = []
    for item in config["inputTextPlugin"]:
        name = _class(item)
        if name == "DefaultInputTextPlugin":
            path = beside(config, item.get("rewriteDef") or config["rewriteDefinitionFile"])
            out.append(DefaultRewriter(*rewrite_file(path)) if path else DefaultRewriter())
        elif name == "ProlongedSoundMarkInputTextPlugin":
            out.append(MarkCollapser("".join(m[0] for m in item.get("prolongedSoundMarks", []) if m), item.get("replacementSymbol", "ー")))
        else:
            raise DefinitionError(f"{item['class']} is an unknown class of rewriters at line 0")
    return out


def providers(config: dict) -> list:
    """The configured providers of unknown words, in order."""
    out = []
    for item in config["oovProviderPlugin"]:
        name = _class(item)
        if name == "SimpleOovProviderPlugin":
            got = SIMPLE | item
            out.append(SimpleOov(int(got["leftId"]), int(got["rightId"]), int(got["cost"]), tuple(got["oovPOS"])))
        elif name == "MeCabOovProviderPlugin":
            shapes, rows = beside(config, item.get("charDef")), beside(config, item.get("unkDef"))
            properties = parse_properties(read_text(shapes)) if shapes else dict(DEFAULT_PROPERTIES)
            out.append(GroupedOov(properties, parse_templates(read_text(rows), properties) if rows else {}))
        else:
            raise DefinitionError(f"{item['class']} is an unknown class of providers at line 0")
    return out


def parts_of(config: dict) -> dict:
    """What the settings say about a dictionary besides its words: ranges, rewriters, providers."""
    path = beside(config, config["characterDefinitionFile"])
    ranges = compile_ranges(ranges_file(path)) if path else DEFAULT_RANGES
    return {"ranges": ranges, "rewriters": rewriters(config), "providers": providers(config)}


def lines(spark: SparkSession, paths) -> DataFrame:
    """(line_no, text): lines of text files, one document each."""
    return spark.read.text(paths).select(F.monotonically_increasing_id().alias("line_no"), F.rtrim(F.col("value"), F.lit("\r\n")).alias("text"))


def lexicon_csv(spark: SparkSession, paths) -> DataFrame:
    """Rows of headerless lexicon files, all strings, with ``row_id`` in file order; malformed rows fail the job."""
    schema = ", ".join(f"{c} string" for c in CSV_COLUMNS)
    raw = spark.read.csv(paths, schema=schema, header=False, mode="FAILFAST", quote='"', escape='"', multiLine=True, emptyValue="", ignoreLeadingWhiteSpace=False)
    return raw.withColumn("row_id", F.monotonically_increasing_id())


def connection_text(spark: SparkSession, path: str) -> DataFrame:
    """(left, right, cost) of a matrix file: a size line, then ``left right cost``; comments and short lines are skipped."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.trim("value").alias("value"))
    parts = F.split("value", r"\s+")
    rows = raw.filter("value <> '' AND NOT contains(value, '#')").withColumn("p", parts).filter(F.size("p") >= 3)
    return rows.select(F.col("p")[0].cast("int").alias("left"), F.col("p")[1].cast("int").alias("right"), F.col("p")[2].cast("int").alias("cost"))


def ranges_file(path: str) -> list:
    return parse_ranges(read_text(path))


def rewrite_file(path: str) -> tuple[set, dict]:
    return parse_rewrite(read_text(path))
