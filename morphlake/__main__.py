"""Command line: ``tokenize`` (also without a subcommand), ``build`` and ``ubuild``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from morphlake.operators.lattice import line_of, morphemes, printed_texts
from morphlake.plans import dictionary as etl
from morphlake.sources.definitions import lines


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="morphlake", description=__doc__)
    sub = p.add_subparsers(dest="command")
    t = sub.add_parser("tokenize", help="texts to morphemes, one per line; without files, standard input")
    t.add_argument("in_files", nargs="*")
    t.add_argument("-r", "--settings", help="JSON settings")
    t.add_argument("-d", "--dictionary", help="folder that build made; without one here or in the settings, all words are unknown")
    t.add_argument("-u", "--user", action="append", default=[])
    t.add_argument("-m", "--mode", choices="ABC", default="C")
    t.add_argument("-a", "--all", action="store_true", help="print all fields")
    t.add_argument("-o", "--output", help="folder to write to")
    for name in ("build", "ubuild"):
        b = sub.add_parser(name)
        b.add_argument("in_files", nargs="+")
        b.add_argument("-o", "--output", required=True)
        b.add_argument("-d", "--description", default="")
        if name == "build":
            b.add_argument("-m", "--matrix", required=True)
        else:
            b.add_argument("-s", "--system", help="folder of the system dictionary that split references may name")
    given = sys.argv[1:] if argv is None else argv
    if not given or given[0] not in ("tokenize", "build", "ubuild", "-h", "--help"):
        given = ["tokenize", *given]
    a = p.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "build":
        etl.build(spark, a.in_files, a.matrix, a.output, description=a.description)
        return 0
    if a.command == "ubuild":
        etl.build(spark, a.in_files, None, a.output, True, a.description, a.system)
        return 0
    d = etl.configured(spark, a.settings, a.dictionary, tuple(a.user))
    if not a.in_files:  # line by line, as they come
        if a.output:
            p.error("an output folder needs input files")
        for line in sys.stdin:
            for m in morphemes(line.rstrip("\r\n"), d, a.mode):
                print(line_of(m, a.all))
            print("EOS", flush=True)
        return 0
    out = printed_texts(lines(spark, a.in_files), d, "text", a.mode, a.all)
    if a.output:
        out.write.mode("overwrite").text(a.output)
    else:
        for r in out.toLocalIterator():  # partitions are in the order of the files
            print(r[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
