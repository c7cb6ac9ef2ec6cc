"""SQL surface: ``SELECT * FROM t, LATERAL tokenize(t.text, 'C')``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from morphlake.operators.lattice import MORPHEME, Dictionary, morphemes

#: Texts up to so many characters are remembered with their morphemes, up to so many of them in a task.
SHORT, REMEMBERED = 100, 10_000


def register(spark: SparkSession, dictionary: Dictionary, name: str = "tokenize") -> None:
    """Register the table function for a dictionary, which is broadcast. A lateral call passes row by row, and short texts
    that come again aren't solved again (``REMEMBERED``); for whole tables ``lattice.tokenized`` passes batches."""
    shared = spark.sparkContext.broadcast(dictionary)

    @udtf(returnType=MORPHEME)
    class Tokenize:
        def __init__(self):
            self.dictionary, self.known = shared.value, {}

        def eval(self, text: str, mode: str):
            rows = self.known.get((text, mode))
            if rows is None:
                rows = morphemes(text, self.dictionary, mode)
                if text and len(text) <= SHORT:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[text, mode] = rows
            yield from rows

    spark.udtf.register(name, Tokenize)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a small file would leave them to fewer tasks: for what is slow row by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
