"""Unbounded texts to morphemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from morphlake.operators.lattice import Dictionary, printed_texts, tokenized


def stream(spark: SparkSession, folder: str, schema: str, dictionary: Dictionary, id_col: str, text_col: str = "text", mode: str = "C", columns: list[str] | None = None, **options) -> DataFrame:
    """Morphemes of a folder's Parquet files, as they arrive."""
    source = spark.readStream.schema(schema).options(**options).parquet(folder)
    return tokenized(source, dictionary, id_col, text_col, mode, columns=columns)


def stream_lines(spark: SparkSession, folder: str, dictionary: Dictionary, mode: str = "C", print_all: bool = False, **options) -> DataFrame:
    """Output lines (value) of a folder's text files, as they arrive: one line is one text, EOS ends it."""
    source = spark.readStream.options(**options).text(folder).select(F.rtrim(F.col("value"), F.lit("\r\n")).alias("text"))
    return printed_texts(source, dictionary, "text", mode, print_all)


def to_parquet(tokens: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there, then stop; a restart goes on from the checkpoint."""
    return tokens.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)


def to_text(lines: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The same for output lines, as text files."""
    return lines.writeStream.format("text").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
