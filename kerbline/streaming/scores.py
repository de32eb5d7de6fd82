"""Score tickets as CSV files arrive.

Scoring is one stateless projection, so a streaming DataFrame goes through the
same functions as a batch one; nothing here keeps state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kerbline.functions import scoring
from kerbline.operators.approval import CompiledApproval, score_compiled
from kerbline.session import use_utc
from kerbline.sources.tickets import known_texts, text_reader, type_violations


def scored_stream(spark: SparkSession, folder: str, model_path: str | None = None) -> DataFrame:
    """Scored tickets from a folder that receives CSV files; with a saved model, also their approval probability."""
    use_utc(spark)
    rows = scoring.score(type_violations(known_texts(text_reader(spark.readStream).csv(folder))))
    return rows if model_path is None else score_compiled(CompiledApproval.load(spark, model_path), rows)


def write_available(stream: DataFrame, path: str, state_path: str) -> StreamingQuery:
    """Append all files present to a Parquet table, exactly once per file."""
    return stream.writeStream.format("parquet").option("checkpointLocation", state_path).trigger(
        availableNow=True).start(path)
