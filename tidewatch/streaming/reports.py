"""Field reports as a stream: the batch scoring plan (C5) on ``readStream`` input.

Scoring is stateless (each report is scored against the baseline tables and
dimensions, which are static), so the streaming query is the batch plan with
a streaming source: a stream-static join per dimension, no watermark and no
state store.  Results go to any sink; ``foreachBatch`` gives exactly-once
writes to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatch.plans import scoring
from tidewatch.plans.baseline import Baseline

REPORT_SCHEMA = T.StructType([
    T.StructField("report_id", T.LongType()),
    T.StructField("district", T.StringType()),
    T.StructField("rainfall_mm", T.DoubleType()),
    T.StructField("selected_date", T.DateType()),
    T.StructField("soil_condition", T.StringType()),
    T.StructField("visible_water", T.StringType()),
])


def read_reports(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A streaming source of field reports (files arriving in ``path``)."""
    reader = spark.readStream.schema(REPORT_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def score_stream(reports: DataFrame, base: Baseline, exposure: scoring.Exposure, model=None) -> DataFrame:
    """C5 over a streaming DataFrame (the same plan as the batch job)."""
    return scoring.score_reports(reports, base, exposure, model=model)


def start(scored: DataFrame, sink_path: str, checkpoint: str, trigger_once: bool = True):
    """Append scored reports to a Parquet sink with a checkpointed, restartable query."""
    writer = scored.writeStream.format("parquet").option("path", sink_path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="10 seconds")
    return writer.start()
