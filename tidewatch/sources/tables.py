"""Readers and writers.

Every reader takes an explicit schema or column list so Parquet scans are
pruned; CSV input is read as strings and coerced by the quality operators.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources import store
from pyspark.sql import types as T


def load_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one of the driver's Parquet tables, keeping only ``columns``."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def read_csv_as_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headered CSV read with every column as STRING (no inference pass)."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return (spark.read.schema(schema).option("header", True)
            .option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path))


def load_raw_tables(spark: SparkSession, data_dir: str, readings_columns: list[str],
                    terrain_columns: list[str] | None = None,
                    impact_columns: list[str] | None = None,
                    readings_file: str = "readings.csv",
                    terrain_file: str = "terrain.csv",
                    impact_file: str = "impact.csv") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three CSV tables (readings, terrain dimension, regional impact)."""
    terrain_columns = terrain_columns or ["district", "avg_elevation_m", "terrain_type"]
    impact_columns = impact_columns or ["region", "affected_population"]
    readings = read_csv_as_strings(spark, os.path.join(data_dir, readings_file), readings_columns)
    terrain = read_csv_as_strings(spark, os.path.join(data_dir, terrain_file), terrain_columns) \
        .withColumn("avg_elevation_m", F.col("avg_elevation_m").try_cast("double"))
    impact = read_csv_as_strings(spark, os.path.join(data_dir, impact_file), impact_columns) \
        .withColumn("affected_population", F.col("affected_population").try_cast("long"))
    return readings, terrain, impact


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """S3: write a table (Parquet by default, CSV with header on request)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_document(df: DataFrame, path: str) -> None:
    """Write a (small, aggregated) result as JSON lines; nested parts stay structs."""
    df.write.mode("overwrite").json(path)


def write_json_file(spark: SparkSession, payload: dict, path: str) -> None:
    """S4 for driver-side summaries that are already bounded (metrics, choices): one file, on any file system."""
    fs, p = store._path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(payload, indent=2, ensure_ascii=False, default=str).encode("utf-8")))
    finally:
        out.close()


def save_model(model, path: str) -> None:
    """Persist a fitted model (a tree model or a Spark ML pipeline)."""
    from tidewatch.operators import learn

    if isinstance(model, learn.TreeModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """Read back what ``save_model`` wrote."""
    from pyspark.ml import PipelineModel

    from tidewatch.operators import learn

    return learn.TreeModel.load(spark, path) if store.exists(spark, f"{path}/nodes") else PipelineModel.load(path)


def load_artifacts(spark: SparkSession, artifacts_dir: str):
    """Model plus the baseline tables written by the training plan."""
    model = load_model(spark, os.path.join(artifacts_dir, "model"))
    tables = {
        name: spark.read.parquet(os.path.join(artifacts_dir, name))
        for name in ("month_baseline", "default_baseline", "terrain_lookup", "region_population", "allowed_districts")
        if store.exists(spark, os.path.join(artifacts_dir, name))
    }
    return model, tables
