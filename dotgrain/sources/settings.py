"""Presets and the last session, as JSON; what can't be read gives what a first start has."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import VERSION, sanitized

PRESETS = "name string, params string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a folder of JSON lines; lines that aren't JSON go, a missing folder is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def load_presets(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, PRESETS).where(F.col("name").isNotNull())


def save_presets(presets: DataFrame, path: str) -> None:
    """presets: name, params. path must be another folder than the one they were read from."""
    presets.select("name", "params").write.mode("overwrite").json(path)


def put_preset(presets: DataFrame, name: str, settings: dict[str, Any]) -> DataFrame:
    """presets with one more, in place of one of the same name."""
    one = presets.sparkSession.createDataFrame([(name, json.dumps(sanitized(settings)))], PRESETS)
    return presets.where(F.col("name") != name).unionByName(one)


def load_session(spark: SparkSession, path: str) -> dict[str, Any] | None:
    row = read_json(spark, path, "version int, params string, ui string").first()
    try:
        return row and {"version": row.version, "params": sanitized(json.loads(row.params)), "ui": json.loads(row.ui) if row.ui else None}
    except (TypeError, ValueError):
        return None


def save_session(spark: SparkSession, path: str, settings: dict[str, Any], ui: dict[str, Any] | None = None) -> None:
    row = (VERSION, json.dumps(sanitized(settings)), json.dumps(ui) if ui else None)
    spark.createDataFrame([row], "version int, params string, ui string").write.mode("overwrite").json(path)
