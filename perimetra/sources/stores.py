"""Tables the engine keeps: site models, alert log, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def save_site_models(model: DataFrame, path: str) -> None:
    """Replace the models of the given sites and leave other sites alone."""
    model.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site_id").parquet(path)


def load_site_models(spark: SparkSession, path: str) -> DataFrame:
    """Saved models; persistence counters are not part of a model and start at 0."""
    return spark.read.parquet(path)


def append_alert_log(events: DataFrame, path: str) -> None:
    """Append open and close records, one folder per day."""
    day = F.to_date(F.timestamp_micros("at_us"))
    events.withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def write_alert_batch(events: DataFrame, path: str, batch_id: int) -> None:
    """Put the records of one micro-batch into its folder, whatever was there before."""
    events.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")


def read_alert_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True
