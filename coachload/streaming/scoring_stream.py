"""Scoring of request files as they arrive (stream-static).

Requests are read with ``readStream`` (JSON lines, the batch reader's
schema); each micro-batch goes through the same batch ``score`` against the
static lookup tables and model.  Each epoch is written to its own folder in
overwrite mode, so a retried batch replaces its own output (idempotent
sink); progress lives in a checkpoint location under the session's shared
checkpoint folder unless one is given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coachload.operators import scoring as sc
from coachload.session import checkpoint_dir
from coachload.sources.requests import LINE_OPTIONS, LINE_SCHEMA, with_ids


def request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LINE_SCHEMA).options(**LINE_OPTIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_ids(reader.json(path))


def start_scoring(spark: SparkSession, request_path: str, lookups: dict[str, DataFrame], model,
                  labels: DataFrame, feature_list: list[str], out_path: str,
                  checkpoint_location: str | None = None, available_now: bool = True,
                  **score_kw):
    """Start the stream; returns the StreamingQuery."""
    ckpt = checkpoint_location or os.path.join(checkpoint_dir(spark).rstrip("/"), "streams", "scoring")

    def run_batch(batch: DataFrame, epoch_id: int) -> None:
        flat = sc.score(batch, lookups, model, labels, feature_list, **score_kw)
        flat.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite") \
            .parquet(os.path.join(out_path, f"epoch={epoch_id}"))

    writer = (request_stream(spark, request_path).writeStream.foreachBatch(run_batch)
              .option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
