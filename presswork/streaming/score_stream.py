"""Scoring of new texts as they arrive. Stateless: no watermark, no state store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def score_stream(spark: SparkSession, source: str, schema: T.StructType, score: Callable[[DataFrame], DataFrame],
                 out: str, checkpoint: str, file_format: str = "parquet", files_per_trigger: int = 1000) -> None:
    """Score every new file below ``source`` with the batch plan and append the result to ``out``.

    Each micro-batch overwrites the folder of its own batch number, so a batch that is rerun after
    a failure does not write its rows twice.
    """
    texts = (
        spark.readStream.format(file_format).schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger).load(source)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run = (
        texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
