"""Scoring of arriving records against a fixed index, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.operators import blocking


def match_stream(arrivals: DataFrame, targets: DataFrame, features, path: str, checkpoint: str, k: int = 5):
    """Start a query that, for each micro-batch of `arrivals` (id, name, ...), appends its k best overlap matches among `targets` to a
    Parquet folder. Batches are named by their number, so that a repeated one replaces what it wrote."""

    def handle(batch: DataFrame, number: int) -> None:
        pairs = blocking.overlap(batch, targets, features)
        best = blocking.top_k(pairs, ["i"], k, "shared").select("i", "j", "shared", F.lit(number).alias("batch"))
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
