"""An extension: incoming embeddings, as a stream, held against the base set.

Each micro-batch is a batch join, so late data and state don't come into it; the sink is written once a batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinsift.functions.vectors import as_double
from twinsift.operators import simjoin


def match_stream(stream: DataFrame, base: DataFrame, out: str, checkpoint: str, threshold: float = 0.1, key: str = "vec_id", vector: str = "embedding", available_now: bool = True) -> StreamingQuery:
    """Writes i, j, dist and batch of each incoming row near a base row to out/batch=<id>; a batch that runs again
    replaces what it wrote."""
    held = base.select(F.col(key).alias("idx"), as_double(F.col(vector)).alias("v"))

    def each(batch: DataFrame, n: int) -> None:
        rows = batch.select(F.col(key).alias("idx"), as_double(F.col(vector)).alias("v"))
        simjoin.cross_set_join(rows, held, threshold, "blocked").write.mode("overwrite").parquet(f"{out}/batch={n}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
