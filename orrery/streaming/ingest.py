"""A stream of triple files, validated batch by batch and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.graph import TRIPLE
from orrery.operators.validate import validate_each


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, place_names: DataFrame | None = None) -> StreamingQuery:
    """JSON lines that appear in ``source`` go to ``sink`` with their ``issues``.

    Rules that look at one triple alone run here; those across a batch need the batch whole and
    run on the table. Each micro-batch commits once, by the file sink's log.
    """
    lines = spark.readStream.schema(f"company_name string, idx long, {TRIPLE}").json(source)
    return validate_each(lines, place_names).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
