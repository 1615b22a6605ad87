"""New call files are added to the store as they arrive in a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelforge.sources.sinks import write_store
from panelforge.sources.vcf import records_of, samples_of


def ingest_calls(spark: SparkSession, landing: str, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Streams call files from ``landing`` into ``store``/records and ``store``/samples.

    The panel is the first word of a file's name.  Each file is handled whole in one batch (files are not split across
    batches), batches are written under their number, so a batch that is run again replaces its own output.
    """
    lines = spark.readStream.text(landing).select(F.col("_metadata.file_path").alias("path"), "value")
    panel = F.lower(F.regexp_extract("path", r"([A-Za-z]+)[^/]*$", 1))

    def load(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("line_ord", F.monotonically_increasing_id()).persist()
        write_store(records_of(rows, panel), f"{store}/records/batch={number}", "overwrite")
        samples_of(rows, panel).write.mode("overwrite").parquet(f"{store}/samples/batch={number}")
        rows.unpersist()

    writer = lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
