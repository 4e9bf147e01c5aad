"""The call log as a stream: daily counts and a resumable append."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.session import shared_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table, file or folder, as a file-source stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if os.path.isfile(path):
        return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return r.parquet(path)


def daily_counts(log: DataFrame, ts: str, key: str, by: str, late: str = "30 days") -> DataFrame:
    """(day, by, n): repeated keys within the watermark count once."""
    x = log.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return x.groupBy(F.window(ts, "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), by, "n")


class LateRows(RuntimeError):
    """Rows came later than the watermark allows and are missing from the result; ``n`` says how many."""

    def __init__(self, n: int) -> None:
        super().__init__(f"{n} rows were later than the watermark allows")
        self.n = n


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process what is there, batch by batch, into a table of the shared folder, and read it.

    Rows that the watermark would drop are counted, and any is an error: a result is whole or it is none.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def write(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if late := sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators):
        raise LateRows(late)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def append_new(stream: DataFrame, keys: list[str], ts: str, late: str = "30 days") -> DataFrame:
    """Results not seen before, appended once each: what a restarted run would write."""
    return run_available(stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys), "append")
