"""Incremental ingest, histograms and discovery on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_results(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """New result files as they appear; the query's checkpoint remembers those that were read."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def stream_histogram(stream: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Running (keys, bin, n, total) for update or complete mode; sums merge across restarts."""
    return stream.groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def stream_consensus(stream: DataFrame, width: float = 0.1) -> DataFrame:
    """Running consensus state (key, bin, intensity, spectra, peaks) of spectra (key, peaks array of (mz, intensity))
    for update mode, each spectrum scaled to its sum. The state is keyed sums in the query's checkpoint: stopped and
    started again, it takes more spectra. Spectra without intensity add nothing."""
    total = F.aggregate("peaks", F.lit(0.0), lambda t, p: t + p["intensity"])
    of = F.transform("peaks", lambda p: F.struct(F.round(p["mz"] / width).cast("long").alias("bin"), p["intensity"].alias("i")))
    rows = stream.select("key", total.alias("total"), of.alias("p")).where("total > 0")
    rows = rows.select("key", "total", "p", F.explode(F.array_distinct(F.transform("p", lambda x: x["bin"]))).alias("bin"))
    mine = F.filter("p", lambda x: x["bin"] == F.col("bin"))
    rows = rows.select("key", "bin", (F.aggregate(mine, F.lit(0.0), lambda t, x: t + x["i"]) / F.col("total")).alias("v"), F.size(mine).alias("k"))
    return rows.groupBy("key", "bin").agg(F.sum("v").alias("intensity"), F.count("*").alias("spectra"), F.sum("k").alias("peaks"))


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there in update mode and stop; the batches are read by `latest`."""
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert_to(out)).start()
    query.awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest row of each key of a table that `upsert_to` wrote."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def consensus_state(state: DataFrame) -> DataFrame:
    """(key, bin, intensity, spectra, near), the bins that `spectra.consensus` takes, of a state's rows."""
    spread = state.select("key", F.explode(F.array(*[F.col("bin") + k for k in range(-2, 3)])).alias("bin"), "peaks").groupBy("key", "bin").agg(F.sum("peaks").alias("near"))
    return state.join(spread, ["key", "bin"]).select("key", "bin", "intensity", "spectra", "near")


def stream_discovery(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Keys first seen, per window of event time; a key counts again only after the watermark has passed it."""
    first = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return first.groupBy(F.window(ts, window)).agg(F.count("*").alias("new_keys")).select(F.col("window.start").alias("start"), "new_keys")


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process what is there and stop."""
    query = stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_to(path: str):
    """A foreachBatch sink for update mode: every batch is a table of its own, the latest of a key counts on reading."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
