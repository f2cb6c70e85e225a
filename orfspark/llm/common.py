"""Shared pieces of the training-data operators.

Working tables are written as Parquet below the folder that the session names
in ``spark.checkpoint.dir``, so that a lost executor costs a re-read and not
the lineage behind it, and so that a following join deals both of its sides
(which lets adaptive execution split a hot key).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a session on this machine alone gets a temporary one; on
    a cluster that would lose rows (each executor would write to its own disk), so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(spark.sparkContext, "_orfspark_shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orfspark-")
        spark.sparkContext._orfspark_shared = folder
    return folder.rstrip("/")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most `rows` rows for the rest of the session, unless it has chosen a number
    itself: with Spark's 10,000, a batch of whole documents is tens of MB in the JVM and again in each worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orfspark/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._orfspark_path = path
    working_tables(spark).append(path)
    return out


def working_tables(spark: SparkSession) -> list[str]:
    """Paths of the session's tables in the shared folder."""
    context = spark.sparkContext
    if not hasattr(context, "_orfspark_tables"):
        context._orfspark_tables = []
    return context._orfspark_tables


def drop_stored(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; without tables, all of the session's (after its results are written)."""
    paths = [t._orfspark_path for t in tables] if tables else list(working_tables(spark))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        working_tables(spark).remove(path)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark df for broadcast if it has at most max_rows rows; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def broadcast_cells(df: DataFrame, cells: Column, max_cells: int) -> DataFrame:
    """Mark df, a stored table, for broadcast if its rows have at most max_cells cells in all; else leave the join to shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(cells)).first()[0] or 0) <= max_cells else df


def others(df: DataFrame, *made: str) -> list[str]:
    """Names of df's columns that are not those of result columns; Spark does not tell upper from lower case."""
    return [c for c in df.columns if c.lower() not in {m.lower() for m in made}]


def quoted(names: list[str]) -> list[str]:
    """Names as `select` takes them, whatever signs they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in names]


def free_prefix(df: DataFrame) -> str:
    """A prefix for working columns that no column of df starts with."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "w_"
    return prefix


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Alternating large-star and small-star rounds over (src long, dst long).
    Nothing is gathered on the driver but a count and a checksum per round.
    Hubs stay splittable: both sides of every join are read from storage and
    dealt anew. Null ends and loops are ignored; no edges give an empty table.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    edges = stored(edges.where("u is not null and v is not null and u <> v").distinct())

    def star(of: DataFrame, large: bool) -> DataFrame:
        near = of.union(of.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else of
        low = stored(near.groupBy("u").agg(F.min("v").alias("m")))
        if large:
            out = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        else:
            moved = near.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = moved.union(low.select("u", F.col("m").alias("v")))
        out = stored(out.where("u <> v").distinct())
        drop_stored(spark, of, low)
        return out

    def mark(of: DataFrame) -> tuple:
        return tuple(of.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    seen = mark(edges)
    if seen[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        edges = star(star(edges, True), False)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
