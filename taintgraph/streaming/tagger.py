"""Incremental tagging of arriving requests against the static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintgraph.functions.text import clean_id
from taintgraph.session import shared_dir


def tag_requests(requests: DataFrame, side: DataFrame) -> DataFrame:
    """Requests (manifest_id, model, example_id, requested_at) with whether the side table holds the id.

    Works on a stream as well: the right side is static and holds each id once."""
    have = side.select(clean_id(side["example_id"]).alias("key")).where("key is not null").distinct().withColumn("held", F.lit(True))
    r = requests.withColumn("key", clean_id(F.col("example_id")))
    return r.join(have, "key", "left").select("manifest_id", "model", "requested_at", F.when(F.col("key").isNull(), "no_id").when(F.col("held"), "found").otherwise("missing").alias("state"))


def monthly_states(tagged: DataFrame, late: str = "30 days") -> DataFrame:
    """Counts per model, state and 30-day window; with a watermark, so that a stream can close its windows."""
    return tagged.withWatermark("requested_at", late).groupBy(F.window("requested_at", "30 days").alias("w"), "model", "state").agg(F.count(F.lit(1)).alias("n"))


def run_once(spark: SparkSession, source: str, side: DataFrame, name: str) -> DataFrame:
    """Read what has arrived below ``source`` (parquet files), tag it, append it to a table in the shared folder."""
    schema = spark.read.parquet(source).schema
    root = f"{shared_dir(spark)}/stream-{name}"
    # a file source wants a folder: the glob keeps it to this table
    folder, _, leaf = source.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(source) if not _is_file(spark, source) else reader.option("pathGlobFilter", leaf).parquet(folder)
    for c, t in stream.dtypes:
        if t == "timestamp_ntz":
            stream = stream.withColumn(c, F.col(c).cast("timestamp"))
    q = tag_requests(stream, side).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
