"""The star-schema test tables seen as recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.signals import collect_signals, let, mean


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as continuous sample rows: element is user_id mod 4, channel the type, sample the place in time.

    Places are counted within hours, after the sums of the hours before, so that no task sorts a whole channel.
    """
    rows = read(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).cast("int").alias("element"), F.col("event_type").alias("channel"), "ts", "event_id", F.date_trunc("hour", "ts").alias("hour"),
        F.col("value").cast("double").alias("value"), (F.get_json_object("props", "$.k").cast("int") % 2).alias("parity"),
    )
    keys = ["element", "channel", "hour"]
    before = Window.partitionBy("element", "channel").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id")) - 1)
    return placed.join(counts, keys).withColumn("sample", (F.col("before") + F.col("place")).cast("long")).select("element", "channel", "event_id", "value", "parity", "sample")


def event_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole channels of events as a continuous recording, with a stimulus channel that is 1 where a view's value is over 80, else 0."""
    series = event_series(spark, sf_dir)
    views = event_samples(spark, sf_dir).where("channel = 'view'").select("element", F.col("sample").cast("int").alias("t_idx"), F.when(F.col("value") > 80, 1.0).otherwise(0.0).alias("value"))
    stim = collect_signals(views, ["element"]).select("element", F.lit("STI").alias("channel"), "data", F.lit(0).alias("epoch"), F.lit(99).alias("ch_idx"), F.lit(10.0).alias("sfreq"), F.lit(0.0).alias("tmin"), F.lit("all").alias("condition"))
    return series.unionByName(stim.select(*series.columns))


def event_epochs(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """Signal rows of n consecutive samples at 10 Hz from -0.2 s on; the condition is the parity at the first sample."""
    s = event_samples(spark, sf_dir)
    cut = s.select("element", "channel", (F.floor(F.col("sample") / n)).cast("int").alias("epoch"), (F.col("sample") % n).cast("int").alias("t_idx"), "value", "parity")
    first = F.min_by("parity", "t_idx")
    ordered = F.array_sort(F.collect_list(F.struct("t_idx", "value")))
    rows = cut.groupBy("element", "channel", "epoch").agg(F.transform(ordered, lambda x: x["value"]).alias("data"), first.cast("string").alias("condition"))
    names = read(spark, sf_dir, "events").select(F.col("event_type").alias("channel")).distinct()
    ranked = names.withColumn("ch_idx", (F.row_number().over(Window.orderBy("channel")) - 1).cast("int"))
    return rows.where(F.size("data") == n).join(F.broadcast(ranked), "channel").withColumn("sfreq", F.lit(10.0)).withColumn("tmin", F.lit(-0.2))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole channels of events without their means, a signal row each, at 10 Hz."""
    s = event_samples(spark, sf_dir).select("element", "channel", F.col("sample").cast("int").alias("t_idx"), "value")
    rows = collect_signals(s, ["element", "channel"])
    centred = rows.withColumn("data", let(mean(F.col("data")), lambda m: F.transform("data", lambda x: x - m)))
    return centred.withColumn("epoch", F.lit(0)).withColumn("ch_idx", F.lit(0)).withColumn("sfreq", F.lit(10.0)).withColumn("tmin", F.lit(0.0)).withColumn("condition", F.lit("all"))


def vector_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as epochs of eight channels with eight samples; the label is element and condition."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("epoch"), F.col("label").alias("element"), F.col("label").cast("string").alias("condition"), F.col("embedding").cast("array<double>").alias("v"))
    each = v.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("ch_idx"))
    return each.select("element", "epoch", "condition", "ch_idx", F.format_string("E%d", F.col("ch_idx") + 1).alias("channel"), F.lit(8.0).alias("sfreq"), F.lit(0.0).alias("tmin"), F.slice("v", F.col("ch_idx") * 8 + 1, 8).alias("data"))


def vector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as epochs of one channel with 64 samples a second."""
    v = read(spark, sf_dir, "embeddings")
    return v.select(F.col("label").alias("element"), F.col("vec_id").cast("int").alias("epoch"), F.col("label").cast("string").alias("condition"), F.lit(0).alias("ch_idx"), F.lit("E1").alias("channel"), F.lit(64.0).alias("sfreq"), F.lit(0.0).alias("tmin"), F.col("embedding").cast("array<double>").alias("data"))
