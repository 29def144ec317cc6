"""Every registered query with SQL gives the SQL's rows; the compiler and streams agree with the plain plans."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wavequill.plans import config, workload
from wavequill.streaming import windows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(workload.ORACLE_SQL))
def test_equals_sql(spark, small, duck, name):
    got = workload.QUERIES[name](spark, small).toPandas()
    want = duck.sql(workload.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.ORACLE_SQL)))
def test_runs(spark, small, name):
    assert workload.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["element", "value"]
    assert set(workload.QUERIES) <= set(entry.queries()) and set(workload.ORACLE_SQL) <= set(entry.oracle_sql())


def test_compiled_pipeline(spark, small):
    out = config.compile_pipeline(spark, f"""
datagrabber: {{kind: VectorTable, datadir: {small}}}
preprocess:
  - {{kind: EEGReference, ref_channels: average}}
  - {{kind: BadEpochsThreshold, reject: {{eeg: 0.9}}, min_events: 0.1}}
markers:
  - {{kind: SpectralPowerBands, bands: {{low: [1, 3]}}, dB: false, trial_method: trim_mean80}}
  - {{kind: PermutationEntropy, tau: 1, channel_aggregation_method: mean, rois: [0, 1, E5]}}
  - {{kind: SymbolicMutualInformationROIs, taus: [1], connectivity_method: mean, channel_method: mean, trial_method: mean}}
  - {{kind: KolmogorovComplexity}}
  - {{kind: TimeLockedContrast, condition_a: '0', condition_b: '1'}}
""")
    n = {r["feature"]: r["n"] for r in out.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    elements = spark.read.parquet(f"{small}/embeddings.parquet").select("label").distinct().count()
    assert n["spectralpower"] == 8 * elements and n["symbolicmutualinformation"] == elements and n["timelockedcontrast"] == 8 * elements
    assert n["kolmogorovcomplexity"] == 8 * n["permutationentropy"]
    with pytest.raises(ValueError, match="unknown marker"):
        config.run_marker(out, {"kind": "Nope"})


def _stream(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), (F.col("value") - 50).alias("value"))
    cut = rows.orderBy("ts")
    n = 4
    for k, (lo, hi) in enumerate([(0, 250), (250, 500), (500, 750), (750, 10**9)][:n]):
        part = cut.withColumn("i", F.expr("row_number() over (order by ts, channel, value) - 1")).where((F.col("i") >= lo) & (F.col("i") < hi)).drop("i")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _finish(spark, df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streamed_windows_equal_batch(spark, small, tmp_path):
    rows, stream = _stream(spark, small, tmp_path)
    got = _finish(spark, windows.windowed_means(stream, "6 hours", "30 days"), "complete", "w1", tmp_path)
    want = windows.windowed_means(rows, "6 hours", "30 days")
    key = lambda df: sorted((str(r["start"]), r["channel"], r["n"], round(r["mean"], 9)) for r in df.collect())
    assert key(got) == key(want)
    sessions = _finish(spark, windows.artifact_sessions(stream, 100.0, "2 hours", "30 days"), "complete", "w2", tmp_path)
    assert sessions.count() == windows.artifact_sessions(rows, 100.0, "2 hours", "30 days").count()
