"""Shared plumbing: scratch tables in the cluster's shared folder and byte-bounded batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python task; numpy temporaries are some ten times as large.
SLICE_BYTES = 1 << 20

#: Bytes and rows of an Arrow batch between the JVM and a Python worker; both hold a batch or two for each running task.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new local one where unset in local mode; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wavequill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches be no larger than the bounds above; smaller settings stay.

    The bounds remain for the session: results are lazy, and Spark reads these settings when a result is computed.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        digits, unit = re.fullmatch(r"(-?\d+)\s*([kmg]?)b?", spark.conf.get(key).lower()).groups()
        now = int(digits) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


class Scratch:
    """Written tables of one operator call, below the shared folder.

    ``keep`` writes a DataFrame as Parquet and reads it again: lineage ends there, so a lost
    executor costs the re-reading of a file and not the recomputation of the plan. ``drop`` frees
    a table that nothing lazy needs any more; the rest goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wavequill/{name}-{uuid.uuid4().hex}"
        _made.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through the cluster's own file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _sweep() -> None:
    for spark, root in _made:
        try:
            delete(spark, root)
        except Exception:  # noqa: BLE001  the JVM may have ended before
            return


def slices(texts: Sequence[str], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of at most ``limit`` characters, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total > limit and i > start:
            yield start, i
            start, total = i, len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Run a per-batch function over Arrow batches.

    ``make()`` is called once in each task and returns the function, so that what it loads or
    caches lives as long as the task. The function gets a record batch of at most
    ``SLICE_BYTES`` characters of the column ``text`` (if there is one) and returns a column dict,
    or None for no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    out = pa_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            ranges: list[tuple[int, int]] = [(0, batch.num_rows)]
            if "text" in batch.schema.names:
                column = batch.column(batch.schema.get_field_index("text"))
                sizes = column.cast(pa.binary()) if pa.types.is_string(column.type) else column
                ranges = list(_by_bytes(sizes))
            for a, b in ranges:
                cols = one(batch.slice(a, b - a))
                if cols is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _by_bytes(column: pa.Array) -> Iterator[tuple[int, int]]:
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        total += n + 1
        if total > SLICE_BYTES and i > start:
            yield start, i
            start, total = i, n + 1
    if start < len(lengths):
        yield start, len(lengths)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """The two columns that text operators need; any others of the input, however named, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
