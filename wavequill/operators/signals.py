"""The two layouts of recordings, and what moves between and along them.

Signal rows hold one channel of one epoch: key columns, ``epoch`` (null for continuous data),
``condition``, ``ch_idx``, ``channel``, ``sfreq``, ``tmin`` and ``data``, an array of doubles.
Sample rows are the same exploded: ``t_idx``, ``t`` and ``value`` in place of ``data``. Kernels that look
at one channel at a time work on signal rows without a shuffle; steps across channels use sample rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNAL_SCHEMA = "subject string, session string, task string, acq string, run string, epoch int, condition string, ch_idx int, channel string, sfreq double, tmin double, data array<double>"


#: Names of channels that carry event codes.
STIMULUS = "(?i)^(sti|stim|status|trigger|event)"


def explode_samples(signals: DataFrame) -> DataFrame:
    """Sample rows of signal rows."""
    keep = [c for c in signals.columns if c != "data"]
    out = signals.select(*keep, F.posexplode("data").alias("t_idx", "value"))
    return out.withColumn("t", F.col("tmin") + F.col("t_idx") / F.col("sfreq"))


def collect_signals(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signal rows of sample rows: values in order of t_idx whatever the order of the shuffle."""
    ordered = F.array_sort(F.collect_list(F.struct("t_idx", "value")))
    return samples.groupBy(*keys).agg(F.transform(ordered, lambda x: x["value"]).alias("data"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where body uses it inside a lambda.

    A plain column would be inlined into the lambda and computed again for each array element.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def first_index(t: float | None, sfreq: Column, tmin: Column) -> Column:
    """Index of the first sample at or after a time; sample times are compared to a millionth of a sample."""
    return F.lit(0) if t is None else F.greatest(F.lit(0), F.ceil((F.lit(float(t)) - tmin) * sfreq - 1e-6).cast("int"))


def last_index(t: float | None, sfreq: Column, tmin: Column, n: Column) -> Column:
    return n - 1 if t is None else F.least(n - 1, F.floor((F.lit(float(t)) - tmin) * sfreq + 1e-6).cast("int"))


def window(values: Column, sfreq: Column, tmin: Column, start: float | None, stop: float | None) -> Column:
    """The samples of an array within [start, stop], both ends included; None and times outside mean the array's ends."""
    a, b = first_index(start, sfreq, tmin), last_index(stop, sfreq, tmin, F.size(values))
    return F.slice(values, a + 1, F.greatest(F.lit(0), b - a + 1))


def crop(signals: DataFrame, tmin: float | None = None, tmax: float | None = None) -> DataFrame:
    """Keep the samples within [tmin, tmax]; tmin of the rows moves along."""
    if tmin is None and tmax is None:
        return signals
    s, t = F.col("sfreq"), F.col("tmin")
    return signals.withColumn("data", window(F.col("data"), s, t, tmin, tmax)).withColumn("tmin", t + first_index(tmin, s, t) / s)


def baseline(signals: DataFrame, start: float | None = None, stop: float | None = 0.0) -> DataFrame:
    """Subtract each row's mean over [start, stop]; an empty window leaves the row as it is."""
    base = window(F.col("data"), F.col("sfreq"), F.col("tmin"), start, stop)
    level = let(base, lambda b: F.when(F.size(b) > 0, mean(b)).otherwise(0.0))
    return signals.withColumn("data", let(level, lambda m: F.transform("data", lambda x: x - m)))


def fixed_epochs(samples: DataFrame, n_samples: int, overlap: int = 0, keys: Sequence[str] = ("element", "channel")) -> DataFrame:
    """Cut continuous sample rows (column ``sample``) into windows of n_samples; an incomplete last one is dropped.

    Windows without overlap are a division; with overlap each sample goes to all windows that it lies in.
    """
    step = n_samples - overlap
    if step <= 0:
        raise ValueError("overlap must be less than the window")
    last = F.floor(F.col("sample") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("sample") - n_samples + 1) / step))
    out = samples.withColumn("epoch", last if overlap == 0 else F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    out = out.withColumn("epoch", F.col("epoch").cast("int")).withColumn("t_idx", (F.col("sample") - F.col("epoch") * step).cast("int"))
    whole = out.groupBy(*keys, "epoch").agg(F.count("*").alias("__n")).where(F.col("__n") == n_samples).drop("__n")
    return out.join(whole, [*keys, "epoch"], "left_semi")


def triggers(stim: DataFrame, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Events of a stimulus channel: samples whose value differs from the one before and is not 0."""
    from pyspark.sql.window import Window

    before = F.coalesce(F.lag("value").over(Window.partitionBy(*keys).orderBy("sample")), F.lit(0.0))
    return stim.withColumn("prev", before).where((F.col("value") != F.col("prev")) & (F.col("value") != 0)).select(*keys, "sample", F.col("prev").cast("int").alias("prev"), F.col("value").cast("int").alias("code"))


def event_epochs(samples: DataFrame, events: DataFrame, before: int, after: int, key: str = "element") -> DataFrame:
    """Samples within [event - before, event + after] of each event, as epochs; events too near an end are dropped.

    The interval join is an equality join: time is cut into bins as long as the window, each event meets
    the two or three bins that it reaches, and samples meet their own. Events are numbered by sample in each element.
    """
    from pyspark.sql.window import Window

    width = before + after + 1
    numbered = events.withColumn("epoch", (F.row_number().over(Window.partitionBy(key).orderBy("sample", "code")) - 1).cast("int")).withColumnRenamed("sample", "at")
    reach = numbered.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("at") - before) / width), F.floor((F.col("at") + after) / width))))
    met = samples.withColumn("__bin", F.floor(F.col("sample") / width)).join(reach, [key, "__bin"])
    met = met.where((F.col("sample") >= F.col("at") - before) & (F.col("sample") <= F.col("at") + after)).drop("__bin")
    out = met.withColumn("t_idx", (F.col("sample") - F.col("at") + before).cast("int"))
    whole = out.groupBy(key, "channel", "epoch").agg(F.count("*").alias("__n")).where(F.col("__n") == width).drop("__n")
    return out.join(whole, [key, "channel", "epoch"], "left_semi")


def stimulus_events(signals: DataFrame, channel: str = STIMULUS, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Events of continuous rows of stimulus channels (a pattern of names): keys, sample, code. As ``triggers``, within each row's array."""
    rows = signals.where(F.col("channel").rlike(channel))
    at = F.transform("data", lambda x, i: F.struct(i.cast("long").alias("sample"), x.cast("int").alias("code"), F.coalesce(F.get("data", i - 1), F.lit(0.0)).cast("int").alias("prev")))
    return rows.select(*keys, F.explode(F.filter(at, lambda e: (e["code"] != e["prev"]) & (e["code"] != 0))).alias("e")).select(*keys, "e.sample", "e.code")


def cut_events(signals: DataFrame, events: DataFrame, tmin: float, tmax: float, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Epochs of continuous signal rows around events (keys, sample, code, name): the samples within [tmin, tmax] of each event.

    A recording's events are bounded and meet each of its channels as one array, so that signals are joined once and sliced, not
    joined sample by sample. Epochs are numbered by sample in the recording; those that reach beyond an end are
    left out, without changing the others' numbers. A recording without events is an error.
    """
    listed = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("sample").cast("long").alias("sample"), F.col("code").cast("int").alias("code"), "name"))).alias("__events"))
    none = F.raise_error(F.concat(F.lit("no matching events for "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))).cast("array<struct<sample:bigint,code:int,name:string>>")
    met = signals.join(listed, list(keys), "left").withColumn("__events", F.coalesce("__events", none))
    first, width = F.round(F.lit(float(tmin)) * F.col("sfreq")).cast("int"), (F.round(F.lit(float(tmax)) * F.col("sfreq")) - F.round(F.lit(float(tmin)) * F.col("sfreq"))).cast("int") + 1
    start = lambda e: e["sample"].cast("int") + first
    cut = F.transform("__events", lambda e, i: F.struct(i.alias("epoch"), e["name"].alias("condition"), F.when((start(e) >= 0) & (start(e) + width <= F.size("data")), F.slice("data", start(e) + 1, width)).alias("data")))
    whole = F.filter(cut, lambda e: e["data"].isNotNull())
    return met.withColumn("__e", F.explode(whole)).select(*(F.col("__e")[c].alias(c) if c in ("epoch", "condition", "data") else F.col(c) for c in signals.columns if c != "tmin"), (first / F.col("sfreq")).alias("tmin"))
