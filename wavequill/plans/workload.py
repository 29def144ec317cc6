"""The registered signal-analytics queries and their SQL counterparts.

Results are rounded to six places in both engines, as sums run in different orders; adding 0.0 turns -0.0 into 0.0.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..functions.aggregate import METHODS, aggregate, aggregate_pairs, method
from ..operators import complexity, decoding, filters, interpolate, ordinal, reject, signals, spectral, spindles, timelocked, waves
from ..operators import reference as ref
from ..operators.select import resolve_rois, select_channels
from ..sources import equipment, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


EVT = """
evt AS (SELECT CAST(user_id % 4 AS INT) AS element, event_type AS channel, event_id, value, CAST(json_extract_string(props, '$.k') AS INT) % 2 AS parity,
               row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY ts, event_id) - 1 AS sample FROM events)
"""
EPOCHS = (
    EVT
    + """
, cut AS (SELECT element, channel, CAST(sample // 10 AS INT) AS epoch, CAST(sample % 10 AS INT) AS t, value, parity FROM evt),
ep AS (SELECT *, count(*) OVER (PARTITION BY element, channel, epoch) AS n, arg_min(parity, t) OVER (PARTITION BY element, channel, epoch) AS cond FROM cut QUALIFY n = 10)
"""
)
VEC = """
vec AS (SELECT CAST(label AS INT) AS element, CAST(vec_id AS INT) AS epoch, CAST(label AS VARCHAR) AS condition, CAST(i // 8 AS INT) AS ch_idx, 'E' || (i // 8 + 1) AS channel,
               CAST(i % 8 AS INT) AS t, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) r(i))
"""


def agg_sql(name: str, value: str = "value") -> str:
    """SQL of an aggregation method over the rows of a group; trimmed means come from sorted lists."""
    plain = {"mean": "avg", "std": "stddev_pop", "median": "median", "min": "min", "max": "max", "sum": "sum"}
    if name in plain:
        return f"{plain[name]}({value})"
    cut = {"trim_mean80": "0.1", "trim_mean90": "0.05"}[name]
    return f"list_avg(list_sort(list({value}))[CAST(floor(count(*) * {cut}) AS BIGINT) + 1 : count(*) - CAST(floor(count(*) * {cut}) AS BIGINT)])"


# ---- event-locked --------------------------------------------------------------------------------


@query(
    "WITH"
    + EPOCHS
    + f""", top AS (SELECT element, channel, epoch, avg(CASE WHEN t BETWEEN 2 AND 7 THEN value END) - avg(CASE WHEN t <= 2 THEN value END) AS value FROM ep GROUP BY ALL),
trial AS (SELECT element, channel, {agg_sql("trim_mean80")} AS value FROM top GROUP BY element, channel)
SELECT element, round(avg(value), 6) + 0.0 AS value FROM trial GROUP BY element"""
)
def topography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-locked level, trimmed over epochs and averaged over channels: the flagship query."""
    top = timelocked.topography(tables.event_epochs(spark, sf_dir), 0.0, 0.5, (None, 0.0))
    return aggregate(top, ["element", "channel", "epoch"], "mean", "trim_mean80", "trial_channel").select("element", r6("value").alias("value"))


@query(
    "WITH"
    + EPOCHS
    + """, top AS (SELECT element, channel, epoch, cond, avg(CASE WHEN t BETWEEN 2 AND 7 THEN value END) - avg(CASE WHEN t <= 2 THEN value END) AS value FROM ep GROUP BY ALL)
SELECT element, channel, round(avg(CASE WHEN cond = 0 THEN value END) - avg(CASE WHEN cond = 1 THEN value END), 6) + 0.0 AS value FROM top GROUP BY element, channel"""
)
def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelocked.contrast(tables.event_epochs(spark, sf_dir), "0", "1", 0.0, 0.5, (None, 0.0)).select("element", "channel", r6("value").alias("value"))


@query(
    "WITH"
    + EPOCHS
    + """SELECT element, channel, epoch, round(regr_slope(value, (t - 2) / 10.0), 6) + 0.0 AS slope, round(regr_intercept(value, (t - 2) / 10.0), 6) + 0.0 AS intercept FROM ep WHERE t >= 2 GROUP BY element, channel, epoch"""
)
def cnv_slope_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelocked.linear_drift(tables.event_epochs(spark, sf_dir), 0.0, None).select("element", "channel", "epoch", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query(
    "WITH"
    + EPOCHS
    + """SELECT element, channel, epoch, t AS t_idx, round(value - avg(CASE WHEN t <= 2 THEN value END) OVER (PARTITION BY element, channel, epoch), 6) + 0.0 AS value FROM ep"""
)
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.explode_samples(signals.baseline(tables.event_epochs(spark, sf_dir))).select("element", "channel", "epoch", "t_idx", r6("value").alias("value"))


@query(
    "WITH"
    + EVT
    + """, w AS (SELECT element, channel, sample // 5 - d.i AS epoch, value FROM evt, range(2) d(i) WHERE sample // 5 - d.i >= 0)
SELECT element, channel, CAST(epoch AS INT) AS epoch, round(sum(value), 6) + 0.0 AS total FROM w GROUP BY ALL HAVING count(*) = 10"""
)
def epoch_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 10 samples, 5 apart."""
    cut = signals.fixed_epochs(tables.event_samples(spark, sf_dir), 10, 5)
    return cut.groupBy("element", "channel", "epoch").agg(r6(F.sum("value")).alias("total"))


@query(
    "WITH"
    + EVT
    + """, stim AS (SELECT element, sample AS at, row_number() OVER (PARTITION BY element ORDER BY sample) - 1 AS epoch FROM evt WHERE channel = 'click')
SELECT s.element, CAST(s.epoch AS INT) AS epoch, e.channel, round(avg(e.value), 6) + 0.0 AS value FROM stim s JOIN evt e ON e.element = s.element AND e.sample BETWEEN s.at - 2 AND s.at + 3
GROUP BY s.element, s.epoch, e.channel HAVING count(*) = 6"""
)
def epoch_events_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = tables.event_samples(spark, sf_dir)
    events = samples.where("channel = 'click'").select("element", "sample", F.lit(1).alias("code"))
    out = signals.event_epochs(samples, events, 2, 3)
    return out.groupBy("element", "epoch", "channel").agg(r6(F.avg("value")).alias("value"))


@query(
    "WITH"
    + EVT
    + """, stim AS (SELECT element, sample, CASE WHEN value > 80 THEN 1 ELSE 0 END AS v FROM evt WHERE channel = 'view'),
step AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY element ORDER BY sample), 0) AS prev FROM stim)
SELECT element, sample, CAST(prev AS INT) AS prev, CAST(v AS INT) AS code FROM step WHERE v <> prev AND v <> 0"""
)
def find_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stim = tables.event_samples(spark, sf_dir).where("channel = 'view'").select("element", "sample", F.when(F.col("value") > 80, 1.0).otherwise(0.0).alias("value"))
    return signals.triggers(stim)


# ---- aggregation ---------------------------------------------------------------------------------

for _m in METHODS:

    def _agg(spark: SparkSession, sf_dir: str, m: str = _m) -> DataFrame:
        by = timelocked.topography(tables.event_epochs(spark, sf_dir))
        return by.groupBy("element", "channel").agg(r6(method(m, "value")).alias("value"))

    query("WITH" + EPOCHS + f", m AS (SELECT element, channel, epoch, avg(value) AS value FROM ep GROUP BY ALL) SELECT element, channel, round({agg_sql(_m)}, 6) + 0.0 AS value FROM m GROUP BY element, channel", f"agg_{_m.replace('_mean', '')}")(_agg)

_VALUES = ", m AS (SELECT element, channel, epoch, avg(value) AS value FROM vec GROUP BY ALL)"


@query("WITH" + VEC + _VALUES + f", c AS (SELECT element, epoch, median(value) AS value FROM m GROUP BY element, epoch) SELECT element, round({agg_sql('trim_mean80')}, 6) + 0.0 AS value FROM c GROUP BY element")
def agg_order_channel_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = timelocked.topography(tables.vector_epochs(spark, sf_dir)).select("element", "channel", "epoch", "value")
    return aggregate(m, ["element", "channel", "epoch"], "median", "trim_mean80").select("element", r6("value").alias("value"))


@query("WITH" + VEC + _VALUES + f", c AS (SELECT element, channel, {agg_sql('trim_mean80')} AS value FROM m GROUP BY element, channel) SELECT element, round(median(value), 6) + 0.0 AS value FROM c GROUP BY element")
def agg_order_trial_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = timelocked.topography(tables.vector_epochs(spark, sf_dir)).select("element", "channel", "epoch", "value")
    return aggregate(m, ["element", "channel", "epoch"], "median", "trim_mean80", "trial_channel").select("element", r6("value").alias("value"))


# ---- equipment, regions, names -------------------------------------------------------------------


@query("WITH" + VEC + "SELECT epoch, channel, CAST(CASE channel WHEN 'E3' THEN 0 WHEN 'E6' THEN 1 ELSE 2 END AS INT) AS pos, round(sum(value), 6) + 0.0 AS total FROM vec WHERE channel IN ('E3', 'E6', 'E8') GROUP BY epoch, channel")
def roi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = resolve_rois(["Fz"], [f"E{i}" for i in range(1, 9)], "egi/64")
    rows = select_channels(tables.vector_epochs(spark, sf_dir), chosen)
    return rows.select("epoch", "channel", "pos", r6(F.aggregate("data", F.lit(0.0), lambda s, x: s + x)).alias("total"))


_CHANNELS = "CASE l_suppkey % 4 WHEN 0 THEN 'E' || (l_partkey % 300 + 1) WHEN 1 THEN 'E' || (l_partkey % 120 + 1) WHEN 2 THEN (CASE l_linenumber % 3 WHEN 0 THEN 'Fz' WHEN 1 THEN 'Cz' ELSE 'T7' END) ELSE 'B' || (l_partkey % 20 + 10) END"


@query(
    f"""WITH c AS (SELECT DISTINCT CAST(l_suppkey % 4 AS INT) AS element, {_CHANNELS} AS channel FROM lineitem),
n AS (SELECT element, count(*) AS n, count_if(regexp_full_match(channel, 'E[0-9]+')) AS e, count_if(channel IN ('Fp1', 'Fp2', 'Fz', 'Cz', 'Pz', 'Oz')) AS f, count_if(regexp_full_match(channel, '[ABCD][0-9][0-9]')) AS b FROM c GROUP BY element)
SELECT element, CASE WHEN e >= 200 THEN 'egi/256' WHEN e >= 100 THEN 'egi/128' WHEN e >= 50 THEN 'egi/64' WHEN f > 0 AND n >= 100 THEN 'brainvision/128' WHEN f > 0 THEN 'brainvision/32' WHEN b > 0 THEN 'biosemi/128' END AS equipment FROM n"""
)
def equipment_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = tables.read(spark, sf_dir, "lineitem").select(F.expr("cast(l_suppkey % 4 as int)").alias("element"), F.expr(_CHANNELS).alias("channel")).distinct()
    return equipment.detect(channels)


@query(
    """SELECT c_custkey, 'sub-' || c_custkey || (CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE '/ses-' || c_nationkey END) || '/eeg/sub-' || c_custkey || (CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE '_ses-' || c_nationkey END)
|| '_task-' || lower(c_mktsegment) || '_desc-markers_eeg.h5' AS path, CAST(c_custkey AS VARCHAR) AS subject FROM customer"""
)
def bids_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer")
    sub = F.format_string("sub-%05d", "c_custkey")
    bare = names.normalise_subject(sub)
    ses = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("ses-"), F.col("c_nationkey").cast("string")))
    none = F.lit(None).cast("string")
    path = names.bids_path(bare, ses, F.lower("c_mktsegment"), none, none, "markers", "eeg", "h5")
    return c.select("c_custkey", path.alias("path"), bare.alias("subject"))


# ---- references ----------------------------------------------------------------------------------


@query("WITH" + VEC + "SELECT element, epoch, channel, t AS t_idx, round(value - avg(value) OVER (PARTITION BY element, epoch, t), 6) + 0.0 AS value FROM vec")
def ref_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.explode_samples(tables.vector_epochs(spark, sf_dir))
    return ref.reference(s).select("element", "epoch", "channel", "t_idx", r6("value").alias("value"))


@query("WITH" + VEC + "SELECT element, epoch, channel, t AS t_idx, round(value - avg(CASE WHEN channel IN ('E1', 'E2') THEN value END) OVER (PARTITION BY element, epoch, t), 6) + 0.0 AS value FROM vec")
def ref_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.explode_samples(tables.vector_epochs(spark, sf_dir))
    return ref.reference(s, ["E1", "E2"], now=False).select("element", "epoch", "channel", "t_idx", r6("value").alias("value"))


# ---- rejection -----------------------------------------------------------------------------------

_SPANS = ", s AS (SELECT element, epoch, channel, max(value) - min(value) AS span FROM vec GROUP BY ALL)"
_BAD_EPOCHS = ", bad AS (SELECT element, epoch, CAST(count_if(span > 0.45) AS BIGINT) AS n_bad FROM s GROUP BY ALL HAVING count_if(span > 0.45) > floor(0.3 * count(*)))"


@query("WITH" + VEC + _SPANS + "SELECT element, channel, CAST(count_if(span > 0.35) AS BIGINT) AS n_bad FROM s GROUP BY element, channel HAVING count_if(span > 0.35) > floor(0.5 * count(*))")
def bad_channels_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject.bad_channels_by_range(tables.vector_epochs(spark, sf_dir), {"eeg": 0.35}, 0.5)


@query(
    "WITH"
    + VEC
    + """, s AS (SELECT element, channel, var_pop(value) AS v FROM vec GROUP BY ALL),
one AS (SELECT *, stddev_pop(v) OVER w > 0 AND abs(v - avg(v) OVER w) > 1.5 * stddev_pop(v) OVER w AS b FROM s WINDOW w AS (PARTITION BY element)),
two AS (SELECT *, b OR (stddev_pop(v) FILTER (WHERE NOT b) OVER w > 0 AND abs(v - avg(v) FILTER (WHERE NOT b) OVER w) > 1.5 * stddev_pop(v) FILTER (WHERE NOT b) OVER w) AS c FROM one WINDOW w AS (PARTITION BY element))
SELECT element, channel, round(v, 6) + 0.0 AS value, c AS is_bad FROM two"""
)
def bad_channels_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject.bad_channels_by_variance(tables.vector_epochs(spark, sf_dir), 1.5, 2).select("element", "channel", r6("value").alias("value"), "is_bad")


@query("WITH" + VEC + _SPANS + _BAD_EPOCHS + "SELECT element, epoch, n_bad FROM bad")
def bad_epochs_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject.bad_epochs_by_range(tables.vector_epochs(spark, sf_dir), {"eeg": 0.45}, 0.3)


@query("WITH" + VEC + _SPANS + _BAD_EPOCHS + "SELECT element, count(DISTINCT epoch) AS n_epochs, round(sum(value), 6) + 0.0 AS total FROM vec ANTI JOIN bad USING (element, epoch) GROUP BY element")
def drop_bad_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _ = reject.reject_epochs(tables.vector_epochs(spark, sf_dir), {"eeg": 0.45}, 0.3, 0.1, now=False)
    return left.groupBy("element").agg(F.countDistinct("epoch").alias("n_epochs"), r6(F.sum(F.aggregate("data", F.lit(0.0), lambda s, x: s + x))).alias("total"))


# ---- ordinal patterns ----------------------------------------------------------------------------

_SYMBOL = """CASE WHEN a <= b AND b <= c THEN 0 WHEN a <= c AND c < b THEN 1 WHEN b < a AND a <= c THEN 2 WHEN c < a AND a <= b THEN 3 WHEN b <= c AND c < a THEN 4 ELSE 5 END"""


@query(
    "WITH"
    + EPOCHS
    + f""", l AS (SELECT element, channel, epoch, t, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c FROM ep WINDOW w AS (PARTITION BY element, channel, epoch ORDER BY t)),
s AS (SELECT element, channel, epoch, {_SYMBOL} AS sym, count(*) AS n FROM l WHERE t <= 7 GROUP BY ALL)
SELECT element, channel, epoch, CAST(1 AS INT) AS tau, round(-sum(n / 8.0 * ln(n / 8.0)) / ln(6), 6) + 0.0 AS value FROM s GROUP BY element, channel, epoch"""
)
def perm_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordinal.permutation_entropy(tables.event_epochs(spark, sf_dir), (1,), 3)
    return out.select("element", "channel", "epoch", "tau", r6("value").alias("value"))


_PAIRS = (
    "WITH"
    + VEC
    + f""", l AS (SELECT element, epoch, channel, ch_idx, t, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS c FROM vec WINDOW w AS (PARTITION BY element, epoch, channel ORDER BY t)),
s AS (SELECT element, epoch, channel, ch_idx, t, {_SYMBOL} AS sym FROM l WHERE t <= 5),
p1 AS (SELECT epoch, channel, sym, count(*) / 6.0 AS p FROM s GROUP BY ALL),
j AS (SELECT x.element, x.epoch, x.channel AS ci, y.channel AS cj, x.sym AS si, y.sym AS sj, count(*) / 6.0 AS p FROM s x JOIN s y ON x.epoch = y.epoch AND x.t = y.t AND x.ch_idx < y.ch_idx GROUP BY ALL),
term AS (SELECT j.element, j.epoch, ci, cj, si, sj, j.p * (ln(j.p) - ln(a.p + 1e-15) - ln(b.p + 1e-15)) AS v FROM j JOIN p1 a ON a.epoch = j.epoch AND a.channel = ci AND a.sym = si JOIN p1 b ON b.epoch = j.epoch AND b.channel = cj AND b.sym = sj),
smi AS (SELECT element, epoch, ci, cj, sum(v) / ln(6) AS value FROM term GROUP BY ALL),
wsmi AS (SELECT element, epoch, ci, cj, sum(CASE WHEN si = sj OR si + sj = 5 THEN 0 ELSE v END) / ln(6) AS value FROM term GROUP BY ALL)
"""
)


@query(_PAIRS + "SELECT element, epoch, ci AS channel_i, cj AS channel_j, round(value, 6) + 0.0 AS value FROM smi")
def smi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordinal.mutual_information_sql(tables.vector_epochs(spark, sf_dir), 1, 3, False)
    return out.select("element", "epoch", "channel_i", "channel_j", r6("value").alias("value"))


@query(_PAIRS + "SELECT element, epoch, CAST(1 AS INT) AS tau, ci AS channel_i, cj AS channel_j, round(value, 6) + 0.0 AS value FROM wsmi")
def wsmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordinal.mutual_information(tables.vector_epochs(spark, sf_dir), (1,), 3, True, full=False)
    return out.select("element", "epoch", "tau", "channel_i", "channel_j", r6("value").alias("value"))


@query(
    _PAIRS
    + f""", full_ AS (SELECT element, epoch, ci, cj, value FROM wsmi UNION ALL SELECT element, epoch, cj, ci, value FROM wsmi UNION ALL SELECT DISTINCT element, epoch, channel, channel, 0.0 FROM vec),
con AS (SELECT element, epoch, ci, avg(value) AS value FROM full_ GROUP BY ALL), ch AS (SELECT element, epoch, median(value) AS value FROM con GROUP BY ALL)
SELECT element, round({agg_sql("trim_mean80")}, 6) + 0.0 AS value FROM ch GROUP BY element"""
)
def smi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordinal.mutual_information(tables.vector_epochs(spark, sf_dir), (1,), 3)
    return aggregate_pairs(out, ["element", "epoch", "channel_i", "channel_j"], "mean", "median", "trim_mean80").select("element", r6("value").alias("value"))


# ---- spectra -------------------------------------------------------------------------------------

_PSD = """
WITH x AS (SELECT CAST(label AS INT) AS element, CAST(vec_id AS INT) AS epoch, seg, i, CAST(embedding[seg * 16 + i + 1] AS DOUBLE) AS v FROM embeddings, range(3) s(seg), range(32) r(i)),
c AS (SELECT *, (v - avg(v) OVER (PARTITION BY epoch, seg)) * (0.54 - 0.46 * cos(2 * pi() * i / 32)) AS w FROM x),
f AS (SELECT element, epoch, seg, k, sum(w * cos(2 * pi() * k * i / 64)) AS re, sum(w * sin(2 * pi() * k * i / 64)) AS im FROM c, range(33) q(k) GROUP BY ALL),
psd AS (SELECT element, epoch, CAST(k AS DOUBLE) AS freq, avg((re * re + im * im) * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END)) / (64.0 * (SELECT sum(pow(0.54 - 0.46 * cos(2 * pi() * i / 32), 2)) FROM range(32) r(i))) AS power FROM f GROUP BY ALL),
bands(band, lo, hi) AS (VALUES ('delta', 1.0, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 12.0), ('beta', 12.0, 30.0), ('gamma', 30.0, 45.0)),
rel AS (SELECT element, epoch, freq, power / greatest(sum(power) OVER (PARTITION BY epoch), 1e-12) AS power FROM psd WHERE freq BETWEEN 1 AND 31)
"""


def _spectra(spark: SparkSession, sf_dir: str, fmin: float = 0.0, fmax: float | None = None) -> DataFrame:
    return spectral.psd(tables.vector_signals(spark, sf_dir), fmin, fmax, n_fft=64, n_per_seg=32, n_overlap=16)


_PSD_ROWS = "SELECT element, epoch, freq, round(power, 6) + 0.0 AS power FROM psd"


@query(_PSD + _PSD_ROWS)
def psd_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).select("element", "epoch", F.explode("psd").alias("p")).select("element", "epoch", "p.freq", r6("p.power").alias("power"))


@query(_PSD + _PSD_ROWS)
def psd_dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same densities without Python."""
    return spectral.psd_sql(tables.vector_signals(spark, sf_dir), 32, 16, 64, 64, 64.0).select("element", "epoch", "freq", r6("power").alias("power"))


@query(_PSD + "SELECT element, epoch, band, round(sum(power), 6) + 0.0 AS value FROM psd JOIN bands ON freq >= lo AND freq < hi AND freq BETWEEN 1 AND 31 GROUP BY element, epoch, band")
def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmin, fmax = spectral.band_range(spectral.BANDS, False, 64.0)
    return spectral.band_power(_spectra(spark, sf_dir, fmin, fmax)).select("element", "epoch", "band", r6("value").alias("value"))


@query(
    _PSD
    + """, b AS (SELECT element, epoch, band, sum(power) AS v FROM rel JOIN bands ON freq >= lo AND freq < hi GROUP BY element, epoch, band),
t AS (SELECT element, greatest(min(CASE WHEN v > 0 THEN v END) * 0.01, 2.220446049250313e-16) AS low FROM b GROUP BY element)
SELECT element, epoch, band, round(10 * log10(greatest(v, low)), 6) + 0.0 AS value FROM b JOIN t USING (element)"""
)
def band_power_rel_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmin, fmax = spectral.band_range(spectral.BANDS, True, 64.0)
    powers = spectral.band_power(spectral.normalise(_spectra(spark, sf_dir, fmin, fmax)))
    return spectral.decibels(powers).select("element", "epoch", "band", r6("value").alias("value"))


@query(_PSD + "SELECT element, epoch, band, round(sum(-power * ln(power)) / ln(count(*)), 6) + 0.0 AS value FROM rel JOIN bands ON freq >= lo AND freq < hi GROUP BY element, epoch, band HAVING count(*) > 1")
def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmin, fmax = spectral.band_range(spectral.BANDS, True, 64.0)
    out = spectral.band_power(spectral.normalise(_spectra(spark, sf_dir, fmin, fmax)), entropy=True)
    return out.select("element", "epoch", "band", r6("value").alias("value"))


@query(
    _PSD
    + """, s AS (SELECT element, epoch, freq, sum(power) OVER (PARTITION BY epoch ORDER BY freq) AS upto, sum(power) OVER (PARTITION BY epoch) AS total FROM psd WHERE freq BETWEEN 1 AND 31)
SELECT element, epoch, min(freq) AS value FROM s WHERE upto >= total * 0.9 GROUP BY element, epoch"""
)
def spectral_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectral_edge(_spectra(spark, sf_dir, 1.0, 31.0), 0.9).select("element", "epoch", "value")


@query(_PSD + ", m AS (SELECT element, freq, avg(power) AS power FROM psd GROUP BY ALL) SELECT element, printf('freq_%.2fHz', freq) AS name, round(power, 6) + 0.0 AS power, round(power / sum(power) OVER (PARTITION BY element), 6) + 0.0 AS norm FROM m")
def psd_estimator_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = spectral.mean_spectrum(_spectra(spark, sf_dir), ["element"])
    return mean.select("element", names.frequency_name(F.col("freq")).alias("name"), r6("power").alias("power"), r6("norm").alias("norm"))


# ---- waves ---------------------------------------------------------------------------------------

_WAVES = (
    "WITH"
    + EVT
    + """, x AS (SELECT element, channel, sample AS t, value - avg(value) OVER (PARTITION BY element, channel) AS v FROM evt),
g AS (SELECT *, CASE WHEN (v < 0) <> (lag(v) OVER (PARTITION BY element, channel ORDER BY t) < 0) THEN 1 ELSE 0 END AS turn FROM x),
h AS (SELECT *, sum(turn) OVER (PARTITION BY element, channel ORDER BY t) AS half FROM g),
a AS (SELECT element, channel, half, min(t) AS t0, min(v) AS lo, max(v) AS hi, arg_min(t, v) AS at_lo, arg_max(t, v) AS at_hi FROM h GROUP BY ALL),
w AS (SELECT element, channel, half, t0, lo, at_lo, lead(t0) OVER q AS m, lead(hi) OVER q AS hi, lead(at_hi) OVER q AS at_hi, lead(t0, 2) OVER q AS z FROM a WINDOW q AS (PARTITION BY element, channel ORDER BY half)),
wave AS (SELECT element, channel AS "Channel", t0 / 10.0 AS "Start", z / 10.0 AS "End", m / 10.0 AS "MidCrossing", (z - t0) / 10.0 AS "Duration", lo AS "ValNegPeak", hi AS "ValPosPeak", hi - lo AS "PTP", 10.0 / (z - t0) AS "Frequency",
  (hi - lo) / ((at_hi - at_lo) / 10.0) AS "Slope", abs(lo) / greatest((at_lo - t0) / 10.0, 2.220446049250313e-16) AS "DescendingSlope", abs(lo) / ((m - at_lo) / 10.0) AS "AscendingSlope"
  FROM w WHERE half >= 1 AND z IS NOT NULL AND lo < 0 AND hi > 0 AND hi - lo >= 15)
"""
)


@query(_WAVES + 'SELECT element, "Channel", round("Start", 6) + 0.0 AS "Start", round("End", 6) + 0.0 AS "End", round("PTP", 6) + 0.0 AS "PTP", round("Frequency", 6) + 0.0 AS "Frequency", round("Slope", 6) + 0.0 AS "Slope", round("AscendingSlope", 6) + 0.0 AS "AscendingSlope" FROM wave')
def slow_waves_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waves.zero_crossing_waves(tables.event_series(spark, sf_dir), 15.0)
    return w.select("element", "Channel", *(r6(c).alias(c) for c in ("Start", "End", "PTP", "Frequency", "Slope", "AscendingSlope")))


_CASCADE = _WAVES + ', k AS (SELECT * FROM wave WHERE "Frequency" <= 3 AND "PTP" < 200 AND "ValPosPeak" < 150)'
_CASCADE_ARGS = {"freq_threshold": 3.0, "max_ptp": 200.0, "artifact_threshold": 150.0}


@query(
    _CASCADE
    + """, l AS (SELECT element, "Channel", quantile_cont("PTP", 0.9) AS lim FROM k GROUP BY ALL)
SELECT element, "Channel", round("Start", 6) + 0.0 AS "Start", round("PTP", 6) + 0.0 AS "PTP" FROM k JOIN l USING (element, "Channel") WHERE "PTP" > lim"""
)
def slow_waves_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waves.zero_crossing_waves(tables.event_series(spark, sf_dir), 15.0)
    return waves.cascade(w, **_CASCADE_ARGS, ptp_percentile=90.0, keys=["element"]).select("element", "Channel", r6("Start").alias("Start"), r6("PTP").alias("PTP"))


@query(
    _WAVES
    + """, k AS (SELECT * FROM wave WHERE "Frequency" <= 3 AND "PTP" < 200 AND "ValPosPeak" < 150 AND "Channel" <> 'click')
SELECT g.element, g.channel AS "Channel", CAST(count("PTP") AS DOUBLE) AS "Density", coalesce(round(avg("PTP"), 6) + 0.0, -1.0) AS "PTP" FROM (SELECT DISTINCT element, channel FROM evt) g LEFT JOIN k ON k.element = g.element AND k."Channel" = g.channel GROUP BY ALL"""
)
def slow_waves_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and counts over the full grid; NaN (no waves) is shown as -1."""
    series = tables.event_series(spark, sf_dir)
    w = waves.cascade(waves.zero_crossing_waves(series.where("channel <> 'click'"), 15.0), **_CASCADE_ARGS, mode="fixed")
    grid = series.select("element", F.col("epoch").alias("Epoch"), F.col("channel").alias("Channel"))
    out = waves.features(w, grid, ("PTP",), ["element"])
    return out.select("element", "Channel", "Density", F.when(F.isnan("PTP"), -1.0).otherwise(r6("PTP")).alias("PTP"))


@query(
    _CASCADE
    + """, lim(ch, t) AS (VALUES ('click', 60.0), ('error', 75.0), ('view', 90.0))
SELECT element, "Channel", count(*) AS n, round(sum("PTP"), 6) + 0.0 AS total FROM k JOIN lim ON lim.ch = k."Channel" AND "PTP" > t GROUP BY element, k."Channel" """
)
def ptp_csv_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from a table; channels that it lacks lose all waves."""
    given = spark.createDataFrame([("sub-003", "click", 60.0), ("3", "error", 75.0), (" 03 ", "view", 90.0), ("04", "signup", 1.0)], "subject string, channel string, ptp_threshold double")
    limits = waves.subject_thresholds(given, "03")
    w = waves.cascade(waves.zero_crossing_waves(tables.event_series(spark, sf_dir), 15.0), **_CASCADE_ARGS, thresholds=limits)
    return w.groupBy("element", "Channel").agg(F.count("*").alias("n"), r6(F.sum("PTP")).alias("total"))


@query(
    _WAVES
    + """, far AS (SELECT element, channel, t FROM x WHERE abs(v) > 100)
SELECT element, "Channel", round("Start", 6) + 0.0 AS "Start" FROM wave w WHERE NOT EXISTS (SELECT 1 FROM far f WHERE f.element = w.element AND f.channel = w."Channel" AND abs(f.t - round(w."MidCrossing" * 10)) <= 10)"""
)
def waves_far_from_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = tables.event_series(spark, sf_dir)
    w = waves.zero_crossing_waves(series, 15.0)
    return waves.far_from_artifacts(w, series, 100.0, 1.0, ["element"]).select("element", "Channel", r6("Start").alias("Start"))


# ---- complexity and decoding ---------------------------------------------------------------------


@query(
    "WITH"
    + EPOCHS
    + """, s AS (SELECT element, channel, epoch, list_sort(list(value)) AS o, list(value ORDER BY t) AS d FROM ep GROUP BY ALL),
b AS (SELECT *, o[2] AS lo, (o[10] - o[2]) / 16 AS size FROM s)
SELECT element, channel, epoch, array_to_string([CAST(CASE WHEN size > 0 THEN greatest(0, least(15, CAST(trunc((x - lo) / size) AS INT))) ELSE 0 END AS INT) FOR x IN d], ',') AS letters FROM b"""
)
def kc_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.event_epochs(spark, sf_dir)
    return rows.select("element", "channel", "epoch", F.array_join(complexity.letters(F.col("data"), 16).cast("array<string>"), ",").alias("letters"))


@query()
def kolmogorov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity.kolmogorov(tables.event_series(spark, sf_dir)).select("element", "channel", r6("value").alias("value"))


@query(
    "WITH"
    + VEC
    + """, s AS (SELECT channel, t, element AS g, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM vec WHERE element IN (0, 1) GROUP BY ALL),
f AS (SELECT a.channel, a.t, (a.n * b.n / CAST(a.n + b.n AS DOUBLE) * pow(a.m - b.m, 2)) / ((a.n * a.v + b.n * b.v) / (a.n + b.n - 2)) AS f FROM s a JOIN s b ON a.channel = b.channel AND a.t = b.t AND a.g = 0 AND b.g = 1)
SELECT channel, t AS t_idx, CAST(row_number() OVER (ORDER BY f DESC, channel, t) AS INT) AS rank, round(f, 6) + 0.0 AS f FROM f QUALIFY rank <= 6"""
)
def anova_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of the features that tells two conditions apart best."""
    rows = signals.explode_samples(tables.vector_epochs(spark, sf_dir).where("element in (0, 1)")).withColumnRenamed("element", "label")
    f = decoding.anova_by_sql(rows, ["channel", "t_idx"])
    best = f.orderBy(F.desc("f"), "channel", "t_idx").limit(6)
    return best.select("channel", "t_idx", F.row_number().over(Window.orderBy(F.desc("f"), "channel", "t_idx")).alias("rank"), r6("f").alias("f"))


def _two_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.vector_epochs(spark, sf_dir).where("element in (0, 1)").withColumn("element", F.lit(0))


@query()
def window_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.window_decoding(_two_conditions(spark, sf_dir), ["0"], ["1"], n_splits=5).select("element", r6("value").alias("value"))


@query()
def time_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.time_decoding(_two_conditions(spark, sf_dir), ["0"], ["1"]).select("element", "t_idx", r6("value").alias("value"))


# ---- filters and spline matrices -----------------------------------------------------------------


def zero_phase_sql(source: str, kind: str, edge: str, order: int, pad: int, prefix: str = "") -> str:
    """Common table expressions that filter ``source`` (key, t from 0, v) forwards and backwards: ``filtered`` (key, t, v).

    Butterworth of an even order as biquads by the bilinear transform, each section's textbook coefficients from the edge over the
    rate; an odd extension of ``pad`` samples; every section starts as after an endless input of the first value. Runs go sample by sample.
    """
    n = order // 2
    sections = range(1, n + 1)
    q = {i: f"(1.0 / (2 * sin((2 * {i} - 1) * pi() / {2 * order})))" for i in sections}
    gain = "1" if kind == "high" else "k * k"
    middle = "-2 * b0" if kind == "high" else "2 * b0"
    coefficients = ", ".join(f"w{i} AS (SELECT {gain} / (1 + k / {q[i]} + k * k) AS b0, 2 * (k * k - 1) / (1 + k / {q[i]} + k * k) AS a1, (1 - k / {q[i]} + k * k) / (1 + k / {q[i]} + k * k) AS a2 FROM warp)" for i in sections)
    row = ", ".join(f"w{i}.b0 AS b{i}0, {middle.replace('b0', f'w{i}.b0')} AS b{i}1, w{i}.a1 AS a{i}1, w{i}.a2 AS a{i}2" for i in sections)
    # Level of each section after an endless unit step, and its two states.
    levels = {0: "1.0", **{i: f"l{i}" for i in sections}}
    steady = "c0 AS (SELECT * FROM co)"
    for i in sections:
        level = f"({levels[i - 1]} * (2 * b{i}0 + b{i}1) / (1 + a{i}1 + a{i}2))"
        steady += f", c{i} AS (SELECT *, {level} AS l{i}, {levels[i - 1]} * b{i}0 - a{i}2 * {level} AS y{i}, {levels[i - 1]} * (b{i}1 + b{i}0) - (a{i}1 + a{i}2) * {level} AS x{i} FROM c{i - 1})"

    def run(name: str, listed: str) -> str:
        start = ", ".join(f"x{i} * xs[1] AS p{i}, y{i} * xs[1] AS r{i}" for i in sections)
        inner = f"SELECT f.key, f.i + 1 AS i, l.xs[f.i + 1] AS o0, f.*, c.* EXCLUDE (key) FROM {name} f JOIN {listed} l ON l.key = f.key, (SELECT 0 AS key, * FROM c{n}) c WHERE f.i < len(l.xs)"
        for i in sections:
            inner = f"SELECT *, b{i}0 * o{i - 1} + p{i} AS o{i} FROM ({inner})"
        states = ", ".join(f"b{i}1 * o{i - 1} - a{i}1 * o{i} + r{i} AS p{i}, b{i}0 * o{i - 1} - a{i}2 * o{i} AS r{i}" for i in sections)
        first = ", ".join(f"p{i}, r{i}" for i in sections)
        return f"""{name}(key, i, v, {first}) AS (
  SELECT key, 0, CAST(0 AS DOUBLE), {start} FROM {listed}, c{n}
  UNION ALL
  SELECT key, CAST(i + 1 AS INT), o{n}, {states} FROM ({inner.replace("f.i + 1 AS i, ", "").replace("f.*, ", "f.i, " + ", ".join(f"f.p{i}, f.r{i}" for i in sections) + ", ")}))"""

    out = f"""warp AS (SELECT tan(pi() * ({edge})) AS k), {coefficients}, co AS (SELECT {row} FROM {", ".join(f"w{i}" for i in sections)}), {steady},
plain AS (SELECT key, list(v ORDER BY t) AS x FROM {source} GROUP BY key),
wide AS (SELECT key, [2 * x[1] - x[{pad} + 1 - j] FOR j IN range(0, {pad})] || x || [2 * x[len(x)] - x[len(x) - 1 - j] FOR j IN range(0, {pad})] AS xs FROM plain),
{run("ahead", "wide")}, turned AS (SELECT key, list(v ORDER BY i DESC) AS xs FROM ahead WHERE i > 0 GROUP BY key),
{run("back", "turned")}, ended AS (SELECT key, list(v ORDER BY i DESC) AS ys FROM back WHERE i > 0 GROUP BY key),
filtered AS (SELECT key, unnest(range(0, len(ys) - {2 * pad})) AS t, unnest(ys[{pad} + 1 : len(ys) - {pad}]) AS v FROM ended)
"""
    return re.sub(r"\b(warp|w\d|co|c\d|plain|wide|ahead|turned|back|ended|filtered)\b", rf"{prefix}\1", out) if prefix else out


_HF = (
    "WITH RECURSIVE"
    + VEC
    + ", j AS (SELECT element || ',' || channel AS key, element, channel, row_number() OVER (PARTITION BY element, channel ORDER BY epoch, t) - 1 AS t, value AS v FROM vec), "
    + zero_phase_sql("j", "high", "25.0 / 64", 4, 15)
    + """, s AS (SELECT split_part(key, ',', 1) AS e, split_part(key, ',', 2) AS channel, stddev_pop(v) AS value FROM filtered GROUP BY ALL),
one AS (SELECT *, stddev_pop(value) OVER w > 0 AND abs(value - avg(value) OVER w) > 1.5 * stddev_pop(value) OVER w AS b FROM s WINDOW w AS (PARTITION BY e)),
two AS (SELECT *, b OR (stddev_pop(value) FILTER (WHERE NOT b) OVER w > 0 AND abs(value - avg(value) FILTER (WHERE NOT b) OVER w) > 1.5 * stddev_pop(value) FILTER (WHERE NOT b) OVER w) AS c FROM one WINDOW w AS (PARTITION BY e))
SELECT CAST(e AS INT) AS element, channel, round(value, 6) + 0.0 AS value, c AS is_bad FROM two"""
)


@query(_HF)
def hf_bad_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vector_epochs(spark, sf_dir).withColumn("sfreq", F.lit(64.0))
    return reject.bad_channels_by_high_frequencies(rows, 1.5).select("element", "channel", r6("value").alias("value"), "is_bad")


_PE_FILTERED = (
    "WITH RECURSIVE"
    + EPOCHS
    + ", j AS (SELECT element || ',' || channel AS key, epoch * 10 + t AS t, value AS v FROM ep), "
    + zero_phase_sql("j", "low", "1.0 / 3", 6, 21)
    + f""", g AS (SELECT split_part(key, ',', 1) AS e, split_part(key, ',', 2) AS channel, t // 10 AS epoch, t % 10 AS t, v FROM filtered),
l AS (SELECT e, channel, epoch, t, v AS a, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c FROM g WINDOW w AS (PARTITION BY e, channel, epoch ORDER BY t)),
s AS (SELECT e, channel, epoch, {_SYMBOL} AS sym, count(*) AS n FROM l WHERE t <= 7 GROUP BY ALL)
SELECT CAST(e AS INT) AS element, channel, CAST(epoch AS INT) AS epoch, round(-sum(n / 8.0 * ln(n / 8.0)) / ln(6), 6) + 0.0 AS value FROM s GROUP BY e, channel, epoch"""
)


@query(_PE_FILTERED)
def perm_entropy_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.ordinal_low_pass(tables.event_epochs(spark, sf_dir), 3, 1)
    return ordinal.permutation_entropy(rows, (1,), 3).select("element", "channel", "epoch", r6("value").alias("value"))


# Notch and resampling by plain Fourier sums over the odd extension of a second at both ends; bins of a shorter signal are the first ones.
_FILTER_SQL = (
    "WITH RECURSIVE"
    + EVT
    + """, x AS (SELECT element || ',' || channel AS key, sample AS t, value - avg(value) OVER (PARTITION BY element, channel) AS v FROM evt), """
    + zero_phase_sql("x", "high", "0.1 / 10", 4, 15, "h")
    + ", "
    + zero_phase_sql("hfiltered", "low", "3.0 / 10", 8, 27, "l")
    + """, e1 AS (SELECT key, len(x) AS n, [2 * x[1] - x[11 - j] FOR j IN range(0, 10)] || x || [2 * x[len(x)] - x[len(x) - 1 - j] FOR j IN range(0, 10)] AS xs FROM (SELECT key, list(v ORDER BY t) AS x FROM lfiltered GROUP BY key)),
b1 AS (SELECT key, n, len(xs) AS m, k, list_sum([xs[t + 1] * cos(2 * pi() * k * t / len(xs)) FOR t IN range(0, len(xs))]) AS re, -list_sum([xs[t + 1] * sin(2 * pi() * k * t / len(xs)) FOR t IN range(0, len(xs))]) AS im FROM e1, LATERAL (SELECT unnest(range(0, len(xs) // 2 + 1)) AS k)),
g1 AS (SELECT *, CASE WHEN abs(k * 10.0 / m - 2) <= 0.5 THEN 0 WHEN abs(k * 10.0 / m - 2) >= 1 THEN 1 ELSE 0.5 - 0.5 * cos(pi() * (abs(k * 10.0 / m - 2) - 0.5) / 0.5) END * CASE WHEN k = 0 OR 2 * k = m THEN 1 ELSE 2 END / m AS g FROM b1),
l1 AS (SELECT key, any_value(n) AS n, any_value(m) AS m, list(re * g ORDER BY k) AS re, list(im * g ORDER BY k) AS im FROM g1 GROUP BY key),
y1 AS (SELECT key, n, [list_sum([re[k + 1] * cos(2 * pi() * k * t / m) - im[k + 1] * sin(2 * pi() * k * t / m) FOR k IN range(0, len(re))]) FOR t IN range(10, 10 + n)] AS x FROM l1),
e2 AS (SELECT key, n, [2 * x[1] - x[11 - j] FOR j IN range(0, 10)] || x || [2 * x[len(x)] - x[len(x) - 1 - j] FOR j IN range(0, 10)] AS xs, CAST(round((n + 20) * 0.8) AS BIGINT) AS size FROM y1),
b2 AS (SELECT key, n, size, len(xs) AS m, k, list_sum([xs[t + 1] * cos(2 * pi() * k * t / len(xs)) FOR t IN range(0, len(xs))]) AS re, -list_sum([xs[t + 1] * sin(2 * pi() * k * t / len(xs)) FOR t IN range(0, len(xs))]) AS im FROM e2, LATERAL (SELECT unnest(range(0, size // 2 + 1)) AS k)),
l2 AS (SELECT key, any_value(n) AS n, any_value(size) AS size, list(re * CASE WHEN k = 0 OR 2 * k = size THEN 1 ELSE 2 END / m ORDER BY k) AS re, list(im * CASE WHEN k = 0 OR 2 * k = size THEN 1 ELSE 2 END / m ORDER BY k) AS im FROM b2 GROUP BY key),
y2 AS (SELECT key, [list_sum([re[k + 1] * cos(2 * pi() * k * t / size) - im[k + 1] * sin(2 * pi() * k * t / size) FOR k IN range(0, len(re))]) FOR t IN range(8, 8 + CAST(round(n * 0.8) AS BIGINT))] AS y FROM l2)
SELECT CAST(split_part(key, ',', 1) AS INT) AS element, split_part(key, ',', 2) AS channel, CAST(len(y) AS INT) AS n, round(list_sum([v * v FOR v IN y]), 6) + 0.0 AS power FROM y2"""
)


@query(_FILTER_SQL)
def filter_iir(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filters.clean(tables.event_series(spark, sf_dir), high_pass=0.1, low_pass=3.0, notches=(2.0,), resample=8.0)
    return out.select("element", "channel", F.size("data").alias("n"), r6(F.aggregate("data", F.lit(0.0), lambda s, x: s + x * x)).alias("power"))


@query()
def spindles_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = tables.event_series(spark, sf_dir).withColumn("sfreq", F.lit(100.0))
    grid = series.select("element", F.col("epoch").alias("Epoch"), F.col("channel").alias("Channel"))
    found = spindles.spindles(series, keys=["element"])
    return spindles.features(found, grid, ["element"]).select("element", "Channel", "Density", *(r6(c).alias(c) for c in ("Duration", "Amplitude", "Frequency")))


def _ring() -> dict[str, tuple[float, float, float]]:
    """Eight made-up places on a unit sphere."""
    import numpy as np

    angle, height = 2 * np.pi * np.arange(8) / 8, 0.3 + 0.05 * np.arange(8)
    return {f"E{i + 1}": (float(np.cos(a) * np.sqrt(1 - h * h)), float(np.sin(a) * np.sqrt(1 - h * h)), float(h)) for i, (a, h) in enumerate(zip(angle, height, strict=True))}


#: Places of ``_ring``, cosines between them, Legendre polynomials by their recursion, and the spline sums of both powers.
_SPLINES = """
place AS (SELECT CAST(i AS INT) AS i, 'E' || (i + 1) AS ch, cos(pi() * i / 4) * sqrt(1 - pow(0.3 + 0.05 * i, 2)) AS x, sin(pi() * i / 4) * sqrt(1 - pow(0.3 + 0.05 * i, 2)) AS y, 0.3 + 0.05 * i AS z FROM range(8) r(i)),
angle AS (SELECT a.i, b.i AS j, greatest(-1, least(1, a.x * b.x + a.y * b.y + a.z * b.z)) AS c FROM place a, place b),
leg(i, j, c, n, p, before) AS (SELECT i, j, c, 1, c, CAST(1 AS DOUBLE) FROM angle UNION ALL SELECT i, j, c, n + 1, ((2 * n + 1) * c * p - n * before) / (n + 1), p FROM leg WHERE n < 50),
spline AS (SELECT i, j, sum((2 * n + 1) / pow(n * (n + 1.0), 4) * p) / (4 * pi()) AS g, sum((2 * n + 1) / pow(n * (n + 1.0), 3) * p) / (4 * pi()) AS h FROM leg GROUP BY i, j)
"""


def solved_sql(name: str, rows: str, size: int) -> str:
    """Gauss and Jordan's elimination: ``name`` (k, m), of which step ``size`` holds the rows of ``rows`` (r, row: a square part and right sides) solved."""
    return f"""{name}(k, m) AS (
  SELECT 0, list(row ORDER BY r) FROM {rows}
  UNION ALL
  SELECT k + 1, [CASE WHEN r = k + 1 THEN [v / m[k + 1][k + 1] FOR v IN m[r]] ELSE [m[r][c] - m[r][k + 1] * m[k + 1][c] / m[k + 1][k + 1] FOR c IN range(1, len(m[r]) + 1)] END FOR r IN range(1, {size} + 1)]
  FROM {name} WHERE k < {size})"""


# Bad places 1 and 6 from the six others: the spline system with a constant, and the bad places' values as right sides.
_INTERP_SQL = (
    "WITH RECURSIVE"
    + VEC
    + ","
    + _SPLINES
    + """, good AS (SELECT i, row_number() OVER (ORDER BY i) AS r FROM place WHERE i NOT IN (1, 6)),
sys AS (SELECT a.r, list(s.g + CASE WHEN a.r = b.r THEN 1e-5 ELSE 0 END ORDER BY b.r) || [1.0] || [(SELECT o.g FROM spline o WHERE o.i = 1 AND o.j = a.i), (SELECT o.g FROM spline o WHERE o.i = 6 AND o.j = a.i)] AS row
  FROM good a, good b JOIN spline s ON s.i = a.i AND s.j = b.i GROUP BY a.r, a.i UNION ALL SELECT 7, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0]),
"""
    + solved_sql("solved", "sys", 7)
    + """, w AS (SELECT CASE b WHEN 1 THEN 'E2' ELSE 'E7' END AS bad, 'E' || (i + 1) AS good, m[r][7 + b] AS w FROM solved, good, range(1, 3) q(b) WHERE k = 7)
SELECT element, epoch, bad AS channel, t AS t_idx, round(sum(w * value), 6) + 0.0 AS value FROM vec JOIN w ON good = channel GROUP BY element, epoch, bad, t"""
)


@query(_INTERP_SQL)
def spherical_interp_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.explode_samples(tables.vector_epochs(spark, sf_dir))
    out = interpolate.interpolate(s, _ring(), ["E2", "E7"])
    return out.where("channel in ('E2', 'E7')").select("element", "epoch", "channel", "t_idx", r6("value").alias("value"))


# The inverse of the spline matrix, its part without a constant, and the Laplacian's sums over average-referenced values; the places lie on a sphere of radius 1.
_CSD_SQL = (
    "WITH RECURSIVE"
    + VEC
    + ","
    + _SPLINES
    + """, sys AS (SELECT i + 1 AS r, list(g + CASE WHEN i = j THEN 1e-5 ELSE 0 END ORDER BY j) || [CASE WHEN i = q THEN 1.0 ELSE 0.0 END FOR q IN range(0, 8)] AS row FROM spline GROUP BY i),
"""
    + solved_sql("solved", "sys", 8)
    + """, inv AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, m[i + 1][9 + j] AS v FROM solved, range(8) a(i), range(8) b(j) WHERE k = 8),
part AS (SELECT i, j, v - (sum(v) OVER (PARTITION BY i)) * (sum(v) OVER (PARTITION BY j)) / (sum(v) OVER ()) AS v FROM inv),
tot AS (SELECT element, epoch, ch_idx AS j, sum(value) - avg(sum(value)) OVER (PARTITION BY element, epoch) AS s FROM vec GROUP BY element, epoch, ch_idx),
c AS (SELECT element, epoch, i, sum(v * s) AS c FROM part JOIN tot USING (j) GROUP BY element, epoch, i)
SELECT element, epoch, 'E' || (spline.i + 1) AS channel, round(sum(h * c), 6) + 0.0 AS total FROM c JOIN spline ON spline.j = c.i GROUP BY element, epoch, spline.i"""
)


@query(_CSD_SQL)
def csd(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    m = interpolate.csd_matrix(np.array(list(_ring().values())))
    out = interpolate.mix_channels(tables.vector_epochs(spark, sf_dir), m)
    return out.select("element", "epoch", "channel", r6(F.aggregate("data", F.lit(0.0), lambda s, x: s + x)).alias("total"))
