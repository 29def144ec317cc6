"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Scratch

#: Hexadecimal digits of the hash that one level of histograms resolves; five levels resolve all 60 bits.
LEVEL_DIGITS, LEVELS = 3, 5


def word_count(text: Column) -> Column:
    """Number of runs of anything but blank, tab, line feed, vertical tab, form feed and return; null: 0."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (1, 2, 3), total: float | None = None, most: float = 3) -> dict[str | None, float]:
    """Words to take of each source.

    Sources by code point, null last, get the weights in turn and share ``total`` (all words) in
    proportion. A target above ``most`` times its source's size stops there; what it leaves is
    shared among the others by weight, until none is above. Sources without words get 0.
    """
    names = sorted((s for s, _ in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * any(s is None for s, _ in sizes)
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest = float(sum(size.values()) if total is None else total)
    out: dict[str | None, float] = {}
    open_ = list(names)
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > most * size[s]]
        if not full:
            out |= {s: weight[s] * share for s in open_}
            break
        for s in full:
            out[s] = float(most * size[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


#: Tables by source are sent to every task while there are at most so many sources (some 10 MB); more are joined by a shuffle.
SENT_SOURCES = 100_000


def _hash(seed: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, LEVEL_DIGITS * LEVELS)


def _copies(h: Column, whole: Column, below: Column, also: Column, most: int = 3) -> Column:
    extra = (h < below) | (also & (h == below))
    return whole + F.when((whole < most) & extra, 1).otherwise(0)


def goals(totals: DataFrame, scratch: Scratch, weights: Sequence[float], most: float) -> tuple[DataFrame, int]:
    """``targets`` for any number of sources: source, source_size, target, whole and budget from a table of source and n, and the number of sources.

    Ranks come from a range sort and the counts of the ranges before; a round of resharing is one aggregate. The driver gets counts by
    range and three sums a round.
    """
    spark = totals.sparkSession
    order = F.col("source").asc_nulls_last()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.keep(totals.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "totals")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    held = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = spark.createDataFrame([(p, sum(c for _, c in held[:i])) for i, (p, _) in enumerate(held)], "part long, before long")
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("before") + row) % len(weights) + 1).cast("int"))
    weighted = placed.join(F.broadcast(before), part == F.col("part")).select("source", "n", turn.alias("w"))
    total, share, closed = None, None, -1
    full = F.lit(False)
    while True:
        r = weighted.agg(F.sum("n").alias("total"), F.count_if(full).alias("closed"), F.sum(F.when(full, most * F.col("n"))).alias("taken"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        total = float(r["total"] or 0) if total is None else total
        if r["closed"] == closed or not r["open"]:
            break
        closed, share = r["closed"], (total - (r["taken"] or 0)) / r["open"]
        full = full | (F.col("w") * share > most * F.col("n"))
    target = F.when(full, (most * F.col("n")).cast("double")).otherwise(F.col("w") * (share or 0.0))
    whole = F.when(F.col("n") > 0, F.least(F.floor(F.col("target") / F.col("n")), F.lit(int(most)))).otherwise(0).cast("int")
    out = weighted.withColumn("target", target).withColumn("whole", whole)
    return out.select("source", F.col("n").alias("source_size"), "target", "whole", (F.col("target") - F.col("whole") * F.col("n")).alias("budget")), sum(c for _, c in held)


def plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: str = "mix") -> tuple[DataFrame, DataFrame, Scratch]:
    """The thresholds by source (to be sent to every task if there are few), the sizes and hashes of all rows, and the scratch folder that holds both."""
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), _hash(seed).alias("h")), "sized")
    budgets, sources = goals(sized.groupBy("source").agg(F.sum("size").alias("n")), scratch, weights, most)
    sent = F.broadcast if sources <= SENT_SOURCES else lambda df: df
    return sent(_thresholds(sized, budgets, scratch, sent)), sized, scratch


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: str = "mix") -> tuple[DataFrame, Scratch]:
    """How often each document is taken, so that every source comes near its target.

    Returns doc_id, source, size, source_size, target, copies and taken, a row for each row of
    ``docs``, and the scratch folder that it reads. A source with a target above its size is taken
    whole as often as it fits; the remainder is a set of documents whose hash lies below a
    threshold. Levels of histograms find it: words by source and leading hash digits, then the
    same within the boundary bucket alone, until the boundary is one hash value (most often after two levels); that one is taken
    if this brings the source nearer to its target. Smaller budgets take subsets of larger ones, no
    documents are sorted, and reruns agree, as the hash is of seed and doc_id.

    Null texts have size 0; a null source is a source of its own; null doc_ids share a hash, and so
    do repeated rows, which are taken or left together. An empty table gives an empty result.
    Totals and thresholds are tables, of any number of sources.
    """
    threshold, sized, scratch = plan(docs, weights, most, seed)
    where = sized.alias("d").join(threshold.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    copies = _copies(F.col("d.h"), F.col("p.whole"), F.col("p.below"), F.col("p.also"), most)
    out = where.select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target", copies.alias("copies"))
    return out.withColumn("taken", (F.col("size") * F.col("copies")).cast("long")), scratch


def repeat(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it, with its columns as they were.

    Sizes and hashes are computed once more beside the rows, so that no text is joined or shuffled:
    the thresholds of the sources, all that is needed, are sent to every task.
    """
    threshold = plan(docs)[0]
    # Everything of the input is in one column and everything made beside it in another, so that no name can clash.
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.col("source").cast("string").alias("s"), _hash("mix").alias("h")).alias("mix"))
    met = base.join(threshold.select(F.struct("source", "whole", "below", "also").alias("plan")), F.col("mix.s").eqNullSafe(F.col("plan.source")))
    copies = _copies(F.col("mix.h"), F.col("plan.whole"), F.col("plan.below"), F.col("plan.also"))
    return met.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")


def _thresholds(sized: DataFrame, budgets: DataFrame, scratch: Scratch, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each source the hash below which documents are taken, and whether that hash itself is.

    A table keeps for each source the beginning of its boundary hash that is known so far, the words below it and those in it; a null
    beginning means that all fits.
    """
    state = scratch.keep(budgets.select("*", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("spent"), F.lit(None).cast("long").alias("last")), "state-0")
    for level in range(1, LEVELS + 1):
        n = LEVEL_DIGITS * level
        going = state.where(F.length("prefix") < n)
        if going.isEmpty():
            break
        bounds = sent(going.select("source", "prefix", (F.col("budget") - F.col("spent")).alias("room"))).alias("b")
        inside = sized.alias("d").join(bounds, F.col("d.source").eqNullSafe(F.col("b.source")) & F.col("d.h").startswith(F.col("b.prefix")))
        histogram = inside.groupBy("d.source", "b.room", F.substring("d.h", 1, n).alias("bucket")).agg(F.sum("d.size").alias("n"), F.min("d.h").alias("least"), F.max("d.h").alias("most"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # The boundary bucket is the first that would pass the budget; at most 16^LEVEL_DIGITS buckets a source.
        over = histogram.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") > F.col("room"))
        met = over.groupBy("source").agg(F.min(F.struct("bucket", "upto", "n", "least", "most")).alias("m")).select(F.col("source").alias("of"), "m")
        both = state.join(sent(met), F.col("source").eqNullSafe(F.col("of")), "left")
        open_, found = F.coalesce(F.length("prefix") < n, F.lit(False)), F.col("m").isNotNull()
        # A bucket of one hash value is the boundary itself: no further level has to look into it.
        prefix = F.when(open_ & found, F.when(F.col("m.least") == F.col("m.most"), F.col("m.least")).otherwise(F.col("m.bucket"))).when(~open_, F.col("prefix"))
        state = scratch.keep(
            both.select(*(c for c in state.columns if c not in ("prefix", "spent", "last")), prefix.alias("prefix"), (F.col("spent") + F.coalesce(F.col("m.upto") - F.col("m.n"), F.lit(0))).alias("spent"), F.coalesce("m.n", "last").alias("last")), f"state-{level}",
        )
    under, beyond = F.col("budget") - F.col("spent"), F.col("spent") + F.col("last") - F.col("budget")
    also = F.col("prefix").isNotNull() & F.coalesce(beyond < under, F.lit(False))
    return state.select("source", "source_size", "target", "whole", F.coalesce("prefix", F.lit("g")).alias("below"), also.alias("also"))


def mix_sql(weights: Mapping[int, int] | None = None) -> str:
    """The same mix in plain SQL over ``documents``: a running sum in hash order in place of the histograms."""
    return r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY source),
w AS (SELECT source, n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM src),
fill(step, source, n, w, capped, t) AS (
  SELECT 0, source, n, w, false, CAST(0 AS DOUBLE) FROM w
  UNION ALL
  SELECT step + 1, source, n, w, capped OR share > 3 * n, CASE WHEN capped OR share > 3 * n THEN CAST(3 * n AS DOUBLE) ELSE share END
  FROM (SELECT *, w * (CAST((sum(n) OVER ()) - coalesce(sum(CASE WHEN capped THEN 3 * n END) OVER (), 0) AS DOUBLE) / CAST(nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) AS DOUBLE)) AS share FROM fill) f
  WHERE step < 40),
goal AS (SELECT source, n, t AS target, least(CAST(floor(t / nullif(n, 0)) AS BIGINT), 3) AS whole FROM fill WHERE step = 40),
runs AS (
  SELECT s.source, s.h, sum(s.size) AS hs FROM sized s GROUP BY s.source, s.h),
cum AS (
  SELECT r.source, r.h, hs, sum(hs) OVER (PARTITION BY r.source ORDER BY h) AS upto, g.target - coalesce(whole, 0) * g.n AS budget
  FROM runs r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source),
first_over AS (SELECT source, min(h) AS h FROM cum WHERE upto > budget GROUP BY source),
took AS (
  SELECT c.source, c.h, CASE WHEN f.h IS NULL OR c.h < f.h THEN 1 WHEN c.h = f.h AND upto - budget < budget - (upto - hs) THEN 1 ELSE 0 END AS extra
  FROM cum c LEFT JOIN first_over f ON c.source IS NOT DISTINCT FROM f.source)
SELECT s.doc_id, s.size, g.n AS source_size, g.target AS target,
       CAST(s.size * (coalesce(g.whole, 0) + CASE WHEN coalesce(g.whole, 0) < 3 THEN k.extra ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
JOIN took k ON k.source IS NOT DISTINCT FROM s.source AND k.h = s.h
"""
