"""Timelines: gaps and islands, overlaps, coverage. Every join carries the group's equality keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_MS, LEAST_FRAMES, SWITCH_MS = 1500, 3, 400


def segments(rows: DataFrame, by: list[str], ts: str = "ts_ms", gap_ms: int = GAP_MS, least: int = LEAST_FRAMES) -> DataFrame:
    """by, start_ms, end_ms, frames: runs of rows at most gap_ms apart, of ``least`` rows or more (equal times count each)."""
    own = Window.partitionBy(*by).orderBy(ts)
    breaks = F.when(F.col(ts) - F.lag(ts).over(own) > gap_ms, 1).otherwise(0)
    runs = rows.select(*by, ts).withColumn("__new", breaks)
    runs = runs.withColumn("__run", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*by, "__run").agg(F.min(ts).alias("start_ms"), F.max(ts).alias("end_ms"), F.count("*").cast("int").alias("frames"))
    return out.filter(F.col("frames") >= least).drop("__run")


def overlaps(segs: DataFrame, scope: list[str], who: str) -> DataFrame:
    """scope, a, b (a < b), and both segments, of every pair whose times overlap strictly."""
    a = segs.select(*scope, F.col(who).alias("a"), F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    b = segs.select(*scope, F.col(who).alias("b"), F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    return a.join(b, scope).filter("a < b AND a_start < b_end AND b_start < a_end")


def sharing(segs: DataFrame, scope: list[str], who: str) -> DataFrame:
    """scope and who of everyone on screen together with someone else."""
    pairs = overlaps(segs, scope, who)
    return pairs.select(*scope, F.explode(F.array("a", "b")).alias(who)).distinct()


def covered(samples: DataFrame, segs: DataFrame, scope: list[str], who: str) -> DataFrame:
    """Samples whose time lies in a segment of another one (ends included)."""
    other = segs.select(*scope, F.col(who).alias("__other"), "start_ms", "end_ms")
    near = [samples[x] == other[x] for x in scope]
    inside = F.col("ts_ms").between(F.col("start_ms"), F.col("end_ms")) & (samples[who] != F.col("__other"))
    condition = inside
    for x in near:
        condition = x & condition
    return samples.join(other, condition, "left_semi")


def established(samples: DataFrame, segs: DataFrame, scope: list[str], who: str) -> DataFrame:
    """scope and who of those with a sample that no other one's segment covers."""
    alone = samples.join(covered(samples, segs, scope, who).select(*scope, who, "seq"), [*scope, who, "seq"], "left_anti")
    return alone.select(*scope, who).distinct()


def alternations(samples: DataFrame, scope: list[str], who: str, switch_ms: int = SWITCH_MS) -> DataFrame:
    """scope, a, b (a < b), alternations: fast switches between two ones' samples in common time order."""
    ones = samples.select(*scope, who).distinct()
    pairs = ones.withColumnRenamed(who, "a").join(ones.withColumnRenamed(who, "b"), scope).filter("a < b")
    side = lambda name, n: pairs.join(samples.withColumnRenamed(who, name), [*scope, name]).select(*scope, "a", "b", "ts_ms", "seq", F.lit(n).alias("side"))
    both = side("a", 0).unionByName(side("b", 1))
    order = Window.partitionBy(*scope, "a", "b").orderBy("ts_ms", "side", "seq")
    switch = (F.col("side") != F.lag("side").over(order)) & (F.col("ts_ms") - F.lag("ts_ms").over(order) <= switch_ms)
    return both.withColumn("__s", switch).groupBy(*scope, "a", "b").agg(F.count_if("__s").alias("alternations"))
