"""Where on the screen someone stands: robust centres, separation, shared frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import scalar as S

MOST_MAD, LEAST_DX, MOST_IOU, LEAST_PAIRED = 0.08, 0.20, 0.05, 3


def upper_median(values: Column) -> Column:
    """Of a sorted array: the element at half its size."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def steady_regions(samples: DataFrame, by: list[str], most_mad: float = MOST_MAD) -> DataFrame:
    """by, median_x, mad_x of those whose horizontal place is known twice or more and holds still."""
    xs = samples.withColumn("__x", S.center_x()).filter("__x IS NOT NULL").groupBy(*by).agg(F.array_sort(F.collect_list("__x")).alias("xs"))
    mid = xs.filter(F.size("xs") >= 2).withColumn("median_x", upper_median(F.col("xs")))
    away = mid.withColumn("mad_x", upper_median(F.array_sort(F.transform("xs", lambda x: F.abs(x - F.col("median_x"))))))
    return away.filter(F.col("mad_x") <= S.f32(most_mad)).select(*by, "median_x", "mad_x")


def separated_regions(regions: DataFrame, scope: list[str], who: str, least_dx: float = LEAST_DX) -> DataFrame:
    """scope, a, b (a < b) of steady ones that stand apart."""
    a = regions.select(*scope, F.col(who).alias("a"), F.col("median_x").alias("ax"))
    b = regions.select(*scope, F.col(who).alias("b"), F.col("median_x").alias("bx"))
    return a.join(b, scope).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ax") - F.col("bx")) >= S.f32(least_dx))).select(*scope, "a", "b")


def same_frame_geometry(candidates: DataFrame, others: DataFrame, scope: list[str], who: str) -> DataFrame:
    """scope, who, paired, separated: candidates' samples with a comparable one at the same time, and those apart from all."""
    box = ["left", "top", "right", "bottom", "frame_w", "frame_h"]
    a = candidates.select(*scope, "ts_ms", F.col(who), F.col("seq"), *[F.col(x).alias("a_" + x) for x in box])
    b = others.select(*scope, "ts_ms", F.col(who).alias("__other"), *[F.col(x).alias("b_" + x) for x in box])
    pairs = a.join(b, [*scope, "ts_ms"]).filter(F.col(who) != F.col("__other"))
    dx, overlap = F.abs(S.center_x("a_") - S.center_x("b_")), S.iou("a_", "b_")
    pairs = pairs.filter(dx.isNotNull() & overlap.isNotNull()).withColumn("__apart", (dx >= S.f32(LEAST_DX)) & (overlap <= S.f32(MOST_IOU)))
    each = pairs.groupBy(*scope, who, "seq").agg(F.every("__apart").alias("apart"))
    return each.groupBy(*scope, who).agg(F.count("*").alias("paired"), F.count_if("apart").alias("separated"))
