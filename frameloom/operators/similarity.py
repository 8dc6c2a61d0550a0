"""Similarities of embeddings inside one video; nothing is compared across videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.vectors import dot

FLOOR, MARGIN, BUCKETS = 0.50, 0.05, 10


def pairs(samples: DataFrame, scope: list[str], kind: str = "float") -> DataFrame:
    """scope, a, b (seq a < b), sim: an equality join on scope with the order as residual."""
    a = samples.select(*scope, F.col("seq").alias("a"), F.col("embedding").alias("va"))
    b = samples.select(*scope, F.col("seq").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, scope).filter("a < b").select(*scope, "a", "b", dot(F.col("va"), F.col("vb"), kind).alias("sim"))


def bucket(sim: Column) -> Column:
    return F.least(F.greatest(((sim * 0.5 + 0.5) * BUCKETS).cast("int"), F.lit(0)), F.lit(BUCKETS - 1))


def histogram(found: DataFrame, scope: list[str]) -> DataFrame:
    """scope, bucket (all of 0..9), pairs, and the scope's mean and max similarity."""
    counts = found.groupBy(*scope, bucket(F.col("sim")).alias("bucket")).agg(F.count("*").alias("pairs"))
    totals = found.groupBy(*scope).agg(F.avg(F.col("sim").cast("double")).alias("mean_sim"), F.max("sim").alias("max_sim"))
    dense = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
    return dense.join(counts, [*scope, "bucket"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def nearest(samples: DataFrame, centroids: DataFrame, scope: list[str], who: str, floor: float = FLOOR, margin: float = MARGIN, kind: str = "double") -> DataFrame:
    """scope, seq, best (null if contested or below the floor), sim and runner_up: the static form of assignment.

    The runner-up is no lower than the floor. Centroids are few for each scope and meet its samples by an equality join."""
    found = samples.join(centroids, scope).withColumn("__sim", dot(F.col("embedding"), F.col("centroid"), kind))
    order = Window.partitionBy(*scope, "seq").orderBy(F.desc("__sim"), F.desc(who))
    top = found.withColumn("__rank", F.row_number().over(order)).filter("__rank <= 2")
    first, second = F.max(F.when(F.col("__rank") == 1, F.col("__sim"))), F.max(F.when(F.col("__rank") == 2, F.col("__sim")))
    own = top.groupBy(*scope, "seq").agg(F.max(F.when(F.col("__rank") == 1, F.col(who))).alias("__best"), first.alias("sim"), second.alias("__second"))
    runner = F.greatest(F.coalesce("__second", F.lit(-1.0)), F.lit(floor).cast(kind))
    wins = (F.col("sim") >= floor) & (F.col("__second").isNull() | (F.col("sim") - runner >= margin))
    return own.select(*scope, "seq", F.when(wins, F.col("__best")).alias("best"), "sim", runner.alias("runner_up"))
