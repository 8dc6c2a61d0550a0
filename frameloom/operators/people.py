"""People of a video: numbering, appearances, best shots, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import scalar as S
from frameloom.operators.segments import segments

SEGMENTS_SHOWN = 6


def numbered(members: DataFrame, who: str = "cluster_id") -> DataFrame:
    """members with person_id: ones with an appearance, 0-based by first time (then by ``who``), per video."""
    firsts = members.groupBy("video_id", who).agg(F.min("ts_ms").alias("__first"))
    countable = segments(members, ["video_id", who]).select("video_id", who).distinct()
    order = Window.partitionBy("video_id").orderBy("__first", who)
    ids = firsts.join(countable, ["video_id", who], "left_semi").withColumn("person_id", F.row_number().over(order) - 1).drop("__first")
    return members.join(ids, ["video_id", who])


def best_shots(members: DataFrame, by: list[str]) -> DataFrame:
    """The best row of each: alone in its frame if any is, then by total, sharpness, and place among the members."""
    order = Window.partitionBy(*by).orderBy(F.desc("solo_frame"), F.desc("total"), F.desc("sharpness"), "member_pos")
    scored = members.withColumn("total", S.quality()["total"])
    return scored.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def people(members: DataFrame) -> DataFrame:
    """video_id, person_id, label, n_samples, appearances (array by start) of numbered members."""
    by = ["video_id", "person_id"]
    segs = segments(members, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "frames"))).alias("appearances"))
    return members.groupBy(*by).agg(F.count("*").alias("n_samples")).join(segs, by).withColumn("label", S.label(F.col("person_id")))


def summary(found: DataFrame, samples: DataFrame) -> DataFrame:
    """video_id, people, appearances, strays (samples of nobody) and the summary line, of every video with samples."""
    per = found.groupBy("video_id").agg(F.count("*").alias("people"), F.sum(F.size("appearances")).alias("appearances"), F.sum("n_samples").alias("n"))
    all_ = samples.groupBy("video_id").agg(F.count("*").alias("total"))
    own = all_.join(per, "video_id", "left").withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("people", "appearances", "n")})
    return own.select("video_id", "people", "appearances", (F.col("total") - F.col("n")).alias("strays"), S.summary(F.col("people"), F.col("appearances")).alias("line"))


def appearance_lines(found: DataFrame) -> DataFrame:
    """video_id, person_id, i (from 1), line of each appearance."""
    each = found.select("video_id", "person_id", F.posexplode("appearances").alias("pos", "a"))
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), S.clock(F.col("a.start_ms")), F.lit("–"), S.clock(F.col("a.end_ms")), F.lit(" · "), F.col("a.frames").cast("string"), F.lit(" frames"))
    return each.select("video_id", "person_id", (F.col("pos") + 1).alias("i"), line.alias("line"))


def trace_lines(found: DataFrame, most: int = SEGMENTS_SHOWN) -> DataFrame:
    shown = F.transform(F.slice("appearances", 1, most), lambda a: F.concat(F.lit("["), a["start_ms"].cast("string"), F.lit("-"), a["end_ms"].cast("string"), F.lit("]")))
    line = F.concat(F.lit("person "), F.col("label"), F.lit(" n="), F.col("n_samples").cast("string"), F.lit(" x"), F.size("appearances").cast("string"), F.lit(" "), F.array_join(shown, ","))
    return found.select("video_id", "person_id", line.alias("line"))


def prune_singletons(members: DataFrame, who: str = "cluster_id", from_clusters: int = 3, least: int = 2) -> DataFrame:
    """members without tiny clusters, in videos of from_clusters clusters or more."""
    sizes = members.groupBy("video_id", who).agg(F.count("*").alias("__n"))
    per = sizes.groupBy("video_id").agg(F.count("*").alias("__clusters"))
    tiny = sizes.join(per, "video_id").filter((F.col("__clusters") >= from_clusters) & (F.col("__n") < least))
    return members.join(tiny, ["video_id", who], "left_anti")


def with_thumbs(found: DataFrame, thumbs: DataFrame) -> DataFrame:
    """found with each person's thumb (video_id, person_id, thumb); null where there is none."""
    return found.join(thumbs, ["video_id", "person_id"], "left")


def first_seen(members: DataFrame, who: str = "cluster_id") -> DataFrame:
    """video_id, who, first_ms, rank (from 0, by first time then who)."""
    firsts = members.groupBy("video_id", who).agg(F.min("ts_ms").alias("first_ms"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy("first_ms", who)) - 1)
