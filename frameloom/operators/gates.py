"""From detections to face samples: clamp, cap per frame, gates, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import scalar as S

FRAME_BLUR, FACE_BLUR, PER_FRAME = 40.0, 60.0, 6


def top_per_group(df: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """The first max(1, limit) rows of each group; the filter on the rank is pushed into the window."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= max(1, limit)).drop("__rank")


def boxes(detections: DataFrame) -> DataFrame:
    """Flags from the boxes as detected; then empty boxes go and the rest are clamped to the frame."""
    flagged = detections.withColumns({"edge_clipped": S.edge_clipped(), "full_face": S.full_face()})
    flagged = flagged.filter((F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")))
    boxed = flagged.select(*[x for x in flagged.columns if x not in ("left", "top", "right", "bottom")], *S.clamped_box())
    return boxed.withColumn("area", S.area())


def capped(detections: DataFrame, per_frame: int = PER_FRAME) -> DataFrame:
    """The largest faces of each frame, and whether a face is alone among them (before any gate on faces)."""
    frame = ["video_id", "frame_idx"]
    top = top_per_group(boxes(detections), frame, [F.desc("area"), "det_idx"], per_frame)
    return top.withColumn("solo_frame", F.count("*").over(Window.partitionBy(*frame)) == 1)


def face_samples(detections: DataFrame, frame_blur: float = FRAME_BLUR, face_blur: float = FACE_BLUR, per_frame: int = PER_FRAME) -> DataFrame:
    """Faces that pass all gates, numbered per video in arrival order (seq); other columns stay."""
    kept = capped(detections.filter(F.col("frame_sharp") >= frame_blur), per_frame).filter(F.col("full_face") & (F.col("face_sharp") >= face_blur))
    kept = kept.withColumns({"eye_open": S.eye_open(), "smiling": F.coalesce(F.col("smiling"), S.f32(0.5)), "sharpness": F.col("face_sharp")})
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx", F.desc("area"), "det_idx")) - 1)


def detect_stats(detections: DataFrame, frame_blur: float = FRAME_BLUR, face_blur: float = FACE_BLUR, per_frame: int = PER_FRAME) -> DataFrame:
    """Per video: frames, frames with kept faces, kept faces, blurred frames, blurred and partial faces."""
    frames = detections.groupBy("video_id", "frame_idx").agg(F.min("frame_sharp").alias("s"))
    frames = frames.groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if(F.col("s") < frame_blur).alias("whip_pan_drops"))
    faces = capped(detections.filter(F.col("frame_sharp") >= frame_blur), per_frame)
    kept = F.col("full_face") & (F.col("face_sharp") >= face_blur)
    counts = faces.groupBy("video_id").agg(
        F.count_distinct(F.when(kept, F.col("frame_idx"))).alias("frames_with_faces"),
        F.count_if(kept).alias("faces_total"),
        F.count_if(F.col("full_face") & ~kept).alias("blurred_face_drops"),
        F.count_if(~F.col("full_face")).alias("partial_faces"),
    )
    zero = {x: F.coalesce(x, F.lit(0)) for x in ("frames_with_faces", "faces_total", "blurred_face_drops", "partial_faces")}
    return frames.join(counts, "video_id", "left").withColumns(zero)
