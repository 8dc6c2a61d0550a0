"""Sources: video files, their metadata, sampled frames, point lookups. Decoding is a pluggable function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom import schemas
from frameloom.functions import pixels
from frameloom.functions import scalar as S

FPS, MOST_FRAMES = 5, 200


def video_files(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """Files of a folder tree: path, modificationTime, length. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length")


def number(text: Column) -> Column:
    """A numeric metadata value; 0 where it is missing or no number."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def videos(files: DataFrame, probe: Callable[[str], dict[str, str]]) -> DataFrame:
    """The videos table of files. probe: metadata texts (duration_ms, width, height, rotation, name) of the file at a path."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [probe(x) for x in batch["path"]]
            yield pd.DataFrame({"uri": batch["path"], **{k: [m.get(k) for m in found] for k in ("name", "duration_ms", "width", "height", "rotation")}})

    raw = files.select("path").mapInPandas(rows, "uri string, name string, duration_ms string, width string, height string, rotation string")
    return named(raw)


def named(raw: DataFrame) -> DataFrame:
    """The videos table from text metadata (uri, name, duration_ms, width, height, rotation)."""
    duration = number(F.col("duration_ms"))
    numbers = [number(F.col(x)).cast("int").alias(x) for x in ("width", "height", "rotation")]
    return raw.select(F.col("uri").alias("video_id"), "uri", S.display_name(F.col("name"), F.col("uri")).alias("display_name"), duration.alias("duration_ms"), *numbers, S.frame_plan(duration).alias("frame_count"))


def checked(videos_: DataFrame, fps: int = FPS, most: int = MOST_FRAMES) -> DataFrame:
    """videos; one without duration or frames to sample is an error when it is read."""
    bad = (F.col("duration_ms") <= 0) | (S.frame_plan(F.col("duration_ms"), fps, most) == 0)
    problem = F.raise_error(F.concat(F.lit("nothing to sample in "), F.col("uri"))).cast("string")
    return videos_.withColumn("uri", F.when(bad, problem).otherwise(F.col("uri")))


def frame_grid(videos_: DataFrame, fps: int = FPS, most: int = MOST_FRAMES) -> DataFrame:
    """videos' columns with frame_idx and ts_ms of each frame to sample; a clip longer than the grid is cut at its end."""
    n = S.frame_plan(F.col("duration_ms"), fps, most)
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    grid = videos_.select("*", F.explode(index).alias("frame_idx"))
    return grid.withColumn("ts_ms", F.floor(F.col("frame_idx").cast("long") * (1_000_000 // max(1, fps)) / 1000))


def sampled_frames(videos_: DataFrame, decode: Callable[[str, int], tuple[int, int, list[int]] | None], fps: int = FPS, most: int = MOST_FRAMES) -> DataFrame:
    """The frames table. decode(uri, ts_ms): width, height and gray values of the nearest frame, or None to skip it.
    Frames are turned upright by the video's rotation (none without that column) and made no larger than detection needs."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.video_id, r.frame_idx, r.ts_ms, *pixels.small_upright(*image, r.rotation)) for r in batch.itertuples() if (image := decode(r.uri, r.ts_ms)) is not None]
            yield pd.DataFrame(out, columns=["video_id", "frame_idx", "ts_ms", "w", "h", "gray"])

    rotation = F.col("rotation") if "rotation" in videos_.columns else F.lit(0)
    return frame_grid(videos_, fps, most).select("video_id", "uri", "frame_idx", "ts_ms", rotation.alias("rotation")).mapInPandas(rows, schemas.FRAMES)


def detections(frames: DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The detections table. detect: rows of frames to rows of detections, one loaded model for each worker."""
    return frames.mapInPandas(lambda batches: map(detect, batches), schemas.DETECTIONS)


def embedded(faces: DataFrame, embed: Callable[[pd.DataFrame], list]) -> DataFrame:
    """faces with embedding, given by embed for a batch of rows."""
    columns = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in faces.schema.fields)
    return faces.mapInPandas(lambda batches: (b.assign(embedding=embed(b)) for b in batches), f"{columns}, embedding array<float>")


def frame_at(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """rows with the frame at their video_id and ts_ms; null where there is none."""
    return rows.join(frames.select("video_id", "ts_ms", "w", "h", "gray"), ["video_id", "ts_ms"], "left")
