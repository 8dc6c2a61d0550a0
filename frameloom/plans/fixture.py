"""Detections derived from the embeddings table by integer rules, with planted persons; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.vectors import normalized


#: Four videos share so many rows: their number grows with the table, their length does not.
VIDEO_ROWS = 2400


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections table with vec_id, person (planted) and embedding."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("own"))
    div = lambda a, b: F.floor(F.expr(a) / b).cast("int")
    own = own.withColumn("video_id", F.concat(F.lit("v"), (F.col("vec_id") % 4 + 4 * F.floor(F.col("vec_id") / VIDEO_ROWS)).cast("string"))).withColumn("k", div(f"vec_id % {VIDEO_ROWS}", 4))
    own = own.withColumns({"scene": div("k", 20), "pos": (F.col("k") % 20).cast("int")}).withColumn("fpf", 1 + F.col("scene") % 2)
    own = own.withColumns({"det_idx": F.col("pos") % F.col("fpf"), "frame_idx": F.col("scene") * 35 + F.floor(F.col("pos") / F.col("fpf")).cast("int")})
    own = own.withColumns({"person": (F.col("scene") + 2 * F.col("det_idx")) % 5, "ts_ms": F.col("frame_idx").cast("long") * 200})
    base = own.filter("vec_id < 5").select(F.col("vec_id").cast("int").alias("person"), F.col("own").alias("base"))  # five rows
    own = own.join(F.broadcast(base), "person")
    mixed = F.zip_with("base", "own", lambda x, y: x.cast("double") + 0.35 * y.cast("double"))
    v = lambda sql, kind="int": F.expr(sql).cast(kind)
    own = own.withColumns({"embedding": normalized(mixed, "double").cast("array<float>"), "left": v("30 + person * 120"), "top": v("200 + (vec_id * 11) % 300")})
    own = own.withColumns({"right": v("left + 90 + vec_id % 40"), "bottom": v("top + 100 + vec_id % 30"), "frame_w": F.lit(640), "frame_h": F.lit(1136)})
    part = lambda factor, null: F.when(F.col("vec_id") % null != 0, ((F.col("vec_id") * factor) % 101 / 100).cast("float"))
    return own.select(
        "video_id", "frame_idx", "ts_ms", v("30 + (frame_idx * 53) % 300", "double").alias("frame_sharp"), "det_idx", "left", "top", "right", "bottom",
        v("(vec_id * 13) % 91 - 45", "float").alias("euler_y"), v("(vec_id * 7) % 61 - 30", "float").alias("euler_z"),
        part(29, 17).alias("left_eye"), part(31, 23).alias("right_eye"), part(53, 19).alias("smiling"), F.lit(None).cast("int").alias("tracking_id"),
        F.when(F.col("vec_id") % 29 != 0, v("left + 25", "float")).alias("eye_lx"), v("top + 35", "float").alias("eye_ly"), v("right - 25", "float").alias("eye_rx"), v("top + 35", "float").alias("eye_ry"),
        v("(left + right) / 2", "float").alias("nose_x"), v("(top + bottom) / 2", "float").alias("nose_y"), v("(left + right) / 2", "float").alias("mouth_x"), v("bottom - 20", "float").alias("mouth_y"),
        v("30 + (vec_id * 37) % 541", "double").alias("face_sharp"), "frame_w", "frame_h", "vec_id", "person", "embedding")


#: Tables det and smp (face samples; cluster is the planted person) for DuckDB.
SQL = """
WITH e0 AS (SELECT vec_id, embedding AS own, 'v' || (vec_id % 4 + 4 * (vec_id // {rows})) AS video_id, vec_id % {rows} // 4 AS k FROM embeddings),
e1 AS (SELECT *, k // 20 AS scene, k % 20 AS pos, 1 + (k // 20) % 2 AS fpf FROM e0),
e2 AS (SELECT *, pos % fpf AS det_idx, scene * 35 + pos // fpf AS frame_idx, (scene + 2 * (pos % fpf)) % 5 AS person FROM e1),
e3 AS (SELECT e2.*, list_transform(list_zip(b.own, e2.own), lambda p: p[1]::DOUBLE + 0.35 * p[2]::DOUBLE) AS mixed FROM e2 JOIN (SELECT vec_id AS person, own FROM e0 WHERE vec_id < 5) b USING (person)),
e4 AS (SELECT *, 30 + person * 120 AS "left", 200 + (vec_id * 11) % 300 AS "top", sqrt(list_sum(list_transform(mixed, lambda x: x * x))) AS norm FROM e3),
det AS (SELECT video_id, frame_idx::INT AS frame_idx, frame_idx * 200 AS ts_ms, (30 + (frame_idx * 53) % 300)::DOUBLE AS frame_sharp, det_idx::INT AS det_idx,
  "left"::INT AS "left", "top"::INT AS "top", ("left" + 90 + vec_id % 40)::INT AS "right", ("top" + 100 + vec_id % 30)::INT AS bottom,
  ((vec_id * 13) % 91 - 45)::FLOAT AS euler_y, ((vec_id * 7) % 61 - 30)::FLOAT AS euler_z,
  CASE WHEN vec_id % 17 <> 0 THEN (((vec_id * 29) % 101) / 100)::FLOAT END AS left_eye, CASE WHEN vec_id % 23 <> 0 THEN (((vec_id * 31) % 101) / 100)::FLOAT END AS right_eye,
  CASE WHEN vec_id % 19 <> 0 THEN (((vec_id * 53) % 101) / 100)::FLOAT END AS smiling, vec_id % 29 = 0 AS partial,
  (30 + (vec_id * 37) % 541)::DOUBLE AS face_sharp, 640 AS frame_w, 1136 AS frame_h, vec_id, person::INT AS person, list_transform(mixed, lambda x: (x / norm)::FLOAT) AS embedding FROM e4),
cap AS (SELECT *, ("right" - "left") * (bottom - "top") AS area, count(*) OVER (PARTITION BY video_id, frame_idx) = 1 AS solo_frame,
  "left" < 51.2::FLOAT OR "top" < 51.2::FLOAT OR "right" > 588.8::FLOAT OR bottom > 1084.8::FLOAT AS edge_clipped FROM det WHERE frame_sharp >= 40),
smp AS (SELECT *, face_sharp AS sharpness, least(coalesce(left_eye, 0.5::FLOAT), coalesce(right_eye, 0.5::FLOAT)) AS eye_open, coalesce(smiling, 0.5::FLOAT) AS smile,
  (row_number() OVER (PARTITION BY video_id ORDER BY frame_idx, area DESC, det_idx) - 1)::INT AS seq FROM cap WHERE NOT partial AND "left" + 25 > 12.8 AND "right" - 25 < 627.2 AND face_sharp >= 60)
""".replace("{rows}", str(VIDEO_ROWS))
