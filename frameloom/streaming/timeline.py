"""Timelines over streams: appearances by session windows, and first-stage assignment with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.operators.identity import Rules, contest, fitted, similarity, unit
from frameloom.operators.segments import GAP_MS, LEAST_FRAMES


def read(spark: SparkSession, path: str, schema: str, files_each: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def appearances(samples: DataFrame, by: list[str], gap_ms: int = GAP_MS, least: int = LEAST_FRAMES, delay: str = "0 seconds") -> DataFrame:
    """by, start_ms, end_ms, frames of (by, ts_ms); on a stream a run is given out once the watermark has passed it."""
    timed = samples.withColumn("__ts", F.timestamp_millis(F.col("ts_ms")))
    timed = timed.withWatermark("__ts", delay) if samples.isStreaming else timed
    runs = timed.groupBy(F.session_window("__ts", f"{gap_ms} milliseconds"), *by).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").cast("int").alias("frames"))
    return runs.filter(F.col("frames") >= least).drop("session_window")


def assigned(samples: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """video_id, seq, cluster_id of (video_id, seq, ts_ms, embedding): each face in time order joins the cluster
    that wins it, or starts one. A video's state is its clusters' sums; a row older than a settled one is given out with -1."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums, centroids, last = ([], [], -1)
        if state.exists:
            raw, raw_centroids, last = state.get
            sums, centroids = ([np.asarray(v, np.float32) for v in x] for x in (raw, raw_centroids))
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "seq"], kind="stable")
        out = []
        for r in rows.itertuples():
            if r.ts_ms < last:
                out.append((key[0], r.seq, -1))
                continue
            last, v = r.ts_ms, np.asarray(r.embedding, np.float32)
            at = contest([similarity(v, c) for c in centroids], rules.join, rules.margin)
            if at is None:
                at = len(sums)
                sums.append(v)
                centroids.append(v)
            else:
                sums[at] = (sums[at] + fitted(v, len(sums[at]))).astype(np.float32)
                centroids[at] = unit(sums[at])
            out.append((key[0], r.seq, at))
        state.update(([v.tolist() for v in sums], [v.tolist() for v in centroids], int(last)))
        yield pd.DataFrame(out, columns=["video_id", "seq", "cluster_id"])

    own = samples.select("video_id", "seq", "ts_ms", "embedding")
    return own.groupBy("video_id").applyInPandasWithState(
        step, "video_id string, seq int, cluster_id int", "sums array<array<float>>, centroids array<array<float>>, last long", "append", GroupStateTimeout.NoTimeout
    )


def collected(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there now, into a Parquet folder, and reads that."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
