"""From videos to people with stub models, on a table and on a stream of frames."""

import random

import numpy as np
import pytest

from frameloom.functions import pixels
from frameloom.functions import scalar as S
from frameloom.plans import video_pipeline
from frameloom.sources import media
from frameloom.streaming import timeline

LEFT, RIGHT = (30, 60, 90, 120), (150, 60, 210, 120)


def stubs():
    """decode, make_detector and an embedder, which reach the workers by value."""

    def decode(uri, ts):
        """A noisy frame with two faces: gray 60 on the left in the first two seconds, 200 on the right after the first."""
        rng = np.random.default_rng(ts)
        image = rng.integers(0, 255, (180, 240))
        for box, value, shown in ((LEFT, 60, ts < 2000), (RIGHT, 200, ts >= 1000)):
            if shown:
                image[box[1] : box[3], box[0] : box[2]] = value + rng.integers(-40, 40, (60, 60))
        if uri == "blurred":
            image[:] = 128
        return 240, 180, image.reshape(-1).tolist()

    def make_detector():
        def detect(image):
            out = []
            for box, value in ((LEFT, 60), (RIGHT, 200)):
                if abs(image[box[1] : box[3], box[0] : box[2]].mean() - value) < 10:
                    x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
                    points = {p + a: v for p in S.LANDMARKS for a, v in (("x", x), ("y", y))}
                    out.append(dict(zip(("left", "top", "right", "bottom"), box, strict=True)) | points | {"euler_y": 0.0, "euler_z": 3.0, "left_eye": 0.9, "right_eye": 0.9, "smiling": 0.2})
            return out

        return detect

    class Bright:
        """Tells faces apart by their brightness."""

        shape, dim = (1, 112, 112, 3), 2

        def embed(self, values):
            assert values.shape == (112 * 112 * 3,) and -1 <= values.min() <= values.max() <= 1
            return np.array([1.0, 0.0]) if np.median(values) < 0 else np.array([0.0, 1.0])

    return decode, make_detector, Bright


def videos(spark, *names):
    return spark.createDataFrame([(n, n, 3000, 0) for n in names], "video_id string, uri string, duration_ms long, rotation int")


def test_videos_to_people(spark):
    found = video_pipeline.run(videos(spark, "a", "blurred"), *stubs())
    people = sorted((r.video_id, r.label, r.n_samples, [(a.start_ms, a.end_ms) for a in r.appearances]) for r in found["people"].collect())
    assert people == [("a", "Person A", 10, [(0, 1800)]), ("a", "Person B", 10, [(1000, 2800)])]
    assert [(r.video_id, r.people, r.strays) for r in found["summary"].collect()] == [("a", 2, 0)]


def test_a_stream_of_frames_gives_the_same(spark, tmp_path):
    decode, *models = stubs()
    frames = media.sampled_frames(videos(spark, "a"), decode)
    for k in range(3):
        frames.filter(f"frame_idx % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "video_id string, frame_idx int, ts_ms long, w int, h int, gray array<int>"
    stream = video_pipeline.observed(timeline.read(spark, str(tmp_path / "in"), schema), *models)
    out = timeline.collected(stream, str(tmp_path / "c"), str(tmp_path / "out"))
    want = video_pipeline.observed(frames, *models)
    key = lambda df: sorted((r.frame_idx, r.det_idx, r.left, r.frame_sharp, tuple(r.embedding)) for r in df.collect())
    assert key(out) == key(want) and len(key(out)) == 20


def test_models_are_checked():
    for shape, dim in (((1, 112, 96, 3), 2), ((112, 112, 3), 2), ((1, 112, 112, 1), 2), ((1, 112, 112, 3), 0)):
        with pytest.raises(ValueError):
            video_pipeline.checked(type("Model", (), {"shape": shape, "dim": dim})())


def test_squares_equal_the_expression(spark):
    rng = random.Random(4)
    boxes = [(l := rng.randrange(-20, 620), t := rng.randrange(-20, 1100), l + rng.randrange(1, 300), t + rng.randrange(1, 300)) for _ in range(300)]
    rows = spark.createDataFrame([(i, *b, 640, 1136) for i, b in enumerate(boxes)], "i int, left int, top int, right int, bottom int, frame_w int, frame_h int")
    got = {r.i: tuple(r.r) for r in rows.select("i", S.embed_rect().alias("r")).collect()}
    assert [got[i] for i in range(300)] == [pixels.embed_square(b, 640, 1136) for b in boxes]
