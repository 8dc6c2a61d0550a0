"""Golden cases of segments, gates, scores, layouts, crops, progress; and what else the operators promise."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameloom.functions import pixels
from frameloom.functions import scalar as S
from frameloom.functions.vectors import dot, normalized
from frameloom.operators import collage, gates, people, regions, segments, similarity
from frameloom.sources import media, sinks
from frameloom.streaming import progress, timeline


def stamps(spark, *groups):
    rows = [("v", g, i, t) for g, ts in enumerate(groups) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "video_id string, who int, seq int, ts_ms long")


RUNS = {
    "S1": ([0, 200, 400, 600], [(0, 600, 4)]),
    "S2": ([0, 200, 600, 3000, 3200, 3400], [(0, 600, 3), (3000, 3400, 3)]),
    "S3": ([0, 200, 400, 20000], [(0, 400, 3)]),
    "S4": ([10100, 10300, 10500, 11500], [(10100, 11500, 4)]),
    "unsorted": ([600, 0, 400, 200], [(0, 600, 4)]),
    "gap": ([0, 1500, 3000, 4501, 4501, 4501], [(0, 3000, 3), (4501, 4501, 3)]),
}


def test_segments(spark):
    df = stamps(spark, *[ts for ts, _ in RUNS.values()])
    got = {}
    for r in segments.segments(df, ["who"]).collect():
        got.setdefault(r.who, []).append((r.start_ms, r.end_ms, r.frames))
    assert [sorted(got[i]) for i in range(len(RUNS))] == [want for _, want in RUNS.values()]
    assert segments.segments(df.limit(0), ["who"]).count() == 0  # S5
    batch = sorted(map(tuple, segments.segments(df, ["who"]).collect()))
    assert sorted((r.who, r.start_ms, r.end_ms, r.frames) for r in timeline.appearances(df, ["who"]).collect()) == batch


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 20000), max_size=40))
def test_segments_are_disjoint(spark, ts):
    got = sorted((r.start_ms, r.end_ms) for r in segments.segments(stamps(spark, ts), ["who"]).collect())
    assert all(b[0] - a[1] > segments.GAP_MS for a, b in zip(got, got[1:]))


def test_overlaps(spark):  # S6
    df = segments.segments(stamps(spark, [0, 200, 400], [200, 400, 600], [5000, 5200, 5400]), ["video_id", "who"])
    assert [(r.a, r.b) for r in segments.overlaps(df, ["video_id"], "who").collect()] == [(0, 1)]
    assert sorted(r.who for r in segments.sharing(df, ["video_id"], "who").collect()) == [0, 1]
    plan = segments.overlaps(df, ["video_id"], "who")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blur(spark):  # B1 to B5
    flat, check = np.full((16, 16), 128), np.indices((16, 16)).sum(0) % 2 * 255
    assert pixels.blur_score(flat) == 0 and pixels.blur_score(np.zeros((2, 2))) == 0
    assert pixels.blur_score(check) > 1000 * (pixels.blur_score(flat) + 1)
    edge = np.where(np.arange(24) < 12, 0, 255) * np.ones((24, 1), int)
    soft = np.array([[int(edge[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].mean()) for x in range(24)] for y in range(24)])
    assert pixels.blur_score(edge) > 2 * pixels.blur_score(soft)
    assert pixels.sharpness_of(check) >= gates.FRAME_BLUR > pixels.sharpness_of(flat)
    images = [(n, x, y, int(g)) for n, image in enumerate((flat, check, edge, np.zeros((2, 2)))) for y, line in enumerate(image) for x, g in enumerate(line)]
    got = {r.image_id: r.sharpness for r in pixels.laplacian_variance(spark.createDataFrame(images, "image_id int, x int, y int, g int")).collect()}
    assert all(got[n] == pytest.approx(pixels.blur_score(i)) for n, i in enumerate((flat, check, edge, np.zeros((2, 2)))))
    assert pixels.resized(np.zeros((100, 1000)), 160).shape == (16, 160) and pixels.model_input(np.array([[[0, 255, 127.5]]])).tolist() == [-1, 1, 0]


def faces(spark, *rows):
    base = dict(left=200, top=300, right=400, bottom=600, frame_w=640, frame_h=1136)
    points = dict(zip(("eye_lx", "eye_ly", "eye_rx", "eye_ry", "nose_x", "nose_y", "mouth_x", "mouth_y"), (100, 100, 200, 100, 150, 200, 150, 300), strict=True))
    own = [{**base, **points, **r} for r in rows]
    kinds = ", ".join(f"{k} {'float' if k in points else 'int'}" for k in own[0])
    return spark.createDataFrame([tuple(x if x is None or k not in points else float(x) for k, x in r.items()) for r in own], kinds)


def test_gates(spark):  # D1 to D8
    areas = spark.createDataFrame([("v", 0, i, a) for i, a in enumerate((100, 2500, 400, *[1] * 10))], "video_id string, frame_idx int, det_idx int, area int")
    top = lambda k: sorted(r.area for r in gates.top_per_group(areas, ["video_id"], [F.desc("area"), "det_idx"], k).collect())
    assert top(2) == [400, 2500] and len(top(6)) == 6 and top(0) == [2500]
    clip = [r[0] for r in faces(spark, {}, {"left": 0}, {"right": 640}, {"top": 0}, {"frame_w": 0, "frame_h": 0}).select(S.edge_clipped()).collect()]
    assert clip == [False, True, True, True, True]
    full = [r[0] for r in faces(spark, {}, {"eye_lx": None}, {"mouth_x": None}, {"eye_lx": 2}, {"eye_lx": 30}, {"frame_w": 0}).select(S.full_face()).collect()]
    assert full == [True, False, False, False, True, False]


SHOT = dict(euler_y=0.0, euler_z=0.0, sharpness=500.0, eye_open=0.9, smiling=0.8, area=40_000, edge_clipped=False, frame_w=640, frame_h=1136, solo_frame=True)
KINDS = "euler_y float, euler_z float, sharpness double, eye_open float, smiling float, area int, edge_clipped boolean, frame_w int, frame_h int, solo_frame boolean, who int, member_pos int"


def shots(spark, *rows):
    return spark.createDataFrame([(*{**SHOT, **r}.values(), 0, i) for i, r in enumerate(rows)], KINDS)


def test_scores(spark):  # Q1 to Q7
    bad = dict(euler_y=30.0, sharpness=70.0, eye_open=0.3, smiling=0.2, edge_clipped=True, area=5000)
    t = [r[0] for r in shots(spark, {}, bad, {"eye_open": 0.1}, {"edge_clipped": True}, {"euler_y": 5.0}, {"euler_y": 40.0}, {"area": 10_000}).select(S.quality()["total"]).collect()]
    assert t[0] > 2 * t[1] and t[2] < 0.4 * t[0] and t[3] == pytest.approx(0.3 * t[0], abs=1e-4) and t[5] < 0.6 * t[4] and 0.40 <= t[6] / t[0] <= 0.55
    best = people.best_shots(shots(spark, {"sharpness": 100.0}, {"sharpness": 500.0}, {"sharpness": 300.0}), ["who"]).first()
    assert best.sharpness == 500
    crowd = people.best_shots(shots(spark, {"sharpness": 400.0}, dict(sharpness=550.0, eye_open=1.0, smiling=1.0, solo_frame=False)), ["who"]).first()
    assert crowd.sharpness == 400
    assert people.best_shots(shots(spark, {}, {}), ["who"]).first().member_pos == 0
    assert shots(spark, {"euler_y": 20.0}).select(S.badges()).first()[0] == ["Eyes open", "Smiling", "Full face"]


def test_layouts(spark):  # L1, L2
    pages = {}
    for r in collage.layout(spark, 15).collect():
        pages.setdefault(r.n, []).append((r.x, r.y, r.w, r.h))
    for n in range(1, 9):
        own = pages[n]
        assert len(own) == n and all(x >= 0 and x + w <= 1080 and y >= 260 and y + h <= 1700 and w > 54 and h > 96 for x, y, w, h in own)
        assert not any(a != b and a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] for a in own for b in own)
    assert max(y + h for _, y, _, h in pages[13]) == 1844 and max(y + h for _, y, _, h in pages[15]) > 1920
    with pytest.raises(ValueError):
        collage.layout(spark, 0)


def test_crops(spark):  # X1 to X5
    def crop(l, t, r, b, fw, fh, w, h, shared=False):
        row = spark.createDataFrame([(l, t, r, b, fw, fh, w, h, shared)], "left int, top int, right int, bottom int, frame_w int, frame_h int, full_w int, full_h int, shared boolean")
        return tuple(row.select(S.generous_crop().alias("c")).select("c.*").first())

    l, t, w, h = crop(270, 400, 370, 500, 640, 1136, 1280, 2272)
    assert w == h >= 570 and l >= 0 and t >= 0 and l + w <= 1280 and l <= 640 <= l + w
    assert crop(270, 400, 370, 500, 0, 1136, 1080, 1920) == (0, 0, 1080, 1920)
    l, t, w, h = crop(0, 0, 60, 60, 640, 1136, 640, 1136)
    assert l >= 0 and t >= 0 and w >= 200 and l + w <= 640
    l, t, w, h = crop(60, 400, 260, 600, 640, 1136, 1280, 2272, True)
    assert l + w <= 641 and w == h >= 400
    l, t, w, h = crop(270, 400, 370, 500, 640, 1136, 1280, 2272, True)
    assert w == h >= 440


def test_progress_and_plan(spark):  # G1 to G6
    cases = {("EXTRACT", 0.0): 0, ("EXTRACT", 0.5): 0.1, ("EXTRACT", 1.0): 0.2, ("DETECT", 0.0): 0.2, ("DETECT", 1.0): 0.55, ("COLLAGE", 1.0): 1, ("EXTRACT", -2.0): 0, ("EXTRACT", 5.0): 0.2}
    rows = spark.createDataFrame(list(cases), "stage string, part double").select(S.overall(F.col("stage"), F.col("part"))).collect()
    assert [r[0] for r in rows] == pytest.approx(list(cases.values()))
    plan = {30_000: 150, 120_000: 200, 100: 1, 0: 0, -5: 0, 41_000: 200}
    clips = spark.createDataFrame([(d,) for d in plan], "duration_ms long")
    assert {r.duration_ms: r.n for r in clips.withColumn("n", S.frame_plan(F.col("duration_ms"))).collect()} == plan
    assert media.frame_grid(clips.filter("duration_ms = 41000")).agg(F.max("ts_ms")).first()[0] == 39_800
    assert clips.select(S.frame_plan(F.col("duration_ms"), fps=0)).distinct().first()[0] == 0


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0], [float("nan")], [0.0, 0.0])], "a array<float>, b array<float>, n array<float>, z array<float>")
    got = row.select(dot(row.a, row.b), dot(row.n, row.a), normalized(row.b), normalized(row.z)).first()
    assert got[0] == 11 and got[1] == -1 and sum(x * x for x in got[2]) == pytest.approx(1, abs=1e-6) and got[3] == [0, 0]
    assert spark.range(1).select(*[similarity.bucket(F.lit(x)) for x in (-1.0, 0.0, 1.0, -2.0)]).first()[:] == (0, 5, 9, 0)


def test_nearest_follows_the_floor(spark):
    own = spark.createDataFrame([("v", 0, [1.0, 0.0]), ("v", 1, [0.52, 0.8541662])], "video_id string, seq int, embedding array<float>")
    cen = lambda *rows: spark.createDataFrame([("v", i, list(c)) for i, c in enumerate(rows)], "video_id string, who int, centroid array<double>")
    best = lambda c: {r.seq: r.best for r in similarity.nearest(own, c, ["video_id"], "who").collect()}
    assert best(cen((1.0, 0.0))) == {0: 0, 1: 0} and best(cen((1.0, 0.0), (0.0, -1.0))) == {0: 0, 1: None}


def test_upper_median_and_iou(spark):
    row = spark.range(1).select(F.array(*map(F.lit, (1.0, 2.0, 3.0, 10.0))).alias("x"))
    assert row.select(regions.upper_median(F.col("x"))).first()[0] == 3
    boxes = spark.createDataFrame([(0, 0, 10, 10, 5, 0, 15, 10, 100, 100)], ", ".join(f"{p}_{x} int" for p in "ab" for x in ("left", "top", "right", "bottom")) + ", w int, h int")
    framed = boxes.withColumns({f"{p}_frame_{x}": F.col(x) for p in "ab" for x in "wh"})
    assert framed.select(S.iou("a_", "b_")).first()[0] == pytest.approx(1 / 3, abs=1e-6)


def test_texts(spark):
    one = spark.range(1)
    get = lambda x: one.select(x).first()[0]
    assert get(S.label(F.lit(26))) == "Person [" and get(S.clock(F.lit(61_999))) == "1:01"
    assert get(S.display_name(F.lit(" "), F.lit("a/b/c.mp4"))) == "c.mp4" and get(S.display_name(F.lit(None).cast("string"), F.lit("a/"))) == "video"
    assert get(S.file_name(F.lit("my clip é!.v.mp4"))) == "collage_my_clip_é__v" and get(S.file_name(F.lit(".mp4"))) == "collage_collage"
    assert get(S.clip_line(F.lit(3), F.lit(1500), F.lit(0), F.lit(0))) == "3 frames · 1.5s"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.mp4").write_bytes(bytes([i]))
    (tmp_path / "in" / "x.txt").write_bytes(b"")
    files = media.video_files(spark, str(tmp_path / "in"))
    found = media.videos(files, lambda path: {"duration_ms": "1000" if path.endswith("1.mp4") else "soon", "width": "64", "height": "48"}).orderBy("uri").collect()
    assert [(r.display_name, r.duration_ms, r.frame_count, r.rotation) for r in found] == [("0.mp4", 0, 0, 0), ("1.mp4", 1000, 5, 0)]
    clips = spark.createDataFrame([("a", "a", 1000)], "video_id string, uri string, duration_ms long")
    frames = media.sampled_frames(clips, lambda uri, ts: None if ts == 200 else (2, 1, [ts % 256, 0]))
    assert [r.ts_ms for r in frames.orderBy("ts_ms").collect()] == [0, 400, 600, 800]
    looked = media.frame_at(spark.createDataFrame([("a", 400), ("a", 401)], "video_id string, ts_ms long"), frames)
    assert {r.ts_ms: r.w for r in looked.collect()} == {400: 2, 401: None}
    with pytest.raises(Exception, match="nothing to sample"):
        media.checked(clips.withColumn("duration_ms", F.lit(0).cast("long"))).collect()
    faces_ = media.embedded(frames.select("video_id", "ts_ms"), lambda rows: [[1.0, 0.0]] * len(rows))
    assert faces_.first().embedding == [1.0, 0.0]
    sinks.publish(clips, str(tmp_path / "out"))
    sinks.publish(clips.union(clips), str(tmp_path / "out"))
    with pytest.raises(Exception):
        sinks.publish(clips.select(F.raise_error(F.lit("no")).alias("x")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and len(list(tmp_path.iterdir())) == 2
    store = sinks.ResultStore(spark)
    store.set(clips_now=clips)
    assert store.get("clips_now").count() == 1
    store.clear()
    assert store.get("clips_now") is None


def test_progress_is_reported(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    listener = progress.ProgressRows()
    spark.streams.addListener(listener)
    try:
        timeline.collected(timeline.read(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "c"), str(tmp_path / "out"))
        for _ in range(100):
            if listener.ended:
                break
            time.sleep(0.1)
        assert list(listener.ended.values()) == ["DONE"] and list(listener.last.values())[0]["batch"] >= 0
    finally:
        spark.streams.removeListener(listener)
    query = timeline.read(spark, str(tmp_path / "in"), "id long").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).start()
    progress.cancel(query)
    assert not query.isActive


def test_streamed_assignment_equals_the_fold(spark, tmp_path):
    rows = [("v", i, 200 * i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(8)]
    schema = "video_id string, seq int, ts_ms long, embedding array<float>"
    for k in (0, 4):
        spark.createDataFrame(rows[k : k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = timeline.collected(timeline.assigned(timeline.read(spark, str(tmp_path / "in"), schema)), str(tmp_path / "c"), str(tmp_path / "out"))
    assert {(r.seq % 2, r.cluster_id) for r in found.collect()} == {(0, 0), (1, 1)}


def test_embedder_squares_and_tile_parts(spark):
    """Worked by hand from the rules: a square at the edge is shifted back, and a part's edges are rounded down."""
    rect = lambda **box: faces(spark, box).select(S.embed_rect().alias("r")).select("r.*").first()
    assert tuple(rect(left=600, right=640, top=300, bottom=340)) == (592, 296, 48, 48)
    assert tuple(rect(left=100, right=141, top=300, bottom=341)) == (94, 294, 50, 50)
    assert tuple(rect(left=0, right=640, top=0, bottom=900)) == (0, 0, 640, 1080)
    fit = spark.range(1).select(S.center_fit(F.lit(301), F.lit(101), F.lit(480), F.lit(640)).alias("r")).select("r.*").first()
    assert tuple(fit) == (112, 0, 76, 101)


def test_frames_are_turned_and_faces_cropped(spark):
    image = np.arange(6).reshape(2, 3)
    assert pixels.small_upright(3, 2, image.reshape(-1).tolist(), 0) == (3, 2, [0, 1, 2, 3, 4, 5])
    assert pixels.small_upright(3, 2, image.reshape(-1).tolist(), 90) == (2, 3, [3, 0, 4, 1, 5, 2])
    assert pixels.small_upright(3, 2, image.reshape(-1).tolist(), 270) == (2, 3, [2, 5, 1, 4, 0, 3])
    assert pixels.small_upright(1280, 1, [7] * 1280, 0)[:2] == (640, 1)
    clips = spark.createDataFrame([("a", "a", 400, 90)], "video_id string, uri string, duration_ms long, rotation int")
    assert {(r.w, r.h) for r in media.sampled_frames(clips, lambda uri, ts: (3, 2, [0] * 6)).collect()} == {(2, 3)}
    big = np.zeros((200, 300), int)
    big[50:150, 100:200] = 9
    assert (pixels.face_crop(big, (100, 50, 100, 100), 5.0) == 9).all() and pixels.face_crop(big, (100, 50, 100, 100)).shape == (112, 112)
    bar = np.zeros((101, 101), int)
    bar[50, :] = 9  # a level line, as seen by a head tilted by a right angle, stands upright
    turned = pixels.face_crop(bar, (0, 0, 101, 101), 90.0)
    assert (turned[:, 55:57] == 9).any(1).all() and (turned[:, :50] == 0).all()
    flat = pixels.face_crop(np.full((100, 100), 9), (0, 0, 100, 100), 45.0)
    assert flat[56, 56] == 9 and flat[0, 0] == 0
    assert pixels.sharpness_of(big, (400, 400, 500, 500)) == 0.0


def test_page_items(spark):
    tiles = spark.createDataFrame([("v", 0, 1, 48, 420, 984, 1000, "Person A", "×2")], "video_id string, idx int, n int, x int, y int, w int, h int, label string, sublabel string")
    names = spark.createDataFrame([("v", "clip · 1 Jan 2024", "1 people"), ("none", "x", "y")], "video_id string, subtitle string, footer string")
    rows = collage.page_items(tiles, names).orderBy("video_id", "z").collect()
    assert [r.item for r in rows] == ["background", "title", "subtitle", "tile", "scrim", "chip", "footer"]
    by = {r["item"]: r for r in rows}
    assert by["scrim"].top == pytest.approx(1420 - 380) and by["chip"].text == "Person A · ×2" and by["chip"].right == 48 + 24 + 13 * 14 + 56
    assert by["footer"].left + by["footer"].right == 1080 and by["footer"].right - by["footer"].left == 8 * 14 + 96


def test_publishing_keeps_the_old_result_if_a_rename_fails(spark, tmp_path, monkeypatch):
    one = spark.range(1)
    path = str(tmp_path / "out")
    sinks.publish(one, path)
    paths = sinks._paths

    class Failing:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return str(a).endswith(".old") and self.fs.rename(a, b) or str(b).endswith(".old") and self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(sinks, "_paths", lambda *a: (Failing(paths(*a)[0]), paths(*a)[1]))
    with pytest.raises(OSError):
        sinks.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 1 and len(list(tmp_path.iterdir())) == 1
