"""Golden cases of clustering, on hand-made vectors (rows are arrival order)."""

import numpy as np
import pandas as pd
import pytest

from frameloom.operators.identity import BOX, Rules, Video, cluster, cluster_faces, split

A, B, C = (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)
FAR = (-0.5774, -0.5774, -0.5774)
LEFT, RIGHT = (40, 180), (460, 600)


def one(ts, v, box=(100, 200), frame=640):
    return {"ts_ms": ts, "embedding": [float(x) for x in v], "left": box[0], "top": 100, "right": box[1], "bottom": 200, "frame_w": frame, "frame_h": frame}


def at(v, *times, box=(100, 200), frame=640):
    return [one(t, v, box, frame) for t in times]


def rep(t0, n, v):
    return at(v, *range(t0, t0 + 200 * n, 200))


def unit(*v):
    return tuple(np.array(v) / np.linalg.norm(v))


def rows(items):
    df = pd.DataFrame(items, columns=["ts_ms", "embedding", "left", "top", "right", "bottom", "frame_w", "frame_h"])
    return df.assign(video_id="v", seq=range(len(df)))


def run(items):
    log = []
    return cluster(rows(items), log=log.append), log


def sizes(items):
    return [len(g) for g in run(items)[0]]


NEAR = lambda i, axis, other: unit(*[1.0 if k == axis else 0.02 * i if k == other else 0.0 for k in range(3)])
AXES = [one(5000 * i + 200 * j, v) for i in range(3) for j, v in enumerate((NEAR(i, 0, 1), NEAR(i, 1, 0)))]
DRIFT = [(0.984808, 0.173648, 0), (0.342020, 0.939693, 0), (0.819152, 0.573576, 0)]
C5 = [one(t, v) for t, v in zip((0, 100, 200, 300), (A, *DRIFT), strict=True)]
C5_LEFT = [one(t, v, LEFT) for t, v in zip((0, 100, 200, 300), (A, *DRIFT), strict=True)]
WARM = (0.906308, 0.422618, 0)
COOL = (0.469472, 0.882948, 0)
C9 = at(A, *range(0, 2001, 200), box=LEFT)
GUEST = (0.3, 0.953939, 0)
SPLIT = (0.3, 0.9539, 0)

CASES = {
    "C1": (AXES, [3, 3]),
    "C3": (rep(0, 3, A) + rep(5000, 3, FAR), [3, 3]),
    "C4": (rep(0, 6, A) + rep(5000, 6, (0.48, 0.8772, 0)), [6, 6]),
    "C5": (C5, [4]),
    "C6": (at(A, 0, 500, 1000, 1500) + at(WARM, 1900, 2500) + at(COOL, 600, 800, 1000, 3000), [6, 4]),
    "C7": (at(A, 0, 500, 1000, 1500) + at(WARM, 1900, 2500) + at(COOL, 600, 800, 1000), [9]),
    "C8": (at(A, *range(0, 2501, 500)) + at((0.45, 0.893, 0), *range(300, 1301, 200)), [6]),
    "C9": (C9 + at(GUEST, *range(1000, 1801, 200), box=RIGHT), [11, 5]),
    "C10": (C9 + at(GUEST, *range(1000, 1801, 200), box=LEFT), [11]),
    "C11": (C9 + at(GUEST, *range(1000, 1801, 200), box=RIGHT, frame=0), [11]),
    "C12": (C5_LEFT, [4]),
    "C16": (rep(0, 3, A) + rep(5000, 3, (0.48, 0.87727, 0)) + at((0.53, 0.285, 0.79867), 10000, 10200), None),
    "C17": (at(A, 0, 200, 400, 600, 1400, 1600) + at(B, 100, 300, 500, 2000) + at((0.60, 0.58, 0.551), 800, 1000, 1200), [6, 4]),
    "C21": (rep(0, 6, A) + at((0.52, 0.85416, 0), 2000, 2200, 2400, 2600), [6, 4]),
    "C22": (rep(0, 6, A) + at(SPLIT, 200, 400) + at((0.3, -0.9539, 0), 600, 800) + rep(5000, 6, C), [6, 6]),
    "C23": (rep(0, 3, A) + rep(5000, 3, B) + at((0.99388, 0.11043, 0), 10000), [4, 3]),
    "C24": ([one(5000 * i + 200 * j, NEAR(i, j, (j + 1) % 3)) for i in range(3) for j in range(3)] + rep(60000, 3, FAR), None),
    "C25": (rep(0, 3, A) + rep(60000, 3, FAR), [3, 3]),
    "C27": ([], []),
    "C28": (rep(30000, 3, A) + rep(1000, 3, B), [3, 3]),
    # Floors: 0.50 with one cluster, 0.55 with two or more.
    "floor of one": (rep(0, 3, A) + [one(5000, (0.5, 0.8660254, 0))], [4]),
    "below": (rep(0, 3, A) + [one(5000, (0.4999, 0.86608, 0))], [3, 1]),
}


@pytest.mark.parametrize("name", [k for k, (_, want) in CASES.items() if want is not None])
def test_sizes(name):
    items, want = CASES[name]
    assert sizes(items) == want


def test_joined_by_the_nearer():  # C2
    items = rep(0, 3, A) + rep(10000, 3, B) + at((0.55, 0.8352, 0), 20000)
    groups, _ = run(items)
    assert len(groups) == 2 and 6 in groups[1]


def test_merge_logs():  # C12, C13, C14, C15
    assert any(x.startswith("merge size=") for x in run(C5_LEFT)[1])
    apart = [x | ({"left": RIGHT[0], "right": RIGHT[1]} if x["ts_ms"] == 200 else {}) for x in C5_LEFT] + at(DRIFT[1], 5000, box=RIGHT)
    groups, log = run(apart)
    assert sorted(map(len, groups)) == [2, 3] and any(x.startswith("block merge") and "different screen regions" in x for x in log)
    groups, log = run(C5_LEFT + at((0.342020, 0.939693, 0), 600, box=LEFT))
    assert sorted(map(len, groups)) == [2, 3] and any("interleaved co-stars" in x for x in log)
    groups, log = run(at(A, 0, 200, 400, 600, 800, 1200, 1600, 2000, box=LEFT) + at(GUEST, 1000, 1400, 1800, box=LEFT))
    assert sorted(map(len, groups)) == [3, 8] and any("alternating co-star" in x for x in log)


def test_contested_and_dropped():  # C16, C17, C22, C24
    got = sorted(sizes(CASES["C16"][0]))
    assert len(got) == 3 and 3 in got and 2 in got
    assert sum("dissolve-drop" in x for x in run(CASES["C17"][0])[1]) == 3
    assert sum("dissolve-drop" in x for x in run(CASES["C22"][0])[1]) == 4


def halves(items):
    log = []
    video = Video(rows(items), Rules(), log.append)
    return [len(h) for h in split(video, list(range(len(items))))], log


def test_fission():  # C18 to C21
    got, log = halves(rep(0, 6, A) + rep(5000, 6, SPLIT))
    assert got == [6, 6] and any("fission" in x for x in log)
    got, log = halves(rep(0, 12, A))
    assert got == [12] and not log
    assert halves(rep(0, 4, A) + rep(5000, 2, SPLIT))[0] == [6]
    assert any("fission" in x for x in run(CASES["C21"][0])[1])


def test_nan_and_order():  # C26, C28
    got = sizes(rep(0, 3, A) + at((float("nan"), 0, 0), 5000))
    assert len(got) == 2 and 3 in got
    items = CASES["C28"][0]
    assert min(items[i]["ts_ms"] for i in run(items)[0][0]) == 1000


def test_invariant_to_row_order(spark):
    items = rows(CASES["C17"][0] + CASES["C9"][0])
    want = None
    for seed in (1, 2):
        shuffled = items.sample(frac=1, random_state=seed)[["video_id", "seq", "ts_ms", "embedding", "left", "top", "right", "bottom", "frame_w", "frame_h"]]
        schema = "video_id string, seq int, ts_ms long, embedding array<float>, left int, top int, right int, bottom int, frame_w int, frame_h int"
        got = sorted(map(tuple, cluster_faces(spark.createDataFrame(shuffled.values.tolist(), schema)).collect()))
        assert len({s for *_, s in got}) == len(got)
        want = want or got
        assert got == want


def test_vectors_of_unequal_sizes_add_up_where_both_have_positions():
    rows = pd.DataFrame({"ts_ms": [0, 200], "embedding": [[3.0, 0.0, 0.0], [0.0, 4.0]], **{x: [0, 0] for x in BOX}})
    video = Video(rows, Rules(), lambda _: None)
    assert np.allclose(video.centroid([0, 1]), [0.6, 0.8, 0.0]) and np.allclose(video.centroid([1, 0]), [0.6, 0.8])
