"""Identities of one video's faces: an ordered fold over its samples.

Each step looks at what earlier steps decided, so a video is one group (some 1,200 samples at most, under
1 MB) and the videos are the parallelism. Sums and comparisons are single precision, in sample order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from frameloom.schemas import DECISIONS

f = np.float32


@dataclass(frozen=True)
class Rules:
    """Thresholds; all can be overridden."""

    join: float = 0.50
    merge: float = 0.55
    margin: float = 0.05
    rescue: float = 0.55
    fission: float = 0.55
    gap_ms: int = 1500
    least_frames: int = 3
    switch_ms: int = 400
    most_switches: int = 3
    most_mad: float = 0.08
    least_dx: float = 0.20
    most_iou: float = 0.05
    least_paired: int = 3
    dissolve_most: int = 12
    prune_from: int = 3
    least_faces: int = 2
    half_least: int = 3
    fission_rounds: int = 10


def ordered_sum(rows: np.ndarray) -> np.ndarray:
    return np.cumsum(rows, axis=0, dtype=f)[-1]


def similarity(a: np.ndarray, b: np.ndarray) -> np.float32:
    n = min(len(a), len(b))
    got = np.cumsum(a[:n] * b[:n], dtype=f)[-1] if n else f(0)
    return f(-1) if np.isnan(got) else got


def unit(v: np.ndarray) -> np.ndarray:
    norm = f(np.sqrt(np.cumsum(v * v, dtype=f)[-1])) if len(v) else f(0)
    return (v / norm).astype(f) if norm > 1e-9 else v


def fitted(v: np.ndarray, size: int) -> np.ndarray:
    """v cut, or filled up with zeros, to a size: of vectors of unequal sizes only the positions that both have add up."""
    out = np.zeros(size, f)
    out[: min(size, len(v))] = v[:size]
    return out


class Video:
    """Columns of one video's samples, in arrival order, and the questions that the stages ask of index lists."""

    def __init__(self, rows: pd.DataFrame, rules: Rules, log: Callable[[str], None]):
        self.rules, self.log = rules, log
        self.ts = rows["ts_ms"].to_numpy(np.int64)
        self.vectors = [np.asarray(v, f) for v in rows["embedding"]]
        box = rows[["left", "top", "right", "bottom", "frame_w", "frame_h"]].to_numpy(np.int64)
        self.framed = (box[:, 4] > 0) & (box[:, 5] > 0)
        self.placed = self.framed & (box[:, 2] > box[:, 0]) & (box[:, 3] > box[:, 1])
        scale = np.where(self.framed[:, None], box[:, [4, 5, 4, 5]], 1).astype(f)
        self.box = (box[:, :4].astype(f) / scale).astype(f)
        self.x = (((box[:, 0] + box[:, 2]).astype(f) / f(2)) / scale[:, 0]).astype(f)
        self._islands: dict[tuple[int, ...], list[tuple[int, int]]] = {}

    def centroid(self, own: list[int]) -> np.ndarray:
        size = len(self.vectors[own[0]])
        return unit(ordered_sum(np.stack([fitted(self.vectors[i], size) for i in own])))

    def by_time(self, own: list[int]) -> list[int]:
        return sorted(own, key=lambda i: self.ts[i])

    def islands(self, own: list[int]) -> list[tuple[int, int]]:
        """Countable stretches of screen time, kept for index lists seen before."""
        key = tuple(own)
        if key not in self._islands:
            times = np.sort(self.ts[own])
            parts = np.split(times, np.flatnonzero(np.diff(times) > self.rules.gap_ms) + 1) if len(times) else []
            self._islands[key] = [(int(p[0]), int(p[-1])) for p in parts if len(p) >= self.rules.least_frames]
        return self._islands[key]

    def together(self, a: list[int], b: list[int]) -> bool:
        return any(s < t2 and s2 < t for s, t in self.islands(a) for s2, t2 in self.islands(b))

    def switches(self, a: list[int], b: list[int]) -> int:
        times = np.concatenate([self.ts[a], self.ts[b]])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(times, kind="stable")
        return int(((np.diff(side[order]) != 0) & (np.diff(times[order]) <= self.rules.switch_ms)).sum()) if len(a) and len(b) else 0

    def region(self, own: list[int]) -> np.float32 | None:
        xs = np.sort(self.x[[i for i in own if self.placed[i]]])
        if len(xs) < 2:
            return None
        middle = xs[len(xs) // 2]
        mad = np.sort(np.abs(xs - middle))[len(xs) // 2]
        return None if mad > f(self.rules.most_mad) else middle

    def apart(self, a: list[int], b: list[int]) -> bool:
        ra, rb = self.region(a), self.region(b)
        return ra is not None and rb is not None and abs(ra - rb) >= f(self.rules.least_dx)

    def overlap(self, i: int, j: int) -> np.float32 | None:
        if not (self.framed[i] and self.framed[j]):
            return None
        a, b = self.box[i], self.box[j]
        inter = max(min(a[2], b[2]) - max(a[0], b[0]), f(0)) * max(min(a[3], b[3]) - max(a[1], b[1]), f(0))
        if inter <= 0:
            return f(0)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
        return f(inter / union) if union > 0 else None


def contest(sims: list[np.float32], floor: float, margin: float) -> int | None:
    """The winner among similarities in order: it reaches the floor and, unless alone, beats what it displaced by the margin."""
    best, lead, second = None, f(floor), f(-1)
    for i, sim in enumerate(sims):
        if sim >= lead:
            best, lead, second = i, sim, lead
        elif sim > second:
            second = sim
    return best if best is not None and (len(sims) <= 1 or f(lead - second) >= f(margin)) else None


def assign(video: Video) -> tuple[list[list[int]], list[np.ndarray]]:
    groups, centroids, sums = [], [], []
    for i in video.by_time(list(range(len(video.ts)))):
        v = video.vectors[i]
        at = contest([similarity(v, q) for q in centroids], video.rules.join, video.rules.margin)
        if at is None:
            groups.append([i])
            centroids.append(v.copy())
            sums.append(v.copy())
        else:
            groups[at].append(i)
            sums[at] = (sums[at] + fitted(v, len(sums[at]))).astype(f)
            centroids[at] = unit(sums[at])
    video.log(f"assigned {len(groups)} raw clusters sizes={[len(g) for g in groups]}")
    return groups, centroids


def refusal(video: Video, a: list[int], b: list[int]) -> str | None:
    """Why two groups of like faces must stay two people."""
    if video.together(a, b):
        return "co-occurring people"
    if video.switches(a, b) >= video.rules.most_switches:
        return "interleaved co-stars"
    return "different screen regions" if video.apart(a, b) else None


def merge(video: Video, groups: list[list[int]], centroids: list[np.ndarray]) -> None:
    """Joins the first pair in index order that may, and starts again, until none may."""

    def once() -> bool:
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                sim = similarity(centroids[i], centroids[j])
                if sim < f(video.rules.merge):
                    continue
                what = f"merge size={len(groups[i])}+{len(groups[j])} sim={sim:.3f}"
                if why := refusal(video, groups[i], groups[j]):
                    video.log(f"block {what} ({why})")
                    continue
                video.log(what)
                groups[i] = groups[i] + groups.pop(j)
                centroids[i] = video.centroid(groups[i])
                centroids.pop(j)
                return True
        return False

    while once():
        pass


def distinct_person(video: Video, own: list[int], peers: dict[int, list[int]], switches: int) -> bool:
    """Whether a never-alone group is a person of its own: apart from all others in shared frames, or alternating with one."""
    rules = video.rules
    if not video.islands(own):
        return False
    paired = separated = 0
    for i in own:
        if not video.placed[i]:
            continue
        verdicts = []
        for j in peers.get(int(video.ts[i]), []):
            if not video.placed[j] or (shared := video.overlap(i, j)) is None:
                continue
            verdicts.append(abs(video.x[i] - video.x[j]) >= f(rules.least_dx) and shared <= f(rules.most_iou))
            if not verdicts[-1]:
                break
        paired += bool(verdicts)
        separated += bool(verdicts) and all(verdicts)
    video.log(f"dissolve-spatial size={len(own)} paired={paired} separated={separated}")
    if paired >= rules.least_paired and separated == paired:
        return True
    if switches >= rules.most_switches and not any(int(video.ts[i]) in peers for i in own):
        video.log(f"dissolve-keep size={len(own)} (alternating co-star, alts={switches})")
        return True
    return False


def dissolve(video: Video, groups: list[list[int]]) -> list[list[int]]:
    """Small groups that are never alone on screen hand their faces to established ones, or lose them."""
    if len(groups) < 2:
        return groups
    islands = [video.islands(g) for g in groups]

    def alone(k: int, i: int) -> bool:
        return not any(s <= video.ts[i] <= t for o, own in enumerate(islands) if o != k for s, t in own)

    firm = [k for k, g in enumerate(groups) if any(alone(k, i) for i in g)]
    if not firm:
        return groups
    centroids = {k: video.centroid(groups[k]) for k in firm}
    peers: dict[int, list[int]] = {}
    for k in firm:
        for i in groups[k]:
            peers.setdefault(int(video.ts[i]), []).append(i)
    groups, gone = [list(g) for g in groups], set()
    for k in reversed([k for k, g in enumerate(groups) if k not in centroids and len(g) <= video.rules.dissolve_most]):
        switches = max(video.switches(groups[k], groups[r]) for r in firm)
        if distinct_person(video, groups[k], peers, switches):
            video.log(f"dissolve-keep size={len(groups[k])} (co-occurring person, separated screen position)")
            continue
        rescued = 0
        for i in video.by_time(groups[k]):
            at = contest([similarity(video.vectors[i], centroids[r]) for r in firm], video.rules.rescue, video.rules.margin)
            if at is None:
                video.log(f"dissolve-drop ts={video.ts[i]}")
                continue
            groups[firm[at]].append(i)
            centroids[firm[at]] = video.centroid(groups[firm[at]])
            rescued += 1
        video.log(f"dissolve cluster size={len(groups[k])} rescued={rescued}")
        gone.add(k)
    return [g for k, g in enumerate(groups) if k not in gone]


def split(video: Video, own: list[int]) -> list[list[int]]:
    """Two halves of a group that holds two people; the group itself otherwise."""
    rules = video.rules
    if len(own) < 2 * rules.half_least:
        return [own]
    sims = [(similarity(video.vectors[a], video.vectors[b]), x, y) for x, a in enumerate(own) for y, b in enumerate(own) if x < y]
    _, x, y = min(sims, key=lambda s: (s[0], s[1], s[2]))
    centres = [video.vectors[own[x]], video.vectors[own[y]]]
    side = np.zeros(len(own), int)
    for _ in range(rules.fission_rounds):
        new = np.array([int(similarity(video.vectors[i], centres[0]) < similarity(video.vectors[i], centres[1])) for i in own])
        if (new == side).all():
            break
        side = new
        if len(set(side)) < 2:
            break
        centres = [video.centroid([i for i, s in zip(own, side, strict=True) if s == half]) for half in (0, 1)]
    halves = [[i for i, s in zip(own, side, strict=True) if s == half] for half in (0, 1)]
    if any(len(h) < rules.half_least or not video.islands(h) for h in halves):
        return [own]
    cross = similarity(video.centroid(halves[0]), video.centroid(halves[1]))
    if cross >= f(rules.fission):
        return [own]
    video.log(f"fission size={len(own)} -> {len(halves[0])}+{len(halves[1])} sim={cross:.3f}")
    return halves


def cluster(rows: pd.DataFrame, rules: Rules = Rules(), log: Callable[[str], None] = lambda _: None) -> list[list[int]]:
    """Groups of row positions (rows in arrival order), by first time; a row is in one group at most."""
    if not len(rows):
        return []
    video = Video(rows, rules, log)
    groups, centroids = assign(video)
    merge(video, groups, centroids)
    groups = dissolve(video, groups)
    if len(groups) >= rules.prune_from:
        for g in groups:
            if len(g) < rules.least_faces:
                log(f"prune tiny cluster size={len(g)}")
        groups = [g for g in groups if len(g) >= rules.least_faces]
    halves = [h for g in groups for h in split(video, g)]
    return sorted(halves, key=lambda g: min(video.ts[i] for i in g))


BOX = ["left", "top", "right", "bottom", "frame_w", "frame_h"]
NEEDED = ["video_id", "seq", "ts_ms", "embedding", *BOX]


def cluster_faces(samples: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """video_id, cluster_id, member_pos, seq of every clustered sample."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
        out = [(rows["video_id"][0], k, pos, int(rows["seq"][i])) for k, g in enumerate(cluster(rows, rules)) for pos, i in enumerate(g)]
        return pd.DataFrame(out, columns=["video_id", "cluster_id", "member_pos", "seq"])

    return samples.select(*NEEDED).groupBy("video_id").applyInPandas(fold, "video_id string, cluster_id int, member_pos int, seq int")


def decisions(samples: DataFrame, rules: Rules = Rules(), most: int = 100) -> DataFrame:
    """video_id, n, msg: the first ``most`` log lines of each video's run."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        lines: list[str] = []
        cluster(rows.sort_values("seq", kind="stable").reset_index(drop=True), rules, lines.append)
        return pd.DataFrame({"video_id": rows["video_id"].iloc[0], "n": range(len(lines[:most])), "msg": lines[:most]})

    return samples.select(*NEEDED).groupBy("video_id").applyInPandas(fold, DECISIONS)


def fission(samples: DataFrame, by: list[str], rules: Rules = Rules()) -> DataFrame:
    """by, half, seq: each group split in two if it holds two people."""
    key = samples.select(*by).schema

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
        video = Video(rows, rules, lambda _: None)
        out = [(*(rows[b][0] for b in by), half, int(rows["seq"][i])) for half, own in enumerate(split(video, list(range(len(rows))))) for i in own]
        return pd.DataFrame(out, columns=[*by, "half", "seq"])

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in key.fields)
    columns = [*dict.fromkeys([*by, *NEEDED])]
    return samples.select(*columns).groupBy(*by).applyInPandas(fold, f"{schema}, half int, seq int")
