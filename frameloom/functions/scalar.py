"""Scalar rules as column expressions. Single precision is kept where thresholds are compared in it (a division
of floats is a double in Spark, so quotients are cast back)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def c(name: str) -> Column:
    return F.col(name)


# -- boxes -----------------------------------------------------------------------------------------


def width() -> Column:
    return F.greatest(c("right") - c("left"), F.lit(0))


def height() -> Column:
    return F.greatest(c("bottom") - c("top"), F.lit(0))


def area() -> Column:
    return width() * height()


def edge_clipped(margin: float = 0.08) -> Column:
    """Whether a box comes within a share of the frame's shorter side of the frame's edge; true without a frame."""
    w, h = c("frame_w"), c("frame_h")
    m = f32(F.least(w, h)) * f32(margin)
    return F.when((w <= 0) | (h <= 0), True).otherwise((c("left") < m) | (c("top") < m) | (c("right") > f32(w) - m) | (c("bottom") > f32(h) - m))


LANDMARKS = ("eye_l", "eye_r", "nose_", "mouth_")


def full_face(margin: float = 0.02) -> Column:
    """Whether all landmarks are there and stand strictly inside the frame's margins."""
    out = (c("frame_w") > 0) & (c("frame_h") > 0)
    for axis, side in (("x", "frame_w"), ("y", "frame_h")):
        points = [c(p + axis) for p in LANDMARKS]
        m = f32(c(side)) * f32(margin)
        for p in points:
            out = out & p.isNotNull()
        out = out & (F.least(*points) > m) & (F.greatest(*points) < f32(c(side)) - m)
    return F.coalesce(out, F.lit(False))


def clamped_box() -> list[Column]:
    """Box coordinates inside the frame."""
    return [clamp(c(x), 0, c("frame_w" if x in ("left", "right") else "frame_h")).alias(x) for x in ("left", "top", "right", "bottom")]


def has_geometry(prefix: str = "") -> Column:
    p = lambda x: c(prefix + x)
    return (p("frame_w") > 0) & (p("frame_h") > 0) & (p("right") > p("left")) & (p("bottom") > p("top"))


def center_x(prefix: str = "") -> Column:
    p = lambda x: c(prefix + x)
    return F.when(has_geometry(prefix), f32(f32(f32(p("left") + p("right")) / f32(2)) / f32(p("frame_w"))))


def center_y(prefix: str = "") -> Column:
    p = lambda x: c(prefix + x)
    return F.when(has_geometry(prefix), f32(f32(f32(p("top") + p("bottom")) / f32(2)) / f32(p("frame_h"))))


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes in frame shares; null without frames or union."""
    side = lambda p, x: f32(f32(c(p + x)) / f32(c(p + ("frame_w" if x in ("left", "right") else "frame_h"))))
    over = lambda lo, hi: F.greatest(F.least(side(a, hi), side(b, hi)) - F.greatest(side(a, lo), side(b, lo)), f32(0))
    size = lambda p: (side(p, "right") - side(p, "left")) * (side(p, "bottom") - side(p, "top"))
    inter = over("left", "right") * over("top", "bottom")
    union = size(a) + size(b) - inter
    framed = (c(a + "frame_w") > 0) & (c(a + "frame_h") > 0) & (c(b + "frame_w") > 0) & (c(b + "frame_h") > 0)
    return F.when(framed, F.when(inter <= 0, f32(0)).when(union > 0, f32(inter / union)))


# -- quality ---------------------------------------------------------------------------------------


def eye_open() -> Column:
    return F.least(F.coalesce(c("left_eye"), f32(0.5)), F.coalesce(c("right_eye"), f32(0.5)))


def quality() -> Column:
    """Struct of frontality, sharp, eyes, smile, size, veto and total."""
    clamp01 = lambda x: clamp(x, f32(0), f32(1))
    frontality = f32(1) - F.least(f32(1), f32((F.abs(c("euler_y")) + f32(0.6) * F.abs(c("euler_z"))) / f32(30)))
    low, high = F.log(F.lit(61.0)), F.log(F.lit(601.0))
    sharp = clamp01(f32((F.log(c("sharpness") + 1.0) - low) / (high - low)))
    frame = f32(c("frame_w")) * f32(c("frame_h"))
    framed = (c("frame_w") > 0) & (c("frame_h") > 0)
    size = F.when(framed, clamp01(f32(f32(c("area")) / (f32(0.08) * frame)))).otherwise(f32(0))
    cut = lambda condition, by: F.when(condition, f32(by)).otherwise(f32(1))
    veto = cut(c("eye_open") < f32(0.25), 0.2) * cut(c("edge_clipped"), 0.3) * cut(F.abs(c("euler_y")) > 35, 0.5) * cut(framed & (f32(c("area")) < f32(0.02) * frame), 0.5)
    total = (f32(0.30) * frontality + f32(0.30) * sharp + f32(0.20) * c("eye_open") + f32(0.15) * c("smiling") + f32(0.05) * size) * veto
    return F.struct(frontality.alias("frontality"), sharp.alias("sharp"), c("eye_open").alias("eyes"), c("smiling").alias("smile"), size.alias("size"), veto.alias("veto"), total.alias("total"))


def badges(most: int = 3) -> Column:
    tests = [(F.abs(c("euler_y")) < 15, "Frontal"), (c("eye_open") > 0.5, "Eyes open"), (c("smiling") > 0.5, "Smiling"), (~c("edge_clipped"), "Full face")]
    return F.slice(F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in tests]), lambda x: x.isNotNull()), 1, most)


# -- crops and layout ------------------------------------------------------------------------------


def whole(x: Column) -> Column:
    return F.when(F.isnan(x), 0).otherwise(x).cast("int")


def generous_crop(full_w: str = "full_w", full_h: str = "full_h", shared: str = "shared") -> Column:
    """Struct l, t, w, h: a square around the face in a frame of full size; see the rules in the tests."""
    w, h, sh = c(full_w), c(full_h), c(shared)
    usable = (c("frame_w") > 0) & (c("frame_h") > 0) & (c("right") > c("left")) & (c("bottom") > c("top")) & (w > 0) & (h > 0)
    sx, sy = f32(f32(w) / f32(c("frame_w"))), f32(f32(h) / f32(c("frame_h")))
    cx, cy = f32(f32(c("left") + c("right")) / f32(2)) * sx, f32(f32(c("top") + c("bottom")) / f32(2)) * sy
    low = f32(F.least(w, h))
    base = F.greatest(f32(c("right") - c("left")) * sx, f32(c("bottom") - c("top")) * sy) * F.when(sh, f32(1.8)).otherwise(f32(2.4))
    side = F.greatest(base, F.when(sh, f32(0.35)).otherwise(f32(0.45)) * low)
    mid = f32(w) / f32(2)
    cap = F.when(f32(c("right")) * sx <= mid, f32(2) * f32(mid - cx)).when(f32(c("left")) * sx >= mid, f32(2) * f32(cx - mid))
    side = F.when(sh & (cap > 0), F.least(side, f32(cap))).otherwise(side)
    cy = cy - f32(0.08) * side
    place = lambda centre, size: clamp(f32(centre - side / f32(2)), f32(0), f32(size) - side)
    left, top = whole(place(f32(cx), w)), whole(place(f32(cy), h))
    cut = lambda at, size: F.greatest(F.least(whole(side), size - at), F.lit(1))
    box = lambda l, t, a, b: F.struct(l.cast("int").alias("l"), t.cast("int").alias("t"), a.cast("int").alias("w"), b.cast("int").alias("h"))
    zero = F.lit(0)
    return F.when(~usable, box(zero, zero, F.greatest(w, F.lit(1)), F.greatest(h, F.lit(1)))).when(side >= f32(0.98) * low, box(zero, zero, w, h)).otherwise(box(left, top, cut(left, w), cut(top, h)))


def embed_rect(expand: float = 0.2) -> Column:
    """Struct l, t, w, h: the square that an embedder sees. Where it meets the right or lower edge it is shifted back."""
    side = f32(F.greatest(width(), height())) * (f32(1) + f32(expand))

    def along(low: str, high: str, size: Column) -> tuple[Column, Column]:
        centre = f32(f32(c(low) + c(high)) / f32(2))
        start = clamp(whole(f32(centre - f32(side / f32(2)))), F.lit(0), size - 1)
        end = F.least(F.greatest(whole(f32(start) + side), start + 1), size)
        start = F.greatest(whole(f32(end) - side), F.lit(0))
        return start, end - start

    (l, w), (t, h) = along("left", "right", c("frame_w")), along("top", "bottom", c("frame_h"))
    return F.struct(l.alias("l"), t.alias("t"), w.alias("w"), h.alias("h"))


def center_fit(bw: Column, bh: Column, rw: Column, rh: Column) -> Column:
    """Struct x, y, w, h: the centred part of a bw x bh image that fills rw x rh, its edges rounded down."""
    scale = F.greatest(f32(f32(rw) / f32(bw)), f32(f32(rh) / f32(bh)))

    def along(image: Column, room: Column) -> tuple[Column, Column]:
        part = f32(f32(room) / scale)
        start = f32((f32(image) - part) / f32(2))
        return whole(start), whole(start + part) - whole(start)

    (x, w), (y, h) = along(bw, rw), along(bh, rh)
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def upright(w: Column, h: Column, rotation: Column) -> list[Column]:
    """Width and height as seen after a rotation by a multiple of 90 degrees."""
    turned = F.pmod(rotation, F.lit(180)) == 90
    return [F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)]


def downscaled(w: Column, h: Column, longest: int = 640) -> list[Column]:
    scale = F.least(f32(1), f32(f32(longest) / f32(F.greatest(w, h))))
    return [F.greatest(whole(f32(w) * scale), F.lit(1)), F.greatest(whole(f32(h) * scale), F.lit(1))]


def thumb(w: Column, h: Column, wide: int) -> list[Column]:
    """Width and height of a thumbnail of fixed width, aspect kept."""
    return [F.lit(wide), F.when(w > 0, F.greatest(whole(f32(f32(h) * f32(wide) / f32(w))), F.lit(1))).otherwise(F.lit(1))]


# -- sampling and progress -------------------------------------------------------------------------


def frame_plan(duration_ms: Column, fps: int = 5, most: int = 200) -> Column:
    """Number of frames to sample."""
    if fps <= 0:
        return F.lit(0)
    return F.when(duration_ms <= 0, 0).otherwise(F.least(F.lit(most).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(duration_ms * fps / 1000)))).cast("int")


#: The stages in order and their shares of the progress.
STAGES = [("EXTRACT", 0.20), ("DETECT", 0.35), ("EMBED", 0.15), ("CLUSTER", 0.10), ("SCORE", 0.10), ("COLLAGE", 0.10)]


def stage_fraction(done: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(clamp(done / total, 0.0, 1.0))


def overall(stage: Column, fraction: Column) -> Column:
    """Progress of the whole run: finished stages, and the share of the present one."""
    out = F.lit(None).cast("double")
    for name, weight in STAGES:
        before = sum(w for n, w in STAGES[: [s for s, _ in STAGES].index(name)])
        out = F.when(stage == name, F.lit(before) + clamp(fraction, 0.0, 1.0) * F.lit(weight)).otherwise(out)
    return out


def eta_ms(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when((done >= 3) & (done < total), F.floor(elapsed * (total - done) / done).cast("long"))


def stage_status(ordinal: Column, current: Column) -> Column:
    return F.when(ordinal < current, "DONE").when(ordinal == current, "CURRENT").otherwise("PENDING")


def progress_text(stage: Column, fraction: Column, done: Column, total: Column, eta: Column) -> Column:
    """Whole percent, the frame counter while frames are sampled, and whole seconds left if they are known."""
    percent = F.concat((overall(stage, fraction) * 100).cast("int").cast("string"), F.lit("%"))
    counter = F.when(stage == "EXTRACT", F.concat(F.lit(" · frame "), done.cast("string"), F.lit("/"), total.cast("string"))).otherwise(F.lit(""))
    left = F.coalesce(F.concat(F.lit(" · ~"), F.floor(eta / 1000).cast("string"), F.lit("s left")), F.lit(""))
    return F.concat(percent, counter, left)


# -- texts -----------------------------------------------------------------------------------------


def clock(ms: Column) -> Column:
    """m:ss, rounded down."""
    s = F.floor(ms / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def label(person_id: Column) -> Column:
    return F.concat(F.lit("Person "), F.chr(person_id + 65))


def display_name(name: Column, uri: Column) -> Column:
    last = F.element_at(F.split(uri, "/"), -1)
    some = lambda x: F.when(F.length(F.trim(x)) > 0, x)
    return F.coalesce(some(name), some(last), F.lit("video"))


def file_name(name: Column, prefix: str = "collage") -> Column:
    """A name's stem made safe for a file, without the time that a sink adds."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    stem = F.when(F.length(F.trim(stem)) > 0, stem).otherwise(F.lit("collage"))
    return F.concat(F.lit(prefix + "_"), F.regexp_replace(F.substring(stem, 1, 40), r"[^\p{L}\p{Nd}_-]", "_"))


def summary(people: Column, appearances: Column) -> Column:
    return F.concat(people.cast("string"), F.lit(" people · "), appearances.cast("string"), F.lit(" appearances"))


def detect_line(faces: Column, hits: Column, frames: Column, whip: Column, blurry: Column, partial: Column) -> Column:
    s = lambda x: x.cast("string")
    return F.concat(s(faces), F.lit(" faces in "), s(hits), F.lit("/"), s(frames), F.lit(" frames · "), s(whip), F.lit(" whip-pan · "), s(blurry), F.lit(" blurry · "), s(partial), F.lit(" partial"))


def clip_line(frames: Column, duration_ms: Column, w: Column, h: Column) -> Column:
    size = F.when(w > 0, F.concat(F.lit(" · "), w.cast("string"), F.lit("×"), h.cast("string"))).otherwise(F.lit(""))
    return F.concat(frames.cast("string"), F.lit(" frames · "), F.format_string("%.1f", duration_ms / 1000.0), F.lit("s"), size)


def caption(name: Column, app: str = "frameloom") -> Column:
    """The line that goes with a shared page."""
    return F.concat(name, F.lit(f" — made with {app}"))


def footer(when: Column) -> Column:
    """A page's date."""
    return F.date_format(when, "d MMM yyyy")


def progress_bounds(spark) -> DataFrame:
    """stage, ordinal, weight, before, after: the stages' shares and their running sums."""
    own = spark.createDataFrame([(n, i, w) for i, (n, w) in enumerate(STAGES)], "stage string, ordinal int, weight double")
    total = F.sum("weight").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))  # six rows
    return own.withColumn("after", F.round(total, 6)).withColumn("before", F.round(F.col("after") - F.col("weight"), 6))
