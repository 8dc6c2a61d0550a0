"""Collage pages as tables: layout rectangles and a draw list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import scalar as S

PAGE_W, PAGE_H, X0, X1, TILE_W, FULL_W, GAP, LEAST_H, GRID_H = 1080, 1920, 48, 552, 480, 984, 24, 200, 1360
#: Fixed value: a label chip's room beside its text.
PADDING = 56
#: Full-width rectangles (y, height) on top of pages of 1 to 5 tiles, and the grid's (y, height) below.
TOPS = {1: [(420, 1000)], 2: [(320, 620), (964, 620)], 3: [(300, 620)], 5: [(300, 540)]}
GRIDS = {3: (944, 480), 4: (300, 640), 5: (864, 380), 6: (300, 440)}


def rectangle(n: Column, i: Column) -> Column:
    """Struct x, y, w, h in page pixels of tile i (from 0) of n."""
    box = lambda x, y, w, h: F.struct(*[v.cast("int").alias(k) for k, v in zip("xywh", (x, y, w, h), strict=True)])
    rows = F.floor((n + 1) / 2)
    high = F.greatest(F.lit(LEAST_H).cast("long"), F.floor((GRID_H - (rows - 1) * GAP) / rows))

    def cell(k: Column, y: Column, h: Column) -> Column:
        return box(F.when(k % 2 == 0, X0).otherwise(X1), y + F.floor(k / 2) * (h + GAP), F.lit(TILE_W), h)

    out = cell(i, F.lit(300), high)
    for count in range(6, 0, -1):
        top = TOPS.get(count, [])
        page = cell(i - len(top), F.lit(GRIDS[count][0]), F.lit(GRIDS[count][1])) if count in GRIDS else box(*[F.lit(None)] * 4)
        for k, (y, h) in enumerate(top):
            page = F.when(i == k, box(F.lit(X0), F.lit(y), F.lit(FULL_W), F.lit(h))).otherwise(page)
        out = F.when(n == count, page).otherwise(out)
    return out


def layout(spark: SparkSession, most: int) -> DataFrame:
    """n, idx, x, y, w, h (page pixels) of all pages of 1 to ``most`` tiles; a small table to broadcast."""
    if most < 1:
        raise ValueError("a page needs a tile")
    own = spark.range(1, most + 1).select(F.col("id").cast("int").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    return own.select("n", "idx", rectangle(F.col("n"), F.col("idx")).alias("r")).select("n", "idx", "r.*")


def draw_list(people: DataFrame, best: DataFrame, page_full: tuple[int, int] | None = None) -> DataFrame:
    """One row per tile: rectangle, crop of the best shot's frame, label and sublabel. Positions are computed, not joined."""
    sizes = people.groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    tiles = people.join(sizes, "video_id").join(best.drop("label", "n_samples", "appearances"), ["video_id", "person_id"])
    w, h = (F.lit(page_full[0]), F.lit(page_full[1])) if page_full else (F.col("frame_w"), F.col("frame_h"))
    tiles = tiles.withColumns({"full_w": w, "full_h": h, "shared": ~F.col("solo_frame"), "r": rectangle(F.col("n"), F.col("person_id"))})
    return tiles.select(
        "video_id", F.col("person_id").alias("idx"), "n", F.col("ts_ms"), "r.x", "r.y", "r.w", "r.h", S.generous_crop().alias("crop"),
        "label", F.concat(F.lit("×"), F.size("appearances").cast("string")).alias("sublabel"))


def chip(text_width: Column) -> Column:
    """Struct left, top, right, bottom of a label of a text's width, with its padding, inside its tile."""
    left, base = F.col("x") + 24, F.col("y") + F.col("h")
    return F.struct(left.alias("left"), (base - 88).alias("top"), F.least(left + text_width + PADDING, F.col("x") + F.col("w") - 16).alias("right"), (base - 24).alias("bottom"))


def page_items(tiles: DataFrame, names: DataFrame, letter_width: float = 14.0) -> DataFrame:
    """video_id, z, item, text and left, top, right, bottom of all that a page shows, in drawing order: background, title,
    subtitle, for each tile its image, scrim and chip, and the footer. tiles: of draw_list(); names: video_id, subtitle, footer.
    A text's width is taken as letter_width for each of its letters, as there is no font here."""
    wide = lambda text: F.length(text) * F.lit(letter_width)
    n = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")

    def item(z, kind: str, text: Column | None, *box) -> Column:
        places = [n(v).alias(k) for k, v in zip(("left", "top", "right", "bottom"), box, strict=True)]
        return F.struct(n(z).alias("z"), F.lit(kind).alias("item"), (F.lit(None) if text is None else text).cast("string").alias("text"), *places)

    pill = wide(F.col("footer")) + 96
    page = F.array(
        item(0, "background", None, 0, 0, PAGE_W, PAGE_H),
        item(1, "title", F.lit("frameloom"), 60, 150, None, None),
        item(2, "subtitle", F.col("subtitle"), 62, 210, None, None),
        item(1000, "footer", F.col("footer"), (PAGE_W - pill) / 2, 1746, (PAGE_W + pill) / 2, 1842),
    )
    x, y, right, bottom = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    label = F.concat("label", F.lit(" · "), "sublabel")
    box = chip(wide(label))
    z = 3 + F.col("idx") * 3
    tile = F.array(item(z, "tile", None, x, y, right, bottom), item(z + 1, "scrim", None, x, bottom - F.col("h") * 0.38, right, bottom), item(z + 2, "chip", label, box["left"], box["top"], box["right"], box["bottom"]))
    shown = tiles.select("video_id").distinct()  # a page without tiles is none
    items = names.join(shown, "video_id", "left_semi").select("video_id", F.inline(page)).unionByName(tiles.select("video_id", F.inline(tile)))
    return items.withColumn("z", F.col("z").cast("int"))
