"""Figures as image files: points in pixel bins, box plots and sheets of outlined samples, aggregated by Spark and drawn where the rows are."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.raster import mask as masks
from brindle.raster import png
from brindle.sources.stores import cut, located

WIDE, TALL = 320, 240
#: Blue, green, red.
PAPER, INK, MARK, LINE = (255, 255, 255), (180, 119, 31), (40, 39, 214), (60, 60, 60)
#: Boxes of a plot at most; each takes so many pixels across.
BOXES, STEP = 400, 24


def pixel_bins(df: DataFrame, panel: str, x: Column, y: Column, flag: Column, wide: int = WIDE, tall: int = TALL) -> DataFrame:
    """(panel, px, py, n, flagged): points by pixel of a panel whose axes reach from its least to its greatest values; y goes down, as in rasters.

    Two aggregations, so a panel has no more rows than pixels, whatever it shows. Points with a null, infinite or NaN coordinate, or without a panel, aren't drawn; an axis without extent is drawn in the middle.
    """
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.select(F.col(panel).alias("panel"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.coalesce(flag, F.lit(False)).alias("f"))
    rows = rows.where(F.col("panel").isNotNull() & fine(F.col("x")) & fine(F.col("y")))
    ends = rows.groupBy("panel").agg(*[f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))])

    def at(c: str, size: int) -> Column:
        place = F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * size)
        return F.when(F.col(f"{c}0") == F.col(f"{c}1"), F.lit(size // 2)).otherwise(F.least(place, F.lit(size - 1))).cast("int")

    both = rows.join(ends, "panel").select("panel", at("x", wide).alias("px"), at("y", tall).alias("py"), "f")
    return both.groupBy("panel", "px", "py").agg(F.count("*").alias("n"), F.count_if("f").alias("flagged"))


def scatters(bins: DataFrame, wide: int = WIDE, tall: int = TALL) -> DataFrame:
    """(panel, content): a PNG file of each panel of pixel bins; the more points, the darker, and pixels with a flagged point in red. A task holds one panel's pixels."""

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        a = np.empty((tall, wide, 3), np.uint8)
        a[:] = PAPER
        depth = np.log1p(part["n"].to_numpy()) / np.log1p(part["n"].max())
        shade = (0.35 + 0.65 * depth)[:, None]
        a[part["py"], part["px"]] = np.round((1 - shade) * np.array(PAPER) + shade * np.array(INK))
        on = part["flagged"].to_numpy() > 0
        a[part["py"][on], part["px"][on]] = MARK
        return pd.DataFrame({"panel": [part["panel"].iloc[0]], "content": [png.encoded(a)]})

    kind = bins.schema["panel"].dataType.simpleString()
    return bins.groupBy("panel").applyInPandas(draw, f"panel {kind}, content binary")


def box_plots(summary: DataFrame, panel: str, group: str, tall: int = TALL) -> DataFrame:
    """(panel, content): a PNG file of each panel with a box for every group, in their order: q1, median, q3, and whiskers to low and high.

    summary has a row for each panel and group (see profile.five_numbers); more than BOXES groups in one figure are an error, as nobody could read it.
    """

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > BOXES:
            raise ValueError(f"{len(part)} boxes in one figure; {BOXES} at most")
        part = part.sort_values("group")
        a = np.empty((tall, STEP * len(part), 3), np.uint8)
        a[:] = PAPER
        low, high = part["low"].min(), part["high"].max()
        level = lambda v: tall // 2 if high == low else min(tall - 1, int((high - v) / (high - low) * tall))
        for k, row in enumerate(part.itertuples()):
            left, right, mid = STEP * k + 4, STEP * k + STEP - 4, STEP * k + STEP // 2
            top, upper, centre, lower, bottom = (level(getattr(row, c)) for c in ("high", "q3", "median", "q1", "low"))
            a[top : bottom + 1, mid] = LINE
            a[upper : lower + 1, left:right] = PAPER
            a[[upper, lower], left:right] = LINE
            a[upper : lower + 1, [left, right - 1]] = LINE
            a[[top, bottom], mid - 3 : mid + 4] = LINE
            a[centre, left:right] = MARK
        return pd.DataFrame({"panel": [part["panel"].iloc[0]], "content": [png.encoded(a)]})

    rows = summary.where(F.col("median").isNotNull()).select(F.col(panel).alias("panel"), F.col(group).alias("group"), *[F.col(c).cast("double").alias(c) for c in ("low", "q1", "median", "q3", "high")])
    return rows.groupBy("panel").applyInPandas(draw, f"panel {rows.schema['panel'].dataType.simpleString()}, content binary")


def sheets(images: DataFrame, boxes: DataFrame, places: DataFrame, rows: int = 1, columns: int = 5, gap: int = 4, alpha: float = 1.0) -> DataFrame:
    """(panel, content): PNG files with rows x columns images each, in the order of places, every box of an image outlined in it.

    images: id, height, width, data; boxes: id, x, y, width, height; places: id, place (from 0), a sample. A task draws the outlines of one image at a time and joins the few of one sheet.
    Boxes with null corners and images without a place aren't drawn; a place without its image stays empty.
    """
    known = boxes.where("x is not null and y is not null").groupBy("id").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("boxes"))
    each = rows * columns
    chosen = images.join(places, "id").join(known, "id", "left")
    cells = chosen.select(F.floor(F.col("place") / each).cast("int").alias("panel"), (F.col("place") % each).cast("int").alias("cell"), "height", "width", "data", "boxes")

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        tall, wide = int(part["height"].max()), int(part["width"].max())
        a = np.zeros((rows * tall + (rows - 1) * gap, columns * wide + (columns - 1) * gap, 3), np.uint8)
        for r in part.itertuples():
            pixels = masks.gray(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1))
            found = [(int(b["x"]), int(b["y"]), int(b["width"]), int(b["height"])) for b in r.boxes] if r.boxes is not None else []
            y, x = r.cell // columns * (tall + gap), r.cell % columns * (wide + gap)
            a[y : y + r.height, x : x + r.width] = masks.outlined(pixels, found, alpha, (255, 255, 0))
        return pd.DataFrame({"panel": [int(part["panel"].iloc[0])], "content": [png.encoded(a)]})

    return cells.groupBy("panel").applyInPandas(draw, "panel int, content binary")


def files(figures: DataFrame, path: str) -> DataFrame:
    """(panel, path, bytes) of the files <path>/<panel>.png, once written.

    Each task writes its panels under another name and moves them, so a task that is run again leaves whole files only. Letters, digits, dots and hyphens of a panel's name stay; others are written as their code.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = located(path)
        store.create_dir(folder, recursive=True)
        for b in batches:
            out = []
            for panel, content in zip(b["panel"], b["content"]):
                name = re.sub(r"[^\w.-]|_", lambda m: f"_{ord(m[0]):x}_", str(panel))
                made = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
                with store.open_output_stream(made) as f:
                    f.write(content)
                store.move(made, f"{folder}/{name}.png")
                out.append((panel, f"{path}/{name}.png", len(content)))
            yield pd.DataFrame(out, columns=["panel", "path", "bytes"])

    kind = figures.schema["panel"].dataType.simpleString()
    return cut(figures.mapInPandas(write, f"panel {kind}, path string, bytes long"))
