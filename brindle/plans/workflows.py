"""Image workflows: locating crops, verifying duplicates, whole-body boxes. Rasters are (height, width, data) rows and stay on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import dedup, enrich, forest, geometry, profile, quantile
from brindle.plans import figures
from brindle.raster import mask as masks
from brindle.raster import metrics, ncc, shape
from brindle.sources.stores import cut

FOUND = (
    "component string, id int, x int, y int, width int, height int, match_score double, peak_margin double, near_exact_fraction double, mae double, "
    "rmse double, ssim double, pearson_corr double, hist_intersection double, status string, banded boolean"
)
#: The same measures over the mask's pixels alone.
MASKED = [f"{k}_masked_eval" for k in metrics.NAMES]
SCORED = FOUND + "".join(f", {k} double" for k in MASKED)
BODY = "x int, y int, width int, height int, coverage double, fallback boolean, largest_cc_aspect_ratio double"
BODY_FEATURES = ["coverage", "aspect_ratio", "center_x_offset", "top_margin_frac", "bottom_margin_frac", "width_frac", "height_frac"]


def raster(row) -> np.ndarray:
    """A row's pixels as a gray array."""
    data = np.frombuffer(row.data, np.uint8)
    n = len(data) // (row.height * row.width)
    return masks.gray(data.reshape(row.height, row.width, n))


def _scored(field: ncc.Field, crop: np.ndarray, mask: np.ndarray | None, component: str, id_: int, top: int = 0, bottom: int | None = None, banded: bool = False, seen: dict | None = None) -> dict:
    """seen: the crop's measures over all pixels by place, for a crop that is scored several times."""
    m = ncc.locate(field, crop, mask, top, bottom)
    window = field.image[m["y"] : m["y"] + m["height"], m["x"] : m["x"] + m["width"]]
    ok = m["status"] == "ok"
    seen = {} if seen is None else seen
    if ok and (m["x"], m["y"]) not in seen:
        seen[m["x"], m["y"]] = metrics.compare(crop, window)
    values = seen[m["x"], m["y"]] if ok else dict.fromkeys(metrics.NAMES)
    # without a mask there is nothing to compare under it
    masked = metrics.compare(crop, window, mask) if ok and mask is not None else dict.fromkeys(metrics.NAMES)
    return {"component": component, "id": id_, **m, **values, **dict(zip(MASKED, (masked[k] for k in metrics.NAMES))), "banded": banded}


def _by_image(crops: DataFrame, whole: DataFrame, schema: str, work: Callable[[ncc.Field, list], list[dict]]) -> DataFrame:
    """work(field, its crops' rows) for each whole image (view, id) that has crops.

    Crops and images are dealt by (view, id) into one sorted stream, so a task holds one image and its crops at a time, has no overhead for each
    image, and decodes and transforms an image once for all its crops. Two whole images for one (view, id) are an error, as either could be meant.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    integers = {x.split()[0]: "Int32" for x in schema.split(", ") if x.split()[1] == "int"}

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, image, rows, out = None, None, [], []

        def flush() -> None:
            if image is not None and rows:
                out.extend(work(ncc.Field(raster(image)), rows))

        def made() -> pd.DataFrame:
            return pd.DataFrame(out, columns=names).astype(integers)

        for b in batches:
            for row in b.itertuples():
                if (row.view, row.id) != key:
                    flush()
                    key, image, rows = (row.view, row.id), None, []
                if not row.crop:
                    if image is not None:
                        raise ValueError(f"several whole images for {key}")
                    image = row
                elif image is not None:
                    rows.append(row)
            if out:
                yield made()
                out = []
        flush()
        if out:
            yield made()

    images = whole.select("view", "id", "height", "width", "data", F.lit(False).alias("crop"))
    both = crops.withColumn("crop", F.lit(True)).unionByName(images, allowMissingColumns=True)
    # by number: kernels cost far more than their bytes say, so small partitions mustn't be merged
    parts = int(crops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "view", "id").sortWithinPartitions("view", "id", "crop").mapInPandas(stream, schema)


def located(
    crops: DataFrame, whole: DataFrame, anchor: str = "vertbra", anchored: tuple[str, ...] = ("shoL", "shoR"), threshold: float = 2, percentile: float | None = None,
    above: int = 100, below: int = 250, use_mask: bool = True, between: tuple[str, str] | None = None,
) -> DataFrame:
    """A box for each crop (component, part, view, id, height, width, data) in its whole image (view, id, height, width, data).

    Crops of the anchored parts are
    searched in a band of rows around the anchor part's box where the band is as high as the crop, else in the whole image. With `between`, two parts, the
    band goes from the bottom of the first one's box to the top of the second one's instead. Metrics are over all pixels, those with _masked_eval over the mask's. Crops without a whole image give no
    row; where nothing can be scored (blank crop or image, or a crop larger than the image) the status says so and metrics are null.
    """

    def work(field: ncc.Field, crops: list) -> list[dict]:
        out, tall = [], field.image.shape[0]
        anchors = between or (anchor,)
        band, ends = None, {}
        for row in sorted(crops, key=lambda row: row.part not in anchors):
            crop = raster(row)
            if crop.shape[0] > tall or crop.shape[1] > field.image.shape[1]:
                out.append({"component": row.component, "id": row.id, "width": crop.shape[1], "height": crop.shape[0], "status": "too large", "banded": False})
                continue
            mask = None
            if use_mask:
                mask = masks.background(crop, threshold) if percentile is None else masks.percentile(crop, percentile)
            in_band = row.part in anchored and band is not None and band[1] - band[0] >= crop.shape[0]
            found = _scored(field, crop, mask, row.component, row.id, *(band if in_band else (0, None)), banded=in_band)
            out.append(found)
            if row.part in anchors and found["status"] == "ok":
                ends[row.part] = (found["y"], found["y"] + found["height"])
                if not between:
                    band = (max(0, found["y"] - above), min(tall, found["y"] + below))
                elif len(ends) == 2:
                    band = (ends[between[0]][1], ends[between[1]][0])
        return out

    return _by_image(crops, whole, SCORED, work)


def swept(crops: DataFrame, whole: DataFrame, thresholds: tuple[float, ...] = (2, 10, 20, 30, 50), percentiles: tuple[float, ...] = ()) -> DataFrame:
    """Boxes for every mask setting, a row a crop and setting; images are decoded and transformed once for all settings.

    Metrics are over all pixels, those with _masked_eval over the mask's.
    """

    def work(field: ncc.Field, crops: list) -> list[dict]:
        out = []
        for row in crops:
            crop, seen = raster(row), {}
            for setting, values, make in (("threshold", thresholds, masks.background), ("percentile", percentiles, masks.percentile)):
                for v in values:
                    mask = make(crop, v)
                    out.append({"setting": setting, "value": float(v), "background_fraction": 1 - masks.coverage(mask), **_scored(field, crop, mask, row.component, row.id, seen=seen)})
        return out

    return _by_image(crops, whole, "setting string, value double, background_fraction double, " + SCORED, work)


def turned(crops: DataFrame, whole: DataFrame, angles: tuple[float, ...] = (-15, -10, -5, 0, 5, 10, 15), scales: tuple[float, ...] = (0.9, 0.95, 1.0, 1.05, 1.1)) -> DataFrame:
    """The best of all rotations and scales of each crop, the first of equal ones, with its angle and scale."""

    def work(field: ncc.Field, crops: list) -> list[dict]:
        out = []
        for row in crops:
            crop = raster(row)
            base = masks.background(crop).astype(np.uint8)
            best = None
            for angle in angles:
                for scale in scales:
                    img, mask = shape.warped(crop, angle, scale), shape.warped(base, angle, scale, nearest=True) > 0
                    if mask.any():
                        m = ncc.locate(field, img, mask)
                        if best is None or m["match_score"] > best[0]["match_score"]:
                            best = (m, angle, scale, img, mask)
            if best:
                m, angle, scale, img, mask = best
                window = field.image[m["y"] : m["y"] + m["height"], m["x"] : m["x"] + m["width"]]
                out.append({"angle": angle, "scale": scale, "component": row.component, "id": row.id, **m, **metrics.compare(img, window, mask), "banded": False})
        return out

    return _by_image(crops, whole, "angle double, scale double, " + FOUND, work)


def _each(df: DataFrame, schema: str, keep: list[str], f) -> DataFrame:
    """f(array) gives dicts for each raster; the named columns go along."""
    kinds = {x.name: x.dataType.simpleString() for x in df.schema}
    full = ", ".join([*[f"{k} {kinds[k]}" for k in keep], schema])
    names = [*keep, *[x.split()[0] for x in schema.split(", ")]]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{**{k: getattr(row, k) for k in keep}, **out} for row in b.itertuples() for out in f(raster(row))]
            yield pd.DataFrame(rows, columns=names)

    return df.select(*keep, *[c for c in ("height", "width", "data") if c not in keep]).mapInPandas(work, full)


def hashed(images: DataFrame, keep: list[str]) -> DataFrame:
    """Adds phash, the perceptual hash's bits as a long."""

    def one(img: np.ndarray) -> list[dict]:
        h = shape.perceptual_hash(img)
        return [{"phash": h - (1 << 64) if h >= 1 << 63 else h}]

    return _each(images, "phash long", keep, one)


def pixel_stats(images: DataFrame, keep: list[str]) -> DataFrame:
    def one(a: np.ndarray) -> list[dict]:
        return [{"area": a.size, "pixel_min": int(a.min()), "pixel_max": int(a.max()), "pixel_mean": float(a.mean()), "pixel_median": float(np.median(a)), "pixel_std": float(a.std())}]

    return _each(images, "area long, pixel_min int, pixel_max int, pixel_mean double, pixel_median double, pixel_std double", keep, one)


def coloured(images: DataFrame, keep: list[str], paper: tuple[int, int, int], mark: tuple[int, int, int]) -> DataFrame:
    """(keep, px, py, marked): the pixels of colour images that aren't paper, and whether they have the mark's colour."""
    kinds = {x.name: x.dataType.simpleString() for x in images.schema}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, 3)
                py, px = np.nonzero((a != paper).any(2))
                yield pd.DataFrame({**{k: getattr(row, k) for k in keep}, "px": px, "py": py, "marked": (a[py, px] == mark).all(1)})

    return images.select(*keep, "height", "width", "data").mapInPandas(work, ", ".join([*[f"{k} {kinds[k]}" for k in keep], "px int, py int, marked boolean"]))


def centroids(images: DataFrame, keep: list[str], threshold: float = 2) -> DataFrame:
    """Centre of mass of what is above the threshold; images without any give no row."""

    def one(a: np.ndarray) -> list[dict]:
        c = masks.centroid(masks.background(a, threshold))
        return [{"centroid_x": c[0], "centroid_y": c[1]}] if c else []

    return _each(images, "centroid_x double, centroid_y double", keep, one)


def cleaned_boxes(images: DataFrame, keep: list[str], min_areas: tuple[int, ...] = (), kernels: tuple[int, ...] = (), distances: tuple[float, ...] = ()) -> DataFrame:
    """Boxes of the mask after each clean-up: component area at least, closing by a square, distance from the main component at most.

    Masks, components and distances are made once an image; blank results give no row.
    """

    def one(a: np.ndarray) -> list[dict]:
        mask = masks.background(a)
        labels = shape.components(mask)
        main = shape.largest(labels)
        far = shape.distance_to(labels == main) if main and distances else None
        made = [("area", v, shape.at_least(labels, v)) for v in min_areas] + [("closing", v, shape.closed(mask, v)) for v in kernels]
        made += [("distance", v, shape.near_main(labels, v, far)) for v in distances] if main else []
        out = []
        for step, v, m in made:
            box = masks.bounds(m)
            if box:
                out.append({"step": step, "value": float(v), "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "kept": masks.coverage(m), "width_frac": (box[2] - box[0]) / a.shape[1]})
        return out

    return _each(images, "step string, value double, x0 int, y0 int, x1 int, y1 int, kept double, width_frac double", keep, one)


def containment(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """(step, value, n, n_contains, median_kept, median_width_frac): how often cleaned boxes hold the union (id, rx0, ry0, rx1, ry1) of an image's regions."""
    inside = geometry.contains(tuple(map(F.col, ("x0", "y0", "x1", "y1"))), tuple(map(F.col, ("rx0", "ry0", "rx1", "ry1"))))
    both = boxes.join(regions, "id")
    middle = quantile.medians(both, ["step", "value"], {"median_kept": F.col("kept"), "median_width_frac": F.col("width_frac")})
    return both.groupBy("step", "value").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_contains")).join(middle, ["step", "value"], "left")


def near_duplicates(left: DataFrame, right: DataFrame, block: str, most: int = 4) -> DataFrame:
    """Pairs of hashed images of a block at a Hamming distance of `most` at most."""
    return dedup.banded_hamming_join(left, right, block, "phash", most)


def verified(flags: DataFrame, boxes: DataFrame, crops: DataFrame, whole: DataFrame) -> DataFrame:
    """flags (component, id, split, image_id, hamming_distance) with the IoU of the flagged crop's own location against the recorded box.

    crops: (split, image_id, height, width, data). Flags without a box, payload or lit pixel give no row.
    """
    view = F.when(F.col("component").endswith("ANT"), "ANT").otherwise("POST")
    known = boxes.select("component", "id", *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "width", "height")])
    rows = flags.join(known, ["component", "id"]).join(crops, ["split", "image_id"]).withColumn("view", view)
    names = "component string, id int, split string, image_id int, hamming_distance int, b_x int, b_y int, b_width int, b_height int, x int, y int, width int, height int, match_score double, peak_margin double"

    def work(field: ncc.Field, crops: list) -> list[dict]:
        out = []
        for row in crops:
            crop = raster(row)
            mask = masks.background(crop)
            if mask.any() and crop.shape[0] <= field.image.shape[0] and crop.shape[1] <= field.image.shape[1]:
                m = ncc.locate(field, crop, mask)
                out.append({**{k.split()[0]: getattr(row, k.split()[0]) for k in names.split(", ")[:9]}, **m})
        return out

    found = _by_image(rows, whole, names, work)
    a, b = geometry.box(), geometry.box("b_")
    dx, dy = geometry.displacement(a, b)
    return found.withColumns({"iou": geometry.iou(a, b), "dx": dx, "dy": dy}).drop("b_x", "b_y", "b_width", "b_height")


def cross_collection(own: DataFrame, other: DataFrame, boxes: DataFrame, whole: DataFrame, most: int = 4) -> DataFrame:
    """Pairs of crops of two collections whose perceptual hashes differ by `most` bits at most, verified by where the second one lies in the first one's whole image.

    own: component, id, region, height, width, data. other: split, image_id, region, height, width, data, as decoded() gives it; rows without pixels take no part.
    boxes: component, id, x, y, width, height. whole: view, id, height, width, data. Only hashes are joined; pixels of the second collection move once, for the pairs they are in.
    """
    ours = hashed(own.where("data is not null"), ["component", "id", "region"])
    theirs = hashed(other.where("data is not null"), ["split", "image_id", "region"])
    pairs = near_duplicates(ours, theirs, "region", most)
    flags = pairs.select(*[F.col(f"l_{c}").alias(c) for c in ("component", "id")], *[F.col(f"r_{c}").alias(c) for c in ("split", "image_id")], F.col("distance").cast("int").alias("hamming_distance"))
    return verified(flags, boxes, other.where("data is not null").select("split", "image_id", "height", "width", "data"), whole)


def box_table(crops: DataFrame, whole: DataFrame, labels: DataFrame, matches: DataFrame, names: dict[int, str], least_iou: float = 0.5, content: str = "data", **how) -> tuple[DataFrame, DataFrame]:
    """(table, summary): every located box with its label, notes of duplicates and of verified matches, and the means of each component.

    labels: component, id, label. matches: as verified() or cross_collection() gives them; those with a lower overlap give no note. names: what labels are called. how: as for located().
    The table has the rows of located(), none more or less: a component and id has one label, one partner and one note at most.
    """
    found = located(crops, whole, **how)
    out = enrich.lookup_join(found, labels, ["component", "id"], ["label"]).withColumn("diagnosis", enrich.code_names(F.col("label"), names))
    partners = dedup.pair_notes(crops, content, "id", "component").withColumnsRenamed({"other_item": "duplicate_of_id", "other_part": "duplicate_of_component"})
    out = enrich.lookup_join(out, partners, ["component", "id"], ["duplicate_of_id", "duplicate_of_component"])
    notes = dedup.match_notes(matches.where(F.col("iou") >= least_iou), ["component", "id"], "split", "image_id", "hamming_distance", "iou").withColumnRenamed("note", "matches")
    out = cut(out.join(notes, ["component", "id"], "left"))  # the located boxes, which cost most, are made once
    measures = ["match_score", "peak_margin", *metrics.NAMES]
    return out, profile.grouped_means(out, "component", measures, scrub=True, suffix="_mean")


def preview_sheets(crops: DataFrame, whole: DataFrame, n: int = 5, seed: int = 0, rows: int = 1, columns: int = 5, **how) -> DataFrame:
    """(panel, content): sheets with the whole images of a seeded sample of n ids, the located box of each of their crops outlined. how: as for located()."""
    spark = whole.sparkSession
    places = spark.createDataFrame(list(enumerate(profile.sampled_ids(crops, "id", n, seed))), "place int, id long")
    ids = F.broadcast(places.select("id"))
    found = located(crops.join(ids, "id", "left_semi"), whole.join(ids, "id", "left_semi"), **how)
    return figures.sheets(whole, found, F.broadcast(places), rows, columns)


def whole_bodies(images: DataFrame, extra: DataFrame, region_ids: DataFrame, pad: int = 5, threshold: float = 2, contamination: float = 0.05) -> DataFrame:
    """(id, view, source, box, features, flags) for all images and those of extra whose (view, id) isn't among them; one forest a view over both.

    images and extra: view, id, source, height, width, data. region_ids: (id, source) that have region crops.
    """
    more = extra.where(F.col("id").isNotNull()).join(images.select("view", "id"), ["view", "id"], "left_anti")
    both = images.unionByName(more).withColumns({"columns": F.col("width"), "rows": F.col("height")})
    boxes = _each(both, BODY, ["id", "view", "source", "columns", "rows"], lambda a: [shape.body_box(a, pad, threshold)])
    x, y, canvas = F.col("x"), F.col("y"), (F.col("columns"), F.col("rows"))
    rows = boxes.withColumns(geometry.features(x, y, x + F.col("width"), y + F.col("height"), *canvas)).drop("columns", "rows")
    scored = forest.anomalies(cut(rows), "view", BODY_FEATURES, contamination)  # rasters are measured once
    own = scored.withColumn("_k", F.concat_ws(":", "source", "id"))
    known = region_ids.select(F.concat_ws(":", "source", "id").alias("_k"))
    out = enrich.exists_flag(own, known, "_k", "has_region_crops").drop("_k")
    return out.withColumn("likely_corrupt_image", forest.likely_corrupt())
