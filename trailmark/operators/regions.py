"""Detections, pixel regions and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.numbers import stable_round
from trailmark.operators.skew import TARGET_ROWS, row_number, running

CELL = 64  # side of a grid cell in pixels


def label_detections(
    detections: DataFrame, position: str = "det_pos", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """``name``, ``name-2``, ``name-3`` per image and object, in detection order."""
    out = running(
        detections, ["image_id", "object"], {"pos": F.col(position)}, {"_rn": row_number()}, target_rows=target_rows
    )
    suffix = F.when(F.col("_rn") > 1, F.concat(F.lit("-"), F.col("_rn").cast("string"))).otherwise("")
    return out.withColumn("label", F.concat("object", suffix)).drop("_rn")


def label_faces(faces: DataFrame, position: str = "det_pos", target_rows: int = TARGET_ROWS) -> DataFrame:
    """``face``, ``face 2``, .. per image."""
    out = running(faces, ["image_id"], {"pos": F.col(position)}, {"_rn": row_number()}, target_rows=target_rows)
    suffix = F.when(F.col("_rn") > 1, F.concat(F.lit(" "), F.col("_rn").cast("string"))).otherwise("")
    return out.withColumn("label", F.concat(F.lit("face"), suffix)).drop("_rn")


def best_region(detections: DataFrame, keys: tuple[str, ...] = ("image_id", "object")) -> DataFrame:
    """Region with the highest score per object; the first one on a tie."""
    rest = [c for c in detections.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col("score"), -F.col("det_pos")))
    return detections.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def pixels_in_regions(pixels: DataFrame, regions: DataFrame, cell: int = CELL) -> DataFrame:
    """Pixels of every region (half-open box of whole pixels) as a grid join.

    ``pixels`` has ``image_id, x, y``; ``regions`` has ``image_id, region_id`` and
    ``box``. Regions are listed under the grid cells they touch, so the join is
    an equi-join on (image, cell) and one huge image spreads over its cells.
    """
    b = F.col("box")
    cells = (
        regions.where((b["x1"] < b["x2"]) & (b["y1"] < b["y2"]))
        .select(
            "image_id", "region_id", "box",
            F.explode(F.sequence(F.floor(b["x1"] / cell), F.floor((b["x2"] - 1) / cell))).alias("_cx"),
        )
        .withColumn("_cy", F.explode(F.sequence(F.floor(b["y1"] / cell), F.floor((b["y2"] - 1) / cell))))
    )
    located = pixels.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    inside = (
        (F.col("x") >= F.col("box.x1")) & (F.col("x") < F.col("box.x2"))
        & (F.col("y") >= F.col("box.y1")) & (F.col("y") < F.col("box.y2"))
    )
    return located.join(cells, ["image_id", "_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def luminance() -> Column:
    """BT.601 luminance; the three weights are fixed values."""
    return F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114


def saturation() -> Column:
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return F.when(high > 0, (high - low) / high).otherwise(0.0)


def region_properties(
    pixels: DataFrame,
    regions: DataFrame,
    props: tuple[str, ...] = ("brightness", "contrast", "saturation"),
    cell: int = CELL,
) -> DataFrame:
    """Brightness, contrast and saturation per region, 4 decimals."""
    measures = {
        "brightness": stable_round(F.avg("_lum") / 255.0, 4),
        "contrast": stable_round(F.stddev_pop("_lum") / 255.0, 4),
        "saturation": stable_round(F.avg("_sat"), 4),
    }
    picked = (
        pixels_in_regions(pixels, regions, cell)
        .select("image_id", "region_id", luminance().alias("_lum"), saturation().alias("_sat"))
    )
    return picked.groupBy("image_id", "region_id").agg(
        F.count(F.lit(1)).alias("n_pixels"), *[measures[p].alias(p) for p in props]
    )


def image_properties(pixels: DataFrame) -> DataFrame:
    """The same measures over whole images."""
    lit = pixels.select("image_id", luminance().alias("_lum"), saturation().alias("_sat"))
    return lit.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_pixels"),
        stable_round(F.avg("_lum") / 255.0, 4).alias("brightness"),
        stable_round(F.stddev_pop("_lum") / 255.0, 4).alias("contrast"),
        stable_round(F.avg("_sat"), 4).alias("saturation"),
    )


def region_depth(depth: DataFrame, regions: DataFrame, cell: int = CELL) -> DataFrame:
    """Mean, min and max of the inverted depth per region.

    The map is inverted against its image's maximum. Because inversion is
    ``max - d``, only aggregates are inverted: the pixels are read once per side
    and no window runs over an image.
    """
    top = depth.groupBy("image_id").agg(F.max("depth").alias("_top"))
    per = pixels_in_regions(depth, regions, cell).groupBy("image_id", "region_id").agg(
        F.avg("depth").alias("_avg"), F.min("depth").alias("_min"), F.max("depth").alias("_max")
    )
    return per.join(top, "image_id").select(
        "image_id", "region_id",
        stable_round(F.col("_top") - F.col("_avg"), 4).alias("mean_depth"),
        stable_round(F.col("_top") - F.col("_max"), 4).alias("min_depth"),
        stable_round(F.col("_top") - F.col("_min"), 4).alias("max_depth"),
    )


def pick_depth(mode: Column | str) -> Column:
    """Depth of the wanted mode; an unknown mode means mean."""
    m = F.col(mode) if isinstance(mode, str) else mode
    return F.when(m == "min", F.col("min_depth")).when(m == "max", F.col("max_depth")).otherwise(F.col("mean_depth"))


def object_depth(
    requests: DataFrame, detections: DataFrame, depth: DataFrame, cell: int = CELL
) -> DataFrame:
    """Depth of the best region of an object; ``requests`` has ``image_id, object, mode``.

    ``detections`` carries whole-pixel boxes. An object without detection gives
    the error text.
    """
    best = best_region(detections).withColumn("region_id", F.col("object"))
    depths = region_depth(depth, best.select("image_id", "region_id", "box"), cell)
    found = best.select("image_id", "object", F.lit(True).alias("_found"))
    joined = requests.join(found, ["image_id", "object"], "left").join(
        depths.withColumnRenamed("region_id", "object"), ["image_id", "object"], "left"
    )
    return joined.select(
        *requests.columns,
        pick_depth("mode").alias("estimated_depth"),
        F.when(F.col("_found").isNull(), "Object not found").alias("error"),
    )
