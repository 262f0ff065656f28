"""Detections, pixel regions and depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import geometry as G
from trailmark.functions import text as X
from trailmark.functions.numbers import stable_round
from trailmark.operators import regions as R
from trailmark.plans import bindings as B
from trailmark.plans.registry import query

_IN = "p.image_id = r.image_id AND p.x >= r.x1 AND p.x < r.x2 AND p.y >= r.y1 AND p.y < r.y2"
_LUM = "(r * 0.299 + g * 0.587 + b * 0.114)"
B.cte("inside", f"""
SELECT r.image_id, r.region_id, p.depth, p.r * 0.299 + p.g * 0.587 + p.b * 0.114 AS lum,
  CASE WHEN greatest(p.r, p.g, p.b) > 0 THEN (greatest(p.r, p.g, p.b) - least(p.r, p.g, p.b)) / greatest(p.r, p.g, p.b) ELSE 0 END AS sat
FROM pixels p JOIN regions r ON {_IN}""", ("pixels", "regions"))


@query("pixels_in_regions", B.sql("inside", body="SELECT image_id, region_id, count(*) AS n_pixels, round(round(sum(depth), 10) + 1e-12, 4) + 0.0 AS depth FROM inside GROUP BY 1, 2"))
def pixels_in_regions(spark, d):
    p = R.pixels_in_regions(B.pixels(spark, d), B.regions(spark, d), cell=4)
    return p.groupBy("image_id", "region_id").agg(
        F.count(F.lit(1)).alias("n_pixels"), stable_round(F.sum("depth"), 4).alias("depth")
    )


@query("region_properties", B.sql("inside", body="""
SELECT image_id, region_id, count(*) AS n_pixels, round(round(avg(lum) / 255, 10) + 1e-12, 4) AS brightness, round(round(stddev_pop(lum) / 255, 10) + 1e-12, 4) AS contrast,
  round(round(avg(sat), 10) + 1e-12, 4) AS saturation FROM inside GROUP BY 1, 2"""))
def region_properties(spark, d):
    return R.region_properties(B.pixels(spark, d), B.regions(spark, d), cell=4)


@query("image_properties", B.sql("pixels", body=f"""
SELECT image_id, count(*) AS n_pixels, round(round(avg({_LUM}) / 255, 10) + 1e-12, 4) AS brightness, round(round(stddev_pop({_LUM}) / 255, 10) + 1e-12, 4) AS contrast,
  round(round(avg(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END), 10) + 1e-12, 4) AS saturation
FROM pixels GROUP BY 1"""))
def image_properties(spark, d):
    return R.image_properties(B.pixels(spark, d))


B.cte("depths", """
SELECT i.image_id, i.region_id, round(round(t.top - avg(depth), 10) + 1e-12, 4) AS mean_depth, round(round(t.top - max(depth), 10) + 1e-12, 4) AS min_depth, round(round(t.top - min(depth), 10) + 1e-12, 4) AS max_depth
FROM inside i JOIN (SELECT image_id, max(depth) AS top FROM pixels GROUP BY 1) t ON i.image_id = t.image_id GROUP BY i.image_id, i.region_id, t.top""", ("inside",))


@query("region_depth", B.sql("depths", body="SELECT * FROM depths"))
def region_depth(spark, d):
    return R.region_depth(B.pixels(spark, d), B.regions(spark, d), cell=4)


B.cte("found_regions", """
SELECT user_id AS image_id, event_type AS object, event_id AS region_id, value AS score FROM events""")


@query("object_depth", B.sql("depths", "found_regions", body="""
SELECT q.image_id, q.object, q.mode, CASE q.mode WHEN 'min' THEN d.min_depth WHEN 'max' THEN d.max_depth ELSE d.mean_depth END AS estimated_depth,
  CASE WHEN b.region_id IS NULL THEN 'Object not found' END AS error
FROM (SELECT DISTINCT user_id AS image_id, o.object, o.mode FROM events, (VALUES ('click', 'min'), ('view', 'max'), ('error', 'median'), ('car', 'mean')) o(object, mode)) q
LEFT JOIN (SELECT image_id, object, arg_max(region_id, struct_pack(s := score, p := -region_id)) AS region_id FROM found_regions GROUP BY 1, 2) b
  ON q.image_id = b.image_id AND q.object = b.object
LEFT JOIN depths d ON b.image_id = d.image_id AND b.region_id = d.region_id"""))
def object_depth(spark, d):
    e = B.table(spark, d, "events").select(
        F.col("user_id").alias("image_id"), F.col("event_type").alias("object"), F.col("event_id").alias("region_id"),
        F.col("value").alias("score"), F.col("event_id").alias("det_pos"),
    )
    found = e.join(B.regions(spark, d), ["image_id", "region_id"]).drop("region_id")
    wanted = F.array(*[
        F.struct(F.lit(o).alias("object"), F.lit(m).alias("mode"))
        for o, m in (("click", "min"), ("view", "max"), ("error", "median"), ("car", "mean"))
    ])
    asked = e.select("image_id").distinct().select("image_id", F.explode(wanted).alias("w")).select("image_id", "w.*")
    return R.object_depth(asked, found, B.pixels(spark, d), cell=4)


@query("label_detections", B.sql("detections", body="""
SELECT image_id, det_pos, object || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, object ORDER BY det_pos) AS rn FROM detections)"""))
def label_detections(spark, d):
    return R.label_detections(B.detections(spark, d)).select("image_id", "det_pos", "label")


@query("label_faces", B.sql("detections", body="""
SELECT image_id, det_pos, 'face' || CASE WHEN rn > 1 THEN ' ' || rn ELSE '' END AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_pos) AS rn FROM detections)"""))
def label_faces(spark, d):
    return R.label_faces(B.detections(spark, d)).select("image_id", "det_pos", "label")


@query("best_region", B.sql("detections", body="""
SELECT image_id, object, arg_max(det_pos, struct_pack(s := score, p := -det_pos)) AS det_pos, max(score) AS score FROM detections GROUP BY 1, 2"""))
def best_region(spark, d):
    return R.best_region(B.detections(spark, d)).select("image_id", "object", "det_pos", "score")


def _sized(spark, d):
    """Line items as pixel boxes on a 640 x 480 image."""
    li = B.table(spark, d, "lineitem")
    q, p = F.col("l_quantity"), F.col("l_partkey").cast("double")
    return li.select(
        F.col("l_orderkey"), B.det_pos().alias("det_pos"),
        F.struct(q.alias("x1"), (q * 2).alias("y1"), (q + p % 600 + 1).alias("x2"), (q * 2 + p % 300 + 1).alias("y2")).alias("box"),
        F.lit(640).alias("w"), F.lit(480).alias("h"),
    )


_BOXES = """(SELECT l_orderkey, (l_linenumber::BIGINT * 1000000 + l_partkey) * 100000000 + round(l_extendedprice * 100)::BIGINT % 100000000 AS det_pos,
  l_quantity AS x1, l_quantity * 2 AS y1, l_quantity + l_partkey % 600 + 1 AS x2, l_quantity * 2 + l_partkey % 300 + 1 AS y2 FROM lineitem)"""


def _flat(df, name="b"):
    return df.select("l_orderkey", "det_pos", *[F.col(name)[c].alias(c) for c in G.CORNERS])


@query("normalize_box", f"""
SELECT l_orderkey, det_pos, round(x1 / 640, 4) AS x1, round(y1 / 480, 4) AS y1, round(x2 / 640, 4) AS x2, round(y2 / 480, 4) AS y2 FROM {_BOXES}""")
def normalize_box(spark, d):
    return _flat(_sized(spark, d).withColumn("b", G.normalize_box("box", "w", "h")))


@query("pixel_box", B.sql("detections", body="""
SELECT image_id AS l_orderkey, det_pos, trunc(x1 * 640)::BIGINT AS x1, trunc(y1 * 480)::BIGINT AS y1, trunc(x2 * 640)::BIGINT AS x2, trunc(y2 * 480)::BIGINT AS y2 FROM detections"""))
def pixel_box(spark, d):
    p = B.detections(spark, d).withColumn("b", G.pixel_box("box", F.lit(640), F.lit(480)))
    return _flat(p.withColumnRenamed("image_id", "l_orderkey"))


def _grown(lo: str, hi: str, limit: int, grown: str) -> str:
    mid = f"({lo} + ({hi} - {lo}) / 2)"
    return f"trunc(greatest(0, {mid} - ({grown}) / 2))::BIGINT AS {lo}, trunc(least({limit}, {mid} + ({grown}) / 2))::BIGINT AS {hi}"


@query("expand_box", f"""
SELECT l_orderkey, det_pos, 'ratio' AS kind, {_grown('x1', 'x2', 640, '(x2 - x1) * 1.5')}, {_grown('y1', 'y2', 480, '(y2 - y1) * 1.5')} FROM {_BOXES}
UNION ALL SELECT l_orderkey, det_pos, 'pixels', {_grown('x1', 'x2', 640, '(x2 - x1) + 20')}, {_grown('y1', 'y2', 480, '(y2 - y1) + 20')} FROM {_BOXES}""")
def expand_box(spark, d):
    s = _sized(spark, d)
    parts = [
        _flat(s.withColumn("b", G.expand_box("box", "w", "h", m))).withColumn("kind", F.lit(k))
        for k, m in (("ratio", 0.5), ("pixels", 20.0))
    ]
    return parts[0].unionByName(parts[1])


@query("enlarge_box", f"""
SELECT l_orderkey, det_pos, greatest(0, x1 - dx) AS x1, greatest(0, y1 - dy) AS y1, least(640, x2 + dx) AS x2, least(480, y2 + dy) AS y2 FROM (
  SELECT l_orderkey, det_pos, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2,
    trunc(0.5 * (x2 - x1) / 2)::BIGINT AS dx, trunc(0.5 * (y2 - y1) / 2)::BIGINT AS dy FROM {_BOXES})""")
def enlarge_box(spark, d):
    whole = F.struct(*[F.col("box")[c].cast("int").alias(c) for c in G.CORNERS])
    return _flat(_sized(spark, d).withColumn("box", whole).withColumn("b", G.enlarge_box("box", "w", "h")))


@query("format_regions", B.sql("detections", body="""
SELECT image_id, det_pos, object || ' at [' || box || ']' AS text FROM (
  SELECT image_id, det_pos, object, (score * 50)::BIGINT || ', ' || (x1 * 1000)::BIGINT AS box FROM detections)"""))
def format_regions(spark, d):
    box = F.array(F.round(F.col("score") * 50).cast("long"), F.round(F.col("box.x1") * 1000).cast("long"))
    one = F.array(F.struct(F.col("object").alias("label"), box.alias("bbox")))
    return B.detections(spark, d).select("image_id", "det_pos", X.format_regions(one).alias("text"))
