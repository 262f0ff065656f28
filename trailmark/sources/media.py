"""Image columns, image files and media references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def image_bytes(df: DataFrame, column: str) -> Column:
    """Bytes of one image column: raw bytes, base64 text, or a struct with ``bytes``."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BinaryType):
        return F.col(column)
    if isinstance(kind, T.StructType):
        return F.col(column)["bytes"]
    return F.try_to_binary(F.regexp_replace(F.col(column), r"\s", ""), F.lit("base64"))


def decode_image_bytes(
    df: DataFrame, columns: list[str], path: str | None = None, files: DataFrame | None = None
) -> DataFrame:
    """Add ``image_bytes``: the first usable of the columns, then the file at ``path``.

    ``files`` has ``path, content`` (Spark's ``binaryFile``).
    """
    options = [F.nullif(image_bytes(df, c), F.lit(b"")) for c in columns]
    out = df.withColumn("image_bytes", F.coalesce(*options) if options else F.lit(None).cast("binary"))
    if path is None or files is None:
        return out
    named = files.select(F.regexp_replace("path", "^file:/*", "/").alias("_p"), F.col("content").alias("_c"))
    joined = out.join(named, F.col(path) == F.col("_p"), "left")
    return joined.withColumn("image_bytes", F.coalesce("image_bytes", "_c")).drop("_p", "_c")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths only; file contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length")


def media_files(files: DataFrame) -> DataFrame:
    """``task_id, ref_id, ext, path`` of files ``<task_id>/<ref_id>.<ext>``."""
    pattern = r"([^/]+)/([^/]+)\.([^./]+)$"
    return files.select(
        F.regexp_extract("path", pattern, 1).alias("task_id"), F.regexp_extract("path", pattern, 2).alias("ref_id"),
        F.regexp_extract("path", pattern, 3).alias("ext"), "path",
    )


def resolve_media(refs: DataFrame, files: DataFrame) -> DataFrame:
    """First file (by path) of every ``(task_id, ref_id)``; null without one."""
    found = media_files(files).groupBy("task_id", "ref_id").agg(F.min("path").alias("path"))
    return refs.join(found, ["task_id", "ref_id"], "left")


def input_image_paths(image_ids: Column | str, task_dir: Column | str) -> Column:
    """``<task_dir>/<id>.png`` for every input image."""
    ids = F.col(image_ids) if isinstance(image_ids, str) else image_ids
    folder = F.col(task_dir) if isinstance(task_dir, str) else task_dir
    return F.transform(ids, lambda i: F.concat(folder, F.lit("/"), i, F.lit(".png")))


EXTENSIONS = [".png", ".webp", ".jpg"]  # fixed values, in order of preference


def path_candidates(path: Column | str, base: str = "./images") -> Column:
    """Paths an image may be found at: itself, then other extensions or the base folder."""
    p = F.col(path) if isinstance(path, str) else path
    ext = F.regexp_extract(p, r"(\.[^./]*)$", 1)
    stem = F.regexp_replace(p, r"\.[^./]*$", "")
    others = F.transform(
        F.filter(F.array(*[F.lit(e) for e in EXTENSIONS]), lambda e: e != ext), lambda e: F.concat(stem, e)
    )
    in_base = F.array(F.concat(F.lit(base + "/"), stem))
    return F.concat(F.array(p), F.when(F.contains(p, F.lit("/")), others).otherwise(in_base))


def find_images(df: DataFrame, path: str, files: DataFrame, base: str = "./images") -> DataFrame:
    """Add ``found``: the first candidate path that exists in the listing."""
    tried = df.select(path).distinct().select(path, F.posexplode(path_candidates(path, base)).alias("_i", "_c"))
    existing = files.select(F.col("path").alias("_c")).distinct()
    best = tried.join(existing, "_c").groupBy(path).agg(F.min_by("_c", "_i").alias("found"))
    return df.join(best, path, "left")


def read_pixels(spark: SparkSession, pattern: str) -> DataFrame:
    """Pixel table ``image_id (path), width, height, x, y, r, g, b`` of image files.

    Spark stores pixels row by row as blue, green, red (and alpha) bytes.
    """
    img = spark.read.format("image").option("dropInvalid", True).load(pattern).select("image.*")
    rows = img.select("origin", "width", "height", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    at = (F.col("y") * F.col("width") + F.col("x")) * F.col("nChannels") + 1

    def channel(i: int) -> Column:
        offset = F.least(F.lit(i), F.col("nChannels") - 1)
        return F.conv(F.hex(F.substring("data", at + offset, F.lit(1))), 16, 10).cast("double")

    return cells.select(
        F.col("origin").alias("image_id"), "width", "height", "x", "y",
        channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"),
    )


def media_maps(media: DataFrame) -> DataFrame:
    """Per task: reference id to path and back, as maps (the media of one task).

    Use ``ids_to_paths`` on tables; this form is for traces that already hold
    their media in one row.
    """
    return media.withColumn(
        "id_to_path", F.map_from_entries(F.transform("media", lambda m: F.struct(m["ref_id"], m["path"])))
    ).withColumn(
        "path_to_id", F.map_from_entries(F.transform("media", lambda m: F.struct(m["path"], m["ref_id"])))
    )


def ids_to_paths(properties: DataFrame, refs: DataFrame) -> DataFrame:
    """Replace reference ids by paths in a long ``(task_id, name, value)`` table; others unchanged."""
    return _swap(properties, refs, "ref_id", "path")


def paths_to_ids(properties: DataFrame, refs: DataFrame) -> DataFrame:
    """Replace paths by reference ids."""
    return _swap(properties, refs, "path", "ref_id")


def _swap(properties: DataFrame, refs: DataFrame, source: str, target: str) -> DataFrame:
    table = refs.groupBy("task_id", F.col(source).alias("_from")).agg(F.min(target).alias("_to"))
    joined = properties.join(
        table.withColumnRenamed("task_id", "_task"),
        (F.col("task_id") == F.col("_task")) & (F.col("value") == F.col("_from")), "left",
    )
    return joined.withColumn("value", F.coalesce("_to", "value")).drop("_task", "_from", "_to")


_JSON_PARTS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?|[^"]+|"'  # a key with its colon, a text, or what lies between


def replace_in_json(text: Column, lookup: Column) -> Column:
    """Replace whole string values of nested JSON text through a lookup map, each once; keys stay."""

    def swapped(part: Column) -> Column:
        inner = F.substring(part, F.lit(2), F.length(part) - 2)
        decoded = F.get(F.from_json(F.concat(F.lit("["), part, F.lit("]")), "array<string>"), 0)
        found = F.try_element_at(lookup, F.when(F.contains(part, F.lit("\\")), decoded).otherwise(inner))
        quoted = F.regexp_extract(F.to_json(F.array(found)), r"(?s)^\[(.*)\]$", 1)
        is_value = part.startswith('"') & part.endswith('"') & (F.length(part) > 1)
        return F.when(is_value & found.isNotNull(), quoted).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_JSON_PARTS), F.lit(0)), swapped), "")
